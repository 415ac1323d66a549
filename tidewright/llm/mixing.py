"""Mixing sources to target weights with hash-threshold histograms.

Targets. Sources in the order of their code points (null last) weigh WEIGHTS, repeated. They share the
sum of all sizes by weight, but none takes more than CAP times its own size: with the sources sorted by
the level at which they reach their cap, the level that uses up the total is found with running sums.

Selection. A target of q times a source's size takes every document floor(q) times and the rest from
documents whose hash is under a threshold. The threshold is found without sorting documents: sizes
are summed by source and the top bits of the hash, the bucket that holds the rest's end is located, and
only that bucket is split by the next bits, until a single hash value is left, which is taken if that
comes nearer. Budgets nest: a larger target takes what a smaller one takes, and more.

Places and running sums over sources come from ranges of them with offsets, so that no task sees all
sources where they are many (hosts, say); sums over sources and the level are single rows.

Edges. A document's hash depends on its doc_id and text only, so reruns and other partitionings agree, and
repeated rows are taken or left together. Null and empty texts have size 0, texts of any length are counted whole. A null
doc_id is an id like others. A null source is a source of its own. Sources without words have target 0. An empty
table gives an empty mix. sample() keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Store, read, words

WEIGHTS, CAP = (5, 2, 1), 3
#: Bits of the hash, and how many each histogram uses.
BITS, STEP = 48, 12


def ticket(seed: int = 1) -> Column:
    """A document's place in its source: BITS bits of a digest of its id and text."""
    key = F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return F.conv(F.substr(F.md5(key.cast("binary")), F.lit(1), F.lit(BITS // 4)), 16, 10).cast("long")


#: Sources in a range that one task orders.
RANGE = 200_000


def _before(store: Store, rows: DataFrame, order: list[Column], n: int, **sums: Column) -> DataFrame:
    """``rows``, with the sum of each of ``sums`` over the rows before each one in ``order``.

    The rows are dealt into n ranges, summed in each, and the sums of the ranges before are added."""
    rows = store.write(rows.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))
    ranges = rows.groupBy("range").agg(*[F.sum(c).alias(f"{k}_all") for k, c in sums.items()])
    lower = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    offsets = ranges.select("range", *[F.coalesce(F.sum(f"{k}_all").over(lower), F.lit(0)).alias(f"{k}_below") for k in sums])
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(F.broadcast(offsets), "range")
    return placed.withColumns({k: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"{k}_below") for k, c in sums.items()}).drop("range", *[f"{k}_below" for k in sums])


def targets(store: Store, sizes: DataFrame) -> DataFrame:
    """source, source_size, target of a table (source, source_size) with a row for each source."""
    n = 1 + sizes.count() // RANGE
    name = F.col("source").asc_nulls_last()
    x = _before(store, sizes, [name], n, place=F.lit(1))
    x = x.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS)).cast("int") + 1)).withColumn("full", CAP * F.col("source_size") / F.col("weight"))
    x = store.write(_before(store, x, [F.col("full").asc(), name], n, sizes_before=F.col("source_size"), weights_before=F.col("weight")))
    total = x.agg(F.sum("source_size").alias("sizes"), F.sum("weight").alias("weights")).first()
    level = (F.lit(total.sizes) - CAP * F.col("sizes_before")) / (F.lit(total.weights) - F.col("weights_before"))
    # The first source that the level doesn't fill, in that order, sets the level of all that aren't full.
    first = x.withColumn("level", level).where("level <= full").agg(F.min_by("level", F.struct("full", F.coalesce("source", F.lit("\U0010ffff")))).alias("level")).first()
    return x.select("source", "source_size", F.least(CAP * F.col("source_size").cast("double"), F.lit(first.level).cast("double") * F.col("weight")).alias("target"))


def plan(store: Store, tickets: DataFrame) -> DataFrame:
    """source, source_size, target, times, limit, take_limit for each source of (source, size, h)."""
    sizes = tickets.groupBy("source").agg(F.sum("size").alias("source_size"))
    now = targets(store, store.write(sizes)).withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    now = store.write(now.withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")))
    for shift in range(BITS - STEP, -1, -STEP):
        cell = F.shiftright("h", shift)
        inside = tickets.select("source", "size", cell.alias("cell"), F.shiftright(cell, STEP).alias("above"))
        edge = now.select(F.col("source").alias("own"), "rest", "prefix")
        small = edge.limit(BROADCAST_ROWS // 10 + 1).count() <= BROADCAST_ROWS // 10
        inside = inside.join(F.broadcast(edge) if small else edge, F.col("source").eqNullSafe(F.col("own")) & (F.col("above") == F.col("prefix")))
        cells = inside.groupBy("source", "cell").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("cell"))
        ends = cells.withColumn("upto", upto).where("upto > rest").groupBy("source").agg(F.min_by(F.struct("cell", "size", (F.col("rest") - (F.col("upto") - F.col("size"))).alias("rest")), "cell").alias("e"))
        ends = ends.select(F.col("source").alias("own"), "e.*").withColumnRenamed("rest", "left")
        # A source without such a cell has no words: nothing of it can be taken.
        then = now.join(ends, F.col("source").eqNullSafe(F.col("own")), "left")
        then = then.select("source", "source_size", "target", "times", F.coalesce("left", F.lit(0.0)).alias("rest"), F.coalesce("cell", F.shiftleft("prefix", STEP)).alias("prefix"), F.coalesce("size", F.lit(0)).alias("last_size"))
        now = store.write(then)
    return now.select("source", "source_size", "target", "times", F.col("prefix").alias("limit"), (2 * F.col("rest") > F.col("last_size")).alias("take_limit"))


def tickets(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), ticket().alias("h"))


def planned(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """Rows with a source and h, and how often the mix takes each: copies."""
    by_source = by_source.withColumnRenamed("source", "own")
    small = by_source.limit(BROADCAST_ROWS // 10 + 1).count() <= BROADCAST_ROWS // 10
    out = rows.join(F.broadcast(by_source) if small else by_source, F.col("source").eqNullSafe(F.col("own")), "left")
    again = (F.col("h") < F.col("limit")) | ((F.col("h") == F.col("limit")) & F.col("take_limit"))
    return out.withColumn("copies", F.col("times") + again.cast("long")).drop("own")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of ``docs`` (doc_id, text, source, and more)."""
    store = Store(docs.sparkSession)
    known = store.write(tickets(docs))
    out = planned(known, plan(store, known))
    return out.withColumn("taken", F.col("size") * F.col("copies")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def sample(docs: DataFrame) -> DataFrame:
    """The rows of the mix with all columns of ``docs``, each as often as it is taken."""
    store, own = Store(docs.sparkSession), docs.columns
    known = store.write(tickets(docs).select("source", "size", "h"))
    rows = docs.select(F.struct(*own).alias("row"), "source", ticket().alias("h"))
    out = planned(rows, plan(store, known)).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth")).select("row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
           ('0x' || substr(md5(concat_ws(':', '1', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 12))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
f AS (SELECT *, 3 * source_size / weight AS fill FROM w),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lev FROM f
      WINDOW b AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT lev FROM l WHERE lev <= fill ORDER BY fill, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(3 * source_size::DOUBLE, (SELECT lev FROM v) * weight) AS target FROM f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
c AS (SELECT source, h, sum(size) AS cell FROM d GROUP BY source, h),
u AS (SELECT c.source, h, cell, sum(cell) OVER (PARTITION BY c.source ORDER BY h) AS upto, target - times * source_size AS rest FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source),
z AS (SELECT source, h, (upto <= rest OR (upto - cell <= rest AND 2 * (rest - (upto - cell)) > cell)) AS again FROM u)
SELECT d.doc_id, d.size, q.source_size, q.target, d.size * (q.times + CASE WHEN z.again THEN 1 ELSE 0 END) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN z ON d.source IS NOT DISTINCT FROM z.source AND d.h = z.h
"""
