"""Interaction of filters: what each order of five filters keeps, removes and costs.

A text is looked at once: the filters that it fails are a mask of five bits. Documents are counted by part and mask, 32 counts for
each part, and the subset-zeta transform turns these into the survivors of every subset of filters: what fails nothing in a
subset is the sum over all masks within its complement. A step of an order is then the difference of two neighbouring
subsets, for all documents as for good and toxic ones, and a Shapley sum is a weighted sum of such differences.

Whether an equal text has a smaller doc_id needs no group of copies: the least doc_id of each digest is found by partial minima, and
a row passes if it holds it. Rows meet that table by digest and doc_id, so copies are spread.

Edges. A null text is the empty one, a null lang the part "". A null doc_id is neither smaller nor greater than another: such a row
never fails E and makes no other fail; nor has it a label. Rows with the same text and doc_id pass or fail E together. Several
labels of a doc_id count as their greatest. Other columns are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, id_join, let, read, utf8

FILTERS = "ABCDE"
_UPPER = bytes(range(65, 91))
_SIGNS = b"#$%&*|"
_CONTINUING = bytes(range(0x80, 0xC0))


def fails(text: bytes) -> int:
    """The bits of A to D that a text in UTF-8 fails. bytes.split() cuts at the white space that the contract names."""
    words = text.split()
    size = len(text) - len(text.translate(None, _CONTINUING)) if not text.isascii() else 0
    points = len(text) - size
    upper = len(text) - len(text.translate(None, _UPPER))
    signs = len(text.translate(None, _SIGNS)) < len(text)
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 3 * points) << 2 | signs << 3


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (A to D) and the text's 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(fails(t), blake2b(t, digest_size=16).digest()) for t in utf8(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m for m, _ in found], pa.int32()), pa.array([h for _, h in found], pa.binary())], names=["doc_id", "part", "mask", "digest"])

    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def with_copies(rows: DataFrame) -> DataFrame:
    """The rows of masks() with the bit of E: a smaller doc_id has the same text."""
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    return rows.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(F.col("doc_id").isNotNull() & F.col("_first").isNull(), 16).otherwise(0)).drop("_first", "digest")


def counted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, and by mask (0 to 31) the documents n, those of quality good, and those that are toxic."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    by_mask = id_join(rows, known, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    held = by_mask.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("m"))
    every = lambda c: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.coalesce(F.col("m")[i][c], F.lit(0)))
    return held.select("part", *[every(c).alias(c) for c in ("n", "good", "toxic")])


def zeta(counts: Column) -> Column:
    """For each subset of the five filters, the sum over all masks within it."""
    bits = F.array(*[F.lit(1 << k) for k in range(5)])
    return F.aggregate(bits, counts, lambda acc, bit: F.transform(acc, lambda x, i: F.when(i.bitwiseAND(bit) != 0, x + F.get(acc, i - bit)).otherwise(x)))


def survivors(counts: Column) -> Column:
    """For each subset of filters, the documents that fail none of it."""
    return let(zeta(counts), lambda z: F.transform(z, lambda _, i: F.get(z, 31 - i)))


def _shapley(alive: Column, bit: Column) -> Column:
    """What a filter removes in all 120 orders: s filters come before it in s! (4 - s)! of them."""
    ways = F.array(*map(F.lit, (24, 6, 4, 6, 24)))
    others = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda s: s.bitwiseAND(bit) == 0)
    return F.aggregate(others, F.lit(0).cast("long"), lambda acc, s: acc + F.get(ways, F.bit_count(s)) * (F.get(alive, s) - F.get(alive, s + bit)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley: 600 rows for each part."""
    store = Store(docs.sparkSession)
    rows = counted(with_copies(store.write(masks(docs))), labels)
    # 32 counts a part; written, so that the steps are made from them and not from the documents.
    sets = store.write(rows.select("part", "n", *[survivors(F.col(c)).alias(f"_{c}") for c in ("n", "good", "toxic")]))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = sets.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    bit = lambda i: F.get(F.array(*[F.lit(1 << k) for k in range(5)]), F.instr(F.lit(FILTERS), F.substring("filter_order", i, F.lit(1))) - 1)
    before = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda acc, i: acc + F.when(i < F.col("step"), bit(i)).otherwise(0))
    steps = steps.withColumn("_bit", bit(F.col("step"))).withColumn("_set", before)
    lost = lambda c: F.get(c, F.col("_set")) - F.get(c, F.col("_set") + F.col("_bit"))
    failing = F.get("_n", F.lit(0)) - F.get("_n", F.col("_bit"))
    return steps.select(
        "part", "filter_order", "step", F.get("_n", F.col("_set") + F.col("_bit")).alias("kept"), lost("_n").alias("removed"), (failing - lost("_n")).alias("redundant"),
        F.get("n", F.col("_bit")).alias("unique_fails"), lost("_good").alias("good_lost"), lost("_toxic").alias("toxic_lost"), _shapley(F.col("_n"), F.col("_bit")).alias("shapley"),
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents and labels."""
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, part, map(['A', 'B', 'C', 'D', 'E'], [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
      regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)]) AS bad FROM d),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, quality, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: bad[k]) AS bad FROM f LEFT JOIN l USING (doc_id)),
y AS (SELECT part, bad, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM x GROUP BY ALL),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT part, array_to_string(o, '') AS filter_order, step::INT AS step, o[step] AS k,
      sum(CASE WHEN NOT list_has_any(bad, o[1:step]) THEN n ELSE 0 END)::BIGINT AS kept,
      sum(CASE WHEN list_contains(bad, o[step]) AND NOT list_has_any(bad, o[1:step - 1]) THEN n ELSE 0 END)::BIGINT AS removed,
      sum(CASE WHEN list_contains(bad, o[step]) AND list_has_any(bad, o[1:step - 1]) THEN n ELSE 0 END)::BIGINT AS redundant,
      sum(CASE WHEN bad = [o[step]] THEN n ELSE 0 END)::BIGINT AS unique_fails,
      sum(CASE WHEN list_contains(bad, o[step]) AND NOT list_has_any(bad, o[1:step - 1]) THEN good ELSE 0 END)::BIGINT AS good_lost,
      sum(CASE WHEN list_contains(bad, o[step]) AND NOT list_has_any(bad, o[1:step - 1]) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM y, s GROUP BY part, o, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, k)::BIGINT AS shapley FROM r
"""
