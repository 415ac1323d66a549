"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges.

1. A document's shingles are hashed once. One permutation is cut into BINS bins and each keeps its
   least hash; an empty bin borrows from the first filled bin of its own random order of all bins
   (optimal densification), so a short text gives full signatures too.
2. Documents with equal shingle sets become one class, told by a 128-bit sum over the set, which its
   smallest doc_id stands for. Only class representatives go on, so a group of copies costs one row.
3. BANDS bands of ROWS bins give bucket keys. In a bucket each member is linked to a hub only, never
   to all others: n rows, not n * n. The hub is the smallest id; then, in buckets that still hold several
   components, the member with most links and a few random ones. Stars can miss a link between two
   members that are both too far from every hub, so documents of buckets that still hold several
   components get an exact search by their rarest shingles, for pairs of different components only.
4. Every candidate link is confirmed on both whole shingle sets, 100 * both >= PERCENT * either.
5. Alternating stars turn confirmed links into components.

With 42 bands of 6 bins a pair at a similarity of exactly 0.8 shares no bucket with probability
(1 - 0.8 ** 6) ** 42, under 3e-6, and less above it.

Edges. Null and empty texts, and texts without words, have no shingles: they are linked with nothing and kept. A row is
told by its doc_id. Where ids are null or come again, a row is told by a 64-bit digest of its id and text
instead: rows with an equal id and text are one document, others are judged each on its own text, whatever the
order of the rows; component_id is then the smallest id of a row reachable (null where none has one), and of
rows without an id the one whose text has the least digest is kept, if no row with an id is. Rows are
returned as often as they came. Texts of any length are read whole. An empty table gives an empty result.
Other columns, whatever their names, are left out by near_duplicates() and kept by one_of_each().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .common import Store, Words, chunks, id_join, mix, read, signed, utf8
from .components import components

BANDS, ROWS = 42, 6
BINS = BANDS * ROWS
#: Random hubs of a bucket in the second stars.
HUBS = 2
_RANDOM = np.random.Generator(np.random.PCG64(5))
#: For each bin, all bins in a random order of its own, itself first.
_ORDER = np.stack([np.concatenate([[i], (p := _RANDOM.permutation(BINS))[p != i]]) for i in range(BINS)])
_BAND = _RANDOM.integers(1, 2**63, BINS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts: (text index, hash), sorted, and the number for each text.

    A text with fewer than k words has its whole word sequence as its one shingle."""
    w = Words(texts, lower=True)
    h, at = w.grams(k)
    doc = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        s = np.full(len(short), 0x5851F42D4C957F2D, np.uint64)
        for j in range(k - 1):
            more = w.count[short] > j
            s[more] = mix(s[more] + w.hash[w.first[short[more]] + j], 3)
        h, doc = np.concatenate([h, mix(s, 9)]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    return doc, h, np.bincount(doc, minlength=len(texts))


def signatures(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """n x BINS one-permutation signatures with optimal densification; rows of empty sets hold no values of use."""
    m = mix(h, 17)
    empty = np.uint64(2**64 - 1)
    sig = np.full(n * BINS, empty, np.uint64)
    cell = doc * BINS + ((m >> np.uint64(40)) * np.uint64(BINS) >> np.uint64(24)).astype(np.int64)
    np.minimum.at(sig, cell, mix(h, 29) >> np.uint64(1))
    sig = sig.reshape(n, BINS)
    full, filled = sig.copy(), sig != empty
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for t in range(1, BINS):
        if not len(row):
            break
        there = _ORDER[col, t]
        hit = filled[row, there]
        full[row[hit], col[hit]] = sig[row[hit], there[hit]]
        row, col = row[~hit], col[~hit]
    return full


def band_keys(sig: np.ndarray) -> np.ndarray:
    """n x BANDS bucket keys; the band is part of its key."""
    return mix((mix(sig, 41) * _BAND).reshape(len(sig), BANDS, ROWS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64), 43)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (a 128-bit sum over the set) and keys, the bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = utf8(batch.column(1))
            doc, h, count = shingles(texts, k)
            keys = band_keys(signatures(doc, h, len(texts))).reshape(-1)
            a, b = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            np.add.at(a, doc, mix(h, 53))
            np.add.at(b, doc, mix(h, 59))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(signed(a)), pa.array(signed(b)), pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), pa.array(signed(keys)))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "keys"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>")


def similar(k: int, percent: int):
    """An Arrow function of two texts: whether their whole shingle sets are alike enough."""

    @arrow_udf("boolean")
    def check(a: pa.Array, b: pa.Array) -> pa.Array:
        a, b = utf8(a), utf8(b)
        out, i = [], 0
        while i < len(a):
            j, size = i, 0
            while j < len(a) and (j == i or size + len(a[j]) + len(b[j]) <= 2 << 20):
                size += len(a[j]) + len(b[j])
                j += 1
            doc, h, count = shingles(a[i:j] + b[i:j], k)
            pair, n = doc % (j - i), j - i
            order = np.lexsort((h, pair))
            h, pair = h[order], pair[order]
            both = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=n)
            out.append(100 * both >= percent * (count[:n] + count[n:] - both))
            i = j
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return check


def rare_pairs(store: Store, docs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``docs`` (a, root) that may be alike enough and have different roots; none is missed.

    Shingles are put in one order, rare ones first. Two sets that overlap by the least allowed share
    one of their first shingles, so early that enough can follow it in both (prefix and position filters).
    What copies of one text have in common is frequent, so it comes late in that order and is hardly
    ever compared; a member that lost its links to edits of its own is found by what it shares with few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            n = b.num_rows
            doc, h, count = shingles(utf8(b.column(2)), k)
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(signed(h)))], names=["a", "root", "n", "h"])

    share = percent / 100
    # Floating point must never raise a bound.
    overlap = lambda n, m: F.ceil((n + m) * (share / (1 + share)) - 1e-6)
    least = lambda n: F.ceil(n * share - 1e-6)
    sets = docs.join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "root", "text").mapInArrow(run, "a long, root long, n long, h array<long>")
    token = store.write(sets.select("a", "root", "n", F.explode("h").alias("h")))
    # Both sides of each join by shingle are written tables, so that a hot shingle's side can be split.
    often = store.write(token.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"))
    place = F.row_number().over(Window.partitionBy("a").orderBy("df", "h"))
    first = token.join(often, "h", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("i", place).where(F.col("i") <= F.col("n") - least(F.col("n")) + 1)
    first = store.write(first.where("df > 1").select("h", "a", "root", "n", "i"))
    # Positions that no partner with this shingle is small enough for go.
    smallest = store.write(first.groupBy("h").agg(F.min("n").alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h", "m"))
    first = first.join(smallest, "h").where(F.col("i") <= F.col("n") - overlap(F.col("n"), F.greatest(F.col("m"), least(F.col("n")))) + 1).drop("m")
    # Sets that are alike enough differ in size by 1 / share at most, so in this measure by one at most.
    first = store.write(first.withColumn("s", F.floor(F.log(F.col("n")) / math.log(1 / share) + 1e-9) if share < 1 else F.col("n")))
    # All but the largest component at each shingle are compared with the others of like size there.
    mains = first.groupBy("h", "root").agg(F.count("*").alias("size")).groupBy("h").agg(F.max(F.struct("size", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    mains = store.write(mains.select("h", F.col("most.root").alias("main")))
    small = first.join(mains, "h").where("root <> main").select("h", F.col("a").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("m"), F.col("i").alias("j"), F.explode(F.array(F.col("s") - 1, "s", F.col("s") + 1)).alias("s"))
    small = store.write(small)
    size = overlap(F.col("n"), F.col("m"))
    near = (F.col("root") != F.col("root_b")) & (F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) + 1 >= size) & (F.least("n", "m") >= size)
    pairs = first.join(small, ["h", "s"]).where(near)
    return store.write(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _reused(docs: DataFrame) -> bool:
    """Whether an id is null or comes again."""
    return bool(docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count())


def _units(spark: SparkSession, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``docs`` with n_shingles and component, told by a digest of id and text; root_id and own break ties in it."""
    rows = docs.withColumn("_unit", F.xxhash64("doc_id", "text")).withColumn("_own", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    found = _linked(spark, rows.select(F.col("_unit").alias("doc_id"), "text").dropDuplicates(["doc_id"]), k, percent)
    return rows.join(found.select(F.col("doc_id").alias("_unit"), F.col("n_shingles").alias("_n_shingles"), F.col("component_id").alias("_component")), "_unit")


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id, text, and more).

    component_id is the smallest doc_id that links reach, the document's own where none do."""
    docs = docs.select("doc_id", "text")
    if not _reused(docs):
        return _linked(spark, docs, k, percent)
    rows = _units(spark, docs, k, percent)
    least = rows.groupBy("_component").agg(F.min("doc_id").alias("_id"), F.min("_own").alias("_first"))
    rows = rows.join(least, "_component").withColumn("component_id", F.when(F.col("_n_shingles") > 0, F.col("_id")).otherwise(F.col("doc_id")))
    alone = F.col("_n_shingles") == 0
    kept = F.when(F.col("doc_id").isNotNull(), F.col("doc_id") == F.col("component_id")).otherwise(F.col("component_id").isNull() & (alone | (F.col("_own") == F.col("_first"))))
    return rows.select("doc_id", F.col("_n_shingles").alias("n_shingles"), "component_id", kept.alias("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, and more) without near-duplicates: of each group the one with the smallest id.

    Where ids are null or come again, the row with the smallest id stays (null after all), then by a fixed order of
    its content, so that one row of a group stays. Texts without shingles are like no other; of such rows
    with an equal id and text one stays, and all that have no id."""
    if not _reused(docs):
        gone = _linked(spark, docs, k, percent).where(~F.col("kept")).select("doc_id")
        return id_join(docs, gone, "doc_id", "left_anti")
    own = docs.columns
    rows = _units(spark, docs, k, percent)
    alone = F.col("doc_id").isNull() & (F.col("_n_shingles") == 0)
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "_own", F.to_json(F.struct(*[c for c in own if c != "text"])).alias("rest"))
    first = rows.where(~alone).groupBy("_component").agg(F.min_by(F.struct(*own), order).alias("row"))
    return first.select("row.*").unionByName(rows.where(alone).select(*own))


def _linked(spark: SparkSession, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """near_duplicates() of rows with ids of their own."""
    store, alike = Store(spark), similar(k, percent)
    base = store.write(sketch(docs, k))
    real = base.where("n_shingles > 0")
    classes = store.write(real.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    # A representative's keys: one row for each class and band.
    reps = classes.select(F.col("rep").alias("doc_id"))
    keys = real.join(reps, "doc_id", "left_semi").select("doc_id", F.explode("keys").alias("key"))
    shared = store.write(keys.groupBy("key").agg(F.count("*").alias("size"), F.min("doc_id").alias("hub")).where("size > 1"))
    bucket = store.write(keys.join(shared, "key"))
    member = bucket.select("key", "hub", F.col("doc_id").alias("a"))
    texts = docs.select("doc_id", "text")
    texts = store.write(id_join(texts, bucket.select("doc_id").distinct(), "doc_id"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        return store.write(pairs.join(one, "a").join(two, "b").where(alike("text_a", "text_b")).select("a", "b"))

    links = confirmed(member.where("a <> hub").select("a", F.col("hub").alias("b")).distinct())
    roots = components(store, links)

    def rooted(rows: DataFrame) -> DataFrame:
        found = roots.select(F.col("node").alias("a"), "root")
        return rows.join(found, "a", "left").withColumn("root", F.coalesce("root", "a"))

    def contracted(new: DataFrame) -> DataFrame:
        """The components with more links: they join whole components, so only their roots are looked at."""
        ends = rooted(rooted(new).select("root", F.col("b").alias("a")).withColumnRenamed("root", "other")).select(F.col("other").alias("a"), F.col("root").alias("b"))
        merged = components(store, ends)
        both = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        return store.write(both.unionByName(merged.join(roots, "node", "left_anti")))

    # Second stars, in buckets that hold several components: the member with most links, and random ones.
    degree = links.select(F.explode(F.array("a", "b")).alias("a")).groupBy("a").agg(F.count("*").alias("links"))
    known = store.write(rooted(member).join(degree, "a", "left").select("key", "a", "root", F.coalesce("links", F.lit(0)).alias("links")))
    hub = lambda order: F.max(F.struct(order, "a", "root"))
    hubs = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), hub("links").alias("h0"), *[hub(F.xxhash64("a", F.lit(i))).alias(f"h{i}") for i in range(1, HUBS + 1)]).where("low < high")
    hubs = hubs.select("key", F.explode(F.array(*[F.struct(F.col(f"h{i}.a").alias("b"), F.col(f"h{i}.root").alias("r")) for i in range(HUBS + 1)])).alias("hub")).select("key", "hub.*")
    pairs = known.join(hubs, "key").where("root <> r").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    roots = contracted(confirmed(pairs))
    # The rest, exactly: documents in buckets that still hold several components.
    open_keys = rooted(member).groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    open_docs = store.write(rooted(member.join(open_keys, "key", "left_semi").select("a").distinct()))
    roots = contracted(confirmed(rare_pairs(store, open_docs, texts, k, percent)))
    found = classes.join(roots, F.col("rep") == F.col("node"), "left").select("set_a", "set_b", F.coalesce("root", "rep").alias("component_id"))
    out = base.select("doc_id", "n_shingles", "set_a", "set_b").join(found, ["set_a", "set_b"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = store.write(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
    store.drop(*[t for _, t in store.tables.values() if t is not out])
    return out


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: shingles of four words, a similarity of 0.8."""
    return near_duplicates(spark, read(spark, sf_dir, "documents"), 4, 80)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
