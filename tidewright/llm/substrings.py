"""Repeated passages: winnowed seeds, extension both ways, maximal repeats over a length threshold.

1. Seeds. Of every SPAN consecutive windows of SEED words the one with the least hash (the last one on a
   tie) is an anchor. A passage of LENGTH = SEED + SPAN - 1 words selects the same anchor wherever it
   stands, so no repeat of that length is without a common anchor, though only some 2 / (SPAN + 1) of all
   positions are kept.
2. Join. Anchors that start in two documents or more are repeated; the rest, nearly all, are dropped. Rows are
   dealt once by their anchor to find its least and greatest doc_id. Anchors that are frequent in a bounded sample
   of the rows aren't dealt: their ends are found with partial sums in each map task and sent back to the rows, so
   a passage that a third of all documents hold lands in no single task; see ends().
3. Extend. A repeated seed grows to the left and right to all passages of LENGTH words that selected it.
   Each such passage is compared by its 128-bit content hash with the first document that holds it, found like
   the ends of an anchor.
4. Maximal repeats. Passages found in an earlier document are merged where they overlap or touch; what
   they cover is a maximal repeat of at least LENGTH words, and it is removed.

A document that equals an earlier one word for word is wholly covered by it; such copies leave the
work at once and only their first one is searched. Texts are read by one vectorised pass for digests and anchors,
again for the extension where they have a repeated seed, and once more to be cut; they are shuffled for the
extension, and for the cut only where something is cut, as long as a count proves that list short.

Edges. Null or empty texts have no words and lose none. Fewer than LENGTH words can't repeat a passage. Rows
with an equal doc_id rank alike: a passage repeated only among them isn't in a smaller doc_id. A null
doc_id comes after all others. Each row is judged on its own text: where an id is null, or comes with
different texts, a digest of the text (key) goes with it through all steps. Texts of any length are read whole. An empty
table gives an empty result. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Store, Words, chunks, id_join, mix, read, signed, utf8

SEED = 4
_LAST = 2**63 - 1


def anchors(w: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of every passage of ``length`` words, the start of the seed it selects, and the seed's hash."""
    h, at = w.grams(SEED, 71)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    span = length - SEED + 1
    by_word = np.full(len(w.hash), np.uint64(2**64 - 1))
    by_word[at] = h
    start = np.flatnonzero(w.doc[: max(0, len(w.hash) - length + 1)] == w.doc[length - 1 :])
    best, where = by_word[start], start.copy()
    for j in range(1, span):
        other = by_word[start + j]
        better = other <= best
        best[better], where[better] = other[better], start[better] + j
    return start, where, best


#: Rows of a sample, and how often a key must stand in it to be a hot one. So hot keys are SAMPLED / HOT at most, and any
#: other key holds some HOT / SAMPLED of all rows, a hundred-thousandth, at most; which ones are hot changes no result.
SAMPLED, HOT = 2_000_000, 20


def ends(store: Store, rows: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """``rows`` (of which there are n) with low and high, the least and greatest ord of all rows with their keys.

    Rows are dealt by key, but for those of hot keys, whose ends are so few that they are sent to all tasks."""
    hot = store.write(rows.sample(min(1.0, SAMPLED / max(1, n)), seed=11).groupBy(*keys).count().where(F.col("count") >= HOT).select(*keys))
    every = Window.partitionBy(*keys)
    cold = rows.join(F.broadcast(hot), keys, "left_anti").withColumns({"low": F.min("ord").over(every), "high": F.max("ord").over(every)})
    some = rows.join(F.broadcast(hot), keys, "left_semi")
    known = store.write(some.groupBy(*keys).agg(F.min("ord").alias("low"), F.max("ord").alias("high")))
    return cold.unionByName(rows.join(F.broadcast(known), keys).select(*cold.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, length: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text's remaining words, joined by a space)."""
    store = Store(spark)
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LAST)).alias("ord"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = Words(utf8(b.column(2)))
            x, y = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
            place = np.arange(len(w.hash), dtype=np.uint64) - np.repeat(w.first, w.count).astype(np.uint64)
            np.add.at(x, w.doc, mix(w.hash + mix(place, 5), 7))
            np.add.at(y, w.doc, mix(w.hash + mix(place, 11), 13))
            _, where, h = anchors(w, length)
            fresh = np.ones(len(where), bool)
            fresh[1:] = where[1:] != where[:-1]
            ends = np.cumsum(np.bincount(w.doc[where[fresh]], minlength=b.num_rows))
            seeds = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(signed(h[fresh])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(w.count.astype(np.int64)), pa.array(signed(x)), pa.array(signed(y)), seeds], names=["doc_id", "ord", "own", "n_words", "x", "y", "seeds"])

    own = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    base = docs.select("doc_id", "ord", "text", own.alias("own")).mapInArrow(sketch, "doc_id long, ord long, own binary, n_words long, x long, y long, seeds array<long>")
    base = store.write(base)
    reused = base.where(F.col("ord") != _LAST).groupBy("ord").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    reused = store.write(reused.where("a < b OR c < d").select("ord", F.lit(True).alias("reused")))
    n_reused = reused.limit(BROADCAST_ROWS + 1).count()

    def keyed(df: DataFrame, own: Column) -> DataFrame:
        """With key: empty where the id alone tells a row's text, so that it costs nothing in a shuffle; if reused ids are too many to broadcast, no row's is."""
        if n_reused > BROADCAST_ROWS:
            return df.withColumn("key", own)
        if not n_reused:
            return df.withColumn("key", F.when(F.col("ord") == _LAST, own).otherwise(F.lit(b"")))
        return df.join(F.broadcast(reused), "ord", "left").withColumn("key", F.when((F.col("ord") == _LAST) | F.col("reused"), own).otherwise(F.lit(b""))).drop("reused")

    docs, base_keyed = keyed(docs, own), keyed(base, F.col("own"))
    # Both sides of each join are written tables or short ones, so that a hot key's side can be split.
    firsts = store.write(base.where(F.col("n_words") >= length).groupBy("x", "y", "n_words").agg(F.min("ord").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    few = firsts.limit(BROADCAST_ROWS // 10 + 1).count() <= BROADCAST_ROWS // 10
    same = base_keyed.select("doc_id", "ord", "key", "n_words", "x", "y")
    copied = store.write(same.join(F.broadcast(firsts) if few else firsts, ["x", "y", "n_words"]).where("ord > first").select("doc_id", "ord", "key", "n_words"))
    copies = copied.select("ord", "key").distinct()
    found = id_join(base_keyed.select("ord", "key", "seeds"), copies, ["ord", "key"], "left_anti").select(F.explode("seeds").alias("seed"), "ord", "key")
    n_seeds = base.agg(F.sum(F.size("seeds").cast("long"))).first()[0] or 0
    hits = store.write(ends(store, found, n_seeds, ["seed"]).where("low < high").groupBy("ord", "key").agg(F.collect_set("seed").alias("seeds")))
    store.drop(base, firsts)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = Words(utf8(b.column(1)))
            start, _, h = anchors(w, length)
            lists = b.column(2)
            owner = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            wanted = np.unique(mix(lists.flatten().to_numpy().view(np.uint64) + mix(owner.astype(np.uint64), 3)))
            start = start[np.isin(mix(signed(h).view(np.uint64) + mix(w.doc[start].astype(np.uint64), 3)), wanted)]
            one, two = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
            for j in range(length):
                one += mix(w.hash[start + j], 101 + j)
                two += mix(w.hash[start + j], 201 + j)
            doc = w.doc[start]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(mix(one, 1))), pa.array(signed(mix(two, 2))), pa.array(b.column(0).to_numpy()[doc]), b.column(3).take(pa.array(doc)), pa.array((start - w.first[doc]).astype(np.int32))],
                names=["one", "two", "ord", "key", "at"],
            )

    passages = docs.join(hits, ["ord", "key"]).select("ord", "text", "seeds", "key").mapInArrow(extend, "one long, two long, ord long, key binary, at int")
    passages = store.write(passages)
    store.drop(hits)
    covered = store.write(ends(store, passages, passages.count(), ["one", "two"]).where("ord > low").groupBy("ord", "key").agg(F.collect_set("at").alias("at")))
    store.drop(passages)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            texts = utf8(b.column(1))
            w = Words(texts)
            gone = np.zeros(len(w.hash) + 1, np.int64)
            lists = b.column(2)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            begin = np.repeat(w.first, sizes) + lists.flatten().to_numpy()
            np.add.at(gone, begin, 1)
            np.add.at(gone, begin + length, -1)
            out = np.cumsum(gone)[:-1] > 0
            # Every kept word with the byte after it, which becomes a space; a text's last one goes.
            stay, data = ~out, w.data.copy()
            data[w.end[stay]] = 32
            edge = np.zeros(len(data) + 1, np.int8)
            np.add.at(edge, w.start[stay], 1)
            np.add.at(edge, w.end[stay] + 1, -1)
            joined = data[np.cumsum(edge[:-1]) > 0].tobytes()
            ends = np.cumsum(np.bincount(w.doc[stay], weights=(w.end - w.start)[stay] + 1, minlength=len(texts))).astype(np.int64).tolist()
            kept = [joined[s : max(s, e - 1)] for s, e in zip([0, *ends], ends, strict=False)]
            removed = np.bincount(w.doc, weights=out, minlength=len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w.count.astype(np.int64)), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    schema = "doc_id long, n_words long, n_removed long, kept string"
    whole = copied.select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit("").alias("kept"))
    done = covered.select("ord", "key", F.lit(True).alias("cut")).unionByName(copies.withColumn("cut", F.lit(False)))
    if done.limit(BROADCAST_ROWS // 4 + 1).count() <= BROADCAST_ROWS // 4:
        # Only texts that lose a part are shuffled.
        told = docs.join(F.broadcast(done), ["ord", "key"], "left")
        some = told.where("cut").drop("cut").join(covered, ["ord", "key"]).select("doc_id", "text", "at")
        rest = told.where("cut IS NULL").select("doc_id", "text", F.lit(None).cast("array<int>").alias("at"))
        return some.mapInArrow(cut, schema).unionByName(rest.mapInArrow(cut, schema)).unionByName(whole)
    left = id_join(docs, copies, ["ord", "key"], "left_anti")
    return left.join(covered, ["ord", "key"], "left").select("doc_id", "text", "at").mapInArrow(cut, schema).unionByName(whole)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: passages of 13 words."""
    out = repeated_passages(spark, read(spark, sf_dir, "documents"), 13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS first FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM f WHERE doc_id > first),
x AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT x.doc_id, string_agg(w, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.p = c.p GROUP BY x.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
