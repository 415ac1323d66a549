"""Quality by ordinal regression on graded ratings: one set of weights over hashed text, ordered thresholds.

Grades: 0 a poor text, 1 a good but toxic one, 2 a good one. Features are hashed from the whole text: words,
shapes of words (runs of letters, capitals, digits and each sign) and pairs of shapes, and whether a
word repeats the one before it; a text's counts are rooted and scaled to length 1. P(grade >= k) gives the
expected grade and the tail probability by which texts are kept.

The fit uses at most SAMPLE labelled rows outside the held-out quarter, those with the least digests of
their ids; labels, ids and sources aren't features. Every row is scored over its whole text.

Edges. Null and empty texts have no features and get the probabilities of the thresholds alone; they aren't kept. With
no labels, or no documents that have one, nothing is learned and every text that has words is kept. Of labels that
come again for an id the least grade counts; a row without a label for quality has no grade, and one that is
good without a label for toxicity is grade 2. Rows of documents with an equal id are each scored, and fitted, on their own
text, in an order by id and features that doesn't depend on how they were dealt. Texts of any length are read
whole; other columns are left out, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks, mix, read, utf8
from .linear import Ordinal

DIMS, GRADES, SAMPLE, KEEP = 1 << 13, 3, 6000, 0.5
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 48, 65, 97, 97


def held_out(doc_id: Column) -> Column:
    """The quarter of ids that no fit sees."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def shapes(w: Words) -> np.ndarray:
    """A hash of each word's sequence of letter classes, equal neighbours taken once."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    kind = _CLASS[w.data]
    size = w.end - w.start
    at = np.repeat(w.start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    first = np.zeros(len(w.data), bool)
    first[w.start] = True
    new = first[at] | (kind[at] != kind[at - 1])
    word = np.repeat(np.arange(len(size)), size)[new]
    place = np.cumsum(new)[new] - 1
    place -= place[np.searchsorted(word, np.arange(len(size)))][word]
    terms = mix(kind[at][new] + np.minimum(place, 12).astype(np.uint64) * np.uint64(257), 19)
    return mix(np.add.reduceat(terms, np.searchsorted(word, np.arange(len(size)))), 23)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of all texts: text index, column, value."""
    w = Words(texts)
    s = shapes(w)
    same = np.zeros(len(s), bool)
    pair = np.zeros(len(s), np.uint64)
    if len(s) > 1:
        inner = w.doc[1:] == w.doc[:-1]
        same[1:] = inner & (w.hash[1:] == w.hash[:-1])
        pair[1:] = np.where(inner, mix(s[1:] * np.uint64(3) + s[:-1], 31), np.uint64(0))
    half = np.uint64(DIMS // 2)
    cols = np.concatenate([w.hash % half, half + s % (half // np.uint64(2)), half + half // np.uint64(2) + pair % (half // np.uint64(2) - np.uint64(2)), np.where(same, DIMS - 1, DIMS - 2).astype(np.uint64)]).astype(np.int64)
    cell, count = np.unique(np.tile(w.doc, 4) * DIMS + cols, return_counts=True)
    row, col = cell // DIMS, cell % DIMS
    value = np.sqrt(count)
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=len(texts)))
    return row, col, value / norm[row]


def grades(labels: DataFrame) -> DataFrame:
    """doc_id and grade of the labelled rows that a fit may see; of repeated labels the least counts."""
    good = F.col("quality") >= 1
    grade = F.when(~good, 0).when(F.col("toxic") >= 1, 1).otherwise(2)
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, rated: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Learn from (doc_id, grade): the ``sample`` rows with the least digests, as hashed counts."""
    some = rated.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            texts = utf8(b.column(1))
            row, col, value = features(texts)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(offsets, pa.array(col.astype(np.int16))), pa.ListArray.from_arrays(offsets, pa.array(value.astype(np.float32)))], names=["doc_id", "grade", "cols", "vals"])

    # At most ``sample`` rows are broadcast and come back, each with no more than DIMS columns.
    table = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").mapInArrow(run, "doc_id long, grade int, cols array<short>, vals array<float>").withColumn("tie", F.xxhash64("grade", "cols", "vals")).toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("tie", "ascending")])
    model = Ordinal(DIMS, GRADES)
    if not table.num_rows:
        return model
    grade = table["grade"].to_numpy()
    sizes = np.array([len(x) for x in table["cols"]], np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    flat = lambda c: np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in table[c]])
    return model.fit(row, flat("cols").astype(np.int64), flat("vals").astype(float), grade, np.ones(len(grade)))


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of a grade of 1 or more), top_probability, kept."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(DIMS, GRADES)
        own.weights, own.thresholds = shared.value
        learned = bool(own.weights.any())
        for b in chunks(batches):
            texts = utf8(b.column(1))
            row, col, value = features(texts)
            tails = own.tails(own.latent(row, col, value, len(texts)))
            some = np.bincount(row, minlength=len(texts)) > 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, -1]), pa.array(some & ((tails[:, 0] >= KEEP) | (not learned)))], names=["doc_id", "expected_grade", "tail_probability", "top_probability", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, top_probability double, kept boolean")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of the labels outside the held-out quarter."""
    docs = read(spark, sf_dir, "documents")
    out = score(docs, fit(docs, grades(read(spark, sf_dir, "labels"))))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "expected_grade", "tail_probability", "top_probability", "kept")
