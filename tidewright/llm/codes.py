"""Product codes of vectors: integer codebooks learned part by part, and the search for the nearest entry.

A vector's components become whole numbers, and the vector eight parts. A part's nearest entry is found by partial distances:
dimensions are taken in the order of falling variance over the codebook's entries, each adds to the distances of the entries still in
question, and an entry is dropped for those parts whose distance has strictly passed their best complete one. The
first complete distance is that of the entry nearest in the first dimension taken, so most others are dropped early. All of it
runs over arrays of many parts at once, with masks in place of branches.

Vectors are written once as packed numbers. A round reads them, and each task sends back its sums by entry and place, which Spark
adds up: 16 x width numbers reach the driver, however many vectors there are. Sums are whole numbers, so a
result doesn't depend on how rows were dealt.

Edges. A vector that is null, or holds null or other than finite numbers, goes; so does one of another width than most of those left (of
equal counts, the greater width), for its distance to them isn't defined, and an empty one. A width that eight doesn't divide
is filled up with zeros. A null vec_id comes after all others; of equal vec_ids the order is that of their packed
bytes, and each row gets its own code. With fewer than 16 vectors there are as many entries. An empty table gives an
empty result. Other columns are left out, whatever their names. Numbers too large for 64-bit distances are handled as Python's
own; an error or sum beyond what a long or 38 digits hold is an error, not a wrong number.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from hashlib import sha256
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Store, read

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors that the search handles at once.
CHUNK = 1 << 14
#: Whole numbers up to here keep the squared distances of up to 4096 dimensions within 63 bits.
_NARROW = 1 << 24


def whole(x: np.ndarray) -> np.ndarray:
    """floor(4096 x) of doubles, as 64-bit numbers where distances fit these, else as Python's."""
    scaled = np.floor(x * SCALE) if not len(x) or np.abs(x).max() < 2**900 else np.array([np.inf])
    if not len(x) or np.abs(scaled).max() < _NARROW and x.shape[-1] <= 4096:
        return scaled.astype(np.int64)
    return np.array([floor(Fraction(v) * SCALE) for v in x.reshape(-1).tolist()], object).reshape(x.shape)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's nearest entry (of equal ones the lower) and its squared distance; see the module's text."""
    if x.dtype != book.dtype:
        x, book = x.astype(object), book.astype(object)
    spread = len(book) * (book * book).sum(axis=0) - book.sum(axis=0) ** 2
    order = sorted(range(book.shape[1]), key=lambda k: (-spread[k], k))
    x, book = np.ascontiguousarray(x[:, order].T), book[:, order]
    index = np.abs(x[0][None, :] - book[:, 0][:, None]).argmin(axis=0) if len(order) else np.zeros(x.shape[1], np.int64)
    guess = index.copy()
    best = ((x - book[guess].T) ** 2).sum(axis=0)
    for e in range(len(book)):
        alive = np.flatnonzero(guess != e)
        total = np.zeros(len(alive), x.dtype)
        for k in range(len(order)):
            total = total + (x[k, alive] - book[e, k]) ** 2
            keep = (total <= best[alive]).astype(bool)
            if not keep.all():
                alive, total = alive[keep], total[keep]
            if not len(alive):
                break
        # What is left is complete and no further than the best one; an equal one counts by its index.
        won = ((total < best[alive]) | (e < index[alive])).astype(bool)
        index[alive[won]], best[alive[won]] = e, total[won]
    return index, best


def packed(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v: the vectors that are kept, as little-endian doubles filled up to a multiple of PARTS."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = vectors.select("vec_id", "label", v.alias("embedding")).where(ok).where(F.size("embedding") > 0)
    widths = kept.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = widths[0].width if widths else PARTS
    size = -(-width // PARTS) * PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.zeros((b.num_rows, size), "<f8")
            x[:, :width] = b.column(2).flatten().to_numpy().reshape(b.num_rows, width)
            rows = pa.Array.from_buffers(pa.binary(8 * size), b.num_rows, [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), rows], names=["vec_id", "label", "v"])

    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.where(F.size("embedding") == width).mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, v binary")


def _blocks(b: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their vectors as whole numbers."""
    for i in range(0, b.num_rows, CHUNK):
        part = b.slice(i, CHUNK)
        yield part, whole(np.frombuffer(b"".join(part.column(at).to_pylist()), "<f8").reshape(part.num_rows, -1))


def _books(spark: SparkSession, rows: DataFrame) -> list[np.ndarray]:
    """The first codebooks: each part of the rows that come first."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()
    return np.split(whole(np.array([np.frombuffer(r.v, "<f8") for r in first])), PARTS, axis=1) if first else []


def _sums(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: the floor of the mean of an entry's parts, or the entry where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(b.shape, object) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for _, x in _blocks(batch, 0):
                for p, part in enumerate(np.split(x, PARTS, axis=1)):
                    index, _ = nearest(part, books[p])
                    order = np.argsort(index, kind="stable")
                    used, start, n = np.unique(index[order], return_index=True, return_counts=True)
                    total[p][used] = total[p][used] + np.add.reduceat(part[order], start, axis=0).astype(object)
                    count[p][used] += n
        out = [(p, e, k, int(total[p][e, k]), int(count[p][e])) for p in range(PARTS) for e in np.flatnonzero(count[p]).tolist() for k in range(total[p].shape[1])]
        if out:
            part, entry, place, sums, n = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()), pa.array(map(Decimal, sums), pa.decimal128(38, 0)), pa.array(n, pa.int64())], names=["part", "entry", "place", "sum", "n"])

    found = rows.select("v").mapInArrow(run, "part int, entry int, place int, sum decimal(38,0), n long")
    # ENTRIES x width rows at most.
    moved = [b.copy() for b in books]
    for r in found.groupBy("part", "entry", "place").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).collect():
        moved[r.part][r.entry, r.place] = int(r["sum"]) // r.n
    return moved


def compress(vectors: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code (two hex digits a part) and error of the kept rows of (vec_id, embedding, label), and the final codebooks.

    The rows are a written table."""
    spark = vectors.sparkSession
    store = Store(spark)
    rows = store.write(packed(vectors))
    books = _books(spark, rows)
    for _ in range(ROUNDS if books else 0):
        books = _sums(rows, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, x in _blocks(batch, 2):
                found = [nearest(part, books[p]) for p, part in enumerate(np.split(x, PARTS, axis=1))]
                codes = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
                error = sum(d for _, d in found)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(error.tolist(), pa.int64())], names=["vec_id", "label", "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = store.write(rows.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"))
    store.drop(rows)
    return coded, books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components as decimal numbers by part, entry and place."""
    return sha256(",".join(str(c) for b in books for c in b.reshape(-1).tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """The rows with the sum of errors over their label. Sums are made in each task before they are shuffled, and meet the rows by
    broadcast if a count shows that there are few of them; of many, a frequent label is one that Spark's adaptive join splits."""
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    few = sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all embeddings."""
    coded, books = compress(read(spark, sf_dir, "embeddings"))
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Parts as lists, a round as two tables: each part's nearest entry, and the entries' new places."""
    distance = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    near = f"(SELECT p.vec_id, p.label, p.part, p.v, min([{distance}, c.entry]) AS best FROM p JOIN {{0}} c USING (part) GROUP BY ALL)"
    steps = [
        "k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS (SELECT vec_id, label, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS v FROM k, range({PARTS}) r(part))",
        f"c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p JOIN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id))",
    ]
    for i in range(ROUNDS):
        means = f"SELECT part, entry, list(m ORDER BY place) AS v FROM (SELECT part, best[2] AS entry, place, floor(sum(v[place]) / count(*))::BIGINT AS m FROM a{i}, range(1, (SELECT max(len(v)) FROM p) + 1) r(place) GROUP BY ALL) GROUP BY ALL"
        steps += [f"a{i} AS MATERIALIZED {near.format(f'c{i}')}", f"m{i} AS ({means})", f"c{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (part, entry))"]
    steps += [
        f"a AS {near.format(f'c{ROUNDS}')}",
        "f AS (SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a GROUP BY ALL)",
        f"s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM f, s"


SQL = _sql()
