"""Shared pieces of the training-data operators: stage storage, let-binding, word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import hadoop, shared_folder

#: White space that separates words, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
#: Bytes of text that the vectorised kernels handle at once (a single longer text is handled alone).
CHUNK_BYTES = 2 << 20
#: Rows up to which an id table may be broadcast: 2 million longs are 16 MB of payload.
BROADCAST_ROWS = 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder; only Spark opens the path, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once per row however often the body uses it.

    Catalyst may inline a projected expression into a lambda and evaluate it for every element;
    binding it as the element of a one-element array rules that out."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What ``combine`` (a sum, a maximum) makes of an array up to each place, in n log n steps.

    A fold that appends to its result copies it at each step; here each of log n rounds takes in what
    stands 1, 2, 4, ... places before."""

    def rounds(a: Column) -> Column:
        steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda d: d < F.size(a))
        return F.aggregate(steps, a, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, combine(x, F.get(acc, i - d))).otherwise(x)))

    return let(values, rounds)


def words(text: Column) -> Column:
    """The words of a text, in order: runs of anything but SPACE. Null has no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


class Store:
    """Tables that cut lineage, as Parquet in a folder that the cluster shares; see shared_folder().

    Losing an executor loses nothing: readers go back to the files. Tables are deleted by drop(), and what a
    result still reads when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, shared_folder(spark)
        self.n = 0
        self.tables: dict[int, tuple[str, DataFrame]] = {}

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df`` now and return the written table."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        for t in tables:
            if known := self.tables.pop(id(t), None):
                p, fs = hadoop(self.spark, known[0])
                fs.delete(p, True)


def id_join(df: DataFrame, ids: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """Join with a table of ids: broadcast when a count proves it small, shuffled otherwise."""
    n = ids.limit(BROADCAST_ROWS + 1).count()
    return df.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, on, how)


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is empty."""
    return [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices with about ``most`` bytes each, so that the kernels' memory doesn't follow the batch size."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


# Multipliers of the word and shingle hashes: any odd numbers with well-spread bits will do.
_SEED = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << 10) - 1, np.uint64(0x9E3779B97F4A7C15))]), dtype=np.uint64)]
_GRAM = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    """Powers of the byte multiplier, for words of up to n bytes."""
    while len(_POWERS[0]) < n:
        p = _POWERS[0]
        _POWERS[0] = np.concatenate([p, p * (p[-1] * np.uint64(0x9E3779B97F4A7C15))])
    return _POWERS[0]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x + np.uint64((salt * 0xD1B54A32D192ED03) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of many texts at once: byte ranges, owning text and 64-bit hashes."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.n = len(texts)
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        if lower:
            data = _LOWER[data]
        self.data = data
        inner = ~_IS_SPACE[data]
        edge = np.diff(inner.view(np.int8), prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.count = np.diff(np.searchsorted(self.start, ends), prepend=0)
        self.doc = np.repeat(np.arange(self.n), self.count)
        self.first = np.cumsum(self.count) - self.count
        if len(self.start):
            at = np.flatnonzero(inner)
            size = self.end - self.start
            where = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            self.hash = mix(np.add.reduceat(_BYTE[data[at]] * _powers(int(size.max()))[where], np.cumsum(size) - size))
        else:
            self.hash = np.zeros(0, np.uint64)

    def grams(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows within one text, and the index of each one's first word."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h += self.hash[at + j] * _GRAM[j]
        return mix(h, salt), at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
