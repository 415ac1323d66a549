"""Context-triggered piecewise fingerprints, compared by edit distance at compatible block sizes.

A rolling hash over WINDOW bytes ends a piece wherever it equals -1 modulo the block size, so an edit
moves no boundary but those near it. A piece gives one letter, from a hash of its bytes. The block size
is LEAST times a power of two, by length alone: about 32 to 64 pieces. A fingerprint is
``block:letters:letters at twice the block``; runs of one letter are cut to three, which is what a text of
one repeated unit would be made of. The letters of whole texts are kept, however many.

Fingerprints compare at a block size that both have. Likeness is 2 * common / (letters of both), where common
is the longest common subsequence (an edit distance of insertions and deletions); it is 0 without a common
run of RUN letters (of half the shorter one, if that is less), which chance alone doesn't give.
Equal fingerprints have likeness 1, two empty ones too.

Edges. Null is the empty text. The document after the last one is the first; with one document it is itself.
Order is by doc_id, descending, a null id last; rows with equal ids stand in the order of their texts. An empty
table gives an empty result. A long text is hashed in blocks, whole; a range of documents is read as a
stream, two texts at a time. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .common import chunks, read

WINDOW, LEAST, PIECES, RUN = 7, 3, 64, 4
#: Bytes that the rolling hash handles at once.
BLOCK = 1 << 20
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def rolling(data: np.ndarray) -> np.ndarray:
    """The 32-bit rolling hash that ends at each byte: sum, weighted sum and shifted xor of the window."""
    n = len(data)
    x = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)])
    plain, weighted, shifted = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for back in range(WINDOW):
        part = x[WINDOW - 1 - back : WINDOW - 1 - back + n]
        plain += part
        weighted += part * np.uint32(WINDOW - back)
        shifted ^= part << np.uint32(5 * back)
    return plain + weighted + shifted


def _letters(text: bytes, cuts: list[int]) -> str:
    out, at, digest = [], 0, xxhash.xxh32_intdigest
    for cut in cuts:
        out.append(_LETTERS[digest(text[at:cut]) & 63])
        at = cut
        if len(out) > 3 and out[-1] == out[-2] == out[-3] == out[-4]:
            out.pop()
    return "".join(out)


def fingerprint(text: bytes) -> str:
    """``block:letters:letters`` of a text in UTF-8."""
    n, block = len(text), LEAST
    while block * PIECES < n:
        block *= 2
    one, two = [], []
    for start in range(0, n, BLOCK):
        lead = min(start, WINDOW - 1)
        h = rolling(np.frombuffer(text, np.uint8, min(BLOCK, n - start) + lead, start - lead))[lead:]
        at = np.flatnonzero(h % np.uint32(block) == block - 1)
        one += (at + start + 1).tolist()
        two += (at[h[at] % np.uint32(2 * block) == 2 * block - 1] + start + 1).tolist()
    for cuts in (one, two):
        if n and (not cuts or cuts[-1] != n):
            cuts.append(n)
    return f"{block}:{_letters(text, one)}:{_letters(text, two)}"


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    run = max(1, min(RUN, min(len(a), len(b)) // 2))
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in runs for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * common(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1 for two fingerprints; 0 if their block sizes aren't compatible."""
    if a == b:
        return 1.0
    block_a, one_a, two_a = a.split(":")
    block_b, one_b, two_b = b.split(":")
    if block_a == block_b:
        return max(_alike(one_a, one_b), _alike(two_a, two_b))
    if int(block_a) == 2 * int(block_b):
        return _alike(one_a, two_b)
    if int(block_b) == 2 * int(block_a):
        return _alike(two_a, one_b)
    return 0.0


#: Bytes of text in a range of doc_id, which one task reads: LEAST_BYTES in up to FEW ranges, RANGE_BYTES at most in more.
LEAST_BYTES, FEW, RANGE_BYTES = 8 << 20, 4096, 64 << 20
#: Cells for each range.
FINER = 4
#: Stands for a null doc_id.
_NULL = -(2**63)


def range_ends(cells: list[tuple[int, int]], most: int) -> list[int]:
    """The greatest ids of ranges of about ``most`` bytes, made of neighbouring cells (greatest id, bytes) in the order of their ids; a cell that has more is a range of its own."""
    ends, held = [], 0
    for i, (high, size) in enumerate(cells):
        held += size
        if i + 1 == len(cells) or held + cells[i + 1][1] > most:
            ends.append(high)
            held = 0
    return sorted(set(ends))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, doc_id, text, last) dealt into ranges of doc_id, each range with the row that follows it.

    There are as many ranges as the texts' bytes need, one for each task. Their ends come from a sort of the ids and sizes alone into FINER times as many cells, of
    which the driver sees two numbers each and joins neighbours to ranges of like bytes, so that long texts that stand together are parted; the one shuffle of texts is by range. Sorted in descending order, a row's next document is the row
    after it: the extra row, of which ``last`` is true, closes each range, so no order over all
    rows is needed and no range waits for another."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.coalesce("doc_id", F.lit(_NULL)).alias("ord"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = int(1 + max(size // RANGE_BYTES, min(size // LEAST_BYTES, FEW)))
    sized = docs.select("ord", F.octet_length("text").cast("long").alias("bytes")).repartitionByRange(FINER * n, "ord")
    cells = sorted((r.high, r.bytes) for r in sized.select(F.spark_partition_id().alias("p"), "ord", "bytes").groupBy("p").agg(F.max("ord").alias("high"), F.sum("bytes").alias("bytes")).collect())
    ends = range_ends(cells, -(-size // n))
    shared = sc.broadcast(np.array(ends, np.int64))

    @arrow_udf("array<int>")
    def to(ords: pa.Array) -> pa.Array:
        """A row's range, and the range that it closes: the greatest id of each range follows the least one of the range above."""
        ords, ends = ords.to_numpy(zero_copy_only=False), shared.value
        part = np.searchsorted(ends, ords)
        also = np.where(ends[part] == ords, (part + 1) % len(ends), -1)
        both = np.stack([part, also], axis=1).reshape(-1)
        sizes = 1 + (also >= 0)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(both[both >= 0], pa.int32()))

    dealt = docs.select("ord", "doc_id", "text", F.posexplode(to("ord")).alias("place", "part")).withColumn("last", F.col("place") == 1)
    return dealt.repartitionById(max(1, len(ends)), F.col("part")).sortWithinPartitions("part", "last", F.desc("ord"), "text").select("part", "doc_id", "text", "last")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in chunks(batches):
            out = []
            for part, doc_id, last, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = (part, doc_id, text, fingerprint(text.encode()))
                if before and before[0] == part:
                    cut = len(before[2]) // 3
                    edited = (before[2][: len(before[2]) - cut] + text[:cut]).encode()
                    print_edited = fingerprint(edited)
                    out.append((before[1], len(before[2]), sha256(edited).hexdigest(), before[3], print_edited, likeness(before[3], print_edited), likeness(before[3], own[3])))
                before = None if last else own
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=_COLUMNS)

    return with_next(docs).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in zip(_COLUMNS, ("long", "long", "string", "string", "string", "double", "double"), strict=True)))


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return fingerprints(read(spark, sf_dir, "documents"))
