"""Byte-level tokenization for the engine's own corpora: word counts, merges, encoding, token streams and windows."""

from __future__ import annotations

import heapq
import json
from base64 import b64encode
from collections.abc import Callable, Iterator
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import SharedSum, put_text, shared_folder
from .order import digest, running_total

#: Fixed value: the pattern that splits a text into words, in Java's dialect. White space is spelled out, as \s is Unicode in the trainer's.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?(?U:[^\s\p{L}\p{N}]+)|(?U:\s+(?!\S))|(?U:\s+)"


def split_words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def word_counts(docs: DataFrame, column: str = "text", pattern: str = WORD) -> DataFrame:
    """word and count over all texts; counts are summed in each task before the shuffle."""
    return docs.select(F.explode(split_words(F.col(column), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where it is one, else the next from 256 on."""
    plain = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class _Words:
    """The letters of all distinct words, with the ways to their neighbours, as narrow arrays: some 8 bytes a letter.

    ``sym`` is a letter's token (``dead`` once it is merged into the one before it), ``after`` and ``before`` how far its
    neighbours in the word are (0 at its ends; the longest word sets the width of these numbers), ``ends`` where words
    end, ``counts`` how often they come, ``at`` the places of each token."""

    def __init__(self, words: pa.Array, counts: np.ndarray, of_byte: np.ndarray, dead: int):
        words = words.cast(pa.large_binary())
        offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        sizes = np.diff(offsets)
        self.kind = kind = np.int32 if len(data) < 2**31 else np.int64
        self.dead, self.counts, self.ends = dead, counts, np.cumsum(sizes).astype(kind)
        self.sym = of_byte.astype(np.min_scalar_type(dead))[data]
        gap = np.min_scalar_type(int(sizes.max(initial=1)))
        self.after, self.before = np.ones(len(data), gap), np.ones(len(data), gap)
        last = self.ends[sizes > 0]
        self.after[last - 1] = 0
        self.before[last - sizes[sizes > 0]] = 0
        parts: dict[int, list[np.ndarray]] = {}
        step = 1 << 22
        for i in range(0, len(data), step):
            order = np.argsort(self.sym[i : i + step], kind="stable")
            tokens, first = np.unique(self.sym[i : i + step][order], return_index=True)
            for t, places in zip(tokens.tolist(), np.split((order + i).astype(kind), first[1:]), strict=True):
                parts.setdefault(t, []).append(places)
        self.at = {t: np.concatenate(p) for t, p in parts.items()}

    def pairs(self, left: np.ndarray) -> tuple[list[int], list[int]]:
        """The pairs that begin at some places (each with one after it), as left << 32 | right, and how often they come."""
        keys = self.sym[left].astype(np.int64) << 32 | self.sym[left + self.after[left]].astype(np.int64)
        names, where = np.unique(keys, return_inverse=True)
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, where, self.counts[np.searchsorted(self.ends, left.astype(self.kind), "right")])
        return names.tolist(), sums.tolist()

    def _around(self, here: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The places before ``here``, and those of ``ends`` that have a place after them."""
        back = self.before[here]
        return np.unique(np.concatenate([(here - back)[back > 0], ends[self.after[ends] > 0]]).astype(self.kind))

    def merge(self, a: int, b: int, new: int) -> np.ndarray:
        """Find every a before b, from the left, for which put() will put ``new``; the places of the pairs that go."""
        here = self.at.get(a, np.zeros(0, self.kind))
        here = self.at[a] = here[self.sym[here] == a]
        here = here[self.after[here] > 0]
        here = np.sort(here[self.sym[here + self.after[here]] == b])
        if a == b and len(here):
            # In a run of equal tokens every other place.
            start = np.concatenate([[True], here[:-1] + self.after[here[:-1]] != here[1:]])
            run = np.maximum.accumulate(np.where(start, np.arange(len(here)), 0))
            here = here[(np.arange(len(here)) - run) % 2 == 0]
        self.here, self.second, self.new = here, (here + self.after[here]).astype(self.kind), new
        return self._around(here, np.concatenate([here, self.second]))

    def put(self) -> np.ndarray:
        """Do what merge() found; the places of the pairs that come."""
        here, second = self.here, self.second
        more = self.after[second]
        way = np.where(more > 0, self.after[here] + more, 0).astype(more.dtype)
        self.sym[here], self.sym[second], self.after[here] = self.new, self.dead, way
        self.before[(here + way)[more > 0]] = way[more > 0]
        self.at[self.new] = np.sort(np.concatenate([self.at.get(self.new, here[:0]), here]))
        return self._around(here, here)


#: Letters of distinct words that a training task holds, about, where there are tasks enough.
TASK_LETTERS = 1 << 24


def _independent(heap: list[tuple[int, int]], pairs: dict[int, int], ids: dict[str, int], names: list[str], room: int) -> list[tuple[int, int, int]]:
    """The merges that come next and can't influence each other, as (left, right, new); they leave the heap, and new tokens get their ids.

    Pairs are taken by falling count, then by left and right id, until one begins with a right or ends with a left part
    of one taken before. What a merge of a and b makes more frequent, (x, ab) or (ab, y), is at most as frequent as
    (x, a) or (b, y) was, which isn't taken and so comes after all that are; and of equal counts a pair with a new id comes last. So
    one by one they would be taken in the same order. That doesn't hold for a pair of equal tokens, nor for a token that
    exists already: such a pair is the last of its batch."""
    batch: list[tuple[int, int, int]] = []
    lefts, rights = set(), set()
    while heap and len(batch) < room:
        n, p = heap[0]
        now = pairs.get(p, 0)
        if now != -n:
            heapq.heappop(heap)
            if now > 0:
                heapq.heappush(heap, (-now, p))
            continue
        a, b = p >> 32, p & 0xFFFFFFFF
        if a in rights or b in lefts:
            break
        heapq.heappop(heap)
        token = names[a] + names[b]
        known = token in ids
        new = ids.setdefault(token, len(names))
        if not known:
            names.append(token)
        batch.append((a, b, new))
        if known or a == b:
            break
        lefts.add(a)
        rights.add(b)
    return batch


def _learn(words: pa.Array, counts: np.ndarray, names: list[str], vocab_size: int, over_all: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> list[tuple[str, str]]:
    """The merges, from a part of the words; every part does the same, and ``over_all`` adds up their keys and numbers."""
    letters = byte_letters()
    ids = {t: i for i, t in enumerate(names)}
    state = _Words(words, counts, np.array([ids[c] for c in letters]), max(vocab_size, len(names)))
    pairs: dict[int, int] = {}
    heap: list[tuple[int, int]] = []

    def add(own: dict[int, int]) -> None:
        """Add what the counts of all parts have changed by."""
        keys, changes = over_all(np.fromiter(own.keys(), np.int64, len(own)), np.fromiter(own.values(), np.int64, len(own)))
        for q, m in zip(keys.tolist(), changes.tolist(), strict=True):
            pairs[q] = pairs.get(q, 0) + m
            if not pairs[q]:
                del pairs[q]
            elif m > 0:
                heapq.heappush(heap, (-pairs[q], q))

    def gather(into: dict[int, int], left: np.ndarray, sign: int) -> None:
        for q, m in zip(*state.pairs(left), strict=True):
            into[q] = into.get(q, 0) + sign * m

    first: dict[int, int] = {}
    step = 1 << 20
    for i in range(0, len(state.sym), step):
        gather(first, i + np.flatnonzero(state.after[i : i + step] > 0), 1)
    add(first)
    merges = []
    while len(names) < vocab_size and (batch := _independent(heap, pairs, ids, names, vocab_size - len(names))):
        changed: dict[int, int] = {}
        for a, b, new in batch:
            merges.append((names[a], names[b]))
            gather(changed, state.merge(a, b, new), -1)
            gather(changed, state.put(), 1)
        add(changed)
    return merges


def merges(counted: DataFrame, vocab_size: int = 8192, special: tuple[str, ...] = ("<|endoftext|>",), tasks: int | None = None) -> list[tuple[str, str]]:
    """Left and right of the byte-pair merges, in order, of a table of distinct words (word, count), which is read twice.

    The most frequent pair is merged first, of equal ones that with the least left id, then right id; special tokens
    come first, then all bytes. Words are dealt evenly to tasks, and a task keeps its words' letters for the whole training, some 8 bytes
    for each. The tasks are a barrier stage: in each round all take the same batch of merges that can't influence each other, apply
    it to their words and add up, through the shared folder, by how much pairs' counts have changed. So every task knows all pairs' counts,
    whose number is bounded by the vocabulary's square and not by the corpus; nothing of it passes the driver. Losing an
    executor repeats the stage from the table. A session needs as many free cores as the stage has tasks; ``tasks`` sets another
    number than one for each TASK_LETTERS letters, at most the session's cores."""
    spark = counted.sparkSession
    names = [*special, *sorted(byte_letters())]
    if tasks is None:
        size = counted.agg(F.coalesce(F.sum(F.octet_length("word").cast("long")), F.lit(0))).first()[0]
        tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-size // TASK_LETTERS)))
    folder = f"{shared_folder(spark)}/rounds"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        held = [(b.column(0), b.column(1).to_numpy()) for b in batches]
        words = pa.concat_arrays([w for w, _ in held]) if held else pa.array([], pa.string())
        counts = np.concatenate([np.zeros(0, np.int64), *[n for _, n in held]])
        # Task 0 names a folder of this attempt.
        attempt = context.allGather(uuid4().hex)[0]
        total = SharedSum(f"{folder}/{attempt}", context.partitionId(), len(context.getTaskInfos()))
        found = _learn(words, counts, list(names), vocab_size, total.add)
        if context.partitionId() == 0 and found:
            left, right = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())], names=["rank", "left", "right"])

    rows = counted.select("word", F.col("count").cast("long").alias("count")).repartition(tasks)
    found = rows.mapInArrow(run, "rank long, left string, right string", barrier=True).collect()
    return [(r.left, r.right) for r in sorted(found, key=lambda r: r["rank"])]


def train(docs: DataFrame, vocab_size: int = 8192, special: tuple[str, ...] = ("<|endoftext|>",), max_words: int | None = None) -> dict:
    """Tokenizer of byte-pair merges, learned by merges(): {"vocab": token -> id, "merges": [[left, right], ...]}.

    Distinct words are written in the shared folder (all of them, unless a caller sets ``max_words``, the most frequent ones); only
    the merges come to the driver."""
    spark = docs.sparkSession
    counted = word_counts(docs)
    if max_words is not None:
        counted = counted.orderBy(F.desc("count"), "word").limit(max_words)
    path = f"{shared_folder(spark)}/words"
    counted.write.option("compression", "zstd").parquet(path)
    learned = merges(spark.read.schema(counted.schema).parquet(path), vocab_size, special)
    ids = {t: i for i, t in enumerate([*special, *sorted(byte_letters())])}
    for left, right in learned:
        ids.setdefault(left + right, len(ids))
    return {"vocab": ids, "merges": [list(m) for m in learned]}


def save(spark: SparkSession, tokenizer: dict, path: str, special: tuple[str, ...] = ("<|endoftext|>",)) -> None:
    """The tokenizer as a file of the tokenizers library, in any file system that Spark knows."""
    added = [{"id": tokenizer["vocab"][s], "content": s, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for s in special]
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, **tokenizer}
    put_text(spark, path, json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level, "model": model}, ensure_ascii=False))


def check_vocabulary(tokenizer: dict, end: str = "<|endoftext|>") -> int:
    """The end token's id; an error if there is none, or if ids don't fit 16 bits."""
    if len(tokenizer["vocab"]) >= 1 << 16:
        raise ValueError("vocabulary must have fewer than 65536 tokens")
    if end not in tokenizer["vocab"]:
        raise ValueError(f"vocabulary has no {end}")
    return tokenizer["vocab"][end]


#: Parts of windows up to which their places are sent to all tasks.
MET = 500_000
#: Words that a Python process remembers, and bytes of words that are looked up at once.
REMEMBERED, CHUNK_BYTES = 600_000, 4 << 20
#: Bytes of a word up to which its least rank is found by a scan.
SHORT = 48
_NONE = 1 << 62


class _Numbers(dict):
    """Numbers of words in the order in which they were first asked for; ``new`` lists the ones that came last."""

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


class _Encoder:
    """Ids of words by a tokenizer's merges: of all pairs of neighbours that of the least rank is joined first, of equal ones the leftmost.

    Words are numbered as they come; word n has ids[first[n] : first[n + 1]]."""

    def __init__(self, tokenizer: dict):
        ids = tokenizer["vocab"]
        self.of_byte = [ids[c] for c in byte_letters()]
        # A pair of ids -> rank << 32 | id of both joined; ranks begin with 1.
        self.joined = {ids[a] << 32 | ids[b]: rank << 32 | ids[a + b] for rank, (a, b) in reversed([*enumerate(tokenizer["merges"], 1)])}
        self.known, self.ids, self.first = _Numbers(), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.known.new = []

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers; their ids are there when this returns. The older half of the memory goes when it is full, before it is asked."""
        if len(self.known) > REMEMBERED or len(self.ids) > 8 * REMEMBERED:
            half = len(self.known) // 2
            cut = self.first[half]
            self.ids, self.first = self.ids[cut:], self.first[half:] - cut
            self.known = _Numbers((w, n - half) for w, n in self.known.items() if n >= half)
            self.known.new = []
        found = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if new := self.known.new:
            self.known.new = []
            lists = [self.merged([self.of_byte[b] for b in w.encode()]) for w in new]
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), np.int32)])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
        return found

    def rows(self, lists: pa.ListArray, end: int | None) -> pa.ListArray:
        """The ids of each row's words, with ``end`` after those of a row that has any."""
        coded = lists.flatten().dictionary_encode()
        which = self.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        first = self.first[which]
        size = self.first[which + 1] - first
        at = np.cumsum(size)
        flat = self.ids[np.repeat(first - at + size, size) + np.arange(at[-1] if len(at) else 0)]
        words = np.cumsum([n or 0 for n in lists.value_lengths().to_pylist()])
        ends = np.concatenate([[0], at])[words]
        if end is not None:
            some = np.diff(ends, prepend=0) > 0
            flat = np.insert(flat, ends[some], end)
            ends = ends + np.cumsum(some)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, pa.int32()))

    def merged(self, parts: list[int]) -> list[int]:
        """Ids of a word's parts (bytes). A short word keeps its pairs' ranks beside it and looks for the least one at each step."""
        if len(parts) > SHORT:
            return self.merged_long(parts)
        joined = self.joined.get
        ranks = [joined(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < _NONE:
            i = ranks.index(least)
            parts[i : i + 2] = [least & 0xFFFFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = joined(parts[i - 1] << 32 | parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = joined(parts[i] << 32 | parts[i + 1], _NONE)
        return parts

    def merged_long(self, parts: list[int]) -> list[int]:
        """Parts are a list linked both ways, and pairs wait in a heap, so a word of n bytes takes n log n steps.

        A pair that has changed since it was put there is passed over."""
        joined, n = self.joined.get, len(parts)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(found, i) for i in range(n - 1) if (found := joined(parts[i] << 32 | parts[i + 1]))]
        heapq.heapify(waiting)
        while waiting:
            found, i = heapq.heappop(waiting)
            j = following[i]
            if parts[i] < 0 or j >= n or joined(parts[i] << 32 | parts[j]) != found:
                continue
            parts[i], parts[j] = found & 0xFFFFFFFF, -1
            k = following[i] = following[j]
            if k < n:
                previous[k] = i
                if more := joined(parts[i] << 32 | parts[k]):
                    heapq.heappush(waiting, (more, i))
            h = previous[i]
            if h >= 0 and (more := joined(parts[h] << 32 | parts[i])):
                heapq.heappush(waiting, (more, h))
        return [p for p in parts if p >= 0]


_KEPT: list[tuple[int, _Encoder]] = []


def _encoder(tokenizer: dict) -> _Encoder:
    """The encoder of this Python process, which keeps its memory of words from task to task."""
    key = hash((tuple(map(tuple, tokenizer["merges"])), tuple(tokenizer["vocab"].items())))
    if not _KEPT or _KEPT[0][0] != key:
        _KEPT[:] = [(key, _Encoder(tokenizer))]
    return _KEPT[0][1]


def encode(docs: DataFrame, tokenizer: dict, end: bool = True, column: str = "text") -> DataFrame:
    """The rows with ids (in place of a column of that name); with ``end`` a text that has any ids ends with the end token.

    A Python process encodes a word once, as long as it remembers it; a null text is the empty one."""
    docs = docs.drop("ids", "_words")
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    eot = check_vocabulary(tokenizer) if end else None
    split = docs.withColumn("_words", split_words(F.col(column)))
    schema = split.schema
    at = len(schema) - 1
    names = [*[f.name for f in schema][:-1], "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            step = max(1, int(batch.num_rows * CHUNK_BYTES / max(batch.nbytes, 1)))
            for i in range(0, batch.num_rows, step):
                b = batch.slice(i, step)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], encoder.rows(b.column(at), eot)], names=names)

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return split.mapInArrow(run, StructType([*schema.fields[:-1], StructField("ids", ArrayType(IntegerType()))]))


def decode(rows: DataFrame, tokenizer: dict, column: str = "ids") -> DataFrame:
    """The rows with ``decoded``: each id's bytes joined, invalid UTF-8 replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(tokenizer)
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        back = {c: b for b, c in enumerate(byte_letters())}
        pieces = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in shared.value["vocab"].items()}
        return pa.array([None if x is None else b"".join(pieces[i] for i in x).decode("utf-8", "replace") for x in ids.to_pylist()], pa.string())

    return rows.withColumn("decoded", text(column))


def token_totals(encoded: DataFrame) -> DataFrame:
    """split and n_tokens of (split, ids)."""
    return encoded.groupBy("split").agg(F.sum(F.size("ids")).cast("long").alias("n_tokens"))


def windows(encoded: DataFrame, key: str, block: int, n: int, seed: int = 1337) -> DataFrame:
    """n windows of the flat token stream (rows in the order of ``key``), with replacement: draw, start, x, y.

    Starts are drawn by digest from [0, total - block - 1). Where rows lie in the stream is found from their sizes alone, and so is
    which rows a window meets: both are dealt into cells of the stream, and tables of numbers are joined. Then each row that was met gives its part of a
    window, so only these parts are shuffled. Rows with equal keys stand in the order of a digest of their ids. A stream without room is an error."""
    spark = encoded.sparkSession
    some = encoded.where(F.size("ids") > 0).select(F.col(key).alias("_key"), F.xxhash64("ids").alias("_tie"), "ids")
    # Wholly equal rows are one, which comes several times.
    sizes = some.groupBy("_key", "_tie", F.size("ids").cast("long").alias("_n")).agg(F.count("*").alias("_times")).withColumn("_span", F.col("_n") * F.col("_times"))
    folder = shared_folder(spark)
    # Numbers only, so that the ids are read twice: for their sizes, and for the parts that windows take.
    sizes.write.parquet(f"{folder}/sizes")
    running_total(spark.read.schema(sizes.schema).parquet(f"{folder}/sizes"), "_key", "_span", "_from", ("_tie", "_n")).write.parquet(f"{folder}/offsets")
    offsets = spark.read.parquet(f"{folder}/offsets")
    total = offsets.agg(F.coalesce(F.sum("_span"), F.lit(0))).first()[0]
    room = total - block - 1
    if room <= 0:
        raise ValueError(f"{total} tokens are too few for windows of {block}")
    cell = max(4 * block, 4096)
    draws = spark.range(n).select(F.col("id").alias("draw")).withColumn("start", digest(F.col("draw"), seed) % room)
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor(b / cell)))
    near = offsets.withColumn("cell", cells(F.col("_from"), F.col("_from") + F.col("_span") - 1))
    want = draws.withColumn("cell", cells(F.col("start"), F.col("start") + block))
    first = F.greatest("start", F.col("_from"), F.col("cell") * cell)
    last = F.least(F.col("start") + block + 1, F.col("_from") + F.col("_span"), (F.col("cell") + 1) * cell)
    met = want.join(near, "cell").withColumn("_a", first).withColumn("_b", last).where("_a < _b").select("draw", "start", "_key", "_tie", "_n", "_a", "_b", ((F.col("_a") - F.col("_from")) % F.col("_n")).cast("int").alias("_at"))
    few = met.limit(MET + 1).count() <= MET
    rows = some.withColumnsRenamed({"_key": "_k", "_tie": "_t"}).join(F.broadcast(met) if few else met, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_t") == F.col("_tie")))
    size = (F.col("_b") - F.col("_a")).cast("int")
    again = F.flatten(F.array_repeat("ids", F.ceil((F.col("_at") + size) / F.col("_n")).cast("int")))
    part = F.when(F.col("_at") + size <= F.col("_n"), F.slice("ids", F.col("_at") + 1, size)).otherwise(F.slice(again, F.col("_at") + 1, size))
    pieces = rows.select("draw", "start", F.struct("_a", part.alias("ids")).alias("p"))
    flat = pieces.groupBy("draw", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_set("p")), lambda p: p["ids"])).alias("ids"))
    return flat.select("draw", "start", F.slice("ids", 1, block).alias("x"), F.slice("ids", 2, block).alias("y"))


def fingerprint(files: DataFrame) -> DataFrame:
    """path and sha256 of a binaryFile table."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def verify(found: str, wanted: str | None) -> None:
    """An error if a fingerprint isn't the wanted one; old records have none, which passes."""
    if wanted is not None and found != wanted:
        raise ValueError(f"tokenizer fingerprint {found[:12]} isn't {wanted[:12]}")


def ranks(tokenizer: dict, special: tuple[str, ...] = ("<|endoftext|>",)) -> list[tuple[str, int]]:
    """(base64 of a token's bytes, id) in the order of ids, without special tokens."""
    back = {c: b for b, c in enumerate(byte_letters())}
    return [(b64encode(bytes(back[c] for c in t)).decode(), i) for t, i in sorted(tokenizer["vocab"].items(), key=lambda x: x[1]) if t not in special]


def vocabulary_size(tokenizer: dict | None, configured: int) -> int:
    """The tokenizer's size where there is one, else the configured one."""
    return len(tokenizer["vocab"]) if tokenizer else configured
