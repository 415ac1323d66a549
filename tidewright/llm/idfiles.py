"""Token ids as compressed files: Re-Pair grammars over blocks of ids, with random access to each document.

Texts are encoded by the tokenizers library and written in the order of doc_id as one stream of ids, each document closed by an
end id. Rows are dealt into ranges of doc_id; a task streams its range into a file of blocks, and holds a block at a time.
A block is compressed on its own: in each round frequent pairs of neighbours are replaced by new symbols, of two that overlap the
more frequent one, until few are left. Its rules and the lengths of what each symbol stands for are stored with it, so that any
range of ids is decoded from the symbols that overlap it.

File, all numbers little-endian:

* blocks, one after the other: n_ids, n_terminals, n_rules, n_symbols and width (five uint32); the terminals' ids (uint32); the rules,
  two symbols each (uint32); the lengths of the rules (uint32); the symbols (``width`` bytes each). Symbol s below n_terminals
  stands for a terminal, s + n_terminals for rule s, which names smaller symbols only;
* the documents: doc_ids (int64), whether each is known (uint8), their numbers of ids (int64);
* the blocks' places in the file (int64) and first ids (int64);
* n_docs, n_blocks, n_ids and the place of the documents (four int64), and the eight letters of MAGIC.

Edges. Null is the empty text: its ids are the end id alone. A null doc_id comes first; rows with an equal doc_id stand in the
order of a digest of their texts, so that only wholly equal rows can change places. Repeated rows are encoded each alone. An empty table has no
files. A document may be longer than a block. Other columns are left out, whatever their names. A task that runs again writes
its file anew and takes its place under the same name, so lost executors cost their tasks only.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import arrow_path
from .bpe import vocabulary
from .common import Store, chunks, read, utf8

END = 1
#: Ids in a block, and the least count of a pair that a rule replaces.
BLOCK, LEAST = 1 << 18, 4
#: A file's bytes of text, and rows, about.
FILE_BYTES, FILE_ROWS = 32 << 20, 1 << 20
#: Words that a task remembers, and new ones that are encoded together.
REMEMBERED, TOGETHER = 1_000_000, 512
#: A letter that is one token of its own between spaces.
MARK, BETWEEN = b"\x01", b" \x01 "
#: ASCII signs, which the vocabulary's pattern takes together.
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
MAGIC = b"TWREPAIR"
_BITS = 17


class _Numbers(dict):
    """Numbers of words in the order in which they were first asked for; ``new`` lists those that came last."""

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


class Encoder:
    """Ids of texts by the tokenizers library, which sees every word once.

    A word is what stands between ASCII white space. This vocabulary's normalizer composes, replaces white space and lowers letters one
    by one, none of which reaches over a space, and its pattern takes no white space into a token, so the ids of a text are those
    of its words. Strings of special tokens hold no white space either. New words are encoded together, with a mark between them, or
    alone if they hold the mark. Word 0 is the end of a text."""

    def __init__(self, content: str, end: int = END):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_str(content), end
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        (self.mark,) = self._ids(MARK)
        self._forget()

    def _ids(self, text: bytes) -> list[int]:
        return self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids

    def _forget(self) -> None:
        self.known = _Numbers({b"": 0})
        self.known.new = []
        self.signs: dict[bytes, list[int]] = {}
        # Word w has the ids from first[w] to first[w + 1].
        self.ids, self.first = np.array([self.end], np.int32), np.array([0, 1], np.int64)

    def _plain(self, word: bytes) -> list[int] | None:
        """Ids of a word of ASCII letters and the signs after them, by the library's model alone, as its pattern cuts it there; None for another."""
        stem = word.rstrip(SIGNS)
        if not stem.isalpha():
            return None
        tokenize = self.tokenizer.model.tokenize
        ids = [t.id for t in tokenize(stem.lower().decode())]
        if len(stem) < len(word):
            signs = word[len(stem) :]
            tail = self.signs.get(signs)
            if tail is None:
                tail = [t.id for t in tokenize(signs.decode())]
                if len(signs) < 4:
                    self.signs[signs] = tail
            ids += tail
        return ids

    def _learn(self) -> None:
        """Ids of the words that are new."""
        words, self.known.new = self.known.new, []
        found = [self._plain(w) for w in words]
        rest = [i for i, ids in enumerate(found) if ids is None]
        for at in range(0, len(rest), TOGETHER):
            some = rest[at : at + TOGETHER]
            if any(MARK in words[i] for i in some):
                for i in some:
                    found[i] = self._ids(words[i])
                continue
            flat = np.array(self._ids(BETWEEN.join(words[i] for i in some)), np.int32)
            marks = np.flatnonzero(flat == self.mark).tolist()
            for i, a, b in zip(some, [-1, *marks], [*marks, len(flat)], strict=True):
                found[i] = flat[a + 1 : b].tolist()
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text in UTF-8 has with its end, and all these ids."""
        if len(self.known) > REMEMBERED or len(self.ids) > 8 * REMEMBERED:
            self._forget()
        number, which = self.known.__getitem__, []
        for text in texts:
            # The vocabulary lowers letters itself, after composing them, which ASCII doesn't take part in; special tokens have a case.
            words = (text.lower() if text.isascii() and b"<|" not in text else text).split()
            words.append(b"")
            which.append(np.fromiter(map(number, words), np.int64, len(words)))
        if self.known.new:
            self._learn()
        counts = [len(w) for w in which]
        which = np.concatenate([*which, np.zeros(0, np.int64)])
        first = self.first[which]
        size = self.first[which + 1] - first
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        return np.diff(ends[np.cumsum(counts) - 1], prepend=0) if counts else np.zeros(0, np.int64), flat


_KEPT: list[tuple[str, int, Encoder]] = []


def encoder(content: str, end: int) -> Encoder:
    """The encoder of this Python process, which keeps its memory of words from task to task."""
    if not _KEPT or _KEPT[0][:2] != (content, end):
        # One thread a task; Spark deals out the work.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _KEPT[:] = [(content, end, Encoder(content, end))]
    return _KEPT[0][2]


def re_pair(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terminals, rules (two symbols each), lengths of the rules and symbols of a block of ids.

    In a round each pair of neighbours has the count of its hash bucket, which decides between pairs that overlap: one is taken
    if it beats those on both sides, and every other one of a run of equal pairs. Of the pairs in a bucket one is replaced, if it was taken
    LEAST times or more; the others get another bucket in the next round. Rounds end when one shortens the block by less than
    a fiftieth."""
    terminals, seq = np.unique(ids, return_inverse=True)
    seq, n_symbols = seq.astype(np.uint32), len(terminals)
    lengths = np.ones(n_symbols, np.int64)
    rules, turn, places = [np.zeros((0, 2), np.uint32)], 0, np.arange(1 << _BITS)
    while len(seq) > 2:
        turn += 1
        left, right = seq[:-1], seq[1:]
        bucket = ((left * np.uint32(0x9E3779B1 + 2 * turn) + (right ^ np.uint32(turn)) * np.uint32(0x85EBCA77)) >> np.uint32(32 - _BITS)).astype(np.intp)
        count = np.bincount(bucket, minlength=1 << _BITS)
        # Buckets with equal counts are told apart by their number; rare ones are out.
        rank = np.where(count >= LEAST, count << _BITS | places, 0)[bucket]
        falls, same = rank[:-1] > rank[1:], rank[:-1] == rank[1:]
        take = rank > 0
        take[1:] &= ~falls
        take[:-1] &= falls | same
        runs = np.flatnonzero(same & take[1:] & take[:-1])
        if len(runs):
            # Within a run of equal ranks every other place, from its first.
            fresh = np.concatenate([[True], np.diff(runs) > 1])
            first = runs[np.maximum.accumulate(np.where(fresh, np.arange(len(runs)), 0))]
            take[runs + 1] = (runs + 1 - first) % 2 == 0
        at = np.flatnonzero(take)
        of = bucket[at]
        chosen = np.zeros(1 << _BITS, np.int64)
        chosen[of] = at
        one = chosen[of]
        fits = (left[at] == left[one]) & (right[at] == right[one])
        at, of = at[fits], of[fits]
        often = np.flatnonzero(np.bincount(of, minlength=1 << _BITS) >= LEAST)
        name = np.zeros(1 << _BITS, np.uint32)
        name[often] = np.arange(n_symbols, n_symbols + len(often))
        own = name[of]
        at, own = at[own > 0], own[own > 0]
        if 50 * len(at) < len(seq):
            break
        pair = chosen[often]
        new = np.stack([left[pair], right[pair]], axis=1)
        rules.append(new)
        lengths = np.concatenate([lengths, lengths[new[:, 0]] + lengths[new[:, 1]]])
        n_symbols += len(often)
        seq[at] = own
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
    return terminals, np.concatenate(rules), lengths[len(terminals) :], seq


def _opened(n: int, rules: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """The terminals below n that symbols stand for: all rules at once are opened, as often as they are nested."""
    seq = seq.astype(np.int64)
    while len(seq):
        rule = seq >= n
        if not rule.any():
            break
        size = 1 + rule
        first = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int64)
        out[first[~rule]] = seq[~rule]
        open_ = rules[seq[rule] - n]
        out[first[rule]], out[first[rule] + 1] = open_[:, 0], open_[:, 1]
        seq = out
    return seq


def expand(terminals: np.ndarray, rules: np.ndarray, lengths: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for. Of many symbols each kind is opened once, and its ids are taken by the lengths of the rules."""
    n = len(terminals)
    if len(seq) <= 2 * (n + len(rules)):
        return terminals[_opened(n, rules, seq)]
    table = terminals[_opened(n, rules, np.arange(n + len(rules)))]
    every = np.concatenate([np.ones(n, np.int64), lengths])
    first = np.cumsum(every) - every
    size = every[seq]
    ends = np.cumsum(size)
    return table[np.repeat(first[seq] - ends + size, size) + np.arange(ends[-1])]


def _pack(ids: np.ndarray) -> bytes:
    terminals, rules, lengths, seq = re_pair(ids)
    width = 2 if len(terminals) + len(rules) <= 1 << 16 else 4
    head = struct.pack("<5I", len(ids), len(terminals), len(rules), len(seq), width)
    return b"".join([head, terminals.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), seq.astype(f"<u{width}").tobytes()])


class Writer:
    """A file that is written from its start to its end."""

    def __init__(self, out, block: int = BLOCK):
        self.out, self.block = out, block
        self.waiting: list[np.ndarray] = []
        self.held = self.at = self.n_ids = 0
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.places: list[int] = []
        self.firsts: list[int] = []

    def add(self, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Some more documents and all their ids."""
        self.docs += doc_ids
        self.sizes += sizes.tolist()
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            flat = np.concatenate(self.waiting)
            whole = len(flat) - len(flat) % self.block
            for i in range(0, whole, self.block):
                self._block(flat[i : i + self.block])
            self.waiting, self.held = [flat[whole:]], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = _pack(ids)
        self.places.append(self.at)
        self.firsts.append(self.n_ids)
        self.out.write(data)
        self.at += len(data)
        self.n_ids += len(ids)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        known = np.array([d is not None for d in self.docs], np.uint8)
        for part in (np.array([d or 0 for d in self.docs], "<i8"), known, np.array(self.sizes, "<i8"), np.array(self.places, "<i8"), np.array(self.firsts, "<i8")):
            self.out.write(part.tobytes())
        self.out.write(struct.pack("<4q", len(self.docs), len(self.places), self.n_ids, self.at) + MAGIC)


class Reader:
    """A file by its index; blocks are read when they are asked for."""

    def __init__(self, data):
        self.data = data
        size = data.size()
        tail = data.read_at(40, size - 40) if size >= 40 else b""
        if tail[32:] != MAGIC:
            raise ValueError("not a file of token ids, or not a whole one")
        n, blocks, self.n_ids, at = struct.unpack("<4q", tail[:32])
        index = data.read_at(size - 40 - at, at)
        take = lambda kind, count, start: np.frombuffer(index, kind, count, start)
        self.docs, self.known, self.sizes = take("<i8", n, 0), take("<u1", n, 8 * n), take("<i8", n, 9 * n)
        self.places, self.firsts = take("<i8", blocks, 17 * n), take("<i8", blocks, 17 * n + 8 * blocks)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ends = np.append(self.places[1:], at)

    def block(self, k: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_ids, terminals, rules, their lengths, and symbols."""
        data = self.data.read_at(int(self.ends[k] - self.places[k]), int(self.places[k]))
        n_ids, t, r, n, width = struct.unpack_from("<5I", data)
        terminals, rules = np.frombuffer(data, "<u4", t, 20), np.frombuffer(data, "<u4", 2 * r, 20 + 4 * t).reshape(r, 2).astype(np.int64)
        lengths = np.frombuffer(data, "<u4", r, 20 + 4 * t + 8 * r).astype(np.int64)
        return n_ids, terminals, rules, lengths, np.frombuffer(data, f"<u{width}", n, 20 + 4 * t + 12 * r)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file, from the blocks and, within them, the symbols that overlap that range."""
        out = []
        for k in range(max(0, int(np.searchsorted(self.firsts, start, "right")) - 1), int(np.searchsorted(self.firsts, end))):
            n_ids, terminals, rules, lengths, seq = self.block(k)
            a, b = max(0, start - int(self.firsts[k])), min(n_ids, end - int(self.firsts[k]))
            ends = np.cumsum(np.concatenate([np.ones(len(terminals), np.int64), lengths])[seq])
            i, j = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b)
            before = int(ends[i - 1]) if i else 0
            out.append(expand(terminals, rules, lengths, seq[i : j + 1])[a - before : b - before])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        return self.ids(int(self.starts[k]), int(self.starts[k] + self.sizes[k]))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, first id and ids of each document in turn; each block is opened once."""
        held, upto, k = np.zeros(0, np.uint32), 0, 0
        for doc_id, known, start, size in zip(self.docs.tolist(), self.known.tolist(), self.starts.tolist(), self.sizes.tolist(), strict=True):
            parts = [held[len(held) - (upto - start) :]] if start < upto else []
            while upto < start + size:
                held = expand(*self.block(k)[1:])
                parts.append(held)
                upto, k = upto + len(held), k + 1
            ids = parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.uint32)])
            yield doc_id if known else None, start, ids[:size]


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """Files of the ids of (doc_id, text) in a folder that Spark and Arrow's file systems both reach; a table of part, file, n_docs and n_ids, part being
    a file's place in the stream.

    Texts are shuffled once, by ranges of doc_id; of equal ones a digest of the text decides, so that they are split too."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(vocabulary_path))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    n = max(1, -(-size.bytes // FILE_BYTES), -(-size.rows // FILE_ROWS), min(spark.sparkContext.defaultParallelism, size.bytes >> 22))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, made = encoder(shared.value, end), None
        part = TaskContext.get().partitionId()
        system, folder = arrow_path(path)
        draft, name = f"{folder}/_{part:06d}-{uuid4().hex}", f"{folder}/part-{part:06d}.ids"
        for b in chunks(batches):
            if made is None:
                system.create_dir(folder, recursive=True)
                out = system.open_output_stream(draft)
                made = Writer(out, block)
            made.add(b.column(0).to_pylist(), *own.encode(utf8(b.column(1))))
        if made is not None:
            made.close()
            out.close()
            system.move(draft, name)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{path}/part-{part:06d}.ids"]), pa.array([len(made.docs)], pa.int64()), pa.array([made.n_ids], pa.int64())], names=["part", "file", "n_docs", "n_ids"])

    dealt = rows.repartitionByRange(n, F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie").select("doc_id", "text")
    return dealt.mapInArrow(run, "part int, file string, n_docs long, n_ids long")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit numbers) of the files of write_tokens(),
    each read by one task."""
    from pyspark.sql import Window

    # One row for each file of FILE_BYTES.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("part", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("first"))
    n = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, inner = arrow_path(name)
                with system.open_input_file(inner) as data:
                    rows, held = [], 0
                    for doc_id, start, ids in Reader(data).documents():
                        rows.append((doc_id, first + start, len(ids), ids.astype("<u4").tobytes()))
                        held += 4 * len(ids) + 32
                        if held > 4 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)

    return placed.repartition(n, "part").select("file", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids"])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents: files are written in the shared folder and read back."""
    store = Store(spark)
    files = store.write(write_tokens(read(spark, sf_dir, "documents"), f"{store.root}/ids", default_path()))
    return read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
