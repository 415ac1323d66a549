"""Byte-pair encoding and decoding with a given vocabulary; nothing is trained.

A word of the pre-tokenizer's pattern is held as one contiguous array of parts with the rank of every
adjacent pair. The least rank is found by a scan, its boundary deleted and the ranks on both sides
refreshed, until no pair has a rank. The scan makes that quadratic, which is the fastest way for the
short words that texts are made of; a word of more than SHORT bytes keeps its ranks in a heap over
linked parts instead, with the same merges in the same order.

Each task remembers the words it has encoded, up to REMEMBERED of them, and forgets the older half beyond it.

Strings of special tokens in a text become those tokens, as the tokenizers library does by default.

Edges. Null is the empty text, which has no ids and decodes to the empty text. Repeated rows, and rows with an equal or
null doc_id, are encoded each alone. An empty table gives an empty result. A text of more than WHOLE letters
is split word by word, so that its words aren't held all at once. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tokens import byte_letters
from .common import read

#: Fixed value: the pattern that byte-level vocabularies of this family split text by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 64
REMEMBERED = 400_000
#: Letters of a text whose words are listed at once.
WHOLE = 1 << 20
_NONE = 1 << 60


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, byte = spec["model"], {c: b for b, c in enumerate(byte_letters())}
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [b""] * (1 + max(*ids.values(), *self.special.values()))
        for token, i in ids.items():
            self.pieces[i] = bytes(byte[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.of_byte = [0] * 256
        for c, b in byte.items():
            self.of_byte[b] = ids[c]
        # A pair of adjacent ids -> rank << 32 | id of the merged part; lower ranks merge first.
        self.merge = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[ids[left] << 32 | ids[right]] = rank << 32 | ids[left + right]
        pattern = regex.compile(PATTERN)
        self.split = lambda t: pattern.findall(t) if len(t) <= WHOLE else (m.group() for m in pattern.finditer(t))
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, list[int]] = {}

    def word(self, text: str) -> list[int]:
        """Ids of one word of the pattern."""
        of_byte, merge = self.of_byte, self.merge.get
        parts = [of_byte[b] for b in text.encode()]
        if len(parts) > SHORT:
            return self.long_word(parts)
        ranks = [merge(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = least & 0xFFFFFFFF
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = merge(parts[i] << 32 | parts[i + 1], _NONE)
            if i:
                ranks[i - 1] = merge(parts[i - 1] << 32 | parts[i], _NONE)
        return parts

    def long_word(self, parts: list[int]) -> list[int]:
        """The same merges, least rank first and leftmost among equals, in n log n steps."""
        merge, n = self.merge.get, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := merge(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or merge(parts[i] << 32 | parts[j]) != r:
                continue
            parts[i], parts[j] = r & 0xFFFFFFFF, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (q := merge(parts[i] << 32 | parts[k])) is not None:
                    heapq.heappush(heap, (q, i))
            if (k := before[i]) >= 0 and (q := merge(parts[k] << 32 | parts[i])) is not None:
                heapq.heappush(heap, (q, k))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> list[int]:
        if self.specials is None or not self.specials.search(text):
            return self.ordinary(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self.ordinary(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self.ordinary(text[at:])

    def ordinary(self, text: str) -> list[int]:
        known, out = self.known, []
        get, add = known.get, out.extend
        for w in self.split(text):
            ids = get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= SHORT:
                    known[w] = ids
            add(ids)
            if len(known) > REMEMBERED:
                for old in list(known)[: len(known) // 2]:
                    del known[old]
        return out

    def decode(self, ids: list[int]) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids]).decode("utf-8", "replace")


def vocabulary(path: str) -> str:
    """A vocabulary file's content, read on the driver: a few MB at most, whatever the corpus holds."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) and decoded, for every row of ``docs`` (doc_id, text, and more)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(shared.value)
        for whole in batches:
            step = max(1, int(whole.num_rows * (4 << 20) / max(whole.nbytes, 1)))
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                ids, sizes, decoded = [], [0], []
                for text in b.column(1).to_pylist():
                    own = vocab.encode(text or "")
                    ids.append(np.array(own, np.int32))
                    sizes.append(sizes[-1] + len(own))
                    decoded.append(vocab.decode(own))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns: doc_id, n_tokens, ids_sha256 and decoded_sha256, made next to the encoder."""
    from hashlib import sha256

    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(shared.value)
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                ids = vocab.encode(b.column(1)[i].as_py() or "")
                rows.append((len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(vocab.decode(ids).encode()).hexdigest()))
            n, one, two = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return digests(read(spark, sf_dir, "documents"), default_path())
