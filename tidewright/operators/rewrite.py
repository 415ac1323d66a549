"""Rewriting texts by a dictionary of phrases that is a table.

A text is cut into words (ASCII letters and apostrophes) and what stands between them, and read once from left to right: at each word
the longest phrase that begins there is replaced, and reading goes on after it. A phrase's words are parted by single spaces. Phrases
are found in any case; what replaces them takes the case of what was found: as it is given, capitalized, or all capitals. A word
that no phrase takes may have its ending replaced. What was written isn't read again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Phrases up to which the dictionary is sent to all tasks: 1 million of 30 letters are some 60 MB.
SENT = 1_000_000
_WORD = re.compile(r"[A-Za-z']+")


def cased(found: str, other: str) -> str:
    """A replacement in the case of what it replaces."""
    letters = [c for c in found if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return other.upper()
    return other[:1].upper() + other[1:] if letters and found[0].isupper() else other


class Phrases:
    """Replacements by the words of phrases, as a tree with a level for each word."""

    def __init__(self, rows: list[tuple[str, str]], endings: tuple[tuple[str, str], ...] = ()):
        self.tree: dict = {}
        self.endings = sorted(endings, key=lambda e: (-len(e[0]), e))
        # Of a phrase's several replacements the least counts.
        for phrase, other in sorted(rows, reverse=True):
            here = self.tree
            for word in phrase.lower().split(" "):
                here = here.setdefault(word, {})
            here[None] = other

    def _longest(self, text: str, words: list[tuple[int, int]], small: list[str], i: int) -> tuple[int, str] | None:
        """The number of words of the longest phrase that begins at word i, and its replacement."""
        here, best, n = self.tree.get(small[i]), None, 1
        while here is not None:
            if None in here:
                best = n, here[None]
            if i + n == len(words) or text[words[i + n - 1][1] : words[i + n][0]] != " ":
                break
            here, n = here.get(small[i + n]), n + 1
        return best

    def _ended(self, word: str, small: str) -> str:
        for ending, other in self.endings:
            if small.endswith(ending) and len(small) > len(ending):
                return word[: len(word) - len(ending)] + (other.upper() if word.isupper() else other)
        return word

    def rewrite(self, text: str) -> str:
        words = [m.span() for m in _WORD.finditer(text)]
        small = [text[a:b].lower() for a, b in words]
        out, at, i = [], 0, 0
        while i < len(words):
            a, b = words[i]
            found = self._longest(text, words, small, i)
            if found:
                b = words[i + found[0] - 1][1]
                new = cased(text[a:b], found[1])
            else:
                new = self._ended(text[a:b], small[i])
            out += [text[at:a], new]
            at, i = b, i + (found[0] if found else 1)
        out.append(text[at:])
        return "".join(out)


def rewrite(df: DataFrame, column: str, phrases: DataFrame, endings: tuple[tuple[str, str], ...] = (), sent: int = SENT) -> DataFrame:
    """The rows with ``column`` rewritten by a table of phrase and replacement (rows with a null count for nothing). Null stays null.

    A dictionary that a count shows to be short is sent to all tasks. Of a longer one each text gets the phrases that begin with one of its
    words, by a join on first words, so no task holds it all. Of columns named alike none may be rewritten."""
    spark = df.sparkSession
    known = phrases.where("phrase IS NOT NULL AND replacement IS NOT NULL AND phrase <> ''").select(F.lower("phrase").alias("phrase"), "replacement")
    schema = StructType([StructField(f.name, StringType()) if f.name == column else f for f in df.schema])
    at = df.columns.index(column)
    if known.limit(sent + 1).count() <= sent:
        shared = spark.sparkContext.broadcast([(r.phrase, r.replacement) for r in known.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dictionary = Phrases(shared.value, endings)
            for b in batches:
                new = pa.array([None if t is None else dictionary.rewrite(t) for t in b.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns[:at], new, *b.columns[at + 1 :]], names=schema.names)

        return df.mapInArrow(run, schema)
    # Each text once, by its digest, so that equal texts share what is found for them.
    texts = df.select(F.col(column).alias("_text")).where("_text IS NOT NULL").distinct().withColumn("_id", F.sha2("_text", 256))
    firsts = texts.select("_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("_text", F.lit("[A-Za-z']+"), F.lit(0)), lambda w: F.lower(w)))).alias("_first"))
    held = firsts.join(known.withColumn("_first", F.substring_index("phrase", " ", 1)), "_first").groupBy("_id").agg(F.collect_set(F.struct("phrase", "replacement")).alias("_phrases"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [Phrases([(p["phrase"], p["replacement"]) for p in some or []], endings).rewrite(t) for t, some in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], names=["_id", "_new"])

    done = texts.join(held, "_id", "left").select("_id", "_text", "_phrases").mapInArrow(each, "_id string, _new string")
    out = df.withColumn("_id", F.sha2(column, 256)).join(done, "_id", "left")
    return out.select(*[F.col("_new").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])
