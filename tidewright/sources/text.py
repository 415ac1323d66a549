"""Scans of line files: prompts with comments, match logs, memo caches, token files; texts from the web; digests of files."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cache import Cache
from ..storage import arrow_path, files
from .token_source import TokenIds

PROMPT = "id string, category string, prompt string, gold string"
#: Blocks of files up to which their counts are sent to all tasks.
BLOCKS = 500_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, seq and value of all lines of text files: seq numbers them from 0, file by file in the order of their names.

    Files are read by line in as many tasks as they have blocks. The task that reads a block counts its lines, and one number for
    each block, the lines of all blocks before it, is added: lines aren't shuffled, and no task reads a whole file."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for b in batches:
            places = []
            for where in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                now, at = where, at + 1 if where == now else 0
                places.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.int64())], names=["file", "block", "value", "_in"])

    # A block's lines come one after the other in one task.
    numbered = raw.mapInArrow(number, "file string, block long, value string, _in long")
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = raw.groupBy(F.col("file").alias("_f"), F.col("block").alias("_b")).agg(F.count("*").alias("n")).select("_f", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_from"))
    few = counts.limit(BLOCKS + 1).count() <= BLOCKS
    placed = numbered.join(F.broadcast(counts) if few else counts, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    return placed.select("file", (F.col("_from") + F.col("_in")).cast("long").alias("seq"), "value")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """seq and line of the files' lines, without blank ones and ones that begin with #."""
    found = lines(spark, path).select("seq", F.trim("value").alias("line"))
    return found.where("line <> '' AND NOT startswith(line, '#')")


def numbered_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines with seq: the one that a line carries, else its number."""
    parsed = F.from_json("line", f"seq long{', ' if schema else ''}{schema}")
    rows = json_lines(spark, path).select(F.col("seq").alias("_line"), parsed.alias("m")).select("_line", "m.*")
    return rows.withColumn("seq", F.coalesce("seq", "_line")).drop("_line")


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """seq, id, category, prompt and gold; a bare JSON string is a prompt."""
    lines = json_lines(spark, path)
    bare = F.from_json(F.concat(F.lit('{"prompt":'), F.col("line"), F.lit("}")), "prompt string")["prompt"]
    p = F.when(F.startswith("line", F.lit('"')), F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("category"), bare.alias("prompt"), F.lit(None).cast("string").alias("gold"))).otherwise(F.from_json("line", PROMPT))
    return lines.select("seq", p.alias("p")).select("seq", "p.*")


def gold_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompts with a known answer."""
    return prompts(spark, path).where("gold IS NOT NULL AND gold <> ''")


MATCH = "match_id string, prompt string, model_a string, model_b string, response_a string, response_b string, judge string, judge_version string, winner string, verdict_forward string, verdict_reverse string, reason string, ts double"


def matches(spark: SparkSession, path: str) -> DataFrame:
    """A match log with seq, its order; see numbered_json()."""
    return numbered_json(spark, path, MATCH)


def memo(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A memo cache that is a log of JSON lines (key and the columns of ``schema``): the last line of each key."""
    from ..operators.arena import last_write

    return last_write(numbered_json(spark, path, f"key string, {schema}").where("key IS NOT NULL")).drop("seq")


def token_file(spark: SparkSession, path: str, block: int = 1 << 16, task_bytes: int = 1 << 26) -> DataFrame:
    """file, block and ids of headerless files of little-endian 16-bit ids: a file, a folder of .bin files or a pattern; see TokenIds."""
    found = files(spark, path, ".bin") or files(spark, path)
    if not found:
        raise FileNotFoundError(path)
    for name, size in found:
        if size % 2:
            raise ValueError(f"{name} has an odd number of bytes")
    spark.dataSource.register(TokenIds)
    return spark.read.format("token_ids").option("block", block).option("task_bytes", task_bytes).option("files", json.dumps([name for name, _ in found])).load(path)


def fetch(url: str, timeout: float = 60.0, agent: str = "tidewright/0.1", tries: int = 3) -> str:
    """A text from the web; what isn't UTF-8 is replaced. A request that fails is made again after 1, 2, ... seconds."""
    from urllib.request import Request, urlopen

    for again in range(tries):
        try:
            with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
                return answer.read().decode("utf-8", "replace")
        except OSError:
            if again == tries - 1:
                raise
            time.sleep(2**again)
    raise ValueError("tries must be 1 or more")


def fetch_all(spark: SparkSession, urls: DataFrame, folder: str, per_host: int = 2, batch: int = 10_000, tries: int = 3, timeout: float = 60.0) -> DataFrame:
    """url and text of a table of addresses (url), kept in a folder.

    Addresses are fetched in batches of about ``batch``, each kept when it is done, so a call that was interrupted, or that adds addresses,
    fetches what is missing. An address is dealt to one of ``per_host`` tasks of its host, which asks for one after the other, so a host sees
    ``per_host`` requests at once. What can't be fetched has a null text, and is tried again by the next call."""
    kept = Cache(spark, folder, "text string")
    wanted = urls.select("url").where("url IS NOT NULL").distinct().withColumn("key", F.sha2("url", 256))
    host = F.coalesce(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.lit(""))

    def call(missing: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = []
                for url in b.column(1).to_pylist():
                    try:
                        texts.append(fetch(url, timeout, tries=tries))
                    except (OSError, ValueError):
                        texts.append(None)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["key", "text"])

        dealt = missing.select("key", "url").repartition(host, F.pmod(F.xxhash64("url"), F.lit(per_host)))
        return dealt.mapInArrow(run, "key string, text string").where("text IS NOT NULL")

    n = max(1, -(-wanted.count() // batch))
    for i in range(n):
        kept.through(wanted.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i), call)
    return wanted.join(kept.read(wanted), "key", "left").select("url", "text")


def fetched_books(spark: SparkSession, numbers: list[int], address: str, folder: str, min_chars: int = 200) -> DataFrame:
    """key and text: the paragraphs of books that are fetched by their numbers, ``{}`` in the address, and kept in a folder. A book that can't be had is an error."""
    urls = spark.createDataFrame([(n, address.format(n)) for n in numbers], "number long, url string")
    found = urls.join(fetch_all(spark, urls, folder), "url")
    missing = [r.number for r in found.where("text IS NULL").select("number").orderBy("number").limit(10).collect()]
    if missing:
        raise OSError(f"books that can't be fetched: {missing}")
    return _paragraphs(found.select(F.col("number").cast("string").alias("file"), "text"), min_chars)


def _paragraphs(found: DataFrame, min_chars: int) -> DataFrame:
    from ..operators import corpus

    out = corpus.paragraphs(found.select("file", corpus.strip_book(F.col("text")).alias("text")), min_chars)
    return out.select(F.concat_ws(":", "file", F.lpad(F.col("ord").cast("string"), 9, "0")).alias("key"), "text")


def books(spark: SparkSession, path: str, min_chars: int = 200) -> DataFrame:
    """key and text: the paragraphs of staged books, without their licence headers and footers."""
    return _paragraphs(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")), min_chars)


def file_digests(spark: SparkSession, path: str, chunk: int = 1 << 22) -> DataFrame:
    """path and sha256 of files, a folder or a pattern: each file is read chunk by chunk by one task, so it may have any length."""
    found = files(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for b in batches:
            for name in b.column(0).to_pylist():
                system, inner = arrow_path(name)
                digest = sha256()
                with system.open_input_stream(inner) as data:
                    while some := data.read(chunk):
                        digest.update(some)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest.hexdigest()])], names=["path", "sha256"])

    rows = spark.createDataFrame([(name,) for name, _ in found], "path string")
    return rows.repartition(max(1, len(found)), "path").mapInArrow(run, "path string, sha256 string")
