"""Sinks: CSV with fixed columns, append-only JSON lines, token files, metrics, Markdown galleries."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists, files, put_text
from .token_source import TokenIds, flat_bytes


def csv(df: DataFrame, columns: list[str], path: str, single: bool = True) -> None:
    """The named columns with headers, other columns are left out: one file for a report that is small by its nature, else a file for each task, in the order
    of a sorted table's ranges."""
    out = df.select(*columns)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows with seq to a log. Their seq goes on after the log's greatest, in their own order, and is written with
    them, so that the order of the whole log doesn't depend on files."""
    from .text import numbered_json

    spark = df.sparkSession
    last = numbered_json(spark, path, "").agg(F.max("seq")).first()[0] if exists(spark, path) else None
    if last is not None:
        least = df.agg(F.min("seq")).first()[0]
        df = df.withColumn("seq", F.col("seq") + F.lit(max(0, last + 1 - (least or 0))))
    append_json(df, path)


def put_new(new: DataFrame, cache_path: str, key: str = "key") -> None:
    """Append the rows whose keys a cache of JSON lines doesn't hold; for one writer at a time (Cache is for several)."""
    spark = new.sparkSession
    if exists(spark, cache_path):
        new = new.join(spark.read.schema(new.schema).json(cache_path).select(key), key, "left_anti")
    append_json(new.dropDuplicates([key]), cache_path)


def _bytes(ids: pa.ListArray) -> list[bytes | None]:
    """Each list as little-endian 16-bit numbers; an id that doesn't fit is an error."""
    data = flat_bytes(ids)
    ends = np.cumsum([0, *[2 * (n or 0) for n in ids.value_lengths().to_pylist()]]).tolist()
    return [data[a:b] if known else None for a, b, known in zip(ends, ends[1:], ids.is_valid().to_pylist(), strict=False)]


def token_bytes(encoded: DataFrame, ids: str = "ids") -> DataFrame:
    """The rows with ``bytes``: their ids as little-endian 16-bit numbers, as a token file has them. Other ids are an error."""
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("binary")
    def pack(ids: pa.Array) -> pa.Array:
        return pa.array(_bytes(ids), pa.binary())

    return encoded.withColumn("bytes", pack(ids))


def token_files(encoded: DataFrame, key: str, path: str, ids: str = "ids", file_ids: int = 1 << 27) -> list[tuple[str, int]]:
    """Flat files of little-endian 16-bit ids, part-00000.bin and so on, that make one stream in the order of ``key``, in place of those in the folder.

    Returns each file with its number of ids. Files have about ``file_ids`` ids; one holds the whole stream if it is
    shorter. Rows are dealt into ranges of the key, and each task streams its range into a file of its own; see TokenIds."""
    spark = encoded.sparkSession
    total = encoded.agg(F.coalesce(F.sum(F.size(ids)), F.lit(0))).first()[0]
    n = max(1, -(-total // file_ids))
    rows = encoded.select(key, F.col(ids).alias("ids")).where(F.size("ids") > 0)
    rows = (rows.repartitionByRange(n, key) if n > 1 else rows.repartition(1)).sortWithinPartitions(key).select("ids")
    spark.dataSource.register(TokenIds)
    rows.write.format("token_ids").mode("overwrite").save(path)
    return [(name.removeprefix("file://"), size // 2) for name, size in files(spark, path, ".bin")] if exists(spark, path) else []


def metrics_row(spark: SparkSession, root: str, day: str, model: str, row: dict) -> str:
    """A run's metrics as one JSON file, root/day/model/metrics.json; returns its path."""
    path = f"{root.rstrip('/')}/{day}/{model}/metrics.json"
    put_text(spark, path, json.dumps(row, indent=2))
    return path


def completions(prompts: DataFrame, play, tokens) -> DataFrame:
    """seq, prompt, completion, n_in and n_out of (seq, prompt): what a player (a function of a column) says, and the ids of both by ``tokens``
    (a column's array of ids)."""
    said = prompts.select("seq", "prompt", play(F.col("prompt")).alias("completion"))
    return said.withColumn("n_in", F.size(tokens(F.col("prompt")))).withColumn("n_out", F.size(tokens(F.col("completion"))))


def gallery(samples: DataFrame, title: str) -> DataFrame:
    """One Markdown text of (seq, prompt, completion, n_in, n_out) in the order of seq; a gallery is read by people, so it is small."""
    part = F.concat(F.lit("## "), "prompt", F.lit("\n\n"), "completion", F.lit("\n\n_"), F.col("n_in").cast("string"), F.lit(" in, "), F.col("n_out").cast("string"), F.lit(" out_\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", part.alias("t")))), lambda x: x["t"]), "\n")
    return samples.agg(F.concat(F.lit(f"# {title}\n\n"), body).alias("markdown"))


def write_gallery(samples: DataFrame, title: str, path: str) -> None:
    """The gallery as one file."""
    put_text(samples.sparkSession, path, gallery(samples, title).first()[0])
