"""Elo ratings that follow an append-only match log: what is new is replayed on top of what was rated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.arena import BASE, K, replay
from ..storage import exists, hadoop

_RATED = "model string, rating double, place long, last long"


def _batches(spark: SparkSession, state: str) -> list[int]:
    if not exists(spark, state):
        return []
    p, fs = hadoop(spark, state)
    return sorted(int(n.removeprefix("batch=")) for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith("batch=") and fs.exists(hadoop(spark, f"{state}/{n}/_SUCCESS")[0]))


def rated(spark: SparkSession, state: str, by: StructType | None = None, before: int | None = None) -> DataFrame:
    """by, model, rating, place and last after the last batch (before batch ``before``, if given)."""
    schema = StructType([*(by or []), *StructType.fromDDL(_RATED)])
    found = [n for n in _batches(spark, state) if before is None or n < before]
    return spark.read.schema(schema).parquet(f"{state}/batch={found[-1]:012d}") if found else spark.createDataFrame([], schema)


def follow(spark: SparkSession, log: str, schema: StructType, state: str, checkpoint: str, by: tuple[str, ...] = (), k: float = K, base: float = BASE, files_per_batch: int = 1000, kept: int = 3, format: str = "json") -> DataFrame:
    """Rate the matches that were appended to the log since the last call; by, model, rating, place and last of all groups.

    A batch of new files is replayed from the ratings of the batch before and written under its own number, so a batch that is run again after a
    crash gives the same. Groups without new matches are carried over. Within a batch seq decides; a match that is appended
    after a later one of its group was rated is an error, and restart() and a new call rate the log afresh. The last ``kept`` batches' ratings stay."""
    groups = StructType([schema[c] for c in by])

    def step(batch: DataFrame, number: int) -> None:
        start = rated(spark, state, groups, number)
        replay(batch, by, k, base, start=start).write.mode("overwrite").parquet(f"{state}/batch={number:012d}")
        for old in _batches(spark, state)[:-kept]:
            p, fs = hadoop(spark, f"{state}/batch={old:012d}")
            fs.delete(p, True)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format).load(log)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return rated(spark, state, groups)
