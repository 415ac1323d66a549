"""A resumable scan: files that match a predicate are added to an output, each file once, whatever is interrupted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType


def resumable_filter(spark: SparkSession, source: str, schema: StructType, keep: Column, out: str, checkpoint: str, files_per_batch: int = 1, format: str = "parquet") -> DataFrame:
    """Scan what hasn't been scanned yet and return all rows kept so far.

    The checkpoint remembers the files that are done. A batch is written to a folder of its own number, so a
    batch that is run again after a crash replaces its own rows and adds none twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format).load(source)
    query = stream.where(keep).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch=*")
    if not found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{out}/batch=*")


def restart(spark: SparkSession, out: str, checkpoint: str) -> None:
    """Forget what was scanned and kept, for a forced rebuild."""
    for path in (out, checkpoint):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
