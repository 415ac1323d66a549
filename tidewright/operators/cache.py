"""A read-through cache: what is known is joined, what isn't is called once for each key and kept.

A cache is a folder. Each put() writes a Parquet table of its own below ``data``, and then a small numbered file below
``commits`` that names it: a table counts from then on, whole or not at all, so a task or driver that is lost in between leaves nothing that
is read. A number is taken by creating its file, which fails if it exists; the later of two writers takes the next one. Where
two tables hold a key, the one with the lesser number counts, so a value that was read once stays."""

from __future__ import annotations

import json
from collections.abc import Callable
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import exists, files, hadoop

#: Wanted keys up to which the cache is filtered by broadcast: 1 million digests are some 100 MB.
FEW_KEYS = 1_000_000
#: Tables after which put() makes one of all.
MANY_TABLES = 64


class Cache:
    """Values by ``key`` (string); ``values`` are the other columns, as a DDL string."""

    def __init__(self, spark: SparkSession, path: str, values: str):
        self.spark, self.path, self.values = spark, path.rstrip("/"), values
        self.schema = StructType.fromDDL(f"key string, {values}")
        self.names = self.schema.names[1:]

    def _commits(self) -> list[tuple[int, str, int]]:
        """Number, table and the last number that it stands for (its own but for a compaction), of the commits that count."""
        if not exists(self.spark, f"{self.path}/commits"):
            return []
        found: list[tuple[int, str, int]] = []
        for name, size in files(self.spark, f"{self.path}/commits"):
            # An empty one belongs to a writer that was lost.
            if size:
                said = json.loads(self._text(name))
                number = int(name.rsplit("/", 1)[1])
                upto = said.get("upto", number)
                if "upto" in said:
                    found = [c for c in found if c[2] > upto]
                found.append((number, said["table"], upto))
        return sorted(found, key=lambda c: c[2])

    def _text(self, path: str) -> str:
        p, fs = hadoop(self.spark, path)
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _commit(self, content: dict) -> None:
        number = max([int(name.rsplit("/", 1)[1]) for name, _ in files(self.spark, f"{self.path}/commits")], default=-1) if exists(self.spark, f"{self.path}/commits") else -1
        while True:
            number += 1
            p, fs = hadoop(self.spark, f"{self.path}/commits/{number:012d}")
            try:
                out = fs.create(p, False)
            except Py4JJavaError as e:
                if fs.exists(p):
                    continue
                raise e
            out.write(bytearray(json.dumps(content).encode()))
            out.close()
            return

    def read(self, wanted: DataFrame | None = None) -> DataFrame:
        """key and values, one row for each key; only for the keys of ``wanted`` (key), if given, which are sent to all tasks where a count shows them few."""
        commits = self._commits()
        if not commits:
            return self.spark.createDataFrame([], self.schema)
        order = F.create_map(*[F.lit(x) for i, (_, table, _) in enumerate(commits) for x in (table, i)])
        held = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{table}" for _, table, _ in commits])
        held = held.withColumn("_order", order[F.regexp_extract("_metadata.file_path", r"/data/([0-9a-f]+)/", 1)])
        if wanted is not None:
            keys = wanted.select("key").distinct()
            held = held.join(F.broadcast(keys) if keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS else keys, "key", "left_semi")
        if len(commits) == 1:
            return held.drop("_order")
        return held.groupBy("key").agg(F.min_by(F.struct(*self.names), "_order").alias("v")).select("key", "v.*")

    def _write(self, rows: DataFrame) -> str | None:
        """A table of rows with distinct keys; none if there are no rows."""
        name = uuid4().hex
        path = f"{self.path}/data/{name}"
        rows.write.option("compression", "zstd").parquet(path)
        if self.spark.read.schema(self.schema).parquet(path).isEmpty():
            self._delete(name)
            return None
        return name

    def _delete(self, table: str) -> None:
        p, fs = hadoop(self.spark, f"{self.path}/data/{table}")
        fs.delete(p, True)

    def put(self, new: DataFrame) -> None:
        """Keep rows whose keys aren't known. Of rows with one key the least counts; a null key isn't kept."""
        one = new.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(*self.names)).alias("v")).select("key", "v.*")
        if self._commits():
            one = one.join(self.read(one).select("key"), "key", "left_anti")
        if name := self._write(one):
            self._commit({"table": name})
        if len(self._commits()) > MANY_TABLES:
            self.compact()

    def compact(self) -> None:
        """One table of all; the ones that it stands for are left to readers that have begun, and go with the next compaction."""
        before = self._commits()
        if len(before) > 1 and (name := self._write(self.read())):
            self._commit({"table": name, "upto": max(c[2] for c in before)})
            live = {c[1] for c in before} | {name} | {c[1] for c in self._commits()}
            p, fs = hadoop(self.spark, f"{self.path}/data")
            for status in fs.listStatus(p):
                if (old := status.getPath().getName()) not in live and self._is_old(old):
                    self._delete(old)

    def _is_old(self, table: str) -> bool:
        """Whether a commit has named the table; one that none has named may be in the making."""
        return any(size and json.loads(self._text(name))["table"] == table for name, size in files(self.spark, f"{self.path}/commits"))

    def through(self, wanted: DataFrame, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of ``wanted`` (key and what a call needs) with the values of their keys.

        ``call`` gets a row for each distinct key that isn't known and adds the values' columns; what it says is kept before it is used. A task that runs
        again may call again, but one value counts. A null key has no values."""
        keys = wanted.where("key IS NOT NULL").dropDuplicates(["key"])
        missing = keys.join(self.read(keys).select("key"), "key", "left_anti") if self._commits() else keys
        if name := self._write(call(missing).select("key", *self.names)):
            self._commit({"table": name})
        return wanted.join(self.read(keys), "key", "left")
