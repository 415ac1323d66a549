"""Token files as a data source of Spark: headerless little-endian 16-bit ids, read by byte ranges, written by a commit.

``spark.dataSource.register(TokenIds)``; then ``spark.read.format("token_ids").load(path)`` gives file, block and ids, and
``df.write.format("token_ids").mode("append").save(path)`` writes a column ``ids`` (array of int), one file for each task, in the order
of the tasks: a table that is sorted over all tasks becomes one stream in that order. Drafts get their names only when all tasks have
succeeded, after the files that are there; a write that fails leaves nothing. Paths are ones that Arrow's file systems reach from the driver and all executors.

Options: ``block`` (ids in a row, 65536), ``task_bytes`` (bytes that a task reads, 64 MB), ``files`` (a JSON list of files, in place of all of the path's).
Overwriting deletes what was there before the new files get their names."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..storage import arrow_path

SCHEMA = "file string, block long, ids array<int>"


def flat_bytes(ids: pa.Array) -> bytes:
    """All ids of a column of lists as 16-bit numbers; one that doesn't fit is an error."""
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and not (0 <= flat.min() and flat.max() < 1 << 16):
        raise ValueError("token ids must be from 0 to 65535")
    return flat.astype("<u2").tobytes()


def _found(system, folder: str) -> list[tuple[str, int]]:
    """The files of a folder, or the one file, by name, with their bytes; hidden ones and drafts don't count."""
    from pyarrow import fs

    info = system.get_file_info(folder)
    if info.is_file:
        return [(folder, info.size)]
    some = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f.path, f.size) for f in some if f.is_file and f.base_name[0] not in "._")


@dataclass
class Range(InputPartition):
    file: str
    start: int
    size: int

    def __init__(self, file: str, start: int, size: int):
        super().__init__((file, start, size))
        self.file, self.start, self.size = file, start, size


class _Reader(DataSourceReader):
    def __init__(self, path: str, block: int, task_bytes: int, names: list[str] | None):
        self.path, self.block, self.step, self.names = path, block, max(1, task_bytes // (2 * block)) * 2 * block, names

    def partitions(self) -> list[Range]:
        system, folder = arrow_path(self.path)
        found = _found(system, folder) if self.names is None else [(n, system.get_file_info(arrow_path(n)[1]).size) for n in self.names]
        if not found:
            raise FileNotFoundError(self.path)
        for name, size in found:
            if size % 2:
                raise ValueError(f"{name} has an odd number of bytes")
        return [Range(name, start, min(self.step, size - start)) for name, size in found for start in range(0, size, self.step)] or [Range(found[0][0], 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, width = arrow_path(self.path)[0], 2 * self.block
        with system.open_input_file(arrow_path(partition.file)[1]) as data:
            for at in range(partition.start, partition.start + partition.size, width):
                ids = np.frombuffer(data.read_at(min(width, partition.start + partition.size - at), at), "<u2").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([partition.file]), pa.array([at // width], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names=["file", "block", "ids"])


@dataclass
class Written(WriterCommitMessage):
    task: int
    draft: str
    n: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, column: int, overwrite: bool):
        self.path, self.column, self.overwrite, self.name = path, column, overwrite, uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = arrow_path(self.path)
        task = TaskContext.get().partitionId()
        draft, n = f"{folder}/_{self.name}/{task:06d}-{uuid4().hex}", 0
        system.create_dir(f"{folder}/_{self.name}", recursive=True)
        with system.open_output_stream(draft) as out:
            for batch in iterator:
                data = flat_bytes(batch.column(self.column))
                out.write(data)
                n += len(data) // 2
        return Written(task, draft, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = arrow_path(self.path)
        old = _found(system, folder)
        used = [int(name.rsplit("-", 1)[1].removesuffix(".bin")) for name, _ in old if name.endswith(".bin") and name.rsplit("-", 1)[-1].removesuffix(".bin").isdigit()]
        after = 0 if self.overwrite else max(used, default=-1) + 1
        if self.overwrite:
            for name, _ in old:
                system.delete_file(name)
        for i, m in enumerate(sorted((m for m in messages if m and m.n), key=lambda m: m.task)):
            system.move(m.draft, f"{folder}/part-{after + i:05d}.bin")
        system.delete_dir(f"{folder}/_{self.name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = arrow_path(self.path)
        if system.get_file_info(f"{folder}/_{self.name}").type.name == "Directory":
            system.delete_dir(f"{folder}/_{self.name}")


class TokenIds(DataSource):
    """See the module's text."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("block", 1 << 16)), int(self.options.get("task_bytes", 1 << 26)), json.loads(self.options["files"]) if "files" in self.options else None)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if "ids" not in schema.names:
            raise ValueError("token files are written from a column ids")
        return _Writer(self.options["path"], schema.names.index("ids"), overwrite)
