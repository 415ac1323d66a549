"""Folders and small files that the driver and the executors share."""

from __future__ import annotations

import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def hadoop(spark: SparkSession, path: str):
    """A path and its file system, as Spark itself sees them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop(spark, path)
    return fs.exists(p)


def shared_folder(spark: SparkSession) -> str:
    """A new folder for tables that a query writes and reads again; it is deleted when the application ends.

    It lies in ``spark.checkpoint.dir``. Where that is unset, a session whose executors are threads of the driver
    (tests) gets a temporary folder, and any other an error: executors don't see each other's disks."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="tidewright-"))
        root = _LOCAL[0]
    path = f"{root.rstrip('/')}/tidewright-{uuid.uuid4().hex}"
    p, fs = hadoop(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def put_text(spark: SparkSession, path: str, content: str) -> None:
    """A small text as one file, written by the driver in place of any that was there."""
    p, fs = hadoop(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(content.encode()))
    out.close()


def files(spark: SparkSession, path: str, suffix: str = "") -> list[tuple[str, int]]:
    """Files of a folder or pattern and their bytes, by name; folders in it and hidden files don't count."""
    p, fs = hadoop(spark, path)
    found = []
    for status in fs.globStatus(p) or []:
        for s in fs.listStatus(status.getPath()) if status.isDirectory() else [status]:
            name = s.getPath().getName()
            if not s.isDirectory() and name.endswith(suffix) and name[0] not in "._":
                uri = s.getPath().toUri()
                found.append((f"file://{uri.getPath()}" if uri.getScheme() == "file" else s.getPath().toString(), s.getLen()))
    return sorted(found)


def arrow_path(path: str):
    """Arrow's file system for a path and the path in it, in any Python process; local paths may hold any letters."""
    from pyarrow import fs

    if "://" not in path or path.startswith("file://"):
        return fs.LocalFileSystem(), path.removeprefix("file://")
    return fs.FileSystem.from_uri(path)


class SharedSum:
    """Sums of numbers by key over the tasks of a barrier stage, round by round, through files in a shared folder.

    In each round a task puts down what it adds, task 0 adds all of it up, and every task reads the sum, so a round costs two
    files a task. A file gets its name when it is whole, and goes when all have read it. (Messages of the barrier itself
    take about a second each.) The folder must be one that Arrow's file systems reach, and another one for each attempt of the
    stage. Without news for ``patience`` seconds the task fails, and the stage with it."""

    def __init__(self, folder: str, task: int, tasks: int, patience: float = 1800.0):
        self.system, self.folder = arrow_path(folder)
        self.task, self.tasks, self.patience, self.round = task, tasks, patience, 0
        self.system.create_dir(self.folder, recursive=True)

    def _put(self, name: str, keys: np.ndarray, values: np.ndarray) -> None:
        draft = f"{self.folder}/_{name}-{uuid.uuid4().hex}"
        with self.system.open_output_stream(draft) as out:
            out.write(np.stack([keys, values]).astype("<i8").tobytes())
        self.system.move(draft, f"{self.folder}/{name}")

    def _get(self, name: str) -> np.ndarray:
        path, pause, end = f"{self.folder}/{name}", 0.001, time.monotonic() + self.patience
        while not self.system.get_file_info(path).is_file:
            if time.monotonic() > end:
                raise TimeoutError(f"no {name} after {self.patience} s")
            time.sleep(pause)
            pause = min(0.05, 1.2 * pause)
        with self.system.open_input_file(path) as data:
            return np.frombuffer(data.readall(), "<i8").reshape(2, -1)

    def add(self, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and sums over all tasks, in the order of the keys; sums of 0 are left out."""
        r, self.round = self.round, self.round + 1
        if self.tasks > 1 and self.task:
            self._put(f"{r}-{self.task}", keys, values)
        if not self.task:
            parts = [np.stack([keys, values]), *[self._get(f"{r}-{t}") for t in range(1, self.tasks)]]
            if r and self.tasks > 1:
                self.system.delete_file(f"{self.folder}/{r - 1}-sum")
            every = np.concatenate(parts, axis=1)
            names, where = np.unique(every[0], return_inverse=True)
            sums = np.zeros(len(names), np.int64)
            np.add.at(sums, where, every[1])
            found = names[sums != 0], sums[sums != 0]
            if self.tasks > 1:
                self._put(f"{r}-sum", *found)
            return found
        found = self._get(f"{r}-sum")
        self.system.delete_file(f"{self.folder}/{r}-{self.task}")
        return found[0], found[1]
