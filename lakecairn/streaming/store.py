"""A table kept in versions: each commit writes a new one and adds a pointer file last.

Pointer files are numbered and never replaced. One is written aside, whole, and then
renamed to its number; a rename onto a number that is there fails. So a reader sees
either the versions before a commit or those with it, a commit that died leaves files
that no pointer names, and of two writers that began with the same version one fails.
A batch id that is already in the history changes nothing, which makes a replayed
streaming batch harmless.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import fold


class ConflictError(OSError):
    """Another commit came first; read the new version and try again."""


class Versions:
    """A list of versions under a root and the pointers to it. The file system must refuse a rename onto a file that is there."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self._text = jvm.org.apache.commons.io.IOUtils

    def _pointers(self) -> list[str]:
        """Paths of the pointer files, oldest first."""
        folder = self._path(f"{self.root}/_versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return [f"{self.root}/_versions/{n}" for n in sorted(names) if n.isdigit()]

    def history(self) -> list[dict]:
        """One entry for each commit, oldest first."""
        found = self._pointers()
        if not found:
            return []
        stream = self._fs.open(self._path(found[-1]))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, entries: list[dict]) -> None:
        """Writes the pointer aside, then renames it to its number, which no other pointer may have."""
        aside = self._path(f"{self.root}/_aside/{uuid.uuid4().hex}")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(json.dumps(entries).encode()))
        stream.close()
        self._fs.mkdirs(self._path(f"{self.root}/_versions"))
        target = self._path(f"{self.root}/_versions/{entries[-1]['version']:012d}")
        try:
            self._files.rename(aside, target, self._no_options)
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                raise ConflictError(f"{self.root} already has version {entries[-1]['version']}") from e
            raise

    def publish(self, write: Callable[[str], dict | None], op: str, batch: str | None = None, params: str = "") -> int:
        """Lets ``write`` fill a new place, then points to it; a known batch id changes nothing.

        What ``write`` returns is kept in the entry. Raises ConflictError if another commit came first.
        """
        entries = self.history()
        if batch is not None and any(e["batch"] == batch for e in entries):
            return entries[-1]["version"]
        version = entries[-1]["version"] + 1 if entries else 0
        path = f"{self.root}/v{version}-{uuid.uuid4().hex}"
        more = write(path) or {}
        self._point([*entries, {"version": version, "op": op, "batch": batch, "ts_ns": time.time_ns(), "inputs": [entries[-1]["path"]] if entries else [], "params": params, "path": path, **more}])
        return version

    def entry(self, version: int | None = None) -> dict:
        found = [e for e in self.history() if version in (None, e["version"])]
        if not found:
            raise FileNotFoundError(f"{self.root} has no version {'' if version is None else version}")
        return found[-1]

    def place(self, version: int | None = None) -> str:
        return self.entry(version)["path"]

    def sweep(self, older_than: float = 86_400.0) -> int:
        """Removes what dead commits left: places and pointers aside that no entry names, last changed ``older_than`` seconds ago or more."""
        named = {e["path"].rsplit("/", 1)[-1] for e in self.history()}
        folders = [s for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("v") and s.getPath().getName() not in named]
        aside = self._path(f"{self.root}/_aside")
        folders += list(self._fs.listStatus(aside)) if self._fs.exists(aside) else []
        old = [s for s in folders if s.getModificationTime() <= (time.time() - older_than) * 1000]
        for s in old:
            self._fs.delete(s.getPath(), True)
        return len(old)


class Store(Versions):
    """One keyed table in versions."""

    def __init__(self, spark: SparkSession, root: str, key: str) -> None:
        super().__init__(spark, root)
        self.key = key

    def read(self, version: int | None = None) -> DataFrame | None:
        return self.spark.read.parquet(self.place(version)) if self.history() else None

    def commit(self, table: DataFrame, op: str, batch: str | None = None) -> int:
        """Writes the table as the next version; returns its number."""
        return self.publish(lambda path: table.write.parquet(path), op, batch)

    def apply(self, changes: DataFrame, *order: str, batch: str | None = None) -> int:
        """Folds changes (key, op, order, columns of the table) into a new version."""
        if batch is not None and any(e["batch"] == batch for e in self.history()):
            return self.history()[-1]["version"]
        base = self.read()
        if base is None:
            columns = [c for c in changes.columns if c not in ("op", *order)]
            base = changes.select(columns).limit(0)
        return self.commit(fold(base, changes, self.key, *order), "commit", batch)

    def needs_turnover(self, threshold: int) -> bool:
        """More commits since the last rebuild than the threshold; 0 never asks."""
        since = 0
        for e in reversed(self.history()):
            if e["op"] == "turnover":
                break
            since += 1
        return threshold > 0 and since > threshold

    def turnover(self) -> int:
        """The current version written anew, sorted by key."""
        return self.commit(self.read().repartitionByRange(self.key).sortWithinPartitions(self.key), "turnover")


def follow(changes: DataFrame, store: Store, *order: str, checkpoint: str) -> StreamingQuery:
    """Commits every micro-batch of a stream of changes; ends when what is there now is committed.

    Within a batch the order columns decide. Across batches later batches win, so a
    feed must bring the changes of a key in order; late ones count as new.
    """

    def each(batch: DataFrame, number: int) -> None:
        store.apply(batch, *order, batch=f"stream-{number}")

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
