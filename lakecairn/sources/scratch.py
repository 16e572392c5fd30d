"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Tables of written() and their folders' names, the latest last.
WRITTEN: list[tuple[DataFrame, str]] = []

#: Bytes of contents that go to Python at once, in place of Spark's 64 MB: a worker holds a batch several times over.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df itself; Arrow batches of its session have about BATCH_BYTES from now on if nobody has set another size."""
    name, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if not spark._jsparkSession.conf().contains(name):
        spark.conf.set(name, BATCH_BYTES)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        set_by_call = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_by_call.get() if set_by_call.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lakecairn-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    WRITTEN.append((out, path.rsplit("/", 1)[-1]))
    return out


def drop_written(df: DataFrame) -> None:
    """Removes the files of a table of written() that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def only_result() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes the tables that written() made inside the block, but for those that the given function was handed."""
    start, kept = len(WRITTEN), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    yield keep
    left = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for df in kept for f in df.inputFiles()}
    for df, name in WRITTEN[start:]:
        if name not in left:
            drop_written(df)
    WRITTEN[start:] = [x for x in WRITTEN[start:] if x[1] in left]
