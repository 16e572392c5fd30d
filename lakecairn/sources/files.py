"""Tables of files from directories, byte streams and other tables."""

from __future__ import annotations

from collections.abc import Iterable
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P


def directory(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """path, size, mtime_ns, content of every file below root. A query without content reads none.

    Spark's scan leaves out files without bytes; those are listed apart, on the driver,
    which keeps no more than their names.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    base = root.rstrip("/").removeprefix("file:")
    found = reader.load(root)
    columns = [F.col("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("content")]
    every = found.select(*columns)
    if empty := _empty_files(spark, root, pattern):
        rows = [(p, 0, t * 1_000_000, bytearray()) for p, t in empty]
        every = every.unionByName(spark.createDataFrame(rows, "path string, size long, mtime_ns long, content binary"))
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), f"^\\Q{base}\\E", "")
    return every.select(P.normalise(path).alias("path"), "size", "mtime_ns", "content")


def _empty_files(spark: SparkSession, root: str, pattern: str | None) -> list[tuple[str, int]]:
    """(path, modification time in ms) of the files of no bytes."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed, out = system.listFiles(place, True), []
    while listed.hasNext():
        f = listed.next()
        if not f.getLen() and (pattern is None or fnmatch(f.getPath().getName(), pattern)):
            out.append((f.getPath().toString(), f.getModificationTime()))
    return out


def stream(spark: SparkSession, named: Iterable[tuple[str, bytes]]) -> DataFrame:
    """The same columns for named byte strings of the caller's."""
    rows = spark.createDataFrame([(n, bytearray(b)) for n, b in named], "path string, content binary")
    return rows.select(P.normalise(F.col("path")).alias("path"), F.octet_length("content").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"), "content")


def from_columns(df: DataFrame, parts: list[Column], content: Column) -> DataFrame:
    """path and content of a table whose rows stand for files: the parts become the path."""
    texts = [F.coalesce(p.cast("string"), F.lit("_")) for p in parts]
    return df.select(P.normalise(F.concat_ws("/", *texts)).alias("path"), F.coalesce(content, F.lit(b"")).alias("content"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as /{lang}/{source}/{doc_id}, with doc_id kept as file_id."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.lit(""), "lang", "source", F.col("doc_id").cast("string"))
    return df.select(F.col("doc_id").alias("file_id"), path.alias("path"), F.encode("text", "utf-8").alias("content"))


def with_attributes(files: DataFrame) -> DataFrame:
    """Adds parent, name, kind, mode and size as a writer records them: plain files, mode 0644."""
    return files.withColumns({
        "parent": P.parent(F.col("path")), "name": P.name(F.col("path")), "kind": F.lit("file"), "mode": F.lit(0o100644), "size": F.octet_length("content").cast("long"),
    })


def directories(files: DataFrame) -> DataFrame:
    """path of every directory above the files, the root included."""
    parts = F.split(F.col("path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.when(k == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, k), "/")))
    return files.select(F.explode(above).alias("path")).distinct()


def edges(files: DataFrame) -> DataFrame:
    """parent, name, child, entry_type (1 file, 2 directory); the root has no edge."""
    own = files.select(F.col("path"), F.lit(1).alias("entry_type"))
    dirs = directories(files).filter("path <> '/'").select("path", F.lit(2).alias("entry_type"))
    return own.unionByName(dirs).select(P.parent(F.col("path")).alias("parent"), P.name(F.col("path")).alias("name"), F.col("path").alias("child"), "entry_type")
