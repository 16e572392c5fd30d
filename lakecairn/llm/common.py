"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import drop_written as drop_written
from ..sources.scratch import only_result as only_result
from ..sources.scratch import written as written

#: Upper-case to lower-case for A-Z only, on UTF-8 bytes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and turns every ASCII byte outside [0-9a-z] into a space; bytes of non-ASCII characters stay.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Rows handed to a text function at once; bounds the memory beside the Arrow batch.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alnum_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return raw.translate(WORDS).split()


def space_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return raw.translate(LOWER).split()


def shielded(docs: DataFrame, text_col: str) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """docs under plain column names, the plain name of a column, and the way back to all columns of docs.

    So a column of docs may have any name: one with dots, or that of a result or of a helper
    column. The text column is ``text``; one that is no string stays beside its text.
    """
    names, own = docs.columns, docs.schema[text_col].dataType == T.StringType()
    plain = ["text" if own and c == text_col else f"c{i}" for i, c in enumerate(names)]
    place = dict(zip(names, plain, strict=True))
    out = docs.toDF(*plain)
    if not own:
        out = out.withColumn("text", F.col(place[text_col]).cast("string"))
    return out, place.__getitem__, lambda df: df.select(*plain).toDF(*names)


def give_back() -> None:
    """Returns what a task no longer uses to the system: Python workers live on and serve other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def text_rows(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the named columns, so extra columns never reach Python nor clash with results."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`") for c in more])


def map_texts(rows: DataFrame, make: Callable[[], Callable[[list[bytes]], list[list]]], fields: list[T.StructField], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One output row for each row of ``rows``: the kept columns, then what the text function returns.

    ``make`` runs once a task and returns a function from a list of UTF-8 texts
    (null as empty) to one list of values for each field.
    """
    kept = [rows.schema[c] for c in keep]
    schema = T.StructType([*kept, *fields])
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in schema]
    place = {c: i for i, c in enumerate(dict.fromkeys([*keep, "text"]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_of = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = [x or b"" for x in part.column(place["text"]).cast(pa.binary()).to_pylist()]
                out = texts_of(texts)
                del texts
                yield pa.RecordBatch.from_arrays([*(part.column(place[c]) for c in keep), *(pa.array(v, t) for v, t in zip(out, types, strict=True))], names)
                del out, part
            del batch
        del texts_of
        give_back()

    return rows.select(*[F.col(f"`{c}`") for c in place]).mapInArrow(run, schema)


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def string(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def flag(name: str) -> T.StructField:
    return T.StructField(name, T.BooleanType())


def id_remainder(col: str, modulus: int) -> F.Column:
    """crc32(id as text) mod modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(col).cast("string"), F.lit("")), "utf-8")), F.lit(modulus))
