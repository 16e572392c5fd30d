"""Bloom filters over content ids."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import splitmix64
from ..sources.scratch import bounded

#: Bits of a word of a filter, as a power of two: a filter is a table of words, so it may be of any size.
WORD_BITS = 6


def bits_for(n: int, rate: float) -> int:
    return 0 if n == 0 else max(8, math.ceil(-n * math.log(rate) / math.log(2) ** 2))


def hashes_for(rate: float) -> int:
    return math.ceil(abs(math.log2(rate)))


def places(ids: list[str], bits: int, k: int) -> np.ndarray:
    """(n, k) bit numbers by double hashing of the first 16 bytes of hex ids."""
    raw = np.frombuffer(b"".join(bytes.fromhex(i[:32]) for i in ids), "<u8").reshape(-1, 2)
    with np.errstate(over="ignore"):
        turned = raw[:, 0] << np.uint64(31) | raw[:, 0] >> np.uint64(33)
        first, second = splitmix64(raw[:, 0]), splitmix64(raw[:, 1] + turned)
        return (first[:, None] + np.arange(k, dtype=np.uint64) * second[:, None]) % np.uint64(bits)


def build(ids: DataFrame, n: int, rate: float = 0.01, *, id_col: str = "drop_id") -> DataFrame:
    """word, bits: the words of the filter that have a bit, each batch's own merged by OR."""
    bits, k = bits_for(n, rate), hashes_for(rate)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.unique(places(batch.column(0).to_pylist(), bits, k))
                words, first = np.unique(at >> np.uint64(WORD_BITS), return_index=True)
                own = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64((1 << WORD_BITS) - 1)), first)
                yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(own.view(np.int64))], ["word", "bits"])

    return bounded(ids.select(id_col)).mapInArrow(local, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))


def probe(ids: DataFrame, filters: DataFrame, n: int, rate: float = 0.01, *, id_col: str = "drop_id") -> DataFrame:
    """id, maybe: false says that the id was never added. Bits meet their word of 8 bytes in a join, so the filter may be of any size."""
    bits, k = bits_for(n, rate), hashes_for(rate)
    if not bits:
        return ids.select(id_col, F.lit(False).alias("maybe"))

    @F.pandas_udf("array<long>")
    def at(own: pd.Series) -> pd.Series:
        return pd.Series(list(places(own.tolist(), bits, k).astype(np.int64)))

    asked = bounded(ids).select(id_col, F.explode(at(F.col(id_col))).alias("bit"))
    by_word = asked.withColumn("word", F.shiftright("bit", WORD_BITS)).join(filters, "word", "left")
    is_set = F.getbit(F.coalesce("bits", F.lit(0)), (F.col("bit") % (1 << WORD_BITS)).cast("int"))
    return by_word.groupBy(id_col).agg((F.min(is_set) == 1).alias("maybe"))
