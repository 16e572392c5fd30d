"""Content-defined chunking and the slices that put files together again.

A position is a cut if the low bits of the gear hash over the bytes since the
search began are zero. Only as many bytes as the mask has bits can matter, so one
NumPy pass by doubling gives the hash at every position; what is left of the
sequential rule is the choice of cuts among the few candidates, and the first
positions of each search, whose window is still short.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import digest, splitmix64
from ..sources.scratch import bounded

#: Fixed value: where the gear table's chain of mixed numbers begins.
GEAR_SEED = 0x0123456789ABCDEF
DEFAULT_SIZES = (65_536, 262_144, 1_048_576)


@lru_cache(maxsize=1)
def gear_table() -> np.ndarray:
    """256 numbers, each the mix of the one before; only 32 low bits are ever used."""
    out, state = [], np.array([GEAR_SEED], np.uint64)
    for _ in range(256):
        state = splitmix64(state)
        out.append(int(state[0]) & 0xFFFFFFFF)
    return np.array(out, np.uint32)


def mask_bits(size_range: int) -> int:
    return 0 if size_range == 0 else max(1, size_range.bit_length() - 1)


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash over the last 32 bytes at each position, modulo 2**32."""
    h = gear_table()[data]
    for k in (1, 2, 4, 8, 16):
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
    return h


def boundaries(raw: bytes, smallest: int, average: int, largest: int) -> list[int]:
    """Ends of the chunks, the last one the length of the content; none for no content."""
    n = len(raw)
    if n <= smallest:
        return [n] if n else []
    data = np.frombuffer(raw, np.uint8)
    bits = (mask_bits(average - smallest), mask_bits(largest - average))
    masks = [np.uint32((1 << b) - 1) for b in bits]
    h = rolling(data)
    candidates = [np.flatnonzero(h & m == 0) for m in masks]
    gear, warm, out, start = gear_table(), max(bits), [], 0
    while start < n:
        last = min(start + largest, n)
        if last - start <= smallest:
            out.append(last)
            start = last
            continue
        begin, turn = start + smallest, min(start + average, last)
        full = min(begin + warm, last)
        # The first positions: the window begins at ``begin``.
        cut, fp = 0, 0
        for i in range(begin, full):
            fp = ((fp << 1) + int(gear[data[i]])) & 0xFFFFFFFF
            if not fp & int(masks[0] if i < turn else masks[1]):
                cut = i + 1
                break
        for own, a, b in ((candidates[0], full, turn), (candidates[1], max(full, turn), last)):
            if not cut and a < b:
                k = int(np.searchsorted(own, a))
                if k < len(own) and own[k] < b:
                    cut = int(own[k]) + 1
        start = cut or last
        out.append(start)
    return out


def stream_boundaries(read: Callable[[int], bytes], smallest: int, average: int, largest: int, *, block: int = 1 << 20) -> Iterator[int]:
    """The same ends for content that comes in pieces. Holds a block and a largest chunk at most: a chunk's end depends on nothing behind its largest size."""
    held, before, more = b"", 0, True
    while more or held:
        while more and len(held) < largest + block:
            piece = read(block)
            held, more = held + piece, bool(piece)
        start = 0
        for end in boundaries(held, smallest, average, largest):
            if more and start + largest > len(held):
                break
            yield before + end
            start = end
        held, before = held[start:], before + start


def chunks(files: DataFrame, sizes: tuple[int, int, int] = DEFAULT_SIZES, *, key: str = "file_id", whole: bool = False, category: Callable[[str, bytes], str | None] | None = None) -> DataFrame:
    """key, seq, file_start, file_end, chunk for each chunk of each file; empty files have none.

    ``whole`` makes each file one chunk. ``category`` (of path and content) adds a column
    category; a file that has one is one chunk as well.
    """
    smallest, average, largest = sizes
    if not 0 < smallest <= average <= largest:
        raise ValueError("sizes must be positive and in order")
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                paths = part.column(2).to_pylist() if category else [""] * part.num_rows
                for i, raw, path in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), paths, strict=True):
                    raw = raw or b""
                    own = category(path or "", raw) if category else None
                    ends = ([len(raw)] if raw else []) if whole or own else boundaries(raw, *sizes)
                    start = 0
                    for seq, end in enumerate(ends):
                        rows.append((i, seq, start, end, raw[start:end], own))
                        start = end
                columns = list(zip(*rows, strict=True)) or [()] * 6
                types = [part.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)][: len(names)], names)

    names = [key, "seq", "file_start", "file_end", "chunk", *(["category"] if category else [])]
    more = ", category string" if category else ""
    return bounded(files).select(key, "content", *([F.col("path").alias("__path")] if category else [])).mapInArrow(run, f"{key} {kind}, seq int, file_start long, file_end long, chunk binary{more}")


def with_ids(chunked: DataFrame) -> DataFrame:
    return chunked.withColumn("drop_id", digest(F.col("chunk")))


def slices(chunked: DataFrame, key: str = "file_id") -> DataFrame:
    """The slice map: where each drop stands in its file. Needs no payload, so none is shuffled."""
    return sliced(with_ids(chunked), key)


def sliced(cut: DataFrame, key: str = "file_id") -> DataFrame:
    """The slice map of chunks that have their ids; reads no chunk of a written table."""
    return cut.select(key, "seq", "file_start", "file_end", "drop_id", F.lit(0).alias("drop_start"), (F.col("file_end") - F.col("file_start")).cast("int").alias("drop_len"))


def running_offsets(pieces: DataFrame, key: str, order: str, length: str) -> DataFrame:
    """Adds start and end of each piece from the lengths before it."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(length).over(before)
    return pieces.withColumns({"end": end, "start": end - F.col(length)})


def unique_drops(chunked: DataFrame) -> DataFrame:
    """drop_id, chunk of each distinct content; equal contents are equal bytes, so any of them serves."""
    return with_ids(chunked).groupBy("drop_id").agg(F.any_value("chunk").alias("chunk"))


Sizes = tuple[int, int, int]
Chunker = Callable[[bytes], list[int]]
