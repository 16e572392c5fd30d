"""Operator 7: SimHash near-duplicates by anchor points of a covering code.

A fingerprint has two halves of 32 bits. Two fingerprints that differ in at most 3
bits differ in at most 1 bit in one half. The anchors of a half are the words of the
Hamming code over its lower 31 bits, whose balls of radius 1 cover every value once.
Each distinct fingerprint goes to every anchor within covering radius plus threshold,
1 + 1 = 2: one anchor for a code word, else 16. Then each close pair meets at the
anchor that is nearest to either of the two. Per anchor the fingerprints are compared
and a tree of links is emitted for each connected part, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from . import common as C
from .components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Hashes counted at once, which bounds the memory of a very long text.
BLOCK = 65_536
#: Groups of an anchor up to this size are compared at all distances at once, larger ones outward from one member.
SMALL = 24
PLACES = np.arange(1, 32, dtype=np.uint64)
#: For each syndrome the pairs of places whose flips lead to a code word, one flip first (place and 0).
FLIPS = np.array([[0] * 16] + [[(0 if i == 0 else 1 << (i - 1)) | (0 if i ^ s == 0 else 1 << ((i ^ s) - 1)) for i in range(32) if i < i ^ s] for s in range(1, 32)], np.uint64)


def fingerprint(raw: bytes) -> int:
    """The 64-bit SimHash of the text's word shingles as a signed integer."""
    words = C.space_words(raw)
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = xxh64_digest(text, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: 1 - SHINGLE].tolist()
        hashes = b"".join([xxh64_digest(text[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)])
    each = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = sum(np.unpackbits(each[i : i + BLOCK], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(each), BLOCK))
    return int(np.packbits(2 * counts > len(each)).view(">i8")[0])


def _printer() -> Callable[[list[bytes]], list[list]]:
    return lambda texts: [[fingerprint(t) for t in texts]]


def fingerprints(rows: DataFrame, keep: tuple[str, ...], name: str = "fp") -> DataFrame:
    return C.map_texts(rows, _printer, [C.long(name)], keep)


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of the value) for all anchors of both halves of unsigned 64-bit values."""
    keys, owners = [], []
    for half in (0, 1):
        x = (values >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)
        bits = (x[:, None] >> (PLACES - np.uint64(1))) & np.uint64(1)
        syndrome = np.bitwise_xor.reduce(bits * PLACES, axis=1).astype(np.int64)
        near = x[:, None] ^ FLIPS[syndrome]
        own = np.broadcast_to(np.arange(len(values))[:, None], near.shape)
        take = np.ones(near.shape, bool)
        take[syndrome == 0, 1:] = False
        keys.append(near[take] | np.uint64(half << 32))
        owners.append(own[take])
    return np.concatenate(keys).astype(np.int64), np.concatenate(owners)


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(values), 4096):
            part = values[i : i + 4096]
            keys, owners = anchors(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[owners])], ["anchor", "fp"])


def linked(values: np.ndarray, distance: int = DISTANCE) -> list[np.ndarray]:
    """The connected parts, of two and more, of distinct unsigned values that link at ``distance`` bits or fewer.

    Works outward from a member: what it reaches leaves the rest, so a dense group costs about its size.
    """
    out, rest = [], values
    while len(rest) > 1:
        part, edge, rest = [rest[:1]], rest[:1], rest[1:]
        while len(edge) and len(rest):
            head, edge = edge[:64], edge[64:]
            hit = (np.bitwise_count(head[:, None] ^ rest[None, :]) <= distance).any(axis=0)
            if hit.any():
                part.append(rest[hit])
                edge, rest = np.concatenate([edge, rest[hit]]), rest[~hit]
        if len(part) > 1:
            out.append(np.concatenate(part))
    return out


def _trees(keys: np.ndarray, values: np.ndarray, distance: int) -> list[np.ndarray]:
    """(member, smallest member) of the connected parts of each anchor's group; rows are sorted by anchor."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    group = np.repeat(np.arange(len(starts)), sizes)
    hot = sizes > SMALL
    for lag in range(1, min(SMALL, int(sizes.max(initial=1)))):
        same = keys[lag:] == keys[:-lag]
        close = same & (np.bitwise_count(values[lag:] ^ values[:-lag]) <= distance)
        hot[group[:-lag][close]] = True
    out = []
    for g in np.flatnonzero(hot):
        for part in linked(np.unique(values[starts[g] : starts[g] + sizes[g]]), distance):
            signed = part.view(np.int64)
            least = signed.min()
            others = signed[signed != least]
            out.append(np.stack([others, np.full(len(others), least)]))
    return out


def _comparer(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys: list[np.ndarray] = []
        held_values: list[np.ndarray] = []

        def flush(keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(keys) and (found := _trees(keys, values, distance)):
                a, b = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            values = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            cut = int(np.searchsorted(keys, keys[-1]))  # the last anchor may go on in the next batch
            if cut:
                yield from flush(np.concatenate([*held_keys, keys[:cut]]), np.concatenate([*held_values, values[:cut]]))
                held_keys, held_values = [], []
            elif held_keys and held_keys[0][0] != keys[0]:
                yield from flush(np.concatenate(held_keys), np.concatenate(held_values))
                held_keys, held_values = [], []
            held_keys.append(keys[cut:])
            held_values.append(values[cut:])
        if held_keys:
            yield from flush(np.concatenate(held_keys), np.concatenate(held_values))

    return run


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b: trees of links over the distinct fingerprints (column fp) whose connected parts are those of all links."""
    spread = distinct.select("fp").mapInArrow(_to_anchors, "anchor long, fp long")
    return spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_comparer(distance), "a long, b long")


def grouped(rows: DataFrame, *ids: str) -> DataFrame:
    """fp, first: for each fingerprint of rows (ids, fp) the smallest ids of its component, as a struct.

    Written, so that a join with it by a fingerprint that very many rows share is split at run time.
    """
    with C.only_result() as keep:
        distinct = C.written(rows.groupBy("fp").agg(F.min(F.when(F.col(ids[0]).isNotNull(), F.struct(*ids))).alias("first")), "prints")
        roots = C.written(components(links(distinct)), "roots")
        linked_ = C.written(distinct.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "first"), "linked")
        least = C.written(linked_.groupBy("root").agg(F.min("first").alias("least")), "least")
        alone = distinct.join(roots, F.col("fp") == F.col("node"), "left_anti").select("fp", "first")
        return keep(C.written(alone.unionByName(linked_.join(least, "root").select("fp", F.col("least").alias("first"))), "groups"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs.

    A null text is empty; texts without words have fingerprint zero and link like any
    other. The component is the smallest non-null id reachable (null if there is none).
    Repeated rows and equal texts share one fingerprint; an empty table gives no rows.
    """
    rows = C.written(fingerprints(C.text_rows(docs, id_col, text_col), ("doc_id",)), "rows")
    found = rows.join(grouped(rows, "doc_id"), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id (null ids last), of equal ids the first as the rows were written.

    Columns stay, whatever their names. Null and empty texts have fingerprint zero and link
    like any other; an empty table stays empty.
    """
    plain, name, back = C.shielded(docs, text_col)
    found = fingerprints(plain, tuple(plain.columns)).withColumn("row", F.monotonically_increasing_id())
    found = C.written(found, "prints")
    rows = found.select(F.col(name(id_col)).isNull().cast("int").alias("none"), F.col(name(id_col)).alias("id"), "row", "fp")
    firsts = grouped(rows, "none", "id", "row").select(F.col("first.row").alias("row")).distinct()
    return back(found.join(firsts, "row", "left_semi"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))
