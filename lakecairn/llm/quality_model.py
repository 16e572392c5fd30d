"""Operator 8: quality classifier, hashed word n-gram logistic regression trained by FTRL-proximal updates.

Features of a text are hashed: its words, its word pairs, and n-grams (1 to 3)
over word shapes, where a word equal to the one before it has a shape of its own.
Values are log(1 + count), scaled to length 1. A score is the logistic function of
a sparse dot product with the weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Bits of the feature hash; the weights are 2**BITS floats, whatever the input.
BITS = 18
#: Labelled rows of each class that the fit may gather on the driver, and bytes of text of each row's class in all.
SAMPLE_ROWS = 2_500
SAMPLE_BYTES = 24_000_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
SHAPES = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
RUN = re.compile(rb"(.)\1+")
SAME = zlib.crc32(b"\0same")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = (keys + np.uint64(seed)) * MIX[0]
    x ^= x >> np.uint64(29)
    x *= MIX[1]
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def _features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indexes, values) of each text."""
    cut = [t.split() for t in texts]
    distinct = list({w for words in cut for w in words})
    place = dict(zip(distinct, range(len(distinct)), strict=True))
    word_hash = np.fromiter(map(zlib.crc32, distinct), np.uint64, len(distinct))
    shape_hash = np.fromiter((zlib.crc32(RUN.sub(rb"\1", w.translate(SHAPES))) for w in distinct), np.uint64, len(distinct))
    out = []
    for words in cut:
        n = len(words)
        if not n:
            out.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        at = np.fromiter(map(place.__getitem__, words), np.int64, n)
        w, s = word_hash[at], shape_hash[at].copy()
        s[1:][at[1:] == at[:-1]] = SAME
        pair = s[:-1] * MIX[2] + s[1:]
        own = np.concatenate([_mix(w, 1), _mix(w[:-1] * MIX[2] + w[1:], 2), _mix(s, 3), _mix(pair, 4), _mix(pair[:-1] * MIX[2] + s[2:], 5)])
        index, count = np.unique(own, return_counts=True)
        value = np.log1p(count)
        out.append((index, value / np.sqrt((value * value).sum())))
    return out


def train(rows: list[tuple[bytes, int]], *, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the bias last) by follow-the-regularised-leader over the rows in a fixed shuffled order."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    data = [(np.append(i, size).astype(np.int32), np.append(v, 1.0).astype(np.float32)) for at in range(0, len(rows), 256) for i, v in _features([t for t, _ in rows[at : at + 256]])]
    labels = [y for _, y in rows]
    rng = np.random.default_rng(8)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, v = data[k]
            own = z[i]
            weight = np.where(np.abs(own) <= L1, 0.0, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))
            g = (1 / (1 + np.exp(-float(weight @ v))) - labels[k]) * v
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * weight
            n[i] += g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[bytes, int]]:
    """(text, label) of at most ``rows`` training rows of each class, in the order of a hash of the id, and of at most ``max_bytes`` of text of each class.

    Training rows are those whose crc32(id as text) mod 5 is not 0. Of an id that is labelled
    twice the larger label counts. The driver gathers that bounded sample and nothing else.
    """
    ids = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y is not null").filter(C.id_remainder("id", 5) != 0)
    ids = ids.groupBy("id").agg(F.max("y").alias("y"))
    picked = [ids.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows) for y in (0, 1)]
    chosen = [(r["id"], r["y"]) for p in picked for r in p.collect()]
    if not chosen:
        return []
    small = docs.sparkSession.createDataFrame(chosen, ids.schema)
    found = C.text_rows(docs, id_col, text_col).join(F.broadcast(small), F.col("doc_id") == F.col("id"))
    # Of an id that stands in several rows, however many, the smallest text counts.
    found = C.written(found.groupBy("id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "sample")
    sizes = found.select("id", "y", F.octet_length("text").cast("long").alias("n")).collect()
    left, kept = {0: max_bytes, 1: max_bytes}, set()
    for r in sorted(sizes, key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"])):
        if r["n"] <= left[r["y"]]:
            left[r["y"]] -= r["n"]
            kept.add(r["id"])
    fitting = docs.sparkSession.createDataFrame([c for c in chosen if c[0] in kept], ids.schema)
    out = [(r["text"].encode(), r["y"], str(r["id"])) for r in found.join(F.broadcast(fitting.select("id")), "id").collect()]
    return [(t, y) for t, y, _ in sorted(out, key=lambda x: (zlib.crc32(x[2].encode()), x))]


def _scorer(weights: np.ndarray, threshold: float) -> Callable[[], Callable[[list[bytes]], list[list]]]:
    def texts_of(texts: list[bytes]) -> list[list]:
        bias = float(weights[-1])
        scores = [1 / (1 + np.exp(-(float(weights[i] @ v) + bias))) for i, v in _features(texts)]
        return [scores, [int(s >= threshold) for s in scores]]

    return lambda: texts_of


def classify(docs: DataFrame, weights: np.ndarray, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier), predicted.

    A null text is empty and gets the score of the bias alone. Repeated rows give
    repeated results, an empty table none; other columns are not read.
    """
    from pyspark.sql import types as T

    fields = [C.double("score"), T.StructField("predicted", T.IntegerType())]
    return C.map_texts(C.text_rows(docs, id_col, text_col), _scorer(weights, threshold), fields)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    scored = classify(docs, train(labelled_sample(docs, labels, "quality")))
    return scored.select("doc_id", (C.id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
