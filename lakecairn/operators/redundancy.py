"""Secret sharing, erasure codes and encryption of payloads."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import bounded

#: Fixed value: the field's polynomial, x^8 + x^4 + x^3 + x + 1.
POLYNOMIAL = 0x11B


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers and logarithms to the generator 3."""
    power, log, x = np.zeros(510, np.uint8), np.zeros(256, np.int64), 1
    for i in range(255):
        power[i] = power[i + 255] = x
        log[x] = i
        x ^= x << 1
        if x > 255:
            x ^= POLYNOMIAL
    return power, log


def multiply(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    power, log = _tables()
    a, b = np.asarray(a, np.uint8), np.asarray(b, np.uint8)
    return np.where((a == 0) | (b == 0), np.uint8(0), power[log[a] + log[b]])


def inverse(a: int) -> int:
    if not a:
        raise ZeroDivisionError("0 has no inverse")
    power, log = _tables()
    return int(power[255 - log[a]])


def matrix_multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((a.shape[0], b.shape[1]), np.uint8)
    for k in range(a.shape[1]):
        out ^= multiply(a[:, k : k + 1], b[k : k + 1])
    return out


def matrix_inverse(m: np.ndarray) -> np.ndarray:
    n = len(m)
    work = np.concatenate([m.astype(np.uint8), np.eye(n, dtype=np.uint8)], axis=1)
    for i in range(n):
        at = i + int(np.argmax(work[i:, i] != 0))
        if not work[at, i]:
            raise ValueError("the matrix has no inverse")
        work[[i, at]] = work[[at, i]]
        work[i] = multiply(work[i], inverse(int(work[i, i])))
        for j in range(n):
            if j != i and work[j, i]:
                work[j] ^= multiply(work[i], int(work[j, i]))
    return work[:, n:]


@lru_cache(maxsize=64)
def generator(k: int, m: int) -> np.ndarray:
    """(k + m) x k, the identity above: any k of its rows have an inverse."""
    if k < 1 or m < 0 or k + m > 255:
        raise ValueError("1 <= k, 0 <= m, k + m <= 255")
    rows = np.zeros((k + m, k), np.uint8)
    for i in range(k + m):
        value = 1
        for j in range(k):
            rows[i, j] = value
            value = int(multiply(np.uint8(value), i))
    return matrix_multiply(rows, matrix_inverse(rows[:k]))


def split_shards(raw: bytes, k: int, m: int) -> list[bytes]:
    """k data shards (zero-padded) and m parity shards of equal length."""
    size = -(-len(raw) // k) if raw else 0
    data = np.frombuffer(raw.ljust(size * k, b"\0"), np.uint8).reshape(k, size)
    return [x.tobytes() for x in matrix_multiply(generator(k, m), data)]


def join_shards(shards: dict[int, bytes], k: int, m: int, length: int) -> bytes:
    """The content from any k shards by number."""
    if len(shards) < k:
        raise ValueError(f"{len(shards)} shards, {k} needed")
    rows = sorted(shards)[:k]
    if len({len(shards[r]) for r in rows}) > 1:
        raise ValueError("shards differ in length")
    data = np.stack([np.frombuffer(shards[r], np.uint8) for r in rows])
    return matrix_multiply(matrix_inverse(generator(k, m)[rows]), data).tobytes()[:length]


def erasure_encode(df: DataFrame, k: int, m: int, *, key: str, content: str = "content") -> DataFrame:
    """key, length, shard, data: k + m rows for each row."""

    @F.pandas_udf("array<binary>")
    def encode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: split_shards(r or b"", k, m))

    return bounded(df).select(key, F.coalesce(F.octet_length(content), F.lit(0)).alias("length"), F.posexplode(encode(F.col(content))).alias("shard", "data"))


def erasure_repair(shards: DataFrame, k: int, m: int, *, key: str) -> DataFrame:
    """key, content from the shards that are left; fewer than k are an error. A group is one stripe, at most k + m rows."""
    grouped = bounded(shards).groupBy(key, "length").agg(F.map_from_entries(F.collect_list(F.struct(F.col("shard").cast("int"), "data"))).alias("own"))

    @F.pandas_udf("binary")
    def decode(own: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([join_shards({int(i): bytes(b) for i, b in (o.items() if isinstance(o, dict) else o)}, k, m, int(n)) for o, n in zip(own, length, strict=True)], dtype=object)

    return grouped.select(key, decode(F.col("own"), F.col("length")).alias("content"))


def missing_shards(shards: DataFrame, k: int, m: int, *, key: str) -> DataFrame:
    """The lost shards themselves, computed anew."""
    whole = erasure_encode(erasure_repair(shards, k, m, key=key), k, m, key=key)
    return whole.join(shards.select(key, "shard"), [key, "shard"], "left_anti")


def share(secret: bytes, k: int, n: int, seed: bytes) -> list[bytes]:
    """n shares of which any k give the secret: the share's number, then a value for each byte.

    Coefficients come from a SHA-256 stream of the seed, which must be secret and random.
    """
    return share_many([secret], k, n, [seed])[0]


def share_many(secrets: list[bytes], k: int, n: int, seeds: list[bytes]) -> list[list[bytes]]:
    """The shares of each secret by its own seed; the bytes of all of them are computed together."""
    import hashlib

    if not 2 <= k <= n <= 255 or not all(secrets):
        raise ValueError("2 <= k <= n <= 255 and a secret are needed")
    streams: list[list[bytes]] = [[] for _ in range(k - 1)]
    for secret, seed in zip(secrets, seeds, strict=True):
        size = len(secret)
        stream = b"".join([hashlib.sha256(seed + i.to_bytes(8, "big")).digest() for i in range(-(-(k - 1) * size // 32))])
        for i, own in enumerate(streams):
            own.append(stream[i * size : (i + 1) * size])
    rows = [np.frombuffer(b"".join(x), np.uint8) for x in (secrets, *streams)]
    values = []
    for x in range(1, n + 1):
        value = np.zeros(len(rows[0]), np.uint8)
        for row in reversed(rows):
            value = multiply(value, x) ^ row
        values.append((bytes([x]), value.tobytes()))
    out, at = [], 0
    for secret in secrets:
        out.append([x + value[at : at + len(secret)] for x, value in values])
        at += len(secret)
    return out


@lru_cache(maxsize=4096)
def _weights(xs: bytes) -> tuple[int, ...]:
    """Of shares with these numbers the factor of each at zero."""
    if len(set(xs)) != len(xs) or 0 in xs:
        raise ValueError("shares must be distinct and of one length")
    out = []
    for own in xs:
        weight = 1
        for x in xs:
            if x != own:
                weight = int(multiply(np.uint8(multiply(np.uint8(weight), x)), inverse(x ^ own)))
        out.append(weight)
    return tuple(out)


def combine(shares: list[bytes]) -> bytes:
    """The secret, by interpolation at zero."""
    return combine_many([shares])[0]


def combine_many(groups: list[list[bytes]]) -> list[bytes]:
    """The secret of each group of shares; groups of one count of shares are computed together."""
    out = [b""] * len(groups)
    for count in {len(g) for g in groups}:
        own = [i for i, g in enumerate(groups) if len(g) == count]
        if any(len({len(s) for s in groups[i]}) != 1 for i in own):
            raise ValueError("shares must be distinct and of one length")
        sizes = np.array([len(groups[i][0]) - 1 for i in own])
        weights = np.array([_weights(bytes([s[0] for s in groups[i]])) for i in own], np.uint8)
        total = np.zeros(int(sizes.sum()), np.uint8)
        for j in range(count):
            total ^= multiply(np.frombuffer(b"".join([groups[i][j][1:] for i in own]), np.uint8), np.repeat(weights[:, j], sizes))
        raw, at = total.tobytes(), 0
        for i, size in zip(own, sizes.tolist(), strict=True):
            out[i] = raw[at : at + size]
            at += size
    return out


def share_rows(df: DataFrame, k: int, n: int, seed: bytes, *, key: str, secret: str) -> DataFrame:
    """key, share for n shares of each secret."""

    @F.pandas_udf("array<binary>")
    def split(keys: pd.Series, secrets: pd.Series) -> pd.Series:
        return pd.Series(share_many([bytes(s) for s in secrets], k, n, [seed + str(i).encode() for i in keys]), dtype=object)

    return bounded(df).select(key, F.explode(split(F.col(key).cast("string"), F.col(secret))).alias("share"))


def combine_rows(shares: DataFrame, *, key: str) -> DataFrame:
    """key, secret; a group is one secret's shares."""

    @F.pandas_udf("binary")
    def join(own: pd.Series) -> pd.Series:
        return pd.Series(combine_many([[bytes(x) for x in s] for s in own]), dtype=object)

    return bounded(shares).groupBy(key).agg(F.collect_list("share").alias("own")).select(key, join(F.col("own")).alias("secret"))


def seal(content: Column, key: Column, nonce: Column, associated: Column) -> Column:
    """AES-256-GCM with nonce and tag beside the ciphertext; built in, no Python."""
    return F.aes_encrypt(content, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, associated)


def open_sealed(sealed: Column, key: Column, associated: Column) -> Column:
    """The content; a wrong key, tag or associated data is an error."""
    return F.aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), associated)
