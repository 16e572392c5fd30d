"""Operator 6: reproducible shuffle and sharding by a Feistel permutation over global row numbers.

Rows are range-partitioned by (id, checksum, size) and numbered 0..N-1 from the
counts of the partitions, so no window runs over the whole table. The number is
written as (l, r) with l < a and r < b, a * b just over N; each round adds a keyed
hash of one half to the other, which permutes 0..a*b-1. Cycle walking applies the
permutation again while the result is N or more; how often that can be needed is
found exactly beforehand by walking the at most a + b numbers from N on. With the
place p of a row, its shard is p mod n and its slot p div n, so any row's shard and
slot can be computed from its number alone. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ROUNDS = 6
SEED = 20_260
#: Bytes that each document takes besides its text.
OVERHEAD = 16


def domain(n: int) -> tuple[int, int]:
    """a, b with n <= a * b < n + a and a near the square root."""
    a = max(2, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(2, -(-n // a))


def permuted(x: Column, a: int, b: int, seed: int = SEED, *, back: bool = False) -> Column:
    """The image of x under the permutation of 0..a*b-1 (``back``: the number it comes from).

    A fold over the rounds: as plain nested expressions each round would stand twice in the next.
    """
    rounds = F.array(*[F.lit(k) for k in (reversed(range(ROUNDS)) if back else range(ROUNDS))])

    def moved(own: Column, other: Column, k: Column, size: int) -> Column:
        key = F.pmod(F.xxhash64(other, F.lit(seed), k), F.lit(size))
        return F.pmod(own - key if back else own + key, F.lit(size))

    def one(s: Column, k: Column) -> Column:
        return F.when(k % 2 == 0, F.struct(moved(s["l"], s["r"], k, a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), moved(s["r"], s["l"], k, b).alias("r")))

    return F.aggregate(rounds, F.struct(F.pmod(x, F.lit(a)).alias("l"), ((x - F.pmod(x, F.lit(a))) / F.lit(a)).cast("long").alias("r")), one, lambda s: s["l"] + s["r"] * F.lit(a))


def walks(spark: SparkSession, n: int, seed: int = SEED) -> int:
    """The most steps that a number under n takes through numbers of n and more before it is back under n.

    Such a run begins at a number of n or more that comes from one under n; there
    are a * b - n numbers to look at, of the order of the square root of n.
    """
    a, b = domain(n)
    left = spark.range(n, a * b).filter(permuted(F.col("id"), a, b, seed, back=True) < n)
    times = 0
    while left.count():
        left = left.select(permuted(F.col("id"), a, b, seed).alias("id")).filter(F.col("id") >= n)
        times += 1
    return times


def place(x: Column, n: int, times: int, seed: int = SEED) -> Column:
    """The place of row number x of n in the shuffle; ``times`` is walks() of n."""
    if n < 2:
        return x
    a, b = domain(n)
    first = permuted(x, a, b, seed)
    if not times:
        return first
    steps = F.array(*[F.lit(0)] * times)
    return F.aggregate(steps, first, lambda p, _: F.when(p >= n, permuted(p, a, b, seed)).otherwise(p))


def numbered(rows: DataFrame, *by: str) -> tuple[DataFrame, int]:
    """rows with ``n``, their number in the order of ``by``, and the count of rows. Rows alike in ``by`` are alike in all.

    The narrow rows are written once in the shared folder with their partition and
    place; a second read adds the partitions' offsets (one row for each partition).
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by) if by else rows
    placed = C.written(dealt.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__id", 33)
    counts = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())
    offsets, total = [], 0
    for p, k in counts:
        offsets.append((p, total))
        total += k
    if not offsets:
        return placed.withColumn("n", F.col("__id")).drop("__id"), 0
    small = spark.createDataFrame(offsets, "part long, start long")
    joined = placed.join(F.broadcast(small), part == F.col("part"))
    return joined.withColumn("n", F.col("start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "part", "start"), total


def shard(docs: DataFrame, shards: int, *, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row; law ``rows``: shard counts are at most one apart.

    A null text has size OVERHEAD and checksum 0. Null and repeated ids are
    numbered like any other; rows alike in id, size and checksum may trade places.
    An empty table gives no rows; other columns are not read. ``grown_shard`` is null,
    as one more shard deals all rows anew under this law.
    """
    text = F.encode(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "utf-8")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"))
    with_number, n = numbered(rows, "doc_id", "text_crc32", "size")
    out = with_number.withColumn("p", place(F.col("n"), n, walks(docs.sparkSession, n, seed) if n > 1 else 0, seed))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("p", F.lit(shards)).cast("int").alias("shard"), F.expr(f"p div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(C.table(spark, sf_dir, "documents"), 40)
