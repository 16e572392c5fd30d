"""Reports over drops, slabs and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P


def inspect(drops: DataFrame, slab: str = "slab") -> DataFrame:
    """slab, n_drops, stored, plain, ratio."""
    return drops.groupBy(slab).agg(F.count("*").alias("n_drops"), F.sum("enc_len").alias("stored"), F.sum("plain_len").alias("plain")).withColumn("ratio", P.ratio(F.col("stored"), F.col("plain")))


def slab_totals(drops: DataFrame, slab: str = "slab") -> DataFrame:
    """The same with a row for the whole (slab null)."""
    return drops.rollup(slab).agg(F.count("*").alias("n_drops"), F.sum("enc_len").alias("stored"), F.sum("plain_len").alias("plain")).withColumn("ratio", P.ratio(F.col("stored"), F.col("plain")))


def slab_drops(drops: DataFrame, slab: str = "slab") -> DataFrame:
    """slab, drop_id, n_drops, stored, plain, ratio: each drop, each slab (drop_id null) and the whole (both null)."""
    out = drops.rollup(slab, "drop_id").agg(F.count("*").alias("n_drops"), F.sum("enc_len").alias("stored"), F.sum("plain_len").alias("plain"))
    return out.withColumn("ratio", P.ratio(F.col("stored"), F.col("plain")))


def gc(drops: DataFrame, slices: DataFrame) -> DataFrame:
    """total, referenced, garbage, garbage_bytes. Marks each drop by one left join with the distinct references."""
    marked = drops.join(slices.select("drop_id").distinct().withColumn("used", F.lit(1)), "drop_id", "left")
    free = F.when(F.col("used").isNull(), 1).otherwise(0)
    return marked.agg(F.count("*").alias("total"), F.count("used").alias("referenced"), F.coalesce(F.sum(free), F.lit(0)).alias("garbage"), F.coalesce(F.sum(free * F.col("enc_len")), F.lit(0)).alias("garbage_bytes"))


def statistics(measured: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, median, stdev (sample; 0 for one), largest. The median is exact."""
    return measured.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(F.col(value), 0.5).alias("median"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"), F.max(value).alias("largest"))


def bench_summary(measured: DataFrame, *keys: str) -> DataFrame:
    """keys, n, median, stdev, throughput (bytes_in a second, at the median), ratio (bytes_out of bytes_in, of the largest run), rss, of runs (seconds, bytes_in, bytes_out, rss)."""
    median = F.percentile(F.col("seconds"), 0.5)
    out = measured.groupBy(*keys).agg(F.count("*").alias("n"), median.alias("median"), F.coalesce(F.stddev_samp("seconds"), F.lit(0.0)).alias("stdev"), F.max("bytes_in").alias("bytes_in"), F.max("bytes_out").alias("bytes_out"), F.max("rss").alias("rss"))
    rate = F.when(F.col("median") > 0, F.col("bytes_in") / F.col("median")).otherwise(F.lit(0.0))
    return out.select(*keys, "n", "median", "stdev", rate.alias("throughput"), P.ratio(F.col("bytes_out"), F.col("bytes_in")).alias("ratio"), "rss")


def wins(medians: DataFrame, row: str, competitor: str, median: str = "median") -> DataFrame:
    """competitor, n_wins, n_ties: within 5 % of a row's best is a tie, the best itself a win."""
    w = Window.partitionBy(row)
    best = F.min(median).over(w)
    marked = medians.select(competitor, (F.col(median) == best).cast("int").alias("win"), ((F.abs(F.col(median) - best) / F.greatest(best, F.lit(1e-9)) < 0.05) & (F.col(median) != best)).cast("int").alias("tie"))
    return marked.groupBy(competitor).agg(F.sum("win").alias("n_wins"), F.sum("tie").alias("n_ties"))
