"""Duplicate content: reports, shared inline content, first occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest


def report(refs: DataFrame, id_col: str = "drop_id", length: str | None = None) -> DataFrame:
    """One row: references, distinct contents, duplicates, their share, and bytes if a length is given.

    Summed by content first, so a content of a third of all references is one
    partial sum a task and no distinct set is ever held.
    """
    size = F.col(length).cast("long") if length else F.lit(0).cast("long")
    each = refs.groupBy(id_col).agg(F.count("*").alias("n"), F.max(size).alias("size"))
    total, unique = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    out = each.agg(total.alias("total_refs"), unique.alias("unique_drops"), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum("size"), F.lit(0)).alias("unique_bytes"))
    dup = F.col("total_refs") - F.col("unique_drops")
    share = F.when(F.col("total_refs") == 0, F.lit(0.0)).otherwise(dup / F.col("total_refs"))
    return out.select("total_refs", "unique_drops", dup.alias("duplicate_refs"), share.alias("duplicate_share"), "total_bytes", "unique_bytes")


def shared_inline(files: DataFrame, limit: int, *, key: str = "file_id") -> DataFrame:
    """drop_id, n_files, first_file of inline contents (at most ``limit`` bytes) of two files and more; ordinals by first file."""
    small = files.filter((F.octet_length("content") <= limit) & (F.octet_length("content") > 0))
    groups = small.groupBy(digest(F.col("content")).alias("drop_id")).agg(F.count("*").alias("n_files"), F.min(key).alias("first_file"))
    return groups.filter("n_files > 1")


def first_wins(refs: DataFrame, id_col: str, *order: str) -> DataFrame:
    """Of each content its first row in the order: a minimum for each key, no sort of the groups."""
    rest = [c for c in refs.columns if c not in (id_col, *order)]
    return refs.groupBy(id_col).agg(F.min(F.struct(*order, *rest)).alias("x")).select(id_col, "x.*")
