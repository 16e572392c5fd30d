"""Directory trees: path index, lookups, listings, sizes and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import digest
from ..sources.scratch import written

#: Levels that a recursive walk may have; deeper trees are refused, not cut.
MAX_DEPTH = 4096
#: Entries of a directory from which on it is hashed in groups.
FLAT_ENTRIES = 1_000_000


def path_index(edges: DataFrame, root: Column, *, parent: str = "parent_id", child: str = "child_id", name: str = "name") -> DataFrame:
    """id, path, depth for the root and everything below it: one join a level.

    A node that is its own ancestor ends there instead of looping. The loop runs once
    for each level of the tree, over the last level only, which is written for the next.
    """
    spark = edges.sparkSession
    level = spark.range(1).select(root.alias("id"), F.lit("/").alias("path"), F.lit(0).alias("depth"), F.array(root).alias("above"))
    own = edges.select(F.col(parent).alias("p"), F.col(child).alias("c"), F.col(name).alias("n"))
    out = level
    for depth in range(1, MAX_DEPTH + 1):
        below = level.join(own, level["id"] == own["p"]).filter(~F.array_contains("above", F.col("c")))
        level = below.select(F.col("c").alias("id"), F.concat(F.when(F.col("path") == "/", "").otherwise(F.col("path")), F.lit("/"), F.col("n")).alias("path"), F.lit(depth).alias("depth"), F.concat("above", F.array("c")).alias("above"))
        level = written(level, "level")
        if level.isEmpty():
            return out.select("id", "path", "depth")
        out = out.unionByName(level)
    raise ValueError(f"the tree is deeper than {MAX_DEPTH}")


def path_index_sql(edges_view: str, root: str) -> str:
    """The same as a recursive common table expression, for trees within Spark's recursion limits."""
    return f"""
        WITH RECURSIVE walk(id, path, depth) AS (
          SELECT CAST({root} AS BIGINT), CAST('/' AS STRING), 0
          UNION ALL
          SELECT e.child_id, CONCAT(CASE WHEN w.path = '/' THEN '' ELSE w.path END, '/', e.name), w.depth + 1
          FROM walk w JOIN {edges_view} e ON e.parent_id = w.id
        ) SELECT id, path, depth FROM walk"""


def resolve(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (path) with the id of each path, null where there is none."""
    return wanted.join(index.select("path", "id"), "path", "left")


def listing(edges: DataFrame, directory: str) -> DataFrame:
    """name, entry_type of one directory, by name. A pushed-down filter, no walk."""
    return edges.filter(F.col("parent") == directory).select("name", "entry_type").orderBy("name")


def stat(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path).select("path", "kind", "mode", "size")


def directory_sizes(files: DataFrame) -> DataFrame:
    """path, n_files, bytes of every directory with all below it; sums before the shuffle, no content read."""
    parts = F.split(F.col("path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.when(k == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, k), "/")))
    return files.select(F.explode(above).alias("path"), "size").groupBy("path").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def entry_hash(name: Column, entry_type: Column, child_hash: Column) -> Column:
    return F.concat(name, F.lit(":"), entry_type.cast("string"), F.lit(":"), child_hash)


def directory_hashes(leaves: DataFrame, levels: int, *, flat: int = FLAT_ENTRIES) -> DataFrame:
    """path, node_hash of every directory from leaves (path, node_hash), bottom-up, ``levels`` directories deep.

    A directory's hash is that of its entries sorted by name. Of a directory with more than
    ``flat`` entries it is that of their groups (by the first 3 digits of the name's digest, one
    hash each), so no task sorts more than a group. One aggregation a level, and a small one for such.
    """
    from ..functions import paths as P

    done, now = None, leaves.select("path", "node_hash", F.lit(1).alias("entry_type"))

    def hashed(entries: DataFrame, *keys: str) -> DataFrame:
        sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("name", "entry"))), lambda x: x["entry"])
        return entries.groupBy(*keys).agg(digest(F.array_join(sorted_, "\n")).alias("node_hash"))

    for _ in range(levels):
        name = P.name(F.col("path"))
        entries = now.select(P.parent(F.col("path")).alias("dir"), name.alias("name"), entry_hash(name, F.col("entry_type"), F.col("node_hash")).alias("entry"))
        large = entries.groupBy("dir").count().filter(F.col("count") > flat).select("dir", F.lit(True).alias("large"))
        group = F.when(F.col("large"), F.substring(digest(F.col("name").cast("binary")), 1, 3)).otherwise("")
        first = hashed(entries.join(large, "dir", "left").withColumn("group", group), "dir", "group")
        second = first.filter("group <> ''").select("dir", F.col("group").alias("name"), F.concat("group", F.lit(":"), "node_hash").alias("entry"))
        now = first.filter("group = ''").select("dir", "node_hash").unionByName(hashed(second, "dir"))
        now = now.select(F.col("dir").alias("path"), "node_hash", F.lit(2).alias("entry_type"))
        done = now if done is None else done.unionByName(now)
    return done.select("path", "node_hash")


def numbering(files: DataFrame, by: str = "path") -> DataFrame:
    """Adds inode: dense numbers from 1 in the order of the path, which must be unique.

    The paths alone are dealt by range and written; partitions are counted and the offsets
    added, so no single task sees all rows, and contents move only in the join with the numbers.
    """
    placed = written(files.select(by).repartitionByRange(by).sortWithinPartitions(by).withColumn("__id", F.monotonically_increasing_id()), "numbers")
    part = F.shiftright("__id", 33)
    counts = placed.groupBy(part.alias("part")).count()
    start = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", F.coalesce(start, F.lit(0)).alias("start"))
    numbers = placed.join(F.broadcast(offsets), part == F.col("part")).select(by, (F.col("start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("inode"))
    return files.join(numbers, by).select(*files.columns, "inode")


def violations(edges: DataFrame, files: DataFrame) -> DataFrame:
    """rule, n: how many rows break each structural rule; all zero for a sound tree."""
    bad_name = edges.filter((F.length("name") == 0) | F.col("name").contains("/") | F.col("name").contains("\0"))
    twice = edges.groupBy("parent", "name").count().filter("count > 1")
    orphans = edges.filter("parent <> '/'").join(edges.select(F.col("child").alias("parent")), "parent", "left_anti")
    missing = edges.filter("entry_type = 1").join(files.select(F.col("path").alias("child")), "child", "left_anti")
    out = None
    for rule, df in (("bad_name", bad_name), ("duplicate_name", twice), ("orphan", orphans), ("missing_file", missing)):
        one = df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out
