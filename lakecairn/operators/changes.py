"""Versions of keyed tables: diff, overlay, change folds, epochs and history."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import digest
from ..sources.scratch import bounded

#: Rows that replay() returns together.
ROWS_AT_ONCE = 10_000

# Operations of an epoch.
EPOCH_OPS = {"add": 0, "remove": 1, "modify": 2, "chmod": 3, "rename": 4, "mkdir": 5, "rmdir": 6}


def diff(parent: DataFrame, child: DataFrame, key: str, content: Column) -> DataFrame:
    """key, op: A added, R removed, M content differs. One full outer join on the key."""
    a = parent.select(F.col(key).alias("ka"), content.alias("ca"))
    b = child.select(F.col(key).alias("kb"), content.alias("cb"))
    both = a.join(b, F.col("ka") == F.col("kb"), "full_outer")
    op = F.when(F.col("ka").isNull(), "A").when(F.col("kb").isNull(), "R").when(~F.col("ca").eqNullSafe(F.col("cb")), "M")
    return both.select(F.coalesce("ka", "kb").alias(key), op.alias("op")).filter("op is not null")


def tree_diff(parent: DataFrame, child: DataFrame, content: Column) -> DataFrame:
    """path, op over trees (path of files and directories, entry_type): nothing below an added or removed directory is listed.

    A directory on both sides is never M; a change of type is.
    """
    a = parent.select(F.col("path").alias("pa"), F.col("entry_type").alias("ta"), content.alias("ca"))
    b = child.select(F.col("path").alias("pb"), F.col("entry_type").alias("tb"), content.alias("cb"))
    both = a.join(b, F.col("pa") == F.col("pb"), "full_outer")
    changed = (F.col("ta") != F.col("tb")) | ((F.col("ta") == 1) & ~F.col("ca").eqNullSafe(F.col("cb")))
    op = F.when(F.col("pa").isNull(), "A").when(F.col("pb").isNull(), "R").when(changed, "M")
    ops = both.select(F.coalesce("pa", "pb").alias("path"), F.coalesce("ta", "tb").alias("entry_type"), op.alias("op")).filter("op is not null")
    above = ops.filter("entry_type = 2 and op <> 'M' or op = 'M'").select(F.col("path").alias("dir"), F.col("op").alias("dir_op"))
    parts = F.split(F.col("path"), "/")
    ups = ops.select("path", "op", F.explode(F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))).alias("dir"))
    hidden = ups.join(above, "dir").select("path", "op").distinct()
    return ops.select("path", "op").join(hidden, ["path", "op"], "left_anti")


def overlay(layers: DataFrame, key: str, layer: str) -> DataFrame:
    """The row of the highest layer for each key; a maximum for each key, combined before the shuffle."""
    rest = [c for c in layers.columns if c not in (key, layer)]
    return layers.groupBy(key).agg(F.max(F.struct(layer, *rest)).alias("x")).select(key, "x.*")


def union_locators(layers: DataFrame, key: str, layer: str, locators: str) -> DataFrame:
    """key, locators: those of all layers, in layer order, each once."""
    each = layers.select(key, layer, F.posexplode(locators).alias("pos", "uri")).groupBy(key, "uri").agg(F.min(F.struct(layer, "pos")).alias("first"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "uri"))), lambda x: x["uri"]).alias(locators))


def last_changes(changes: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key its last change."""
    rest = [c for c in changes.columns if c not in (key, *order)]
    return changes.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("x")).select(key, "x.*")


def fold(base: DataFrame, changes: DataFrame, key: str, *order: str, op: str = "op") -> DataFrame:
    """base after the changes: last change wins; ``delete`` removes, ``add`` and ``update`` set the row."""
    columns = [c for c in base.columns if c != key]
    last = last_changes(changes, key, *order).select(F.col(key).alias("__k"), F.col(op).alias("__op"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = base.join(last, F.col(key) == F.col("__k"), "full_outer").filter("__op is null or __op <> 'delete'")
    return both.select(F.coalesce(key, "__k").alias(key), *[F.when(F.col("__op").isNull(), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in columns])


def refused(base: DataFrame, changes: DataFrame, key: str, *order: str, op: str = "op") -> DataFrame:
    """Updates and deletes of a key that is neither in the base nor added before; an earlier delete makes it unknown again."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(op).over(w)
    known = base.select(F.col(key).alias("__k"))
    joined = changes.withColumn("__before", before).join(known, F.col(key) == F.col("__k"), "left")
    there = F.when(F.col("__before").isNull(), F.col("__k").isNotNull()).otherwise(F.col("__before") != "delete")
    return joined.filter(F.col(op).isin("update", "delete") & ~there).drop("__before", "__k")


def history(entries: DataFrame) -> DataFrame:
    """seq, op, ts (seconds), n_inputs, param_bytes."""
    return entries.select("seq", "op", F.floor(F.col("ts_ns") / 1_000_000_000).alias("ts"), F.size("inputs").alias("n_inputs"), F.octet_length("params").alias("param_bytes")).orderBy("seq")


def epoch_id(parent: Column, sequence: Column, ops_hash: Column) -> Column:
    return digest(F.concat_ws("|", parent, sequence.cast("string"), ops_hash))


def chained(ops: DataFrame, chain: str, *order: str, ops_hash: str = "ops_hash") -> DataFrame:
    """chain, sequence (from 1), parent_id ("0" first), ops_hash, epoch_id for the operations of each chain in order.

    Every id covers the one before, so a chain is a walk; it keeps one id, however long it is.
    """
    kind = ops.schema[chain].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sequence, parent = None, 0, "0"
        for batch in batches:
            keys, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            numbers, parents, ids = [], [], []
            for key, own in zip(keys, hashes, strict=True):
                if sequence == 0 or key != now:
                    now, sequence, parent = key, 0, "0"
                sequence += 1
                made = hashlib.sha256(f"{parent}|{sequence}|{own}".encode()).hexdigest()
                numbers.append(sequence)
                parents.append(parent)
                ids.append(made)
                parent = made
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64()), pa.array(parents, pa.string()), batch.column(1), pa.array(ids, pa.string())], [chain, "sequence", "parent_id", "ops_hash", "epoch_id"])

    rows = ops.repartition(chain).sortWithinPartitions(chain, *order).select(chain, F.col(ops_hash).alias("ops_hash"))
    return rows.mapInArrow(run, f"{chain} {kind}, sequence long, parent_id string, ops_hash string, epoch_id string")


def verify_chain(epochs: DataFrame, *, chain: str | None = None) -> DataFrame:
    """epochs with ``sound``: numbered one after another, each naming the id before it, each id as computed.

    Each epoch meets the one before it in a join on the number (and the chain, if there are
    several), so a chain of any length is checked in parallel. Of epochs with one number none is sound.
    """
    keys = [chain] if chain else []
    numbered = epochs.groupBy(*keys, "sequence").agg(F.count("*").alias("__n"), F.min("epoch_id").alias("__id"))
    before = numbered.select(*keys, (F.col("sequence") + 1).alias("sequence"), F.col("__n").alias("__before_n"), F.col("__id").alias("__before"))
    least = F.broadcast(epochs.agg(F.min("sequence").alias("__first"))) if not chain else epochs.groupBy(chain).agg(F.min("sequence").alias("__first"))
    joined = epochs.join(numbered.drop("__id"), [*keys, "sequence"]).join(before, [*keys, "sequence"], "left")
    joined = joined.join(least, chain) if chain else joined.crossJoin(least)
    follows = F.coalesce((F.col("__before_n") == 1) & (F.col("__before") == F.col("parent_id")), F.lit(False))
    ok = (epoch_id(F.col("parent_id"), F.col("sequence"), F.col("ops_hash")) == F.col("epoch_id")) & (F.col("__n") == 1) & ((F.col("sequence") == F.col("__first")) | follows)
    return joined.withColumn("sound", F.coalesce(ok, F.lit(False))).select(*epochs.columns, "sound")


def replay(ops: DataFrame, root: str = "root") -> DataFrame:
    """root, path, kind, drop_id, mode after all operations (root, epoch, pos, op, path, to, drop_id, mode) of each root in order.

    Renames tie paths together, so a root's operations run one after another; roots
    run in parallel. Without renames last_changes() needs no Python.
    """
    out = f"{root} {ops.schema[root].dataType.simpleString()}, path string, kind string, drop_id string, mode int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, under, rows, kinds = None, {}, {}, [], None

        def done() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [root, "path", "kind", "drop_id", "mode"])

        for batch in batches:
            kinds = [batch.schema.types[0], pa.string(), pa.string(), pa.string(), pa.int32()]
            for key, *op in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    rows += [(now, p, *v) for p, v in state.items()]
                    if len(rows) >= ROWS_AT_ONCE:
                        yield done()
                        rows.clear()
                    now, state, under = key, {}, {}
                _apply(state, *op, under)
        rows += [(now, p, *v) for p, v in state.items()]
        for at in range(0, len(every := rows), ROWS_AT_ONCE):
            rows = every[at : at + ROWS_AT_ONCE]
            yield done()

    placed = bounded(ops).select(root, "epoch", "pos", "op", "path", "to", "drop_id", "mode").repartition(root).sortWithinPartitions(root, "epoch", "pos")
    return placed.select(root, "op", "path", "to", "drop_id", "mode").mapInArrow(run, out)


class EpochError(ValueError):
    pass


def _apply(state: dict[str, tuple], op: str, path: str, to: str | None, drop_id: str | None, mode: int | None, under: dict[str, int] | None = None) -> None:
    """One operation. ``under`` has the count of paths below each path and is kept up to date; with it, only renames of what has any look through the state."""
    below = [p for p in state if p.startswith(path + "/")] if op in ("remove", "rmdir", "rename") and (under is None or under.get(path)) else []
    if op in ("add", "mkdir"):
        if path in state:
            raise EpochError(f"{op}: {path} exists")
        state[path] = ("file" if op == "add" else "dir", drop_id if op == "add" else None, mode)
        _count(under, path, 1)
        return
    if path not in state:
        raise EpochError(f"{op}: no {path}")
    kind, old_id, old_mode = state[path]
    if op == "modify":
        state[path] = (kind, drop_id, old_mode)
    elif op == "chmod":
        state[path] = (kind, old_id, mode)
    elif op in ("remove", "rmdir"):
        if below:
            raise EpochError(f"{op}: {path} is not empty")
        del state[path]
        _count(under, path, -1)
    elif op == "rename":
        if to is None or to in state:
            raise EpochError(f"rename: {to} exists")
        for p in [path, *below]:
            state[to + p[len(path) :]] = state.pop(p)
            _count(under, p, -1)
            _count(under, to + p[len(path) :], 1)
    else:
        raise EpochError(f"unknown operation {op}")


def _count(under: dict[str, int] | None, path: str, n: int) -> None:
    if under is not None:
        while (cut := path.rfind("/")) >= 0:
            path = path[:cut]
            under[path] = under.get(path, 0) + n
