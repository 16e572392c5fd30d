"""A dataset image: a directory tree stored as files, slices and drops in versions.

Contents of at most the profile's inline threshold stand in a table of their own, each
once, however many files share it; larger files are chunked, deduplicated, classified,
encoded and packed into slabs. A version is its own files and slices, which hold no
contents, and lists of folders of drops and inline contents, most of them written by
earlier commits; it is published by adding one pointer.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import paths as P
from .functions.hashing import digest
from .operators import changes, dedup, reports, storage, tree
from .operators.cache import DropCache
from .plans.config import Profile, select
from .sources import files as S
from .sources.scratch import only_result, written
from .streaming.store import Versions


#: Tables that hold contents: a version lists the folders of each.
PAYLOADS = ("drops", "inline", "dictionaries")


class ImageError(ValueError):
    pass


class Image(Versions):
    # Building

    def build(self, files: DataFrame, profile: Profile | str = "balanced", op: str = "build", *, base: Image | None = None) -> int:
        """Publishes files (path, mtime_ns, content). With a base, drops that it has are not stored again."""
        profile = select(profile) if isinstance(profile, str) else profile

        def write(root: str) -> dict:
            plain = _attributed(files)
            _rows(plain, profile).write.parquet(f"{root}/files")
            _contents(plain, profile).write.parquet(f"{root}/inline")
            self._store(plain, self.spark.read.parquet(f"{root}/files"), profile, root, base=base.drops() if base else None)
            if base:
                storage.references(self.spark.read.parquet(f"{root}/slices"), base.drops()).write.parquet(f"{root}/references")
            return {**self._entry(root), "layer": base is not None}

        return self.publish(write, op, params=profile.name)

    def _store(self, plain: DataFrame, ids: DataFrame, profile: Profile, root: str, *, base: DataFrame | None = None, first_slab: int = 0) -> None:
        """Slices, drops and dictionaries of the files above the inline threshold, written below root; ids are rows of the files table."""
        large = plain.filter(F.col("size") > profile.inline_threshold)
        dictionaries = (profile.max_dict_size, profile.min_class_size) if profile.dictionaries else None
        with only_result():
            made = storage.build(large, profile.sizes, profile.tournament(), whole=profile.whole_files, dictionaries=dictionaries, special=not profile.whole_files, base=base, ids=ids)
            made["drops"] = made["drops"].withColumn("slab", F.col("slab") + first_slab)
            storage.write(made, root)

    def _entry(self, root: str, before: dict | None = None, new: str | None = None) -> dict:
        """What the history keeps of a version: the folders of its payloads (those of an earlier entry and those below new) and its root hash."""
        folders = {name: [*(before[name] if before else []), f"{new or root}/{name}"] for name in PAYLOADS}
        read = self.spark.read.parquet
        return {**folders, "root": _root(read(f"{root}/files"), read(f"{root}/slices"), read(*folders["drops"]))}

    # Tables

    def files(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.place()}/files")

    def slices(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.place()}/slices")

    def drops(self) -> DataFrame:
        return self.spark.read.parquet(*self.entry()["drops"])

    def inline(self) -> DataFrame:
        """content_id, content of the inline contents."""
        return self.spark.read.parquet(*self.entry()["inline"])

    def references(self) -> DataFrame:
        """Rows of drops for what a layer takes from its base (the sentinel codec, no payload); none for an image that stands alone."""
        if not self.entry().get("layer"):
            return self.drops().limit(0)
        return self.spark.read.parquet(f"{self.place()}/references")

    def dictionaries(self) -> DataFrame:
        return self.spark.read.parquet(*self.entry()["dictionaries"])

    def edges(self) -> DataFrame:
        return S.edges(self.files().select("path"))

    # Reading

    def contents(self, files: DataFrame | None = None, *, base: Image | None = None) -> DataFrame:
        """path, mtime_ns, content of the files (all of them, or some rows of files())."""
        files = self.files() if files is None else files
        drops = self.drops() if base is None else self.drops().unionByName(base.drops())
        dictionaries = self.dictionaries() if base is None else self.dictionaries().unionByName(base.dictionaries())
        large = files.filter("not inline").select("file_id", F.struct("file_id", "path", "mtime_ns").alias("file"))
        read = storage.read_files(self.slices().join(large, "file_id"), drops, key="file", dictionaries=dictionaries)
        small = files.filter("inline").join(self.inline(), "content_id").select("path", "mtime_ns", "content")
        return small.unionByName(read.select("file.path", "file.mtime_ns", "content"))

    def ls(self, path: str = "/") -> DataFrame:
        if path != "/" and not self.edges().filter((F.col("child") == path) & (F.col("entry_type") == 2)).head(1):
            raise ImageError(f"{path} is no directory")
        return tree.listing(self.edges(), path)

    def stat(self, path: str) -> DataFrame:
        return tree.stat(self.files(), path)

    def tree(self) -> DataFrame:
        """path, depth, entry_type of all entries, by path."""
        return self.edges().select(F.col("child").alias("path"), P.depth(F.col("child")).alias("depth"), "entry_type").orderBy("path")

    def cat(self, path: str, offset: int = 0, length: int | None = None) -> bytes:
        row = self.cat_multi([path], offset, length).head()
        if row is None:
            raise ImageError(f"no file {path}")
        return bytes(row["content"])

    def cat_multi(self, wanted: DataFrame | Iterable[str], offset: int = 0, length: int | None = None) -> DataFrame:
        """path, content of some files in one pass; slices outside the range are never joined.

        ``wanted`` is a table with a column path, of any size, or a short list of paths.
        A path wanted more than once is read once, one that is no file not at all.
        """
        if isinstance(wanted, DataFrame):
            files = self.files().join(wanted.select("path"), "path", "left_semi")
        else:
            files = self.files().filter(F.col("path").isin(*wanted))
        if length is None:
            return self.contents(files).select("path", P.byte_range(F.col("content"), F.lit(offset), F.lit(None)).alias("content"))
        small = files.filter("inline").join(self.inline(), "content_id").select("path", P.byte_range(F.col("content"), F.lit(offset), F.lit(length)).alias("content"))
        large = files.filter("not inline").select("file_id", "path")
        part = storage.read_range(self.slices().join(large.select("file_id"), "file_id", "left_semi"), self.drops(), offset, length, dictionaries=self.dictionaries())
        return small.unionByName(large.join(part, "file_id", "left").select("path", F.coalesce("content", F.lit(b"")).alias("content")))

    def extract(self, target: str) -> int:
        """Writes every file below the target URI, which all executors must reach; any failure fails the job."""
        uri = target if "://" in target else f"file://{target}"

        def run(batches):  # noqa: ANN001, ANN202
            from pyarrow import fs

            system, root = fs.FileSystem.from_uri(uri)
            for batch in batches:
                for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if ".." in path.split("/"):
                        raise ImageError(f"{path} leaves the target")
                    at = f"{root.rstrip('/')}{path}"
                    system.create_dir(at.rpartition("/")[0])
                    with system.open_output_stream(at) as out:
                        out.write(raw)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

        return self.contents().select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    def reachable(self) -> DataFrame:
        """drop_id of every drop that the tree needs."""
        return self.slices().select("drop_id").distinct()

    def reader(self, capacity: int = 256) -> DropCache:
        """For repeated point reads from the driver: decoded drops, the least recently used go first."""
        return DropCache(lambda ids: {r["drop_id"]: bytes(r["chunk"]) for r in storage.plain(self.drops().filter(F.col("drop_id").isin(*ids)), self.dictionaries()).select("drop_id", "chunk").collect()}, capacity)

    # Reports

    def inspect(self) -> DataFrame:
        return reports.inspect(self.drops())

    def summary(self) -> DataFrame:
        """One row: n_files, n_dirs, n_drops, n_slabs, stored, plain, ratio."""
        totals = self.drops().agg(F.coalesce(F.sum("enc_len"), F.lit(0)).alias("stored"), F.coalesce(F.sum("plain_len"), F.lit(0)).alias("plain"))
        one = F.lit(1).alias("k")
        return self.counters().select(one, "*").join(totals.select(one, "*"), "k").drop("k").withColumn("ratio", P.ratio(F.col("stored"), F.col("plain")))

    def slab(self) -> DataFrame:
        """A row for each drop, for each slab and for the whole."""
        return reports.slab_drops(self.drops())

    def gc(self) -> DataFrame:
        return reports.gc(self.drops(), self.slices())

    def dedup(self) -> DataFrame:
        """Drop references and inline contents together."""
        refs = self.slices().select("drop_id", "drop_len").unionByName(self.files().filter("inline").select(F.col("content_id").alias("drop_id"), F.col("size").cast("int").alias("drop_len")))
        return dedup.report(refs, length="drop_len")

    def counters(self) -> DataFrame:
        """n_files, n_dirs, n_drops, n_slabs; an image of no files has its root and nothing else."""
        f = self.edges().agg(F.count_if(F.col("entry_type") == 1).alias("n_files"), (F.count_if(F.col("entry_type") == 2) + 1).alias("n_dirs"))
        d = self.drops().agg(F.count("*").alias("n_drops"), F.countDistinct("slab").alias("n_slabs"))
        one = F.lit(1).alias("k")
        return f.select(one, "*").join(d.select(one, "*"), "k").drop("k")

    def log(self) -> DataFrame:
        rows = [(e["version"], e["op"], e["ts_ns"], e["inputs"], e["params"]) for e in self.history()]
        return changes.history(self.spark.createDataFrame(rows, "seq int, op string, ts_ns long, inputs array<string>, params string"))

    def check(self) -> DataFrame:
        """checked, passed, failed over drops and inline contents."""
        inline = self.inline().select((digest(F.col("content")) == F.col("content_id")).alias("ok"))
        drops = storage.plain(self.drops(), self.dictionaries()).select((digest(F.col("chunk")) == F.col("drop_id")).alias("ok"))
        both = inline.unionByName(drops)
        return both.agg(F.count("*").alias("checked"), F.coalesce(F.sum(F.col("ok").cast("long")), F.lit(0)).alias("passed"), F.coalesce(F.sum((~F.col("ok")).cast("long")), F.lit(0)).alias("failed"))

    def root_id(self) -> str:
        """The hash that covers files, slices and drops as they are now; contents are covered by their ids."""
        return _root(self.files(), self.slices(), self.drops())

    def verify(self) -> DataFrame:
        """rule, n of the structural rules and of the root hash, which is computed anew; all zero for a sound image."""
        gaps = self.slices().groupBy("file_id").agg(F.sum("drop_len").alias("sum"), F.max("file_end").alias("end"), F.min("file_start").alias("start"))
        broken = gaps.filter("sum <> end or start <> 0").agg(F.count("*").alias("n")).select(F.lit("slice_gap").alias("rule"), "n")
        known = self.drops().select("drop_id").unionByName(self.references().select("drop_id"))
        unknown = self.files().filter("inline").join(self.inline().select("content_id"), "content_id", "left_anti").select(F.col("content_id").alias("drop_id"))
        lost = self.slices().join(known, "drop_id", "left_anti").select("drop_id").unionByName(unknown).agg(F.count("*").alias("n")).select(F.lit("missing_drop").alias("rule"), "n")
        changed = self.spark.createDataFrame([("root", int(self.root_id() != self.entry()["root"]))], "rule string, n long")
        return tree.violations(self.edges(), self.files()).unionByName(broken).unionByName(lost).unionByName(changed)

    # Changes

    def diff(self, other: Image) -> DataFrame:
        """path, op (A, R, M) from this image to the other."""

        def nodes(image: Image) -> DataFrame:
            files = image.files().select("path", F.lit(1).alias("entry_type"), F.col("content_id").alias("c"))
            return files.unionByName(S.directories(image.files()).filter("path <> '/'").select("path", F.lit(2).alias("entry_type"), F.lit(None).cast("string").alias("c")))

        return changes.tree_diff(nodes(self), nodes(other), F.col("c"))

    def change(self, ops: Iterable[tuple[str, str, bytes | None]], profile: Profile | str = "balanced-rw") -> int:
        """add, update and delete of paths as one commit; an update or delete of an unknown path is refused.

        Only the contents that the commit brings are cut, and only drops that are new are
        stored, in a folder of their own; the drops of earlier commits stay where they are.
        """
        rows = [(i, op, path, bytearray(raw or b"")) for i, (op, path, raw) in enumerate(ops)]
        log = self.spark.createDataFrame(rows, "t int, op string, path string, content binary").withColumn("path", P.normalise(F.col("path"))).withColumn("mtime_ns", F.lit(0).cast("long"))
        if bad := changes.refused(self.files().select("path"), log, "path", "t").select("op", "path").head(1):
            raise ImageError(f"{bad[0]['op']}: no {bad[0]['path']}")
        last = changes.last_changes(log, "path", "t")
        return self.merge(last.filter("op <> 'delete'").select("path", "mtime_ns", "content"), last.select("path"), profile)

    def merge(self, brought: DataFrame, gone: DataFrame, profile: Profile | str = "balanced-rw", op: str = "commit") -> int:
        """A version without the paths of gone (those brought among them) and with the files brought (path, mtime_ns, content)."""
        profile = select(profile) if isinstance(profile, str) else profile
        now = self.entry()
        files, slices, drops, inline = self.files(), self.slices(), self.drops(), self.inline()
        ids = files.agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("n")).first()["n"]
        slabs = drops.agg(F.coalesce(F.max("slab"), F.lit(-1)).alias("n")).first()["n"] + 1

        def write(root: str) -> dict:
            plain = _attributed(brought)
            own = written(_rows(plain, profile, ids), "own")
            left = files.join(gone.unionByName(brought.select("path")), "path", "left_anti").select(*files.columns)
            left.unionByName(own).write.parquet(f"{root}/files")
            _contents(plain, profile).join(inline.select("content_id"), "content_id", "left_anti").write.parquet(f"{root}/new/inline")
            self._store(plain, own, profile, f"{root}/new", base=drops, first_slab=slabs)
            kept = slices.join(left.select("file_id"), "file_id", "left_semi").select(*slices.columns)
            kept.unionByName(self.spark.read.parquet(f"{root}/new/slices")).write.parquet(f"{root}/slices")
            return self._entry(root, now, f"{root}/new")

        return self.publish(write, op, params=profile.name)

    def delta(self, other: Image, root: str) -> Image:
        """What leads from this image to the other, as an image at root: removed paths, changed files and the drops that this one lacks.

        Nothing is decoded. Its entry names the root hash that it applies to.
        """
        out = Image(self.spark, root)
        own, theirs = self.files().select("path", "content_id", "mode"), other.files()
        same = theirs.join(own, ["path", "content_id", "mode"], "left_semi")
        changed = theirs.join(same.select("path"), "path", "left_anti").select(*theirs.columns)
        removed = own.select("path").join(theirs.select("path"), "path", "left_anti")

        def write(at: str) -> dict:
            changed.write.parquet(f"{at}/files")
            removed.write.parquet(f"{at}/removed")
            slices = other.slices().join(changed.select("file_id"), "file_id", "left_semi").select(*other.slices().columns)
            slices.write.parquet(f"{at}/slices")
            new = storage.layer(storage.referenced(other.drops(), slices), self.drops())
            small = other.inline().join(changed.select("content_id"), "content_id", "left_semi").join(self.inline().select("content_id"), "content_id", "left_anti")
            storage.write({"drops": new, "inline": small, "dictionaries": other.dictionaries()}, at)
            return {**self._entry(at), "base": self.entry()["root"]}

        out.publish(write, "delta")
        return out

    def apply(self, delta: Image) -> int:
        """The version that a delta leads to; a delta of another state is refused. Drops are copied as they are."""
        said = delta.entry()
        if said.get("base") != self.entry()["root"]:
            raise ImageError("the delta applies to another state")
        now = self.entry()
        files, slices, drops, inline = self.files(), self.slices(), self.drops(), self.inline()
        ids = files.agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("n")).first()["n"]
        slabs = drops.agg(F.coalesce(F.max("slab"), F.lit(-1)).alias("n")).first()["n"] + 1
        brought, removed = delta.files(), self.spark.read.parquet(f"{said['path']}/removed")

        def write(root: str) -> dict:
            left = files.join(removed.unionByName(brought.select("path")), "path", "left_anti").select(*files.columns)
            left.unionByName(brought.withColumn("file_id", F.col("file_id") + ids + 1)).write.parquet(f"{root}/files")
            kept = slices.join(left.select("file_id"), "file_id", "left_semi").select(*slices.columns)
            kept.unionByName(delta.slices().withColumn("file_id", F.col("file_id") + ids + 1)).write.parquet(f"{root}/slices")
            new = delta.inline().join(inline.select("content_id"), "content_id", "left_anti")
            storage.write({"drops": delta.drops().withColumn("slab", F.col("slab") + slabs), "inline": new, "dictionaries": delta.dictionaries()}, root)
            return self._entry(root, now)

        return self.publish(write, "apply")

    @staticmethod
    def flatten(layers: list[Image], root: str) -> Image:
        """One image of several, of each path the file of the last layer that has it; drops are copied once, without decoding."""
        out = Image(layers[0].spark, root)

        def numbered(tables: list[DataFrame]) -> DataFrame:
            every = None
            for k, df in enumerate(tables):
                one = df.withColumn("layer", F.lit(k))
                every = one if every is None else every.unionByName(one)
            return every

        every = numbered([x.files() for x in layers])
        top = changes.overlay(every, "path", "layer")

        def write(at: str) -> dict:
            with only_result():
                order = tree.numbering(top.select("path", "layer", "file_id")).withColumnRenamed("file_id", "old")
                order = written(order.select("path", "layer", "old", F.col("inode").alias("file_id")), "order")
                columns = [c for c in every.columns if c != "layer"]
                rows = top.drop("file_id").join(order.select("path", "file_id"), "path")
                rows.select(*columns).write.parquet(f"{at}/files")
                slices = numbered([x.slices() for x in layers]).withColumnRenamed("file_id", "old").join(order.select("layer", "old", "file_id"), ["layer", "old"])
                slices.select(*layers[0].slices().columns).write.parquet(f"{at}/slices")
                drops = numbered([x.drops() for x in layers]).drop("slab", "offset")
                first = drops.groupBy("drop_id").agg(F.min(F.struct("layer", "enc_len")).alias("x")).select("drop_id", "x.*")
                need = written(storage.referenced(first, out.spark.read.parquet(f"{at}/slices")), "need")
                placed = drops.join(storage.packed(need).drop("enc_len"), ["drop_id", "layer"])
                dictionaries = numbered([x.dictionaries() for x in layers]).drop("layer").dropDuplicates(["dict_id"])
                small = numbered([x.inline() for x in layers]).drop("layer").join(out.spark.read.parquet(f"{at}/files").select("content_id"), "content_id", "left_semi").dropDuplicates(["content_id"])
                storage.write({"drops": placed.select(*layers[0].drops().columns), "inline": small, "dictionaries": dictionaries}, at)
            return out._entry(at)

        out.publish(write, "flatten")
        return out

    def turnover(self, profile: Profile | str) -> int:
        """Everything encoded anew with another profile."""
        return self.build(self.contents(), profile, "turnover")

    def compact(self) -> int:
        """Referenced drops copied into full slabs without decoding; files and slices as they are."""
        files, slices, drops, inline, dictionaries = self.files(), self.slices(), self.drops(), self.inline(), self.dictionaries()

        def write(root: str) -> dict:
            files.write.parquet(f"{root}/files")
            slices.write.parquet(f"{root}/slices")
            small = inline.join(files.select("content_id"), "content_id", "left_semi")
            storage.write({"drops": storage.compact(drops, slices).select(*drops.columns), "inline": small, "dictionaries": dictionaries.dropDuplicates(["dict_id"])}, root)
            return self._entry(root)

        return self.publish(write, "compact")


def _attributed(files: DataFrame) -> DataFrame:
    return S.with_attributes(files.select("path", "mtime_ns", F.coalesce("content", F.lit(b"")).alias("content")))


def _rows(plain: DataFrame, profile: Profile, before: int = 0) -> DataFrame:
    """The files table, numbered from behind ``before``: which content each file has, and whether that is an inline one. Rows are numbered without their contents."""
    rows = plain.select("path", "parent", "name", "kind", "mode", "size", "mtime_ns", digest(F.col("content")).alias("content_id"), (F.col("size") <= profile.inline_threshold).alias("inline"))
    return tree.numbering(rows).select((F.col("inode") + before).alias("file_id"), *rows.columns)


def _contents(plain: DataFrame, profile: Profile) -> DataFrame:
    """content_id, content of the files up to the inline threshold, each content once."""
    return plain.filter(F.col("size") <= profile.inline_threshold).select(digest(F.col("content")).alias("content_id"), "content").dropDuplicates(["content_id"])


def _root(files: DataFrame, slices: DataFrame, drops: DataFrame) -> str:
    sections = [
        ("files", files, F.concat_ws("|", "path", "kind", F.col("mode").cast("string"), F.col("mtime_ns").cast("string"), "content_id")),
        ("slices", slices, F.concat_ws("|", *[F.col(c).cast("string") for c in ("file_id", "seq", "file_start", "file_end", "drop_id")])),
        ("drops", drops, F.concat_ws("|", "drop_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("codec", "plain_len", "enc_len", "slab", "offset", "dict_id")])),
    ]
    return storage.root_hash(sections).first()["root"]
