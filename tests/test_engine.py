"""Operators against scalar models, round trips and their own rules."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakecairn.functions import codecs, content, hashing, paths
from lakecairn.functions.codecs import CODECS, choose_whole, round_trips, special_codec
from lakecairn.operators import changes, chunking, redundancy, sketches, storage, tree
from lakecairn.plans import config
from lakecairn.sources import files, locators, schemas
from lakecairn.streaming.store import ConflictError, Store

SIZES = (64, 256, 1024)


def scalar_boundaries(raw, least, average, most):
    gear, x = [], np.array([chunking.GEAR_SEED], np.uint64)
    for _ in range(256):
        x = hashing.splitmix64(x)
        gear.append(int(x[0]))
    first, second = ((1 << chunking.mask_bits(n)) - 1 for n in (average - least, most - average))
    out, start = [], 0
    while start < len(raw):
        end = min(start + most, len(raw))
        cut, fp = end, 0
        if end - start > least:
            for i in range(start + least, end):
                fp = (2 * fp + gear[raw[i]]) % 2**64
                if not fp & (first if i < min(start + average, end) else second):
                    cut = i + 1
                    break
        out.append(cut)
        start = cut
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 6000), st.integers(1, 250), st.integers(0, 9), st.sampled_from([SIZES, (16, 64, 128), (64, 64, 64), (1, 2, 3)]))
def test_chunker_as_the_scalar_model(n, letters, seed, sizes):
    raw = np.random.default_rng(seed).integers(0, letters, n, dtype=np.uint8).tobytes()
    if sizes == (1, 2, 3):
        raw = raw[:300]
    assert chunking.boundaries(raw, *sizes) == scalar_boundaries(raw, *sizes)


def test_an_insert_touches_few_chunks():
    raw = np.random.default_rng(4).integers(0, 256, 60_000, dtype=np.uint8).tobytes()

    def ids(b):
        ends = chunking.boundaries(b, *SIZES)
        return {hashlib.sha256(b[i:j]).digest() for i, j in zip([0, *ends], ends, strict=False)}

    assert len(ids(raw[:30_000] + b"!" + raw[30_000:]) - ids(raw)) <= 12


def test_codecs():
    for raw in (b"", b"a", bytes(range(256)) * 9, b"text " * 500, np.random.default_rng(0).bytes(1001)):
        assert all(codecs.round_trips(raw))
    with pytest.raises(KeyError):
        codecs.decompress(0x7F, b"", 0)


def test_tournament_rules():
    rules = codecs.Tournament(("lz4", "zstd", "brotli"))
    text = b"the same words again and again " * 40
    sizes = {n: len(codecs.CODECS[n].compress(text)) for n in rules.codecs}
    kind, out = codecs.choose(text, "text", rules)
    assert len(out) == min(sizes.values()) and codecs.BY_ID[kind].name == min(sizes, key=sizes.get)
    assert codecs.choose(text, "media", rules) == (0, text)
    assert codecs.choose(b"x" * 20, "binary", rules)[0] in (0, codecs.CODECS["zstd"].id)
    noise = np.random.default_rng(1).bytes(999)
    assert codecs.choose(noise, "text", rules) == (0, noise)
    assert codecs.choose(text, "text", codecs.Tournament(("lz4", "brotli"), stop_permille=1000))[0] == codecs.CODECS["lz4"].id


def test_pack_is_greedy(spark):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 900, 300).tolist()
    df = spark.createDataFrame([(f"{i:04d}", int(n)) for i, n in enumerate(lengths)], "drop_id string, enc_len long")
    got = {r["drop_id"]: (r["slab"], r["offset"]) for r in storage.pack(df, 5000).collect()}
    slab = used = offset = 0
    for i, n in enumerate(lengths):
        if used and used + n + storage.RECORD_BYTES > 5000 - storage.HEADER_BYTES:
            slab, used, offset = slab + 1, 0, 0
        assert got[f"{i:04d}"] == (slab, offset)
        used, offset = used + n + storage.RECORD_BYTES, offset + n


def test_a_missing_drop_is_an_error(spark):
    df = spark.createDataFrame([(1, bytearray(b"abc" * 400))], "file_id long, content binary")
    built = storage.build(df, SIZES)
    assert bytes(storage.read_files(built["slices"], built["drops"]).first()["content"]) == b"abc" * 400
    with pytest.raises(Exception, match="drop missing"):
        storage.read_files(built["slices"], built["drops"].limit(0)).collect()


def test_write_and_read_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"abc" * 400)), (2, bytearray(b"")), (3, bytearray(b"abc" * 400))], "file_id long, content binary")
    storage.write(storage.build(df, SIZES), str(tmp_path))
    back = storage.read_files(spark.read.parquet(f"{tmp_path}/slices"), schemas.read(spark, str(tmp_path), "drops"))
    assert {r["file_id"]: bytes(r["content"]) for r in back.collect()} == {1: b"abc" * 400, 3: b"abc" * 400}
    with pytest.raises(schemas.SchemaError):
        schemas.check(df, "drops")
    with pytest.raises(schemas.SchemaError):
        schemas.check(df, "files", version=2)


def test_directory_scan(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.txt").write_bytes(b"hello")
    (tmp_path / "a" / "b" / "y.bin").write_bytes(b"\0\1")
    got = {r["path"]: (r["size"], bytes(r["content"])) for r in files.directory(spark, str(tmp_path)).collect()}
    assert got == {"/a/x.txt": (5, b"hello"), "/a/b/y.bin": (2, b"\0\1")}
    assert {(r["parent"], r["name"], r["entry_type"]) for r in files.edges(files.directory(spark, str(tmp_path))).collect()} == {("/", "a", 2), ("/a", "b", 2), ("/a", "x.txt", 1), ("/a/b", "y.bin", 1)}


def test_cycles_end(spark):
    edges = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "c", 1)], "parent_id long, name string, child_id long")
    assert {r["path"] for r in tree.path_index(edges, F.lit(0).cast("long")).collect()} == {"/", "/a", "/a/b"}


def test_recursive_sql_agrees(spark):
    edges = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (0, "c", 3), (3, "d", 4)], "parent_id long, name string, child_id long")
    edges.createOrReplaceTempView("some_edges")
    sql = {tuple(r) for r in spark.sql(tree.path_index_sql("some_edges", "0")).collect()}
    assert sql == {tuple(r) for r in tree.path_index(edges, F.lit(0).cast("long")).collect()}


def test_structure_rules_find_faults(spark):
    edges = spark.createDataFrame([("/", "a", "/a", 2), ("/", "a", "/a", 2), ("/gone", "x", "/gone/x", 1), ("/a", "y/z", "/a/y/z", 1)], "parent string, name string, child string, entry_type int")
    have = spark.createDataFrame([("/gone/x",)], "path string")
    assert {r["rule"]: r["n"] for r in tree.violations(edges, have).collect()} == {"bad_name": 1, "duplicate_name": 1, "orphan": 1, "missing_file": 1}


def test_paths(spark):
    df = spark.createDataFrame([(" //a//b/ ",), ("/",), ("",), ("x",)], "p string").select(paths.normalise(F.col("p")).alias("n"))
    df = df.select("n", paths.parent(F.col("n")), paths.name(F.col("n")), paths.depth(F.col("n")))
    assert [tuple(r) for r in df.collect()] == [("/a/b", "/a", "b", 2), ("/", None, "", 0), ("/", None, "", 0), ("/x", "/", "x", 1)]
    raw = spark.createDataFrame([(bytearray(b"0123456789"), o, n) for o, n in ((0, 3), (8, 5), (20, 1), (-2, 4), (4, None))], "b binary, o int, n int")
    assert [bytes(r[0]) for r in raw.select(paths.byte_range(F.col("b"), F.col("o"), F.col("n"))).collect()] == [b"012", b"89", b"", b"0123", b"456789"]


def test_text_digest(spark):
    import base64

    h = hashlib.sha256(b"x").hexdigest()
    got = spark.createDataFrame([(h,)], "h string").select(hashing.text_digest(F.col("h"))).first()[0]
    assert got == "s2:" + base64.b32encode(bytes.fromhex(h)).decode().rstrip("=").lower()


def test_headers():
    import struct

    pe = bytearray(200)
    pe[:2], pe[60:64], pe[100:104], pe[104:106] = b"MZ", struct.pack("<I", 100), b"PE\0\0", struct.pack("<H", 0xAA64)
    assert content.executable_arch(bytes(pe)) == "arm64"
    assert content.executable_arch(b"\xcf\xfa\xed\xfe" + struct.pack("<I", 0x01000007) + bytes(20)) == "x86-64"
    assert content.executable_arch(b"\x7fELF" + bytes(30)) is None
    comm = struct.pack(">hIhHQ", 2, 10, 16, 16383 + 15, 44_100 << 48)
    aiff = b"FORM" + struct.pack(">I", 30) + b"AIFFCOMM" + struct.pack(">I", 18) + comm
    assert content.pcm_header(aiff) == {"rate": 44_100, "channels": 2, "bits": 16, "order": "big"}
    assert content.pcm_header(b"RIFF" + bytes(4) + b"WAVEfmt ") is None


def test_fold_and_refused(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    log = spark.createDataFrame([(1, 1, "delete", None), (2, 1, "add", "c"), (3, 9, "update", "x"), (4, 2, "delete", None), (5, 2, "update", "y")], "t long, k long, op string, v string")
    assert {tuple(r) for r in changes.fold(base, log, "k", "t").collect()} == {(1, "c"), (9, "x"), (2, "y")}
    assert {(r["k"], r["t"]) for r in changes.refused(base, log, "k", "t").collect()} == {(9, 3), (2, 5)}


def test_union_locators(spark):
    df = spark.createDataFrame([("s", 0, ["a", "b"]), ("s", 1, ["b", "c"]), ("t", 1, ["z"])], "k string, layer int, uris array<string>")
    assert {r["k"]: r["uris"] for r in changes.union_locators(df, "k", "layer", "uris").collect()} == {"s": ["a", "b", "c"], "t": ["z"]}


def test_replay_refuses_nonsense():
    for ops in ([("modify", "/a", None, "x", None)], [("mkdir", "/d", None, None, 1), ("add", "/d/f", None, "x", 1), ("rmdir", "/d", None, None, None)], [("add", "/a", None, "x", 1), ("add", "/a", None, "y", 1)], [("add", "/a", None, "x", 1), ("fly", "/a", None, None, None)]):
        state = {}
        with pytest.raises(changes.EpochError):
            for o in ops:
                changes._apply(state, *o)


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"), "k")
    assert s.read() is None
    log = spark.createDataFrame([(1, 1, "add", "a"), (2, 2, "add", "b")], "t long, k long, op string, v string")
    assert s.apply(log, "t", batch="one") == 0
    assert s.apply(log, "t", batch="one") == 0  # replayed
    s.apply(spark.createDataFrame([(3, 1, "delete", None)], "t long, k long, op string, v string"), "t", batch="two")
    assert [tuple(r) for r in s.read().collect()] == [(2, "b")] and s.read(0).count() == 2
    assert s.needs_turnover(1) and not s.needs_turnover(5)
    s.turnover()
    assert not s.needs_turnover(1) and [h["op"] for h in s.history()] == ["commit", "commit", "turnover"]


def test_erasure_all_losses():
    raw = bytes(range(200))
    shards = redundancy.split_shards(raw, 4, 3)
    for lost in range(1 << 7):
        left = {i: s for i, s in enumerate(shards) if not lost >> i & 1}
        if len(left) >= 4:
            assert redundancy.join_shards(left, 4, 3, len(raw)) == raw
        else:
            with pytest.raises(ValueError):
                redundancy.join_shards(left, 4, 3, len(raw))


def test_missing_shards_are_computed_anew(spark):
    df = spark.createDataFrame([(1, bytearray(b"some content"))], "id long, content binary")
    whole = redundancy.erasure_encode(df, 3, 2, key="id")
    lost = whole.filter("shard in (0, 4)")
    anew = redundancy.missing_shards(whole.filter("shard not in (0, 4)"), 3, 2, key="id")
    assert {(r["shard"], bytes(r["data"])) for r in anew.collect()} == {(r["shard"], bytes(r["data"])) for r in lost.collect()}


def test_shares():
    shares = redundancy.share(b"secret", 3, 5, b"seed")
    for pick in ((0, 1, 2), (4, 2, 0), (1, 3, 4), (0, 1, 2, 3, 4)):
        assert redundancy.combine([shares[i] for i in pick]) == b"secret"
    assert redundancy.combine(shares[:2]) != b"secret"
    for bad in ((1, 3), (4, 3), (2, 256)):
        with pytest.raises(ValueError):
            redundancy.share(b"s", *bad, b"")


def test_bloom_rate(spark):
    ids = [(hashlib.sha256(str(i).encode()).hexdigest(),) for i in range(4000)]
    mine, other = spark.createDataFrame(ids[:2000], "drop_id string"), spark.createDataFrame(ids[2000:], "drop_id string")
    filters = sketches.build(mine, 2000).persist()
    assert sketches.probe(mine, filters, 2000).filter("not maybe").count() == 0
    assert sketches.probe(other, filters, 2000).filter("maybe").count() < 60
    assert sketches.bits_for(0, 0.01) == 0 and sketches.hashes_for(0.01) == 7


def test_profiles():
    assert len(config.PROFILES) == 9
    for p in config.PROFILES.values():
        assert config.Profile.from_toml(p.to_toml()) == p
    with pytest.raises(config.ConfigError):
        config.custom("balanced", sizes=(10, 5, 20))
    with pytest.raises(config.ConfigError):
        config.custom("balanced", stop_permille=1001)
    with pytest.raises(config.ConfigError):
        config.select("none")


def test_locators_and_archives(spark, tmp_path):
    (tmp_path / "u").write_bytes(b"0123456789")
    found = locators.Locators()
    uri = (tmp_path / "u").as_uri()
    assert [bytes(r["content"]) for r in found.fetch_range(spark, [["ipfs:x", uri]], 2, 3).collect()] == [b"234"]
    with pytest.raises(locators.LocatorError):
        found.pick(["ipfs:x"])
    blocks = [b"one", b"", b"three" * 50]
    assert locators.decode_car(locators.encode_car(blocks)) == blocks
    raw = bytearray(locators.encode_car(blocks))
    raw[-1] ^= 1
    with pytest.raises(locators.LocatorError):
        locators.decode_car(bytes(raw))
    assert locators.read_varint(locators.varint(300)) == (300, 2)
    assert locators.cid_text(locators.cid(b"x")).startswith("bafkrei")


# Versions, codecs, chains


def _table(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "k long")


def test_a_commit_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), "k")
    store.commit(_table(spark, 1), "build")

    def dies(*_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):  # while data is written
        store.publish(lambda path: (_table(spark, 2).write.parquet(path), dies()) and None, "commit")
    monkeypatch.setattr(Store, "_point", dies)
    with pytest.raises(RuntimeError):  # before the pointer
        store.commit(_table(spark, 3), "commit")
    monkeypatch.undo()
    real = store._files

    class Broken:
        rename = dies

    store._files = Broken()
    with pytest.raises(RuntimeError):  # between the pointer aside and its rename
        store.commit(_table(spark, 4), "commit")
    store._files = real
    other = Store(spark, store.root, "k")
    assert [r["k"] for r in other.read().collect()] == [1] and len(other.history()) == 1
    assert other.commit(_table(spark, 5), "commit") == 1 and [r["k"] for r in store.read().collect()] == [5]
    assert [r["k"] for r in store.read(0).collect()] == [1]
    assert store.sweep(older_than=3600) == 0 and store.sweep(older_than=-5) == 4
    assert [r["k"] for r in other.read().collect()] == [5] and store.sweep(older_than=-5) == 0


def test_of_two_writers_one_wins(spark, tmp_path):
    a, b = (Store(spark, str(tmp_path / "s"), "k") for _ in range(2))
    a.commit(_table(spark, 1), "build")

    def slow(path):
        b.commit(_table(spark, 2), "commit")  # comes first
        _table(spark, 3).write.parquet(path)

    with pytest.raises(ConflictError):
        a.publish(slow, "commit")
    assert [r["k"] for r in a.read().collect()] == [2] and [e["version"] for e in a.history()] == [0, 1]


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=600), st.lists(st.sampled_from([b"\xe8", b"\xe9", b"abc,", b"\0\0\0\x94", b"\xff"]), max_size=200).map(b"".join)))
def test_every_codec_gives_any_content_back(raw):
    assert [c for c, ok in zip(CODECS, round_trips(raw), strict=True) if not ok] == []


def test_special_codecs_win_on_their_kind():
    rng = np.random.default_rng(3)
    pixels = rng.normal(1000, 5, 50_000).astype(">i2").tobytes()
    assert choose_whole(pixels, "ricepp")[0] == CODECS["ricepp"].id
    assert choose_whole(pixels, None)[0] != CODECS["ricepp"].id
    assert choose_whole(b"", "ricepp") == (0, b"") and choose_whole(b"x", "flac")[0] == 0
    assert special_codec("pcm:44100/1/16") == "flac" and special_codec("exec:arm64") == "bcj-arm64+zstd" and special_codec(None) is None


def test_chains(spark):
    ops = spark.createDataFrame([("a", i, f"h{i}") for i in range(5)] + [("b", 0, "h")], "c string, t int, ops_hash string")
    made = changes.chained(ops, "c", "t")
    assert all(r["sound"] for r in changes.verify_chain(made, chain="c").collect())
    one = made.filter("c = 'a'").drop("c")
    assert all(r["sound"] for r in changes.verify_chain(one).collect())
    broken = one.withColumn("parent_id", F.when(F.col("sequence") == 3, F.lit("x")).otherwise(F.col("parent_id")))
    assert {r["sequence"] for r in changes.verify_chain(broken).collect() if not r["sound"]} == {3}
    twice = one.unionByName(one.filter("sequence = 2"))
    assert {r["sequence"] for r in changes.verify_chain(twice).collect() if not r["sound"]} == {2, 3}
    gap = one.filter("sequence <> 2")
    assert {r["sequence"] for r in changes.verify_chain(gap).collect() if not r["sound"]} == {3}


def test_packing_in_groups(spark):
    assert [storage.packing_prefix(n, 10) for n in (0, 640, 641, 10_240, 10_241)] == [0, 0, 1, 1, 2]
    drops = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("drop_id"), (F.col("id") % 50 + 1).alias("enc_len"))
    got = storage.packed(drops, 1000).orderBy("slab", "offset").collect()
    assert len(got) == 3000 and len({r["drop_id"][0] for r in got if r["slab"] == 0}) == 1
    by = {}
    for r in got:
        used, count = by.get(r["slab"], (0, 0))
        assert r["offset"] == used
        by[r["slab"]] = (used + r["enc_len"], count + 1)
    assert set(by) == set(range(len(by))) and all(n + 49 * k <= 1000 - 56 for n, k in by.values())


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from lakecairn.sources import scratch

    unset = SimpleNamespace(get=lambda *_: None)
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))
    far = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, _jsc=jsc, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(far)


def test_root_hash_of_any_depth(spark, monkeypatch):
    values = [f"row {i}" for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v string")

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    def by_hand(levels):
        now = [(sha(v), sha(v)) for v in values]
        for level in range(levels, -1, -1):
            groups = {}
            for b, h in sorted(now):
                groups.setdefault(b[: 3 * level], []).append(h if level == levels else b + h)
            now = [(b, sha("".join(x))) for b, x in groups.items()]
        return sha("lakecairn/v1" + now[0][1] + sha(""))

    assert [storage.root_levels(n) for n in (0, 4096 * 65_536, 4096 * 65_536 + 1)] == [1, 1, 2]
    for levels in (1, 2, 3):
        monkeypatch.setattr(storage, "root_levels", lambda n, levels=levels: levels if n else 1)
        assert storage.root_hash([("a", df, F.col("v")), ("none", df.limit(0), F.col("v"))]).first()["root"] == by_hand(levels)


def test_flat_directories_are_hashed_in_groups(spark):
    names = [f"n{i}" for i in range(40)]
    leaves = spark.createDataFrame([(f"/big/{n}", f"h{n}") for n in names] + [("/small/a", "ha")], "path string, node_hash string")
    got = {r["path"]: r["node_hash"] for r in tree.directory_hashes(leaves, 2, flat=10).collect()}

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    groups = {}
    for n in sorted(names):
        groups.setdefault(sha(n)[:3], []).append(f"{n}:1:h{n}")
    big = sha("\n".join(f"{g}:{sha(chr(10).join(e))}" for g, e in sorted(groups.items())))
    assert got["/big"] == big and got["/small"] == sha("a:1:ha") and got["/"] == sha(f"big:2:{big}\nsmall:2:{got['/small']}")
    plain = {r["path"]: r["node_hash"] for r in tree.directory_hashes(leaves, 2).collect()}
    assert plain["/big"] == sha("\n".join(f"{n}:1:h{n}" for n in sorted(names)))
