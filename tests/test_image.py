"""Images end to end, through the command line where it has a command."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from lakecairn.__main__ import run
from lakecairn.functions.signing import SignatureError
from lakecairn.image import Image, ImageError
from lakecairn.plans import catalog
from lakecairn.sources import files as S


@pytest.fixture
def made(spark, tmp_path):
    src = tmp_path / "src"
    (src / "docs" / "old").mkdir(parents=True)
    rng = np.random.default_rng(7)
    big = rng.integers(97, 101, 300_000, dtype=np.uint8).tobytes()
    content = {"/docs/a.txt": b"small", "/docs/old/b.bin": big, "/docs/c.bin": big, "/d.bin": big[:150_000] + b"!" + big[150_000:], "/empty": b""}
    for path, raw in content.items():
        (src / path[1:]).write_bytes(raw)
    image = str(tmp_path / "image")
    assert run(spark, ["build", image, str(src), "--profile", "balanced"]) == 0
    return image, content, tmp_path


def test_read_back(spark, made, capfd):
    root, content, tmp = made
    image = Image(spark, root)
    assert {r["path"]: bytes(r["content"]) for r in image.contents().collect()} == content
    capfd.readouterr()
    assert run(spark, ["cat", root, "/d.bin", "/docs/a.txt", "--length", "3"]) == 0
    assert capfd.readouterr().out.encode().endswith(content["/d.bin"][:3] + b"sma")
    assert run(spark, ["extract", root, str(tmp / "out")]) == 0
    assert all((tmp / "out" / p[1:]).read_bytes() == raw for p, raw in content.items())
    assert image.cat("/d.bin", 149_990, 20) == content["/d.bin"][149_990:150_010]
    assert image.cat("/docs/a.txt", 1, 100) == b"mall" and image.cat("/d.bin", 10**7, 5) == b""
    assert [r["name"] for r in image.ls("/docs").collect()] == ["a.txt", "c.bin", "old"]
    with pytest.raises(ImageError):
        image.ls("/nowhere")
    with pytest.raises(ImageError):
        image.cat("/nowhere")
    for command in ("tree", "inspect", "slab", "gc", "dedup", "history", "check", "verify", "counters", "summary", "sweep", "root"):
        assert run(spark, [command, root]) == 0
    d = image.dedup().first()
    assert d["duplicate_refs"] >= 5 and d["unique_bytes"] < 0.6 * d["total_bytes"]
    assert image.check().first()["failed"] == 0 and image.counters().first()["n_dirs"] == 3


def test_cat_multi_of_a_table(spark, made):
    root, content, _ = made
    image = Image(spark, root)
    every = image.files().select("path")
    wanted = every.unionByName(every).unionByName(spark.createDataFrame([("/nowhere",), (None,)], "path string"))
    got = [(r["path"], bytes(r["content"])) for r in image.cat_multi(wanted, 149_990, 500).collect()]
    assert sorted(got) == sorted((p, raw[149_990:150_490]) for p, raw in content.items())
    assert {r["path"]: bytes(r["content"]) for r in image.cat_multi(every).collect()} == content
    assert image.cat_multi(every.limit(0), 0, 5).count() == 0


def test_cat_multi_of_all_documents(spark):
    files = S.documents(spark, "/root/testdata/sf0.001")
    image = catalog._image(spark, files)
    want = sorted((r["path"], bytes(r["content"])[1000:1500]) for r in files.select("path", "content").collect())
    assert len(want) > 60
    assert sorted((r["path"], bytes(r["content"])) for r in image.cat_multi(files.select("path"), 1000, 500).collect()) == want


def test_changes(spark, made):
    root, content, tmp = made
    image, first = Image(spark, root), Image(spark, root).root_id()
    copy = Image(spark, str(tmp / "copy"))
    copy.build(image.contents())
    assert copy.root_id() == first and copy.diff(image).count() == 0
    image.change([("add", "docs/new/x", b"1"), ("update", "/docs/a.txt", b"other"), ("delete", "/docs/old/b.bin", None), ("add", "/empty2", b"")])
    assert image.root_id() != first
    assert {tuple(r) for r in copy.diff(image).collect()} == {("/docs/new", "A"), ("/docs/a.txt", "M"), ("/docs/old", "R"), ("/empty2", "A")}
    with pytest.raises(ImageError):
        image.change([("delete", "/nowhere", None)])
    image.turnover("max-read")
    image.compact()
    assert image.cat("/docs/c.bin") == content["/docs/c.bin"] and image.gc().first()["garbage"] == 0
    assert [e["op"] for e in image.history()] == ["build", "commit", "turnover", "compact"]


def test_layer_stores_only_what_is_new(spark, made):
    root, content, tmp = made
    base, layer = Image(spark, root), Image(spark, str(tmp / "layer"))
    layer.build(base.contents().unionByName(spark.createDataFrame([("/more", 0, bytearray(content["/d.bin"] + b"tail"))], "path string, mtime_ns long, content binary")), base=base)
    assert 0 < layer.drops().count() < 4
    got = {r["path"]: bytes(r["content"]) for r in layer.contents(base=base).collect()}
    assert got == content | {"/more": content["/d.bin"] + b"tail"}


def test_commits_store_only_their_own_drops(spark, made):
    root, content, tmp = made
    image = Image(spark, root)
    before = image.entry()
    fresh = np.random.default_rng(1).integers(0, 90, 200_000, dtype=np.uint8).tobytes()
    image.change([("add", "/docs/fresh.bin", fresh), ("add", "/docs/again.bin", content["/d.bin"]), ("update", "/docs/c.bin", b"tiny")])
    now = image.entry()
    assert now["drops"][:-1] == before["drops"] and len(now["drops"]) == 2
    own = spark.read.parquet(now["drops"][-1])
    assert own.agg({"plain_len": "sum"}).first()[0] == len(fresh)
    assert {r["path"]: bytes(r["content"]) for r in image.contents().collect()} == content | {"/docs/fresh.bin": fresh, "/docs/again.bin": content["/d.bin"], "/docs/c.bin": b"tiny"}
    assert not any(r["n"] for r in image.verify().collect()) and image.check().first()["failed"] == 0
    assert image.gc().first()["garbage"] == 0
    image.change([("delete", "/docs/fresh.bin", None)])
    assert image.gc().first()["garbage_bytes"] > 0
    image.compact()
    assert image.gc().first()["garbage"] == 0 and image.cat("/docs/again.bin") == content["/d.bin"] and len(image.entry()["drops"]) == 1


def test_deltas_and_flattened_layers(spark, made):
    root, content, tmp = made
    image, other = Image(spark, root), Image(spark, str(tmp / "other"))
    other.build(image.contents())
    other.change([("update", "/docs/a.txt", b"new"), ("delete", "/docs/old/b.bin", None), ("add", "/more", content["/d.bin"] + bytes(range(256)) * 200)])
    want = {r["path"]: bytes(r["content"]) for r in other.contents().collect()}
    assert run(spark, ["delta", root, other.root, str(tmp / "delta")]) == 0
    delta = Image(spark, str(tmp / "delta"))
    assert {r["path"] for r in delta.files().collect()} == {"/docs/a.txt", "/more"}
    assert 0 < delta.drops().count() < other.drops().count()
    assert run(spark, ["apply", root, str(tmp / "delta")]) == 0
    assert {r["path"]: bytes(r["content"]) for r in image.contents().collect()} == want and not any(r["n"] for r in image.verify().collect())
    with pytest.raises(ImageError, match="another state"):
        image.apply(delta)
    one = Image(spark, str(tmp / "one"))
    one.build(spark.createDataFrame([("/docs/a.txt", 0, bytearray(b"top")), ("/only", 0, bytearray(content["/d.bin"]))], "path string, mtime_ns long, content binary"))
    assert run(spark, ["flatten", str(tmp / "flat"), root, one.root]) == 0
    flat = Image(spark, str(tmp / "flat"))
    assert {r["path"]: bytes(r["content"]) for r in flat.contents().collect()} == want | {"/docs/a.txt": b"top", "/only": content["/d.bin"]}
    assert not any(r["n"] for r in flat.verify().collect())


def test_verify_finds_a_changed_table(spark, made):
    root, _, _ = made
    image = Image(spark, root)
    files = image.files().collect()
    spark.createDataFrame([{**r.asDict(), "mtime_ns": 5} for r in files], image.files().schema).write.mode("overwrite").parquet(f"{image.place()}/files")
    assert {r["rule"]: r["n"] for r in image.verify().collect()}["root"] == 1 and run(spark, ["verify", root]) == 1


def test_layers_name_what_they_take_from_the_base(spark, made):
    root, content, tmp = made
    base, layer = Image(spark, root), Image(spark, str(tmp / "layer"))
    layer.build(base.contents().filter("path in ('/d.bin', '/docs/a.txt')"), base=base)
    taken = layer.references().collect()
    assert taken and all(r["codec"] == 0xFE and r["payload"] is None for r in taken)
    assert {r["drop_id"] for r in taken} == {r["drop_id"] for r in layer.reachable().collect()}
    assert {r["rule"]: r["n"] for r in layer.verify().collect()}["missing_drop"] == 0
    assert {r["path"]: bytes(r["content"]) for r in layer.contents(base=base).collect()}["/d.bin"] == content["/d.bin"]


def test_cached_drops(spark, made):
    image = Image(spark, made[0])
    ids = sorted(r["drop_id"] for r in image.drops().select("drop_id").collect())[:4]
    cache = image.reader(3)
    got = cache.get(ids[:2])
    assert (cache.hits, cache.misses) == (0, 2) and all(hashlib.sha256(raw).hexdigest() == i for i, raw in got.items())
    assert cache.get(ids[:2]) == got and cache.hits == 2
    cache.get(ids[2:])
    assert len(cache) == 3 and cache.evicted == 1
    cache.get([ids[0]])  # the least recently used one went
    assert cache.misses == 5
    with pytest.raises(KeyError):
        cache.get(["f" * 64])


def test_commands_on_keys_and_secrets(spark, made, capfd):
    root, _, tmp = made
    key, box = str(tmp / "key"), str(tmp / "box")
    assert run(spark, ["keygen", key]) == 0 and run(spark, ["keygen", box, "--kind", "X25519"]) == 0
    assert (tmp / "key").stat().st_mode & 0o077 == 0
    capfd.readouterr()
    assert run(spark, ["sign", root, key]) == 0
    (tmp / "side").write_text(capfd.readouterr().out)
    assert run(spark, ["verify-sig", root, str(tmp / "side"), "--trusted", f"{key}.pub"]) == 0
    Image(spark, root).change([("add", "/x", b"1")])
    with pytest.raises(SignatureError):
        run(spark, ["verify-sig", root, str(tmp / "side")])
    (tmp / "plain").write_bytes(b"some secret")
    assert run(spark, ["seal", str(tmp / "plain"), f"{box}.pub", str(tmp / "sealed")]) == 0
    assert b"some secret" not in (tmp / "sealed").read_bytes()
    assert run(spark, ["open", str(tmp / "sealed"), box, str(tmp / "opened")]) == 0 and (tmp / "opened").read_bytes() == b"some secret"
    assert run(spark, ["shamir-split", str(tmp / "plain"), "2", "3", str(tmp / "share")]) == 0
    assert run(spark, ["shamir-combine", str(tmp / "whole"), str(tmp / "share.3"), str(tmp / "share.1")]) == 0 and (tmp / "whole").read_bytes() == b"some secret"


def test_benchmark_command(spark, made, capfd):
    _, _, tmp = made
    capfd.readouterr()
    assert run(spark, ["benchmark", str(tmp / "src"), str(tmp / "bench"), "--runs", "1", "--profile", "max-speed"]) == 0
    lines = [x.split("\t") for x in capfd.readouterr().out.strip().splitlines()]
    assert lines[0][:3] == ["dataset", "profile", "op"] and [x[2] for x in lines[1:]] == ["build", "check", "extract"]


def test_inline_contents_stand_once(spark, tmp_path):
    image = Image(spark, str(tmp_path / "i"))
    rows = [(f"/a{i}", 0, bytearray(b"same")) for i in range(50)] + [("/b", 0, bytearray(b"")), ("/c", 0, bytearray(b"")), ("/d", 0, None)]
    image.build(spark.createDataFrame(rows, "path string, mtime_ns long, content binary"))
    assert sorted(bytes(r["content"]) for r in image.inline().collect()) == [b"", b"same"]
    image.change([("add", "/e", b"same"), ("add", "/f", b"other"), ("delete", "/b", None)])
    assert [bytes(r["content"]) for r in spark.read.parquet(image.entry()["inline"][-1]).collect()] == [b"other"]
    assert {r["path"]: bytes(r["content"]) for r in image.contents().collect()} == {f"/a{i}": b"same" for i in range(50)} | {"/c": b"", "/d": b"", "/e": b"same", "/f": b"other"}
    image.change([("delete", "/f", None)])
    image.compact()
    assert sorted(bytes(r["content"]) for r in image.inline().collect()) == [b"", b"same"]
    first = image.inline().limit(1).collect()
    spark.createDataFrame(first, image.inline().schema).write.mode("overwrite").parquet(image.entry()["inline"][0])
    assert {r["rule"]: r["n"] for r in image.verify().collect()}["missing_drop"] > 0


def test_counters_of_no_files(spark, tmp_path):
    """image_counters over documents without rows: no file, and the root alone."""
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert catalog.queries()["image_counters"](spark, str(tmp_path)).collect() == [(0, 1)]
