"""What steps hold and move, and contents that are empty or null."""

from __future__ import annotations

import base64
import hashlib
import lzma
import random
import re
import time
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakecairn.functions import filters, hashing
from lakecairn.functions.codecs import CODECS
from lakecairn.operators import changes, redundancy, sketches, storage
from lakecairn.plans import catalog
from lakecairn.sources import scratch


def test_bloom_filters_travel_as_words(spark):
    ids = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("drop_id"))
    filters = sketches.build(ids, 20_000)
    assert filters.dtypes == [("word", "bigint"), ("bits", "bigint")]
    kept = filters.collect()
    assert len(kept) <= -(-sketches.bits_for(20_000, 0.01) >> 6) and len({r["word"] for r in kept}) == len(kept)
    want = set(sketches.places([r["drop_id"] for r in ids.collect()], sketches.bits_for(20_000, 0.01), 7).ravel().tolist())
    assert {r["word"] * 64 + k for r in kept for k in range(64) if r["bits"] >> k & 1} == want
    other = spark.range(20_000, 40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("drop_id"))
    assert sketches.probe(ids, filters, 20_000).filter("not maybe").count() == 0
    assert sketches.probe(other, filters, 20_000).filter("maybe").count() < 400


def test_batches_are_bounded_unless_set(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.newSession()
    scratch.bounded(own.range(1))
    assert own.conf.get(name).removesuffix("b") == str(scratch.BATCH_BYTES)
    other = spark.newSession()
    other.conf.set(name, "123456")
    scratch.bounded(other.range(1))
    assert other.conf.get(name).removesuffix("b") == "123456"


def _with_symbols(raw):
    """The symbol codec as a plain model: a pattern of the table's strings, the longest first."""

    def pattern(table):
        return re.compile(b"|".join([*(re.escape(s) for s in sorted(table, key=lambda s: (-len(s), s))), b"."]), re.DOTALL)

    table = []
    for _ in range(5):
        parts = pattern(table).findall(raw)
        gain = Counter(parts)
        gain.update(a + b for a, b in zip(parts, parts[1:], strict=False) if len(a) + len(b) <= 8)
        table = [s for s, _ in sorted(gain.items(), key=lambda x: (-x[1] * len(x[0]), x[0]))[:255]]
    code = {s: bytes([i]) for i, s in enumerate(table)}
    body = b"".join(code.get(p) or b"\xff" + p for p in pattern(table).findall(raw))
    return bytes([len(table)]) + b"".join(bytes([len(s)]) + s for s in table) + body


@settings(max_examples=80, deadline=None)
@given(st.one_of(st.binary(max_size=300), st.lists(st.sampled_from([b"\0", b"a", b"ab", b"abcdefgh", b"\xff", b"the "]), max_size=300).map(b"".join)))
def test_symbols_as_the_plain_model(raw):
    assert filters.with_symbols(raw) == _with_symbols(raw)
    assert filters.without_symbols(filters.with_symbols(raw)) == raw


def test_symbols_of_a_text_take_less_than_patterns_did():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=400)).encode() for _ in range(12)]
    filters.with_symbols(texts[0])

    def seconds(f):
        began = time.process_time()
        for t in texts:
            f(t)
        return time.process_time() - began

    assert seconds(filters.with_symbols) < 0.5 * seconds(_with_symbols)


def test_xz_clears_no_more_memory_than_the_content_calls_for():
    for n in (0, 1, 100, 5000, 1 << 17):
        raw = bytes(range(250)) * (n // 250) + bytes(n % 250)
        made = CODECS["xz"].compress(raw)
        assert lzma.decompress(made) == raw and lzma.LZMADecompressor(memlimit=(1 << 20) + 4 * n).decompress(made) == raw
        assert CODECS["xz"].decompress(lzma.compress(raw), n) == raw


def test_round_trips_are_spread(spark):
    made = catalog.queries()["codec_round_trips"](spark, "/root/testdata/sf0.001")
    parts = made.groupBy(F.spark_partition_id()).count().count()
    assert parts > spark.sparkContext.defaultParallelism


def test_empty_texts_are_contents(spark, tmp_path):
    texts = [(1, "a"), (2, ""), (3, None), (4, "a"), (5, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in catalog.queries()["verify_content"](spark, str(tmp_path)).collect()] == [(2, 2, 0)]


def test_shares_of_many_secrets():
    secrets = [bytes([i]) * (1 + i % 7) + b"x" for i in range(200)]
    seeds = [b"s%d" % i for i in range(200)]
    made = redundancy.share_many(secrets, 3, 5, seeds)
    assert made == [redundancy.share(s, 3, 5, x) for s, x in zip(secrets, seeds, strict=True)]
    assert made[2][0] == bytes.fromhex("01a2a45561")
    some = [[own[j] for j in ((0, 1, 2), (4, 0, 3), (0, 1, 2, 3))[i % 3]] for i, own in enumerate(made)]
    assert redundancy.combine_many(some) == secrets
    calls, whole = [], redundancy.multiply
    try:
        redundancy.multiply = lambda a, b: calls.append(1) or whole(a, b)
        redundancy.combine_many(redundancy.share_many(secrets, 3, 5, seeds))
    finally:
        redundancy.multiply = whole
    assert len(calls) < len(secrets)


def test_replay_of_many_roots_in_few_batches(spark, monkeypatch):
    rows = [(i, 0, 0, "mkdir", "/in", None, None, 1) for i in range(300)] + [(i, 1, 0, "add", "/in/f", None, "x", 2) for i in range(300)]
    ops = spark.createDataFrame(rows, "root long, epoch int, pos long, op string, path string, to string, drop_id string, mode int").coalesce(1)
    sizes = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            sizes.add(1)
            yield b

    own = type(ops).mapInArrow
    monkeypatch.setattr(type(ops), "mapInArrow", lambda self, f, schema: own(self, lambda batches: count(f(batches)), schema))
    assert changes.replay(ops).count() == 600
    assert sizes.value <= 8


def test_removals_do_not_look_through_the_state():
    class State(dict):
        def __iter__(self):
            raise AssertionError("looked through")

    state, under = State(), {}
    for i in range(50):
        changes._apply(state, "add", f"/in/{i}", None, "x", 1, under)
    for i in range(50):
        changes._apply(state, "remove", f"/in/{i}", None, None, None, under)
    assert not len(state) and not any(under.values())


def test_text_digests_need_no_function_for_each_letter(spark):
    made = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("d")).select("d", hashing.text_digest(F.col("d")).alias("t"))
    assert all(r["t"] == "s2:" + base64.b32encode(bytes.fromhex(r["d"])).decode().lower().rstrip("=") for r in made.collect())
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan


def test_files_leave_in_bounded_batches():
    part = {"seq": 0, "drop_id": "d", "drop_start": 0, "drop_len": 3 << 20, "codec": 0, "plain_len": 3 << 20, "dict_id": None, "payload": bytes(3 << 20)}
    kind = pa.list_(pa.struct([("seq", pa.int32()), ("drop_id", pa.string()), ("drop_start", pa.int32()), ("drop_len", pa.int32()), ("codec", pa.int32()), ("plain_len", pa.int64()), ("dict_id", pa.int32()), ("payload", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array([[part], [part], [part, part], [part], [part]], kind)], ["key", "parts"])
    made = list(storage._joiner({})([batch]))
    assert [b.column(0).to_pylist() for b in made] == [[0, 1], [2], [3, 4]]
    assert [len(c) >> 20 for b in made for c in b.column(1).to_pylist()] == [3, 3, 6, 3, 3]


def test_contents_are_not_moved_for_their_number(spark):
    rows = [(10 + i, f"/f/{i}", bytearray(bytes(range(256)) * (1 + i % 3))) for i in range(9)]
    named = spark.createDataFrame(rows, "file_id long, path string, content binary")
    own = storage.build(named.select("path", "content"), (64, 256, 1024), ids=named.select("path", "file_id"))
    usual = storage.build(named.select("file_id", "content"), (64, 256, 1024))
    assert {tuple(r) for r in own["slices"].collect()} == {tuple(r) for r in usual["slices"].select(*own["slices"].columns).collect()}
    read = storage.read_files(own["slices"].join(named.select("file_id", F.struct("path").alias("file")), "file_id"), own["drops"], key="file")
    assert {r["path"]: bytes(r["content"]) for r in read.select("file.path", "content").collect()} == {p: bytes(c) for _, p, c in rows}


def test_dictionaries_travel_with_the_code(spark):
    texts = [f"line {i} of a text with words that come again {i % 7} and again {i % 11}, and a number {i * i}".encode() for i in range(400)]
    rows = [(hashlib.sha256(t).hexdigest(), len(t), "text", CODECS["zstd"].id, len(CODECS["zstd"].compress(t)), bytearray(CODECS["zstd"].compress(t))) for t in texts]
    drops = spark.createDataFrame(rows, "drop_id string, plain_len long, class string, codec int, enc_len long, payload binary")
    made, found = storage.with_profile_dictionaries(drops, 2048, 50)
    assert made.filter("dict_id is not null and enc_len = octet_length(payload)").count() > 300
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r["drop_id"]: bytes(r["chunk"]) for r in storage.plain(made, found).collect()} == {r[0]: t for r, t in zip(rows, texts, strict=True)}


def test_one_sequence_is_packed_in_blocks(spark, monkeypatch):
    rng = random.Random(7)
    for bits, most, capacity in ((4, 900, 5000), (5, 6000, 5000), (6, 20, 1000)):
        monkeypatch.setattr(storage, "BLOCK_BITS", 7)
        monkeypatch.setattr(storage, "RECORD_BYTES", 49)
        lengths = [rng.randrange(most) for _ in range(300 * bits)]
        df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "k long, n long")
        slab = used = offset = 0
        want = []
        for i, n in enumerate(lengths):
            if used and used + n + 49 > capacity - storage.HEADER_BYTES:
                slab, used, offset = slab + 1, 0, 0
            want.append((i, slab, offset))
            used, offset = used + n + 49, offset + n
        made = storage.pack(df, capacity, order="k", length="n")
        assert sorted((r["k"], r["slab"], r["offset"]) for r in made.collect()) == want
        assert "FlatMapGroupsInArrow" in made._jdf.queryExecution().optimizedPlan().toString()
