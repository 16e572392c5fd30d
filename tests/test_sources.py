"""Locators over the web, ranges, streams of content, and the description of an image."""

from __future__ import annotations

import io
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakecairn.operators import chunking
from lakecairn.plans import manifest as M
from lakecairn.sources import locators as L

BODY = bytes(range(256)) * 40


@pytest.fixture(scope="module")
def server():
    asked = []
    block = L.cid_text(L.cid(BODY))

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append((self.path, self.headers.get("Range")))
            own = self.headers.get("Range") if "whole" not in self.path else None
            body, status = BODY, 200
            if "missing" in self.path:
                body, status = b"", 404
            elif own:
                a, b = map(int, own.removeprefix("bytes=").split("-"))
                body, status = BODY[a : b + 1], 206 if a < len(BODY) else 416
            elif "wrong" in self.path:
                body = b"other"
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", asked, block
    httpd.shutdown()


def one(df):
    return bytes(df.first()["content"])


def test_web_locators(spark, server):
    address, asked, block = server
    found = L.Locators()
    with pytest.raises(L.LocatorError):
        found.pick([f"{address}/a"])
    found.register_web(address)
    assert one(found.fetch(spark, [["nothing:x", f"{address}/a"]])) == BODY
    assert one(found.fetch_range(spark, [[f"{address}/a"]], 1000, 20)) == BODY[1000:1020]
    assert ("/a", "bytes=1000-1019") in asked
    assert one(found.fetch_range(spark, [[f"{address}/whole"]], 1000, 20)) == BODY[1000:1020]
    assert one(found.fetch_range(spark, [[f"{address}/a"]], 10**6, 20)) == b""
    assert one(found.fetch_range(spark, [[f"{address}/a"]], 5, 0)) == b""
    assert one(found.fetch(spark, [[f"ipfs://{block}"]])) == BODY and (f"/ipfs/{block}", None) in asked
    with pytest.raises(L.LocatorError):
        L.gateway_address(address, "ipfs://a/../b")
    with pytest.raises(Exception, match="404"):
        found.fetch(spark, [[f"{address}/missing"]]).collect()
    # a raw block that isn't the one named
    wrong = L.cid_text(L.cid(b"something else"))
    with pytest.raises(Exception, match="doesn't match"):
        found.fetch(spark, [[f"ipfs://{wrong}"]]).collect()


def test_ranges_of_files(spark, tmp_path):
    (tmp_path / "f").write_bytes(BODY)
    uri = f"file://{tmp_path}/f"
    found = L.Locators()
    for offset, length in ((0, 5), (100, 1000), (len(BODY) - 3, 10), (len(BODY) + 5, 2), (7, 0)):
        assert one(found.fetch_range(spark, [[uri]], offset, length)) == BODY[offset : offset + length]
    found.register("file", L._hadoop)  # no reader of ranges: the whole unit is cut
    assert one(found.fetch_range(spark, [[uri]], 100, 1000)) == BODY[100:1100]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 9000), st.integers(1, 3000), st.sampled_from([(64, 256, 1024), (16, 16, 64), (1, 2, 3)]))
def test_streamed_content_has_the_same_cuts(seed, size, block, sizes):
    raw = np.random.default_rng(seed).integers(0, 7, size, dtype=np.uint8).tobytes()
    assert list(chunking.stream_boundaries(io.BytesIO(raw).read, *sizes, block=block)) == chunking.boundaries(raw, *sizes)


H = "0" * 64
GOOD = {
    "header": M.Header(), "features": M.Features([(1, True), (900, False)]), "metadata": M.MetadataReference(H, 10, 2, inline="aGk="),
    "slabs": M.SlabIndex([(H, ["file:/a", "s3a://b/c"])]), "delta": M.DeltaLinkage(H, [("A", "/a"), ("R", "/b")]),
    "erasure": M.ErasurePolicy(4, 2, overrides=[(H, 2, 1)]), "sharing": M.SharingPolicy(1, 2, [("ann", "YQ=="), ("bob", "Yg==")], hint="ask"),
    "encryption": M.EncryptionPolicy(2, [("key", {"ephemeral": "a", "nonce": "b", "sealed": "c"})]),
}


def test_descriptions(spark):
    assert M.parse(M.encode(GOOD)) == GOOD
    assert M.parse(M.encode({"header": M.Header()})) == {"header": M.Header()}
    assert GOOD["erasure"].of(H) == (2, 1) and GOOD["erasure"].of("1" * 64) == (4, 2)
    assert [r["section"] for r in M.table(spark, GOOD).collect()] == list(M.SECTIONS)


BAD = [
    ("header", {"drops": 2}), ("header", {"drops": True}), ("features", {"flags": [[0, False]]}), ("features", {"flags": [[1, True], [1, False]]}), ("features", {"flags": [[900, True]]}),
    ("features", {"flags": [[1, 1]]}), ("metadata", {"inline": None}), ("metadata", {"locators": ["file:/x"]}), ("metadata", {"codec": 0x77}), ("metadata", {"hash": "xyz"}), ("metadata", {"length": -1}),
    ("metadata", {"inline": "A" * 2_000_000}), ("slabs", {"slabs": [[H, ["a"]], [H, ["b:"]]]}), ("slabs", {"slabs": [[H, []]]}), ("delta", {"ops": [["X", "/a"]]}), ("delta", {"ops": [["A", "/a"], ["R", "/a"]]}),
    ("erasure", {"k": 0}), ("erasure", {"k": 200, "m": 100}), ("erasure", {"scheme": 9}), ("erasure", {"overrides": [[H, 1, 1], [H, 2, 1]]}), ("sharing", {"k": 3}), ("sharing", {"n": 3}),
    ("sharing", {"shares": [["ann", "YQ=="], ["ann", "Yg=="]]}), ("sharing", {"shares": [["ann", ""], ["bob", "Yg=="]]}), ("sharing", {"hint": "x" * 5000}), ("encryption", {"cipher": 3}),
    ("encryption", {"recipients": []}), ("encryption", {"recipients": [["k", {"nonce": "a"}]]}), ("encryption", {"what": 1}),
]


@pytest.mark.parametrize(("section", "change"), BAD)
def test_damaged_descriptions_are_refused(section, change):
    raw = json.loads(M.encode(GOOD))
    raw[section] |= change
    with pytest.raises(M.ManifestError):
        M.parse(json.dumps(raw))


def test_order_and_unknown_sections():
    raw = json.loads(M.encode(GOOD))
    for bad in ({k: v for k, v in raw.items() if k != "header"}, {"features": raw["features"], "header": raw["header"]}, raw | {"more": {}}, []):
        with pytest.raises(M.ManifestError):
            M.parse(json.dumps(bad))
    with pytest.raises(M.ManifestError):
        M.parse("{")
