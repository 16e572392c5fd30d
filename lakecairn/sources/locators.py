"""Where units of storage lie: locators by URI scheme, range reads, content addresses."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

#: Schemes that the cluster's file systems serve; further ones need their jar on the class path.
HADOOP_SCHEMES = ("file", "hdfs", "s3a", "gs", "abfs", "viewfs")


class LocatorError(ValueError):
    pass


Reader = Callable[[SparkSession, list[str]], DataFrame]
RangeReader = Callable[[SparkSession, list[str], int, int], DataFrame]


class Locators:
    """Readers by scheme; of several locators of a unit the first that has a reader is used."""

    def __init__(self) -> None:
        self.readers: dict[str, Reader] = dict.fromkeys(HADOOP_SCHEMES, _hadoop)
        self.ranges: dict[str, RangeReader] = dict.fromkeys(HADOOP_SCHEMES, _hadoop_range)

    def register(self, scheme: str, reader: Reader, ranges: RangeReader | None = None) -> None:
        """A reader of whole units, and one of byte ranges if there is a way that doesn't read all."""
        if not scheme.isalnum() or not scheme[0].isalpha():
            raise LocatorError(f"{scheme!r} is no scheme")
        self.readers[scheme.lower()] = reader
        self.ranges.pop(scheme.lower(), None)
        if ranges:
            self.ranges[scheme.lower()] = ranges

    def register_web(self, gateway: str | None = None, *, timeout: float = 30.0) -> None:
        """http and https; with the address of a gateway, ipfs as well."""
        for scheme in ("http", "https"):
            self.register(scheme, lambda spark, uris: _web(spark, [(u, u) for u in uris], None, timeout), lambda spark, uris, a, n: _web(spark, [(u, u) for u in uris], (a, n), timeout))
        if gateway:
            self.register("ipfs", lambda spark, uris: _web(spark, [(u, gateway_address(gateway, u)) for u in uris], None, timeout), lambda spark, uris, a, n: _web(spark, [(u, gateway_address(gateway, u)) for u in uris], (a, n), timeout))

    def pick(self, uris: Iterable[str]) -> tuple[str, str]:
        for uri in uris:
            scheme, colon, _ = uri.partition(":")
            if colon and scheme.lower() in self.readers:
                return scheme.lower(), uri
        raise LocatorError("no reader for any of the locators")

    def _by_scheme(self, uris: list[list[str]]) -> dict[str, list[str]]:
        by: dict[str, list[str]] = {}
        for own in uris:
            scheme, uri = self.pick(own)
            by.setdefault(scheme, []).append(uri)
        return by

    def fetch(self, spark: SparkSession, uris: list[list[str]]) -> DataFrame:
        """uri, content for a driver-side list of units, each with its locators; schemes are read in one scan each."""
        return _together(spark, [self.readers[scheme](spark, own) for scheme, own in self._by_scheme(uris).items()])

    def fetch_range(self, spark: SparkSession, uris: list[list[str]], offset: int, length: int) -> DataFrame:
        """The bytes [offset, offset + length) of each unit; only a scheme without a reader of ranges reads units whole."""
        parts = []
        for scheme, own in self._by_scheme(uris).items():
            if scheme in self.ranges:
                parts.append(self.ranges[scheme](spark, own, offset, length))
            else:
                parts.append(self.readers[scheme](spark, own).select("uri", P.byte_range(F.col("content"), F.lit(offset), F.lit(length)).alias("content")))
        return _together(spark, parts)


def _together(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "uri string, content binary")


def _hadoop(spark: SparkSession, uris: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(uris).select(F.col("path").alias("uri"), "content")


def _hadoop_range(spark: SparkSession, uris: list[str], offset: int, length: int) -> DataFrame:
    """Opened, sought and read on the driver: of each unit in its list the bytes asked for, and no more."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    commons = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    rows = []
    for uri in uris:
        path = hadoop(uri)
        system = path.getFileSystem(conf)
        size = max(0, min(length, system.getFileStatus(path).getLen() - offset))
        raw = b""
        if size:
            stream = system.open(path)
            try:
                stream.seek(offset)
                raw = bytes(commons.toByteArray(stream, size))
            finally:
                stream.close()
        rows.append((uri, bytearray(raw)))
    return spark.createDataFrame(rows, "uri string, content binary")


def gateway_address(gateway: str, uri: str) -> str:
    """The address at a gateway of ``ipfs://<content id>/<path>``."""
    rest = uri.partition(":")[2].lstrip("/")
    if not rest or ".." in rest.split("/"):
        raise LocatorError(f"{uri} has no content id")
    return f"{gateway.rstrip('/')}/ipfs/{rest}"


def _web(spark: SparkSession, uris: list[tuple[str, str]], part: tuple[int, int] | None, timeout: float) -> DataFrame:
    """uri, content read by the tasks; a whole raw block is checked against the content id in its locator. Errors fail the task, which is tried again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        for batch in batches:
            for uri, address in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                headers = {"Range": f"bytes={part[0]}-{part[0] + part[1] - 1}"} if part else {}
                raw = b""
                if part is None or part[1]:
                    try:
                        with urlopen(Request(address, headers=headers), timeout=timeout) as answer:  # noqa: S310
                            raw = answer.read()
                            if part and answer.status != 206:  # the server sent all of it
                                raw = raw[part[0] : part[0] + part[1]]
                    except HTTPError as e:
                        if not part or e.code != 416:  # 416: nothing at that place
                            raise
                named = uri.partition(":")[2].lstrip("/")
                if part is None and uri.startswith("ipfs:") and named.startswith("bafkrei") and "/" not in named and cid_text(cid(raw)) != named:
                    raise LocatorError(f"{uri}: the content doesn't match its id")
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([raw], pa.binary())], ["uri", "content"])

    rows = spark.createDataFrame(uris, "uri string, address string").repartition(max(1, min(len(uris), 64)))
    return rows.mapInArrow(run, "uri string, content binary")


def locate(drops: DataFrame, slab_index: DataFrame) -> DataFrame:
    """drop_id, slab, uri: the first locator of each drop's slab."""
    first = slab_index.select(F.col("ordinal").alias("slab"), F.element_at("locators", 1).alias("uri"))
    return drops.select("drop_id", "slab").join(first, "slab").select("drop_id", "slab", "uri")


# Interchange containers: unsigned varints, raw SHA-256 content ids and version 1 archives.


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(raw: bytes, at: int = 0) -> tuple[int, int]:
    """(number, place after it)."""
    n = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise LocatorError("varint is cut short")
        n |= (raw[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if raw[at - 1] < 128:
            return n, at


def cid(raw: bytes) -> bytes:
    """Version 1, raw codec 0x55, SHA-256 multihash 0x12 of 32 bytes."""
    return b"\x01\x55\x12\x20" + hashlib.sha256(raw).digest()


def cid_text(binary: bytes) -> str:
    return "b" + base64.b32encode(binary).decode().rstrip("=").lower()


def encode_car(blocks: list[bytes]) -> bytes:
    """An archive whose root is the first block."""
    root = b"\xd8\x2a\x58\x25\x00" + cid(blocks[0])  # a tagged link in the header's map
    header = b"\xa2\x65roots\x81" + root + b"\x67version\x01"
    parts = [varint(len(header)), header]
    for b in blocks:
        parts += [varint(len(b) + 36), cid(b), b]
    return b"".join(parts)


def decode_car(raw: bytes) -> list[bytes]:
    """The blocks; each is checked against its id."""
    size, at = read_varint(raw)
    at += size
    out = []
    while at < len(raw):
        size, at = read_varint(raw, at)
        body = raw[at + 36 : at + size]
        if at + size > len(raw) or cid(body) != raw[at : at + 36]:
            raise LocatorError("a block doesn't match its id")
        out.append(body)
        at += size
    return out
