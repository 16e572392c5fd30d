"""Compression codecs by id, and the choice of one for a chunk."""

from __future__ import annotations

import bz2
import contextlib
import lzma
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard

from . import filters


@dataclass(frozen=True)
class Codec:
    id: int
    name: str
    compress: Callable[[bytes], bytes]
    decompress: Callable[[bytes, int], bytes]


def _arrow(name: str) -> tuple[Callable[[bytes], bytes], Callable[[bytes, int], bytes]]:
    codec = pa.Codec(name)
    return (lambda raw: codec.compress(raw, asbytes=True)), (lambda raw, n: codec.decompress(raw, n, asbytes=True) if n else b"")


def _sized(raw: bytes, compress: Callable[[bytes], bytes]) -> bytes:
    """The length before the compressed form."""
    return len(raw).to_bytes(4, "little") + compress(raw)


def _plain(raw: bytes, decompress_: Callable[[bytes, int], bytes]) -> bytes:
    return decompress_(raw[4:], int.from_bytes(raw[:4], "little"))


def byte_shuffle(raw: bytes, width: int = 4) -> bytes:
    """First bytes of all elements, then second bytes, and so on; a rest shorter than an element stays at the end."""
    cut = len(raw) - len(raw) % width
    return np.frombuffer(raw[:cut], np.uint8).reshape(-1, width).T.tobytes() + raw[cut:]


def byte_unshuffle(raw: bytes, width: int = 4) -> bytes:
    cut = len(raw) - len(raw) % width
    return np.frombuffer(raw[:cut], np.uint8).reshape(width, -1).T.tobytes() + raw[cut:]


def bit_shuffle(raw: bytes, block: int = 8) -> bytes:
    """Bit planes of each run of ``block`` bytes; a rest stays at the end."""
    cut = len(raw) - len(raw) % block
    bits = np.unpackbits(np.frombuffer(raw[:cut], np.uint8)).reshape(-1, block, 8)
    return np.packbits(bits.transpose(2, 0, 1)).tobytes() + raw[cut:]


def bit_unshuffle(raw: bytes, block: int = 8) -> bytes:
    cut = len(raw) - len(raw) % block
    bits = np.unpackbits(np.frombuffer(raw[:cut], np.uint8)).reshape(8, -1, block)
    return np.packbits(bits.transpose(1, 2, 0)).tobytes() + raw[cut:]


def _xz(raw: bytes) -> bytes:
    """The usual preset with a dictionary that is as large as the content calls for, 8 MB at most: a larger one is only cleared memory."""
    size = min(1 << 23, max(1 << 12, 1 << max(0, len(raw) - 1).bit_length()))
    return lzma.compress(raw, filters=[{"id": lzma.FILTER_LZMA2, "preset": lzma.PRESET_DEFAULT, "dict_size": size}])


def _registry() -> dict[str, Codec]:
    lz4, lz4_back = _arrow("lz4_raw")
    brotli, brotli_back = _arrow("brotli")
    snappy, snappy_back = _arrow("snappy")
    zstd_own, zstd_other = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    zstd = zstd_own.compress
    zstd_back = lambda raw, n: zstd_other.decompress(raw, max_output_size=max(n, 1))
    # Fixed ids of the codecs.
    found = (
        Codec(0x00, "store", lambda raw: raw, lambda raw, n: raw),
        Codec(0x01, "lz4", lz4, lz4_back),
        Codec(0x02, "zstd", zstd, zstd_back),
        Codec(0x03, "xz", _xz, lambda raw, n: lzma.decompress(raw)),
        Codec(0x04, "brotli", brotli, brotli_back),
        Codec(0x05, "deflate", lambda raw: zlib.compress(raw, 6), lambda raw, n: zlib.decompress(raw)),
        Codec(0x06, "snappy", snappy, snappy_back),
        Codec(0x07, "flac", lambda raw: filters.best_prediction(raw, (0, 1, 2, 3), (1, 2), "<u2"), lambda raw, n: filters.unpredicted(raw, n, "<u2")),
        Codec(0x08, "ricepp", lambda raw: filters.best_prediction(raw, (0, 1), (1,), ">u2"), lambda raw, n: filters.unpredicted(raw, n, ">u2")),
        Codec(0x09, "fsst+brotli", lambda raw: _sized(filters.with_symbols(raw), brotli), lambda raw, n: filters.without_symbols(_plain(raw, brotli_back))),
        Codec(0x0A, "shuffle+lz4", lambda raw: lz4(byte_shuffle(raw)), lambda raw, n: byte_unshuffle(lz4_back(raw, n))),
        Codec(0x0E, "shuffle+zstd", lambda raw: zstd(byte_shuffle(raw)), lambda raw, n: byte_unshuffle(zstd_back(raw, n))),
        Codec(0x0F, "bitshuffle+lz4", lambda raw: lz4(bit_shuffle(raw)), lambda raw, n: bit_unshuffle(lz4_back(raw, n))),
        Codec(0x10, "bzip2", bz2.compress, lambda raw, n: bz2.decompress(raw)),
        Codec(0x13, "lz4-hc", lz4, lz4_back),
        Codec(0x14, "libdeflate", lambda raw: zlib.compress(raw, 9), lambda raw, n: zlib.decompress(raw)),
        Codec(0x20, "bcj-x86+lz4", lambda raw: lz4(filters.x86_branches(raw)), lambda raw, n: filters.x86_branches(lz4_back(raw, n), back=True)),
        Codec(0x21, "bcj-x86+zstd", lambda raw: zstd(filters.x86_branches(raw)), lambda raw, n: filters.x86_branches(zstd_back(raw, n), back=True)),
        Codec(0x23, "bcj-arm64+lz4", lambda raw: lz4(filters.arm64_branches(raw)), lambda raw, n: filters.arm64_branches(lz4_back(raw, n), back=True)),
        Codec(0x24, "bcj-arm64+zstd", lambda raw: zstd(filters.arm64_branches(raw)), lambda raw, n: filters.arm64_branches(zstd_back(raw, n), back=True)),
    )
    assert len({c.id for c in found}) == len(found), "duplicate codec id"
    return {c.name: c for c in found}


CODECS = _registry()
BY_ID = {c.id: c for c in CODECS.values()}


#: Fixed value: says that a drop is stored in a base, not here.
REFERENCED = 0xFE


def decompress(codec: int, payload: bytes, plain_len: int) -> bytes:
    """By id; an unknown one, or that of a drop in a base, is an error. Tasks call this by name, as codecs themselves can't be sent to them."""
    if codec == REFERENCED:
        raise ValueError("the drop is stored in the base")
    return BY_ID[codec].decompress(payload, plain_len)


def round_trips(raw: bytes) -> list[bool]:
    """For each codec in the registry's order whether it gives the content back."""
    return [c.decompress(c.compress(raw), len(raw)) == raw for c in CODECS.values()]


@dataclass(frozen=True)
class Tournament:
    codecs: Sequence[str] = ("lz4", "zstd", "brotli")
    text_codec: str = "brotli"
    binary_codec: str = "zstd"
    min_size: int = 256
    skip_binary: bool = False
    stop_permille: int = 0
    #: Whole files: no tournament, the binary codec for binary content and the text codec for all other.
    by_class: bool = False


def choose(raw: bytes, kind: str, rules: Tournament) -> tuple[int, bytes]:
    """(codec id, encoded): the smallest candidate, the earlier of equals, never larger than the content itself.

    Media, compressed and incompressible content is stored; content below the least
    size, or binary content when told so, goes straight to its class's codec.
    """
    if rules.by_class:
        codec = CODECS[rules.binary_codec if kind == "binary" else rules.text_codec]
        encoded = codec.compress(raw)
        return (codec.id, encoded) if len(encoded) < len(raw) else (0, raw)
    usual = {"binary": rules.binary_codec, "text": rules.text_codec, "code": rules.text_codec, "sparse": rules.text_codec}.get(kind, "store")
    if usual == "store":
        return 0, raw
    if len(raw) < rules.min_size or kind == "binary" and rules.skip_binary:
        names: Sequence[str] = (usual,)
    else:
        names = [n for n in rules.codecs if n != "store"]
    best = (0, raw)
    for n in names:
        encoded = CODECS[n].compress(raw)
        if len(encoded) < len(best[1]):
            best = (CODECS[n].id, encoded)
        if len(encoded) < len(raw) and rules.stop_permille and len(encoded) * 1000 // len(raw) <= rules.stop_permille:
            break
    return best


#: Codecs of special formats by the beginning of their category.
SPECIAL = (("exec:x86", "bcj-x86+zstd"), ("exec:arm64", "bcj-arm64+zstd"), ("exec:aarch64", "bcj-arm64+zstd"), ("fits:", "ricepp"), ("pcm:", "flac"), ("tabular", "fsst+brotli"))
#: Shares of the plain length from which on a second general codec and the category's own are tried.
SECOND_ABOVE, SPECIAL_ABOVE = 0.05, 0.15


def special_codec(category: str | None) -> str | None:
    return next((codec for start, codec in SPECIAL if category and category.startswith(start)), None)


def choose_whole(raw: bytes, special: str | None) -> tuple[int, bytes]:
    """(codec id, encoded) of a whole file: brotli, zstd unless that is small already, the category's own where both did poorly.

    ricepp is tried in any case. A codec that fails on the content is passed over; content is never stored larger than it is.
    """
    best = (0, raw)

    def attempt(name: str) -> None:
        nonlocal best
        with contextlib.suppress(Exception):
            encoded = CODECS[name].compress(raw)
            if len(encoded) < len(best[1]):
                best = (CODECS[name].id, encoded)

    attempt("brotli")
    if len(best[1]) > SECOND_ABOVE * len(raw):
        attempt("zstd")
    if special and (special == "ricepp" or len(best[1]) > SPECIAL_ABOVE * len(raw)):
        attempt(special)
    return best
