"""What a piece of content is: magic numbers, entropy, ratios, class and format headers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of content that classification looks at.
SAMPLE = 4096
#: Samples whose bytes are counted together.
RATED_AT_ONCE = 512

# Class ids, thresholds and magic numbers of the public formats, first match wins.
CLASS_IDS = {"text": 1, "code": 2, "binary": 3, "compressed": 4, "media": 5, "sparse": 6, "incompressible": 7}
LOW_ENTROPY = 0.5
INCOMPRESSIBLE = 6.5
ZERO_RATIO = 0.8
PRINTABLE_RATIO = 0.85
#: (class, offset, hex of the bytes there, least length of the content)
MAGIC = (
    ("compressed", 0, "1F8B", 2),
    ("compressed", 0, "28B52FFD", 4),
    ("compressed", 0, "FD377A585A00", 6),
    ("compressed", 0, "425A68", 3),
    ("compressed", 0, "377ABCAF271C", 6),
    ("media", 0, "FFD8FF", 3),
    ("media", 0, "89504E47", 4),
    ("media", 0, "474946383761", 6),
    ("media", 0, "474946383961", 6),
    ("media", 8, "57454250", 12),
    ("media", 0, "FFFB", 2),
    ("media", 0, "494433", 3),
    ("media", 0, "664C6143", 4),
    ("media", 4, "66747970", 12),
    ("media", 0, "4F676753", 4),
    ("code", 0, "7F454C46", 4),
    ("code", 0, "FEEDFACE", 4),
    ("code", 0, "FEEDFACF", 4),
    ("code", 0, "CEFAEDFE", 4),
    ("code", 0, "CFFAEDFE", 4),
    ("code", 0, "4D5A", 2),
)
CSV_EXTENSIONS = ("csv", "tsv", "json", "jsonl", "ndjson")


def magic_class(content: Column) -> Column:
    """The class that the first bytes name, or null."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.lit(None).cast("string")
    for kind, offset, value, least in reversed(MAGIC):
        hit = (F.substring(head, 2 * offset + 1, len(value)) == value) & (F.octet_length(content) >= least)
        if value == "57454250":
            hit &= F.substring(head, 1, 8) == "52494646"
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("entropy", "zero_ratio", "printable_ratio")]))
def sample_ratios(content: pd.Series) -> pd.DataFrame:
    """Bits per byte, share of zero bytes, share of printable ASCII and \\n \\r \\t, over the first SAMPLE bytes; zeros when empty."""
    printable = np.zeros(256, bool)
    printable[32:127] = True
    printable[[9, 10, 13]] = True
    times = np.arange(SAMPLE + 1, dtype=float)
    weight = times * np.log2(np.maximum(times, 1))
    parts = [np.zeros((0, 3))]
    for at in range(0, len(content), RATED_AT_ONCE):
        samples = [(raw or b"")[:SAMPLE] for raw in content.iloc[at : at + RATED_AT_ONCE]]
        sizes = np.fromiter(map(len, samples), np.int64, len(samples))
        place = np.repeat(np.arange(len(samples)) * 256, sizes) + np.frombuffer(b"".join(samples), np.uint8)
        counts = np.bincount(place, minlength=256 * len(samples)).reshape(-1, 256)
        n = np.maximum(sizes, 1)
        entropy = np.maximum(np.log2(n) - weight[counts].sum(axis=1) / n, 0.0)
        parts.append(np.stack([entropy, counts[:, 0] / n, counts[:, printable].sum(axis=1) / n], axis=1))
    return pd.DataFrame(np.concatenate(parts), columns=["entropy", "zero_ratio", "printable_ratio"])


def content_class(content: Column, ratios: Column) -> Column:
    """Empty is sparse; magic wins; then zeros, entropy and printable bytes decide."""
    return (
        F.when(F.octet_length(content) == 0, "sparse")
        .when(magic_class(content).isNotNull(), magic_class(content))
        .when((ratios["entropy"] < LOW_ENTROPY) & (ratios["zero_ratio"] > ZERO_RATIO), "sparse")
        .when(ratios["entropy"] >= INCOMPRESSIBLE, "incompressible")
        .when(ratios["printable_ratio"] > PRINTABLE_RATIO, "text")
        .otherwise("binary")
    )


def class_id(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in CLASS_IDS.items() for x in kv])[name]


def looks_tabular(path: Column, content: Column) -> Column:
    """A known extension, 95 % printable and over 1 % of ``,"{}[]`` in the sample. JVM only: latin-1 is a character a byte."""
    sample = F.decode(F.substring(content, 1, SAMPLE), "ISO-8859-1")
    n = F.length(sample)
    printable = n - F.length(F.regexp_replace(sample, r"[\x20-\x7E\n\r\t]", ""))
    marks = n - F.length(F.regexp_replace(sample, r'[,"{}\[\]]', ""))
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return extension.isin(*CSV_EXTENSIONS) & (n > 0) & (printable >= 0.95 * n) & (marks > 0.01 * n)


def executable_arch(raw: bytes) -> str | None:
    """x86-64 or arm64 of an ELF, PE or Mach-O header."""
    names = {(b"elf", 62): "x86-64", (b"elf", 183): "arm64", (b"pe", 0x8664): "x86-64", (b"pe", 0xAA64): "arm64", (b"mac", 0x01000007): "x86-64", (b"mac", 0x0100000C): "arm64"}
    if len(raw) < 20:
        return None
    if raw[:4] == b"\x7fELF":
        return names.get((b"elf", struct.unpack_from("<H", raw, 18)[0]))
    if raw[:2] == b"MZ" and len(raw) >= 64:
        at = struct.unpack_from("<I", raw, 60)[0]
        return names.get((b"pe", struct.unpack_from("<H", raw, at + 4)[0])) if raw[at : at + 4] == b"PE\0\0" and len(raw) >= at + 6 else None
    if raw[:4] in (b"\xcf\xfa\xed\xfe", b"\xce\xfa\xed\xfe"):
        return names.get((b"mac", struct.unpack_from("<I", raw, 4)[0]))
    if raw[:4] in (b"\xfe\xed\xfa\xcf", b"\xfe\xed\xfa\xce"):
        return names.get((b"mac", struct.unpack_from(">I", raw, 4)[0]))
    return None


def fits_header(raw: bytes) -> dict[str, int] | None:
    """bitpix, naxis, naxis1, naxis2 of the first header block."""
    if not raw.startswith(b"SIMPLE") or len(raw) < 86:
        return None
    cards = {}
    for at in range(0, min(len(raw), 2880) - 79, 80):
        key = raw[at : at + 8].rstrip()
        if key == b"END":
            break
        try:
            cards[key] = int(raw[at + 10 : at + 30])
        except ValueError:
            continue
    if b"BITPIX" not in cards or b"NAXIS" not in cards:
        return None
    return {"bitpix": cards[b"BITPIX"], "naxis": cards[b"NAXIS"], "naxis1": cards.get(b"NAXIS1", 0), "naxis2": cards.get(b"NAXIS2", 0)}


def _riff_parts(raw: bytes, order: str) -> Iterator[tuple[bytes, bytes]]:
    at = 12
    while at + 8 <= len(raw):
        size = struct.unpack_from(order + "I", raw, at + 4)[0]
        if at + 8 + size > len(raw):
            return
        yield raw[at : at + 4], raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def pcm_header(raw: bytes) -> dict[str, int | str] | None:
    """rate, channels, bits and byte order of an uncompressed WAV or AIFF."""
    if raw[:4] == b"RIFF" and raw[8:12] == b"WAVE":
        for kind, body in _riff_parts(raw, "<"):
            if kind == b"fmt ":
                if len(body) < 16:
                    return None
                tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
                return {"rate": rate, "channels": channels, "bits": bits, "order": "little"} if tag == 1 else None
    if raw[:4] == b"FORM" and raw[8:12] == b"AIFF":
        for kind, body in _riff_parts(raw, ">"):
            if kind == b"COMM" and len(body) >= 18:
                channels, _, bits, exponent, mantissa = struct.unpack_from(">hIhHQ", body)
                return {"rate": int(mantissa * 2.0 ** (exponent - 16383 - 63)), "channels": channels, "bits": bits, "order": "big"}
    return None


def special_category(raw: bytes) -> str | None:
    """The first special format that claims the content: ``exec:<arch>``, ``fits:<bitpix>``, ``pcm:<rate>/<channels>/<bits>``."""
    if arch := executable_arch(raw):
        return f"exec:{arch}"
    if fits := fits_header(raw):
        return f"fits:{fits['bitpix']}"
    if pcm := pcm_header(raw):
        return f"pcm:{pcm['rate']}/{pcm['channels']}/{pcm['bits']}"
    return None


def is_tabular(path: str, raw: bytes) -> bool:
    """looks_tabular for a task's own bytes."""
    sample = raw[:SAMPLE]
    marks = len(sample) - len(sample.translate(None, b',"{}[]'))
    printable = len(sample) - len(sample.translate(None, bytes([9, 10, 13, *range(0x20, 0x7F)])))
    name, dot, extension = path.rpartition(".")
    return bool(dot) and extension.lower() in CSV_EXTENSIONS and len(sample) > 0 and printable >= 0.95 * len(sample) and marks > 0.01 * len(sample)


def file_category(path: str, raw: bytes) -> str | None:
    """The special format of a file, or ``tabular``, or none."""
    return special_category(raw) or ("tabular" if is_tabular(path, raw) else None)


@F.pandas_udf(T.StringType())
def categorize(path: pd.Series, content: pd.Series) -> pd.Series:
    """special_category of each file, or null."""
    return content.map(lambda raw: special_category(raw or b""))
