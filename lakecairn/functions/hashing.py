"""Digests, their text form, and 64-bit mixing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name of the digest, to be stored beside every id.
DIGEST = "sha2-256"
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def digest(content: Column) -> Column:
    """Content id: 64 lowercase hex digits."""
    return F.sha2(content, 256)


def text_digest(hex_digest: Column) -> Column:
    """Lower-case base32 without padding, after the name of the digest."""
    padded = F.concat(hex_digest, F.lit("0"))
    groups = [F.lpad(F.conv(F.substring(padded, at, 10), 16, 32), 8, "0") for at in range(1, 61, 10)]  # 40 bits are 10 hex digits or 8 letters
    groups.append(F.lpad(F.conv(F.substring(padded, 61, 5), 16, 32), 4, "0"))
    return F.concat(F.lit("s2:"), F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32))


def splitmix64(x: np.ndarray) -> np.ndarray:
    """The public 64-bit finaliser, wrapping. In NumPy: Spark's ANSI arithmetic raises on overflow."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))
