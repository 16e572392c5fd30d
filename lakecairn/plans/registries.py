"""Ids of schemes by kind, as a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.codecs import CODECS

# Fixed values. ``here`` says whether this engine computes it.
ERASURE = ((0x00, "none", True), (0x01, "reed-solomon-gf256", True), (0xFF, "extended", False))
SHARING = ((0x01, "shamir", True), (0xFF, "extended", False))
CIPHERS = ((0x00, "plaintext", True), (0x01, "xchacha20-poly1305", True), (0x02, "aes-256-gcm", True), (0x03, "aes-256-ocb", False), (0xFF, "extended", False))


def table(spark: SparkSession) -> DataFrame:
    """kind, id, name, here."""
    rows = [(kind, i, name, here) for kind, own in (("erasure", ERASURE), ("sharing", SHARING), ("cipher", CIPHERS)) for i, name, here in own]
    rows += [("codec", c.id, c.name, True) for c in CODECS.values()]
    return spark.createDataFrame(rows, "kind string, id int, name string, here boolean")


def lookup(kind: str, id_: int) -> str:
    for i, name, _ in {"erasure": ERASURE, "sharing": SHARING, "cipher": CIPHERS}[kind]:
        if i == id_:
            return name
    raise KeyError(f"{kind} {id_:#04x} is not known")


def lookup_or_none(kind: str, id_: int, *, here: bool = False) -> str | None:
    """The name, or none; with ``here``, only of schemes that this engine computes."""
    return next((name for i, name, own in {"erasure": ERASURE, "sharing": SHARING, "cipher": CIPHERS}[kind] if i == id_ and (own or not here)), None)
