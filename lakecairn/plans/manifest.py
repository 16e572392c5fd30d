"""The description of an image: named sections, each checked when it is read.

A section is a JSON object below its name. An unknown section, or a required feature
that this engine doesn't have, is refused rather than passed over; every list and text has
a ceiling, so a damaged description cannot ask for more memory than that.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.codecs import BY_ID
from . import registries

#: The most shards or shares, bytes of a share, of a hint and of inline metadata, and entries of a list.
MOST_SHARDS = 255
SHARE_BYTES = 1024
HINT_BYTES = 4096
INLINE_BYTES = 1 << 20
MOST_ENTRIES = 1 << 16
VERSIONS = {"drops": 1, "metadata": 1, "manifest": 1}
#: Features by id; a writer may require them of a reader.
FEATURES = {1: "dictionaries", 2: "layers", 3: "special codecs", 4: "erasure", 5: "encryption"}


class ManifestError(ValueError):
    pass


def _check(ok: bool, why: str) -> None:  # noqa: FBT001
    if not ok:
        raise ManifestError(why)


def _whole(value: Any, name: str, least: int, most: int) -> None:
    _check(isinstance(value, int) and not isinstance(value, bool) and least <= value <= most, f"{name} must be a whole number from {least} to {most}")


def _hash(value: Any, name: str) -> None:
    _check(isinstance(value, str) and len(value) == 64 and set(value) <= set("0123456789abcdef"), f"{name} must be 64 hex digits")


def _entries(value: Any, name: str) -> None:
    _check(isinstance(value, (list, tuple)) and len(value) <= MOST_ENTRIES, f"{name} must be a list of at most {MOST_ENTRIES}")


@dataclass(frozen=True)
class Header:
    drops: int = 1
    metadata: int = 1
    manifest: int = 1

    def validate(self) -> None:
        for name, known in VERSIONS.items():
            _whole(getattr(self, name), f"{name} version", 1, known)


@dataclass(frozen=True)
class Features:
    """(id, required); 0 is reserved, none comes twice, and a required one must be known."""

    flags: list[tuple[int, bool]] = field(default_factory=list)

    def validate(self) -> None:
        _entries(self.flags, "flags")
        for flag, required in self.flags:
            _whole(flag, "a feature's id", 1, 0xFFFF)
            _check(isinstance(required, bool), "required must be true or false")
            _check(not required or flag in FEATURES, f"feature {flag} is required and not known")
        _check(len({f for f, _ in self.flags}) == len(self.flags), "a feature comes twice")


@dataclass(frozen=True)
class MetadataReference:
    """Where the metadata lies: locators, or the bytes themselves in base64, never both or none."""

    hash: str
    length: int
    codec: int = 0
    locators: list[str] = field(default_factory=list)
    inline: str | None = None

    def validate(self) -> None:
        _hash(self.hash, "the metadata's hash")
        _whole(self.length, "the metadata's length", 0, 0xFFFFFFFF)
        _check(self.codec in BY_ID, f"codec {self.codec} is not known")
        _entries(self.locators, "locators")
        _check(bool(self.locators) != (self.inline is not None), "metadata is either inline or at a locator")
        _check(all(":" in u for u in self.locators), "a locator has no scheme")
        _check(self.inline is None or len(base64.b64decode(self.inline, validate=True)) <= INLINE_BYTES, "inline metadata is too large")


@dataclass(frozen=True)
class SlabIndex:
    """(slab id, locators) by ordinal."""

    slabs: list[tuple[str, list[str]]] = field(default_factory=list)

    def validate(self) -> None:
        _entries(self.slabs, "slabs")
        for slab, locators in self.slabs:
            _hash(slab, "a slab's id")
            _entries(locators, "locators")
            _check(bool(locators) and all(":" in u for u in locators), "a slab needs locators with schemes")
        _check(len({s for s, _ in self.slabs}) == len(self.slabs), "a slab comes twice")


@dataclass(frozen=True)
class DeltaLinkage:
    """The root that a delta applies to, and (A, R or M; path)."""

    base: str
    ops: list[tuple[str, str]] = field(default_factory=list)

    def validate(self) -> None:
        _hash(self.base, "the base's root")
        _entries(self.ops, "ops")
        _check(all(op in "ARM" and len(op) == 1 and path.startswith("/") for op, path in self.ops), "an operation is A, R or M of a path")
        _check(len({p for _, p in self.ops}) == len(self.ops), "a path comes twice")


@dataclass(frozen=True)
class ErasurePolicy:
    """k data and m parity shards, with others for single slabs."""

    k: int
    m: int
    scheme: int = 1
    overrides: list[tuple[str, int, int]] = field(default_factory=list)

    def validate(self) -> None:
        _check(registries.lookup_or_none("erasure", self.scheme) == "reed-solomon-gf256", f"erasure scheme {self.scheme} is not computed here")
        for k, m in [(self.k, self.m), *[(k, m) for _, k, m in self.overrides]]:
            _whole(k, "k", 1, MOST_SHARDS)
            _whole(m, "m", 0, MOST_SHARDS)
            _check(k + m <= MOST_SHARDS, f"k + m is more than {MOST_SHARDS}")
        _entries(self.overrides, "overrides")
        for slab, *_ in self.overrides:
            _hash(slab, "a slab's id")
        _check(len({s for s, *_ in self.overrides}) == len(self.overrides), "a slab comes twice")

    def of(self, slab: str) -> tuple[int, int]:
        return next(((k, m) for s, k, m in self.overrides if s == slab), (self.k, self.m))


@dataclass(frozen=True)
class SharingPolicy:
    """k of n shares, held by named custodians (custodian, share in base64)."""

    k: int
    n: int
    shares: list[tuple[str, str]]
    scheme: int = 1
    hint: str | None = None

    def validate(self) -> None:
        _check(registries.lookup_or_none("sharing", self.scheme) == "shamir", f"sharing scheme {self.scheme} is not computed here")
        _whole(self.n, "n", 1, MOST_SHARDS)
        _whole(self.k, "k", 1, self.n)
        _check(len(self.shares) == self.n, "there must be n shares")
        _check(all(c for c, _ in self.shares) and len({c for c, _ in self.shares}) == self.n, "each custodian holds one share")
        _check(all(0 < len(base64.b64decode(s, validate=True)) <= SHARE_BYTES for _, s in self.shares), f"a share has 1 to {SHARE_BYTES} bytes")
        _check(self.hint is None or len(self.hint.encode()) <= HINT_BYTES, f"the hint has at most {HINT_BYTES} bytes")


@dataclass(frozen=True)
class EncryptionPolicy:
    """The cipher, and keys wrapped for their recipients (recipient's public key, envelope)."""

    cipher: int
    recipients: list[tuple[str, dict[str, str]]] = field(default_factory=list)
    version: int = 1

    def validate(self) -> None:
        _whole(self.version, "version", 1, 1)
        _check(registries.lookup_or_none("cipher", self.cipher, here=True) is not None, f"cipher {self.cipher} is not computed here")
        _entries(self.recipients, "recipients")
        _check(self.cipher == 0 or bool(self.recipients), "an encrypted image needs a recipient")
        _check(all(set(e) == {"ephemeral", "nonce", "sealed"} for _, e in self.recipients), "an envelope has an ephemeral key, a nonce and the sealed key")


#: Sections in their order; the header comes first and is required.
SECTIONS: dict[str, Callable[..., Any]] = {"header": Header, "features": Features, "metadata": MetadataReference, "slabs": SlabIndex, "delta": DeltaLinkage, "erasure": ErasurePolicy, "sharing": SharingPolicy, "encryption": EncryptionPolicy}


def _tuples(value: Any) -> Any:
    return [tuple(_tuples(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for v in value] if isinstance(value, list) else value


def parse(text: str) -> dict[str, Any]:
    """The checked sections of a description."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise ManifestError("the description is no JSON") from e
    _check(isinstance(raw, dict) and "header" in raw, "the description has no header")
    _check(list(raw) == [s for s in SECTIONS if s in raw], "sections are unknown or out of order")
    out = {}
    for name, body in raw.items():
        try:
            out[name] = SECTIONS[name](**{k: _tuples(v) for k, v in body.items()})
            out[name].validate()
        except (TypeError, AttributeError, ValueError) as e:
            raise e if isinstance(e, ManifestError) else ManifestError(f"{name}: {e}") from e
    return out


def encode(sections: dict[str, Any]) -> str:
    """The text of sections, checked, in their order."""
    text = json.dumps({s: asdict(sections[s]) for s in SECTIONS if s in sections})
    parse(text)
    return text


def table(spark: SparkSession, sections: dict[str, Any]) -> DataFrame:
    """section, body (JSON) for each section."""
    return spark.createDataFrame([(s, json.dumps(asdict(sections[s]), sort_keys=True)) for s in SECTIONS if s in sections], "section string, body string")
