"""Build profiles and their checks; TOML round trip."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, replace

from ..functions.codecs import CODECS, Tournament


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Profile:
    name: str
    sizes: tuple[int, int, int]
    text_codec: str
    binary_codec: str
    metadata_codec: str
    inline_threshold: int
    candidates: tuple[str, ...]
    min_size: int
    skip_binary: bool
    stop_permille: int
    dictionaries: bool
    min_class_size: int
    max_dict_size: int
    mode: str = "read-only"
    turnover_threshold: int = 0
    whole_files: bool = False
    metadata_quality: int = 5

    def validate(self) -> Profile:
        least, average, most = self.sizes
        if not 0 < least <= average <= most:
            raise ConfigError("chunk sizes must be positive and in order")
        if not 1 <= self.metadata_quality <= 11:
            raise ConfigError("metadata quality is 1 to 11")
        if not 0 <= self.stop_permille <= 1000:
            raise ConfigError("the short-circuit threshold is at most 1000 per mille")
        if len(set(self.candidates)) != len(self.candidates):
            raise ConfigError("a candidate is named twice")
        for codec in (self.text_codec, self.binary_codec, self.metadata_codec, *self.candidates):
            if codec not in CODECS:
                raise ConfigError(f"unknown codec {codec}")
        return self

    def tournament(self) -> Tournament:
        return Tournament(self.candidates, self.text_codec, self.binary_codec, self.min_size, self.skip_binary, self.stop_permille)

    def to_toml(self) -> str:
        def said(v: object) -> str:
            if isinstance(v, bool):
                return str(v).lower()
            if isinstance(v, (tuple, list)):
                return "[" + ", ".join(map(said, v)) + "]"
            return f'"{v}"' if isinstance(v, str) else str(v)

        return "".join(f"{k} = {said(v)}\n" for k, v in asdict(self).items())

    @classmethod
    def from_toml(cls, text: str) -> Profile:
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in tomllib.loads(text).items()}
        try:
            return cls(**values).validate()
        except TypeError as e:
            raise ConfigError(str(e)) from e


# Fixed values of the nine profiles. Candidates without a codec here are left out.
PROFILES = {
    p.name: p.validate()
    for p in (
        Profile("max-ratio", (8192, 65_536, 262_144), "brotli", "zstd", "brotli", 8192, ("store", "lz4", "lz4-hc", "zstd", "brotli", "bzip2"), 256, False, 0, True, 50, 131_072, metadata_quality=11),
        Profile("max-speed", (512, 4096, 16_384), "lz4", "lz4", "lz4", 4096, ("store", "lz4"), 0, True, 500, False, 0, 0),
        Profile("balanced", (2048, 16_384, 65_536), "brotli", "lz4", "zstd", 4096, ("store", "lz4", "brotli"), 256, True, 250, True, 100, 65_536),
        Profile("competitive", (1024, 8192, 65_536), "zstd", "lz4", "zstd", 4096, ("store", "lz4", "brotli"), 0, True, 250, False, 0, 0),
        Profile("max-read", (8192, 65_536, 262_144), "zstd", "zstd", "zstd", 8192, ("store", "lz4", "zstd", "brotli"), 256, False, 200, True, 50, 131_072),
        Profile("max-write", (16_384, 131_072, 524_288), "lz4", "lz4", "lz4", 4096, ("store", "lz4"), 0, True, 500, False, 0, 0, whole_files=True),
        Profile("max-write-rw", (16_384, 131_072, 524_288), "lz4", "lz4", "lz4", 4096, ("store", "lz4"), 0, True, 500, False, 0, 0, "read-write", 500, True),
        Profile("max-read-rw", (8192, 65_536, 262_144), "zstd", "zstd", "zstd", 8192, ("store", "lz4", "zstd", "brotli"), 256, False, 200, True, 50, 131_072, "read-write", 1000),
        Profile("balanced-rw", (2048, 16_384, 65_536), "zstd", "lz4", "zstd", 4096, ("store", "lz4", "zstd"), 256, True, 250, True, 100, 65_536, "read-write", 1000),
    )
}


def select(name: str) -> Profile:
    if name not in PROFILES:
        raise ConfigError(f"unknown profile {name}")
    return PROFILES[name]


def custom(base: str, **changes: object) -> Profile:
    return replace(select(base), name="custom", **changes).validate()
