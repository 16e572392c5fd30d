"""Paths, modes, URIs, byte ranges and ratios as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMAT_MASK = 0xF000
#: The file-type bits of POSIX modes.
KINDS = {0x4000: "dir", 0x8000: "file", 0xA000: "symlink", 0x2000: "device", 0x6000: "device", 0x1000: "pipe", 0xC000: "socket"}


def normalise(path: Column) -> Column:
    """One leading slash, no empty parts, none at the end; the root is ``/``."""
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(F.trim(path), "/"), lambda p: p != ""), "/"))


def parent(path: Column) -> Column:
    """The directory of a normalised path; null for the root."""
    return F.when(path == "/", F.lit(None)).otherwise(F.coalesce(F.nullif(F.regexp_replace(path, "/[^/]*$", ""), F.lit("")), F.lit("/")))


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth(path: Column) -> Column:
    return F.when(path == "/", 0).otherwise(F.size(F.split(path, "/")) - 1)


def kind_of_mode(mode: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.coalesce(kinds[mode.bitwiseAND(F.lit(FORMAT_MASK))], F.lit("unknown"))


def scheme(uri: Column) -> Column:
    """What stands before the first colon; null without one."""
    return F.when(F.instr(uri, ":") > 1, F.lower(F.substring_index(uri, ":", 1)))


def byte_range(content: Column, offset: Column, length: Column) -> Column:
    """Bytes [offset, offset + length) as far as there are any; a null length reads to the end."""
    size = F.octet_length(content)
    start = F.least(F.greatest(offset, F.lit(0)), size)
    return F.substring(content, start + 1, F.greatest(F.least(F.coalesce(length, size), size - start), F.lit(0)))


def ratio(out: Column, into: Column) -> Column:
    """out / in, 1.0 for nothing in."""
    return F.when(into == 0, F.lit(1.0)).otherwise(out.cast("double") / into.cast("double"))


def permille(out: Column, into: Column) -> Column:
    return F.when(into == 0, F.lit(1000)).otherwise(F.floor(out * 1000 / into)).cast("long")
