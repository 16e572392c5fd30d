"""python -m lakecairn COMMAND ...: builds, reads, changes, signs and measures dataset images, and keeps their secrets."""

from __future__ import annotations

import argparse
import base64
import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import signing
from .image import Image, ImageError
from .operators import redundancy, reports
from .plans.config import PROFILES
from .sources import files as S

TABLES = ("tree", "inspect", "summary", "slab", "gc", "dedup", "history", "check", "verify", "counters")
#: Commands on local files, with their arguments; the rest begin with an image.
LOCAL = {"keygen": ("key",), "seal": ("source", "recipient", "target"), "open": ("source", "key", "target"), "shamir-split": ("secret", "k", "n", "prefix"), "shamir-combine": ("target", "shares*"), "benchmark": ("directory", "scratch")}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakecairn", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: str, profile: bool = False) -> argparse.ArgumentParser:
        own = sub.add_parser(name)
        if name not in LOCAL:
            own.add_argument("image")
        for a in arguments:
            own.add_argument(a.rstrip("?*"), nargs=a[-1] if a[-1] in "?*" else None)
        if profile:
            own.add_argument("--profile", choices=sorted(PROFILES), default="balanced")
        return own

    add("build", "directory", profile=True).add_argument("--base")
    for name in TABLES:
        add(name)
    add("ls", "path?")
    add("stat", "path")
    cat = add("cat", "paths*")
    cat.add_argument("--offset", type=int, default=0)
    cat.add_argument("--length", type=int)
    add("extract", "target")
    add("add", "path", "source", profile=True)
    add("delete", "path", profile=True)
    add("diff", "other")
    add("turnover", profile=True)
    add("compact")
    add("root")
    add("sweep")
    add("delta", "other", "target")
    add("apply", "delta")
    add("flatten", "layers*")
    add("sign", "key")
    add("verify-sig", "sidecar").add_argument("--trusted")
    for name, arguments in LOCAL.items():
        own = add(name, *arguments, profile=name == "benchmark")
        if name == "keygen":
            own.add_argument("--kind", choices=("Ed25519", "X25519"), default="Ed25519")
        elif name == "benchmark":
            own.add_argument("--runs", type=int, default=3)
    return p


def _read_pair(path: str) -> signing.KeyPair:
    return signing.KeyPair(signing.body_of(Path(f"{path}.pub").read_text()), signing.body_of(Path(path).read_text()))


def _private(path: str, content: bytes) -> None:
    """A file that only its owner may read."""
    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "wb") as f:
        f.write(content)


def local(spark: SparkSession, a: argparse.Namespace) -> None:
    """Commands that need no image: keys, sealed files, shared secrets."""
    if a.command == "keygen":
        pair = signing.key_pair(spark, a.kind)
        _private(a.key, signing.pem(pair.private, "PRIVATE").encode())
        Path(f"{a.key}.pub").write_text(signing.pem(pair.public, "PUBLIC"))
    elif a.command == "seal":
        key, nonce = os.urandom(32), os.urandom(12)
        head = signing.wrap_key(spark, signing.body_of(Path(a.recipient).read_text()), key) | {"content_nonce": base64.b64encode(nonce).decode()}
        sealed = signing.seal(spark, "aes-256-gcm", key, nonce, Path(a.source).read_bytes())
        Path(a.target).write_bytes(json.dumps(head).encode() + b"\n" + sealed)
    elif a.command == "open":
        head, _, sealed = Path(a.source).read_bytes().partition(b"\n")
        envelope = json.loads(head)
        nonce = base64.b64decode(envelope.pop("content_nonce"))
        _private(a.target, signing.open_sealed(spark, "aes-256-gcm", signing.unwrap_key(spark, _read_pair(a.key), envelope), nonce, sealed))
    elif a.command == "shamir-split":
        for i, part in enumerate(redundancy.share(Path(a.secret).read_bytes(), int(a.k), int(a.n), os.urandom(32))):
            _private(f"{a.prefix}.{i + 1}", part)
    elif a.command == "shamir-combine":
        _private(a.target, redundancy.combine([Path(x).read_bytes() for x in a.shares]))


def measured(spark: SparkSession, directory: str, scratch: str, profile: str, runs: int) -> DataFrame:
    """reports.bench_summary of building, checking and extracting the directory, each ``runs`` times. rss is that of the driver's Python."""
    import resource
    import uuid

    files = S.directory(spark, directory)
    size = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    rows = []
    for _ in range(runs):
        place = f"{scratch.rstrip('/')}/{uuid.uuid4().hex}"
        image = Image(spark, f"{place}/image")
        for op, step in (("build", lambda: image.build(files, profile)), ("check", lambda: image.check().collect()), ("extract", lambda: image.extract(f"{place}/out"))):  # noqa: B023
            start = time.perf_counter()
            step()
            took = time.perf_counter() - start
            rows.append((directory, profile, op, took, size, image.summary().first()["stored"], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss))
    return reports.bench_summary(spark.createDataFrame(rows, "dataset string, profile string, op string, seconds double, bytes_in long, bytes_out long, rss long"), "dataset", "profile", "op")


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)

    def show(df: DataFrame) -> None:
        print("\t".join(df.columns))
        for row in df.toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in row))

    if a.command == "benchmark":
        show(measured(spark, a.directory, a.scratch, a.profile, a.runs).orderBy("op"))
        return 0
    if a.command in LOCAL:
        local(spark, a)
        return 0
    image = Image(spark, a.image)
    if a.command == "build":
        print(image.build(S.directory(spark, a.directory), a.profile, base=Image(spark, a.base) if a.base else None))
    elif a.command in TABLES:
        df = image.log() if a.command == "history" else getattr(image, a.command)()
        show(df)
        if a.command == "check":
            return int(df.first()["failed"] > 0)
        if a.command == "verify":
            return int(any(r["n"] for r in df.collect()))
    elif a.command == "ls":
        show(image.ls(a.path or "/"))
    elif a.command == "stat":
        show(image.stat(a.path))
    elif a.command == "cat":
        found = {r["path"]: bytes(r["content"]) for r in image.cat_multi(a.paths, a.offset, a.length).collect()}
        for path in a.paths:
            if path not in found:
                raise ImageError(f"no file {path}")
            sys.stdout.buffer.write(found[path])
    elif a.command == "extract":
        print(image.extract(a.target))
    elif a.command == "add":
        with open(a.source, "rb") as f:
            print(image.change([("add", a.path, f.read())], a.profile))
    elif a.command == "delete":
        print(image.change([("delete", a.path, None)], a.profile))
    elif a.command == "diff":
        show(image.diff(Image(spark, a.other)).orderBy("path"))
    elif a.command == "turnover":
        print(image.turnover(a.profile))
    elif a.command == "compact":
        print(image.compact())
    elif a.command == "root":
        print(image.root_id())
    elif a.command == "sweep":
        print(image.sweep())
    elif a.command == "delta":
        show(image.delta(Image(spark, a.other), a.target).files().select("path", "size").orderBy("path"))
    elif a.command == "apply":
        print(image.apply(Image(spark, a.delta)))
    elif a.command == "flatten":
        Image.flatten([Image(spark, x) for x in a.layers], a.image)
    elif a.command == "sign":
        print(signing.sign(spark, _read_pair(a.key), image.root_id()))
    elif a.command == "verify-sig":
        trusted = signing.body_of(Path(a.trusted).read_text()) if a.trusted else None
        signing.verify(spark, Path(a.sidecar).read_text(), image.root_id(), trusted)
    return 0


def main() -> int:
    spark = SparkSession.builder.appName("lakecairn").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        return run(spark, sys.argv[1:])
    except (ImageError, FileNotFoundError, signing.SignatureError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
