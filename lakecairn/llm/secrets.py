"""Operator 10: secret scans judged by how widely a candidate is owned.

Patterns give candidate spans. The hash of each candidate's value is aggregated
over the corpus by distinct repositories and owners: a value that stands in
COPIED_REPOS repositories or belongs to COPIED_OWNERS owners is a copied example,
a value of fewer repositories and only one or two owners looks live.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Fixed patterns of the contract: kind, pattern, group that holds the value, its least length.
BASE = (
    ("assign", rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", rb"AKIA[A-Z0-9]+", 0, 16),
    ("hex", rb"[0-9a-f]+", 0, 32),
)
#: Further public token formats.
MORE = (
    ("github", rb"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", rb"xox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("pem", rb"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    ("login", rb"[a-z][a-z0-9+.-]{1,20}://[^\s/:@\"'<>]{1,64}:([^\s/@\"'<>]{3,128})@", 1, 3),
)
KINDS = tuple(k for k, *_ in (*BASE, *MORE))
#: Bytes that a text must hold (A-Z lower-cased) for a pattern to be worth trying; hex has none.
NEEDS = {"assign": (b"passw", b"secret", b"token", b"api"), "access": (b"akia",), "github": (b"gh",), "slack": (b"xox",), "jwt": (b"eyj",), "pem": (b"private key",), "login": (b"://",)}
CONTINUED = bytes(range(0x80, 0xC0))
#: A run of 32 is where a hex match of 32 or more begins; shorter runs need no visit.
LONG_HEX = re.compile(rb"[0-9a-f]{32,}")
#: From so many distinct repositories on, a value is a copied example.
COPIED_REPOS = 3
#: From so many distinct owners on as well, whatever the number of repositories.
COPIED_OWNERS = 3
COMPILED = {k: re.compile(p) for k, p, *_ in (*BASE, *MORE)} | {"hex": LONG_HEX}


def spans(raw: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, place of the kind in KINDS, end, value) in bytes, by start and kind; leftmost and non-overlapping in each kind."""
    low, out = raw.translate(C.LOWER), []
    for i, (kind, _, group, least) in enumerate((*BASE, *MORE)):
        if any(x in low for x in NEEDS[kind]) if kind in NEEDS else True:
            out += [(m.start(), i, m.end(), m[group]) for m in COMPILED[kind].finditer(raw) if len(m[group]) >= least]
    return sorted(out)


def places(raw: bytes, offsets: list[int]) -> dict[int, int]:
    """The code points before each byte offset, counted in one pass over the text."""
    if raw.isascii():
        return dict(zip(offsets, offsets, strict=True))
    out, at, n = {}, 0, 0
    for x in sorted(set(offsets)):
        n += len(raw[at:x].translate(None, CONTINUED))
        out[x], at = n, x
    return out


def _extractor() -> Callable[[list[bytes]], list[list]]:
    def texts_of(texts: list[bytes]) -> list[list]:
        rows = []
        for raw in texts:
            found = spans(raw)
            if not found:
                rows.append((0, 0, 0, EMPTY, "", []))
                continue
            place = places(raw, [x for a, _, b, _ in found for x in (a, b)])
            said = [(i, f"{KINDS[i]}:{place[a]}:{place[b]}", value) for a, i, b, value in found]
            base = ",".join(s for i, s, _ in said if i < len(BASE))
            counts = [sum(i == k for i, *_ in said) for k in range(3)]
            rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(s for _, s, _ in said), [hashlib.sha256(v).digest()[:16].hex() for *_, v in said]))
        return [list(x) for x in zip(*rows, strict=True)] if rows else [[] for _ in range(6)]

    return texts_of


EMPTY = hashlib.sha256(b"").hexdigest()


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: counts, digest and spans, with the hashes of the values in the spans' order."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{repo_col}`").cast("string").alias("repo"), F.col(f"`{owner_col}`").cast("string").alias("owner"))
    fields = [C.long("n_assign"), C.long("n_access"), C.long("n_hex"), C.string("base_sha256"), C.string("spans"), T.StructField("hashes", T.ArrayType(T.StringType()))]
    return C.map_texts(rows, _extractor, fields, ("doc_id", "repo", "owner"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners: distinct repositories and owners of each value.

    Null counts as a repository or owner of its own; an owner in several repositories
    counts once. Counted in two steps, so a value with a third of all rows is first
    summed where its rows are.
    """
    pairs = found.select(F.explode(F.array_distinct("hashes")).alias("hash"), F.coalesce("repo", F.lit("\0")).alias("repo"), F.coalesce("owner", F.lit("\0")).alias("owner"))
    return pairs.groupBy("hash").agg(F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"))


def verdicts(found: DataFrame, row: str, copied_repos: int, copied_owners: int) -> DataFrame:
    """row, each: at, live, n_repos and n_owners of the row's spans, in their order."""
    live = (F.col("n_repos") < copied_repos) & (F.col("n_owners") < copied_owners)
    each = found.select(row, F.posexplode("hashes").alias("at", "hash")).join(C.written(ownership(found), "owned"), "hash")
    return each.groupBy(row).agg(F.sort_array(F.collect_list(F.struct("at", live.alias("live"), "n_repos", "n_owners"))).alias("each"))


def scan(docs: DataFrame, *, copied_repos: int = COPIED_REPOS, copied_owners: int = COPIED_OWNERS, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, live, n_repos, n_owners.

    ``live`` says for each span, in order, whether its value stands in fewer than
    ``copied_repos`` repositories and belongs to fewer than ``copied_owners`` owners;
    ``n_repos`` and ``n_owners`` give both counts for each span. A null text is empty; null ids, repositories
    and owners are allowed; repeated rows give repeated results, an empty table none.
    """
    found = C.written(candidates(docs, id_col=id_col, text_col=text_col, repo_col=repo_col, owner_col=owner_col).withColumn("row", F.monotonically_increasing_id()), "secrets")
    held = found.filter(F.size("hashes") > 0)
    verdict = verdicts(held, "row", copied_repos, copied_owners)
    out = found.drop("repo", "owner", "hashes").join(verdict, "row", "left")
    for name, kind in (("live", "boolean"), ("n_repos", "bigint"), ("n_owners", "bigint")):
        out = out.withColumn(name, F.coalesce(F.col(f"each.{name}"), F.array().cast(f"array<{kind}>")))
    n_live = F.size(F.filter("live", lambda x: x)).cast("long")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", n_live.alias("n_live"), (F.size("live") - n_live).cast("long").alias("n_copied"), "live", "n_repos", "n_owners")


def masked(text: str, said: str, live: list[bool]) -> str:
    """The text with each live span replaced by a mark of its kind; overlapping spans go together."""
    out, at = [], 0
    for span, on in zip(said.split(","), live, strict=True):
        kind, a, b = span.split(":")
        if not on or int(b) <= at:
            continue
        out += [text[at : max(at, int(a))], f"[{kind}]" if int(a) >= at else ""]
        at = int(b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, copied_repos: int = COPIED_REPOS, copied_owners: int = COPIED_OWNERS, text_col: str = "text", repo_col: str = "source", owner_col: str = "doc_id", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with live-looking secrets masked in the text and ``chars_col`` (its code points) kept in step.

    The scanned rows are written once; only rows with a live value are joined with
    the verdicts, so the texts of all others are not shuffled. Rows and columns
    stay, whatever the columns' names; null and empty texts pass through, repeated rows
    stay alike, an empty table stays empty.
    """
    plain, name, back = C.shielded(docs, text_col)
    names = plain.columns
    fields = [C.string("spans"), T.StructField("hashes", T.ArrayType(T.StringType()))]
    found = C.map_texts(plain, lambda: lambda texts: _extractor()(texts)[4:], fields, tuple(names))
    found = C.written(found.withColumn("row", F.monotonically_increasing_id()), "secrets")
    held = found.filter(F.size("hashes") > 0)
    values = held.select("row", "hashes", F.col(name(repo_col)).cast("string").alias("repo"), F.col(name(owner_col)).cast("string").alias("owner"))
    verdict = verdicts(values, "row", copied_repos, copied_owners).select("row", F.col("each.live").alias("live"))
    clean = F.udf(masked, T.StringType(), useArrow=True)
    done = held.join(verdict, "row", "left").withColumn("text", clean(F.col("text"), "spans", "live"))
    if name(text_col) != "text":
        done = done.withColumn(name(text_col), F.col("text").cast(docs.schema[text_col].dataType))
    if chars_col in docs.columns:
        done = done.withColumn(name(chars_col), F.length("text").cast(docs.schema[chars_col].dataType))
    return back(found.filter(F.size("hashes") == 0).select(*names).unionByName(done.select(*names)))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    out = scan(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied", said("live"), said("n_repos"), said("n_owners"))
