"""Operator 9: a ledger of quality rules, one bit for each, judged by versioned policies.

The ledger is computed once: measurements and, in ``failed``, one bit for each
rule that the text fails. A policy is a mask of the bits that reject, so a new
policy or an ablation is bitwise arithmetic over the ledger and reads no text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")
#: A rule's bit is its place here. Each is a condition on the measurements under which the text fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > 3 * n_words",
    "shouting": "n_letters >= 50 and 10 * n_upper > 7 * n_letters",
    "odd_word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 25 * n_words)",
    "repeated_lines": "n_lines >= 4 and 10 * n_dup_lines > 7 * n_lines",
    "no_letters": "n_words > 0 and 4 * n_letters < word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Policies by version: which failures reject.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["many_symbols"] | BIT["shouting"] | BIT["no_letters"],
    "v2": sum(BIT.values()),
}
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
CONTINUED = bytes(range(0x80, 0xC0))
UPPER = bytes(range(65, 91))
NOT_LETTERS = bytes(c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122)) + CONTINUED


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text, the first included."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    size = len(index)
    pairs = ids[:-1] * size + ids[1:]
    if size >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * size + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    if not same.any():
        return 0
    found = np.zeros(n - 2, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for i in range(3):
        inside[i : n - 2 + i] |= found
    return int(inside.sum())


def measure(raw: bytes) -> tuple[int, ...]:
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = raw.translate(None, NOT_LETTERS)
    return (
        len(words),
        len(raw.translate(None, SPACE + CONTINUED)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        len(letters),
        len(letters) - len(letters.translate(None, UPPER)),
    )


def _measures() -> Callable[[list[bytes]], list[list]]:
    return lambda texts: [list(x) for x in zip(*map(measure, texts), strict=True)] if texts else [[] for _ in MEASURES]


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``failed`` (long): the bits of the rules that the whole text fails.

    A null text counts as empty (it fails ``few_words``). Repeated rows give
    repeated rows, an empty table none; other columns are not read.
    """
    out = C.map_texts(C.text_rows(docs, id_col, text_col), _measures, [C.long(m) for m in MEASURES])
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return out.withColumn("failed", failed)


def written_ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger as a table in the shared folder: every rule is evaluated once, whatever is asked of it later."""
    return C.written(ledger(docs, id_col=id_col, text_col=text_col), "ledger")


def judged(ledger_: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept``: no bit of the policy's mask is set."""
    return ledger_.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablations(ledger_: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: texts that fail it, and texts that only it rejects, in one pass over the ledger.

    Hand in a written ledger (written_ledger) to judge it by several policies: no text is read again.
    """
    mask = POLICIES[policy]
    rules = [r for r in RULES if BIT[r] & mask]
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    sums = [F.coalesce(F.sum(F.when(hit.bitwiseAND(F.lit(BIT[r])) != 0, 1).otherwise(0)), F.lit(0)).alias(f"f{BIT[r]}") for r in rules]
    alone = [F.coalesce(F.sum(F.when(hit == BIT[r], 1).otherwise(0)), F.lit(0)).alias(f"a{BIT[r]}") for r in rules]
    one = ledger_.agg(*sums, *alone)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f{BIT[r]}").alias("n_failed"), F.col(f"a{BIT[r]}").alias("n_only")) for r in rules])
    return one.select(F.explode(rows).alias("x")).select(F.lit(policy).alias("policy"), "x.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(ledger(C.table(spark, sf_dir, "documents")), "v1")
    base = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")
