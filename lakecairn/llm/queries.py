"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_byte_bpe
from .decontaminate import op4_decontaminate
from .licenses import op3_license_scan
from .ppm import op1_ppm_score
from .quality_model import op8_quality_classifier
from .quality_rules import op9_quality_rules
from .secrets import op10_secret_scan
from .sharding import op6_feistel_shards
from .simhash import op7_simhash
from .toxicity import op5_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ppm_score, op2_byte_bpe, op3_license_scan, op4_decontaminate, op5_toxicity, op6_feistel_shards, op7_simhash, op8_quality_classifier, op9_quality_rules, op10_secret_scan)}


#: Words of the text with A-Z lower-cased, the same set of characters as ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.
_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_ALNUM} AS w FROM benchmark),
bk AS (SELECT item, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS key FROM bk, unnest(range(1, len(w) - k + 2)) t(i)),
dw AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS key FROM d JOIN (SELECT DISTINCT k FROM win) ks ON len(w) >= k, unnest(range(1, len(w) - k + 2)) t(i)),
hit AS (SELECT doc_id, i, dw.k, item FROM dw JOIN win ON dw.key = win.key AND dw.k = win.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)"""

QUALITY_RULES = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS key FROM w, unnest(range(1, len(w) - 1)) u(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(x, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS n_letters, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS n_upper
  FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT + 8 * (n_letters >= 50 AND 10 * n_upper > 7 * n_letters)::INT
  + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words))::INT + 32 * (n_lines >= 4 AND 10 * n_dup_lines > 7 * n_lines)::INT + 64 * (n_words > 0 AND 4 * n_letters < word_chars)::INT)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 79) = 0 AS kept, failed FROM f"""


def _matches(order: int, kind: str, pattern: str, value: int, least: int, before: str = "0") -> str:
    """Matches of a pattern in every text: the place is the length of all gaps and matches before it."""
    p = pattern.replace("'", "''")
    return f"""SELECT rid, {order} AS ord, '{kind}' AS kind, w[i] AS w, v[i] AS v, list_sum(list_transform(gaps[1 : i], lambda g: length(g))) + coalesce(list_sum(list_transform(w[1 : i - 1], lambda g: length(g))), 0) AS a0, {before} AS skip
  FROM (SELECT rid, string_split_regex(x, '{p}') AS gaps, regexp_extract_all(x, '{p}') AS w, regexp_extract_all(x, '{p}', {value}) AS v FROM t) q, unnest(range(1, len(w) + 1)) u(i) WHERE length(v[i]) >= {least}"""


_TOKEN = "[A-Za-z0-9_-]"
_SPACE = r"\x20\t-\r"
SECRETS = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x, coalesce(source, chr(1)) AS repo, coalesce(doc_id::VARCHAR, chr(1)) AS owner FROM documents),
m0 AS ({" UNION ALL ".join((
    _matches(0, "assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    _matches(1, "access", "AKIA[A-Z0-9]+", 0, 16),
    _matches(2, "hex", "[0-9a-f]{32,}", 0, 32),
    _matches(3, "github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    _matches(4, "slack", "xox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 15),
    _matches(5, "jwt", rf"(?:^|[^A-Za-z0-9_-])(eyJ{_TOKEN}{{8,}}\.eyJ{_TOKEN}{{8,}}\.{_TOKEN}{{8,}})", 1, 28, "length(w[i]) - length(v[i])"),
    _matches(6, "pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    _matches(7, "login", rf"""[a-z][a-z0-9+.-]{{1,20}}://[^{_SPACE}/:@"'<>]{{1,64}}:([^{_SPACE}/@"'<>]{{3,128}})@""", 1, 3),
))}),
m AS (SELECT rid, ord, kind, v, a0 + skip AS a, a0 + length(w) AS b FROM m0),
o AS (SELECT v, count(DISTINCT repo) AS n_repos, count(DISTINCT owner) AS n_owners FROM m JOIN t USING (rid) GROUP BY 1),
e AS (SELECT *, kind || ':' || a || ':' || b AS said, n_repos < 3 AND n_owners < 3 AS live FROM m JOIN o USING (v)),
g AS (SELECT rid, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex, string_agg(said, ',' ORDER BY a, ord) FILTER (ord < 3) AS base, string_agg(said, ',' ORDER BY a, ord) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied, string_agg(live::VARCHAR, ',' ORDER BY a, ord) AS live, string_agg(n_repos::VARCHAR, ',' ORDER BY a, ord) AS n_repos, string_agg(n_owners::VARCHAR, ',' ORDER BY a, ord) AS n_owners FROM e GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied, coalesce(live, '') AS live, coalesce(n_repos, '') AS n_repos, coalesce(n_owners, '') AS n_owners FROM t LEFT JOIN g USING (rid)"""


def oracle_sql() -> dict[str, str]:
    return {"op10_secret_scan": SECRETS, "op4_decontaminate": DECONTAMINATE, "op9_quality_rules": QUALITY_RULES}
