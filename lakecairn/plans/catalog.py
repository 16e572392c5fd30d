"""Every query of the engine by name, with the SQL that gives the same rows.

The driver's tables stand in for a dataset: documents as a tree of files, events as a
feed of changes, orders and lineitem as keyed versions and layers.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content as K
from ..functions import paths as P
from ..functions.codecs import CODECS, round_trips
from ..functions.hashing import digest, text_digest
from ..operators import changes, chunking, dedup, redundancy, reports, sketches, storage, tree
from ..sources import files as S
from ..sources.scratch import bounded, place, written
from ..streaming.store import Store, follow
from .config import custom, select

#: Chunk sizes at which the documents split.
SIZES = (64, 256, 1024)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _scratch(spark: SparkSession, name: str) -> str:
    """A new place in the folder that driver and executors share."""
    return place(spark, name)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"), "lang", "source")


def _spread(df: DataFrame) -> DataFrame:
    """df in parts by file_id, four for each core, for steps that take long over few bytes: files may have fewer row groups than there are cores."""
    return bounded(df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "file_id"))


# Deduplication


def _chunk_sql(sizes: tuple[int, int, int]) -> str:
    """The cuts of documents, c(doc_id, seq, start, stop), and their bytes, d(doc_id, x, n).

    One row a byte gives the places where the hash over all bytes before (h) or since a
    search began (w, only its first bytes differ) ends a chunk; the cuts follow one after another.
    """
    least, average, most = sizes
    small, large = (chunking.mask_bits(n) for n in (average - least, most - average))
    warm = max(small, large)
    gear = ", ".join(str(int(g) % (1 << warm)) for g in chunking.gear_table())
    near = ", ".join(f"lag(g, {k}, 0) OVER o AS p{k}, lead(g, {k}, 0) OVER o AS n{k}" for k in range(1, warm))
    h = " + ".join(f"(p{k} << {k})" for k in range(warm))
    since = [" + ".join(f"(n{j} << {k - j})" for j in range(k + 1)) for k in range(warm)]
    w = " ".join(f"WHEN ({x}) % {1 << small} = 0 THEN {k}" for k, x in enumerate(since))
    return f"""
  d AS (SELECT doc_id, hex(encode(text)) AS x, octet_length(encode(text)) AS n FROM documents WHERE text <> ''),
  gear AS (SELECT unnest(range(256)) AS b, unnest([{gear}]) AS g),
  b AS (SELECT doc_id, i, g FROM (SELECT doc_id, unnest(range(n)) AS i, CAST('0x' || unnest(regexp_extract_all(x, '..')) AS INTEGER) AS b FROM d) JOIN gear USING (b)),
  q AS MATERIALIZED (SELECT doc_id, i, g AS p0, g AS n0, {near} FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  r AS MATERIALIZED (SELECT doc_id, i, {h} AS h, CASE {w} END AS w FROM q),
  l AS MATERIALIZED (SELECT doc_id, list(i ORDER BY i) FILTER (h % {1 << small} = 0) AS cs, list(i ORDER BY i) FILTER (h % {1 << large} = 0) AS cl, list(i * {warm} + w ORDER BY i) FILTER (w IS NOT NULL) AS ws FROM r GROUP BY 1),
  c(doc_id, seq, start, stop) AS (
    SELECT doc_id, -1, 0::BIGINT, 0::BIGINT FROM d UNION ALL
    SELECT doc_id, seq + 1, s, CASE WHEN last - s <= {least} THEN last ELSE coalesce(
        list_filter(list_transform(list_filter(ws, lambda v: v // {warm} = s + {least}), lambda v: v // {warm} + v % {warm} + 1), lambda v: v <= last)[1],
        list_filter(cs, lambda v: v >= least(s + {least + warm}, last) AND v < least(s + {average}, last))[1] + 1,
        list_filter(cl, lambda v: v >= greatest(least(s + {least + warm}, last), least(s + {average}, last)) AND v < last)[1] + 1, last) END
    FROM (SELECT c.doc_id, seq, stop AS s, least(stop + {most}, n) AS last, cs, cl, ws FROM c JOIN d USING (doc_id) JOIN l USING (doc_id) WHERE stop < n))"""


_CHUNKS = f"""WITH RECURSIVE {_chunk_sql(SIZES)},
  k AS (SELECT doc_id AS file_id, seq, start AS file_start, stop AS file_end, sha256(unhex(substring(x, 2 * start + 1, 2 * (stop - start)))) AS drop_id FROM c JOIN d USING (doc_id) WHERE seq >= 0)"""


@query(f"""{_CHUNKS}, u AS (SELECT drop_id, count(*) AS n, max(file_end - file_start) AS b FROM k GROUP BY 1)
SELECT coalesce(sum(n), 0)::BIGINT AS total_refs, count(*) AS unique_drops, (coalesce(sum(n), 0) - count(*))::BIGINT AS duplicate_refs, coalesce((sum(n) - count(*)) / sum(n), 0)::DOUBLE AS duplicate_share,
  coalesce(sum(n * b), 0)::BIGINT AS total_bytes, coalesce(sum(b), 0)::BIGINT AS unique_bytes FROM u""")
def dedup_report_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A1 over content-defined chunks."""
    cut = chunking.with_ids(chunking.chunks(_docs(spark, sf), SIZES))
    return dedup.report(cut.select("drop_id", F.octet_length("chunk").alias("n")), length="n")


@query("""
WITH d AS (SELECT sha256(text) h, count(*) n, max(octet_length(encode(text))) b FROM documents GROUP BY 1)
SELECT sum(n)::BIGINT AS total_refs, count(*) AS unique_drops, (sum(n) - count(*))::BIGINT AS duplicate_refs, (sum(n) - count(*)) / sum(n)::DOUBLE AS duplicate_share,
  sum(n * b)::BIGINT AS total_bytes, sum(b)::BIGINT AS unique_bytes FROM d""")
def dedup_report(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    return dedup.report(d.select(digest(F.col("content")).alias("drop_id"), F.octet_length("content").alias("n")), length="n")


@query("""
SELECT sha256(text) AS drop_id, count(*) AS n_files, min(doc_id) AS first_file FROM documents
WHERE octet_length(encode(text)) BETWEEN 1 AND 4096 GROUP BY 1 HAVING count(*) > 1""")
def inline_sharing(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.shared_inline(_docs(spark, sf), select("balanced").inline_threshold)


@query("""SELECT sha256(text) AS drop_id, min(doc_id) AS file_id FROM documents GROUP BY 1""")
def first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.first_wins(_docs(spark, sf).select(digest(F.col("content")).alias("drop_id"), "file_id"), "drop_id", "file_id")


@query("""
WITH d AS (SELECT doc_id, sha256(text) h FROM documents), s AS (SELECT h, min(doc_id) f FROM d GROUP BY 1 HAVING count(*) > 1)
SELECT d.doc_id AS file_id, s.f AS shared_with FROM d JOIN s USING (h)""")
def shared_inline_resolve(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("file_id", digest(F.col("content")).alias("drop_id"))
    table = d.groupBy("drop_id").agg(F.count("*").alias("n"), F.min("file_id").alias("shared_with")).filter("n > 1")
    return d.join(table, "drop_id").select("file_id", "shared_with")


@query("""
WITH a AS (SELECT DISTINCT sha256(text) h FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT sha256(text) h FROM documents WHERE source IN ('src0', 'src1', 'src2'))
SELECT 'union' AS op, count(*) AS n FROM (SELECT h FROM a UNION SELECT h FROM b)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT h FROM a INTERSECT SELECT h FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT h FROM a EXCEPT SELECT h FROM b)""")
def drop_sets(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select(digest(F.col("content")).alias("drop_id"), "lang", "source")
    a, b = d.filter("lang = 'en'").select("drop_id"), d.filter(F.col("source").isin("src0", "src1", "src2")).select("drop_id")
    parts = (("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.distinct().subtract(b)))
    out = None
    for name, df in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# Trees and paths

_FILES = "f AS (SELECT '/' || lang || '/' || source || '/' || doc_id AS path, octet_length(encode(text)) AS size, text, lang, source, doc_id FROM documents)"


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_attributes(S.documents(spark, sf))


@query(f"""WITH {_FILES} SELECT path, '/' || lang || '/' || source AS parent, doc_id::VARCHAR AS name, 'file' AS kind, 33188 AS mode, size::BIGINT AS size FROM f""")
def tree_files(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf).select("path", "parent", "name", "kind", "mode", "size")


_EDGES = f"""{_FILES}, e AS (
  SELECT '/' || lang || '/' || source AS parent, doc_id::VARCHAR AS name, path AS child, 1 AS entry_type FROM f
  UNION ALL SELECT DISTINCT '/' || lang, source, '/' || lang || '/' || source, 2 FROM f
  UNION ALL SELECT DISTINCT '/', lang, '/' || lang, 2 FROM f)"""


@query(f"WITH {_EDGES} SELECT parent, name, child, entry_type FROM e")
def tree_edges(spark: SparkSession, sf: str) -> DataFrame:
    return S.edges(S.documents(spark, sf).select("path"))


_GEO = """geo AS (
  SELECT 0::BIGINT AS parent_id, r_name AS name, 1000 + r_regionkey::BIGINT AS child_id FROM region
  UNION ALL SELECT 1000 + n_regionkey, n_name, 2000 + n_nationkey::BIGINT FROM nation
  UNION ALL SELECT 2000 + c_nationkey, c_name, 1000000 + c_custkey FROM customer
  UNION ALL SELECT 1000000 + o_custkey, o_orderkey::VARCHAR, 1000000000 + o_orderkey FROM orders)"""
_WALK = f"""WITH RECURSIVE {_GEO}, walk(id, path, depth) AS (
  SELECT 0::BIGINT, '/'::VARCHAR, 0 UNION ALL
  SELECT g.child_id, CASE WHEN w.path = '/' THEN '' ELSE w.path END || '/' || g.name, w.depth + 1 FROM walk w JOIN geo g ON g.parent_id = w.id)"""


def _geo(spark: SparkSession, sf: str) -> DataFrame:
    def level(name: str, parent: str, base: int, label: str, child: str, own: int) -> DataFrame:
        up = F.lit(0).cast("long") if not parent else F.col(parent).cast("long") + base
        return _t(spark, sf, name).select(up.alias("parent_id"), F.col(label).cast("string").alias("name"), (F.col(child).cast("long") + own).alias("child_id"))

    parts = [level("region", "", 0, "r_name", "r_regionkey", 1000), level("nation", "n_regionkey", 1000, "n_name", "n_nationkey", 2000), level("customer", "c_nationkey", 2000, "c_name", "c_custkey", 1_000_000), level("orders", "o_custkey", 1_000_000, "o_orderkey", "o_orderkey", 1_000_000_000)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"{_WALK} SELECT id, path, depth FROM walk")
def path_index(spark: SparkSession, sf: str) -> DataFrame:
    return tree.path_index(_geo(spark, sf), F.lit(0).cast("long"))


@query(f"{_WALK} SELECT depth, count(*) AS n, max(length(path))::BIGINT AS longest FROM walk GROUP BY depth")
def tree_walk(spark: SparkSession, sf: str) -> DataFrame:
    index = tree.path_index(_geo(spark, sf), F.lit(0).cast("long"))
    return index.groupBy("depth").agg(F.count("*").alias("n"), F.max(F.length("path")).cast("long").alias("longest"))


@query(f"""{_WALK}, q AS (SELECT '/' || r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT '/NOWHERE' UNION ALL SELECT '/')
SELECT q.path, w.id FROM q LEFT JOIN walk w ON w.path = q.path""")
def resolve_paths(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    wanted = n.select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("path")).unionByName(spark.createDataFrame([("/NOWHERE",), ("/",)], "path string"))
    return tree.resolve(tree.path_index(_geo(spark, sf), F.lit(0).cast("long")), wanted).select("path", "id")


@query(f"WITH {_EDGES} SELECT name, entry_type FROM e WHERE parent = '/en'")
def list_directory(spark: SparkSession, sf: str) -> DataFrame:
    return tree.listing(S.edges(S.documents(spark, sf).select("path")), "/en")


@query(f"WITH {_FILES} SELECT path, 'file' AS kind, 33188 AS mode, size::BIGINT AS size FROM f WHERE path = (SELECT min(path) FROM f WHERE doc_id = 7)")
def stat_file(spark: SparkSession, sf: str) -> DataFrame:
    t = _tree(spark, sf)
    return t.filter("file_id = 7").select("path", "kind", "mode", "size")


@query(f"""WITH {_FILES}, up AS (SELECT '/' AS path, size FROM f UNION ALL SELECT '/' || lang, size FROM f UNION ALL SELECT '/' || lang || '/' || source, size FROM f)
SELECT path, count(*) AS n_files, sum(size)::BIGINT AS bytes FROM up GROUP BY path""")
def directory_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return tree.directory_sizes(_tree(spark, sf).select("path", "size"))


@query(f"""WITH {_FILES},
a AS (SELECT lang, source, sha256(string_agg(doc_id::VARCHAR || ':1:' || sha256(text), chr(10) ORDER BY doc_id::VARCHAR COLLATE "C")) h FROM f GROUP BY 1, 2),
b AS (SELECT lang, sha256(string_agg(source || ':2:' || h, chr(10) ORDER BY source COLLATE "C")) h FROM a GROUP BY 1),
c AS (SELECT sha256(string_agg(lang || ':2:' || h, chr(10) ORDER BY lang COLLATE "C")) h FROM b)
SELECT '/' || lang || '/' || source AS path, h AS node_hash FROM a UNION ALL SELECT '/' || lang, h FROM b UNION ALL SELECT '/', h FROM c""".replace(' COLLATE "C"', ""))
def directory_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return tree.directory_hashes(S.documents(spark, sf).select("path", digest(F.col("content")).alias("node_hash")), 3)


@query(f"WITH {_FILES} SELECT path, row_number() OVER (ORDER BY path) AS inode FROM f")
def inode_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return tree.numbering(S.documents(spark, sf).select("path"))


@query("""SELECT 'bad_name' AS rule, count(*) FILTER (doc_id % 13 = 0) AS n FROM documents UNION ALL SELECT 'duplicate_name', count(*) FILTER (doc_id % 5 = 0) FROM documents
UNION ALL SELECT 'orphan', count(*) FILTER (doc_id % 7 = 0) FROM documents UNION ALL SELECT 'missing_file', count(*) FILTER (doc_id % 11 = 0) + count(*) FILTER (doc_id % 55 = 0) FROM documents""")
def structure_violations(spark: SparkSession, sf: str) -> DataFrame:
    """A tree with faults of every kind: names with a slash, edges that come twice, parents that nothing leads to, files that are gone."""
    files = S.documents(spark, sf).select("path", "file_id")
    number = F.col("file_id").cast("string")

    def edge(where: str, parent: Column, name: Column, child: Column, kind: int) -> DataFrame:
        return files.filter(where).select(parent.alias("parent"), name.alias("name"), child.alias("child"), F.lit(kind).alias("entry_type"))

    edges = S.edges(files.select("path")).unionByName(edge("file_id % 5 = 0", P.parent(F.col("path")), P.name(F.col("path")), F.col("path"), 1))
    edges = edges.unionByName(edge("file_id % 7 = 0", F.concat(F.lit("/nowhere/"), number), F.lit("x"), F.concat(F.lit("/nowhere/"), number, F.lit("/x")), 2))
    edges = edges.unionByName(edge("file_id % 13 = 0", F.lit("/"), F.concat(F.lit("a/b"), number), F.concat(F.lit("/a/b"), number), 2))
    return tree.violations(edges, files.filter("file_id % 11 <> 0").select("path"))


@query("""SELECT page_id, regexp_extract(url, '^([^:]+):', 1) AS scheme, regexp_replace(regexp_replace('/' || url || '/', '/+', '/', 'g'), '(.)/$', '\\1') AS path FROM pages""")
def uri_parts(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "pages").select("page_id", P.scheme(F.col("url")).alias("scheme"), P.normalise(F.col("url")).alias("path"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'dir' WHEN 1 THEN 'file' WHEN 2 THEN 'symlink' ELSE 'pipe' END AS kind, (o_orderkey % 512)::BIGINT AS permissions FROM orders""")
def mode_kinds(spark: SparkSession, sf: str) -> DataFrame:
    bits = F.element_at(F.array(F.lit(0x4000), F.lit(0x8000), F.lit(0xA000), F.lit(0x1000)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    mode = bits + (F.col("o_orderkey") % 512).cast("int")
    return _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), P.kind_of_mode(mode).alias("kind"), mode.bitwiseAND(F.lit(0xFFF)).cast("long").alias("permissions"))


# Content

_BYTES = """h AS (SELECT doc_id, substring(hex(encode(text)), 1, 8192) x FROM documents),
b AS (SELECT doc_id, substring(x, 2 * i - 1, 2) AS v FROM h, unnest(range(1, length(x) // 2 + 1)) t(i)),
c AS (SELECT doc_id, v, count(*) k FROM b GROUP BY 1, 2),
r AS (SELECT doc_id, sum(k) n, sum(CASE WHEN v BETWEEN '20' AND '7E' OR v IN ('09', '0A', '0D') THEN k ELSE 0 END) p FROM c GROUP BY 1)"""


@query(f"""WITH {_BYTES} SELECT c.doc_id AS file_id, round(-sum(k / n * log2(k / n)) + 0.0, 9) AS entropy, any_value(p / n) AS printable_ratio FROM c JOIN r USING (doc_id) GROUP BY 1
UNION ALL SELECT doc_id, 0.0, 0.0 FROM documents WHERE text IS NULL OR text = ''""")
def entropy_profile(spark: SparkSession, sf: str) -> DataFrame:
    r = _docs(spark, sf).select("file_id", K.sample_ratios(F.col("content")).alias("r"))
    return r.select("file_id", F.round("r.entropy", 9).alias("entropy"), F.col("r.printable_ratio").alias("printable_ratio"))


@query(f"""WITH {_BYTES}, e AS (SELECT c.doc_id, -sum(k / n * log2(k / n)) AS h, any_value(p / n) AS q FROM c JOIN r USING (doc_id) GROUP BY 1),
d AS (SELECT e.*, substring(hex(encode(text)), 1, 24) AS m FROM e JOIN documents USING (doc_id))
SELECT doc_id AS file_id, CASE WHEN starts_with(m, '1F8B') OR starts_with(m, '425A68') THEN 'compressed' WHEN starts_with(m, '474946383761') OR starts_with(m, '474946383961') OR starts_with(m, '494433') OR starts_with(m, '664C6143') OR starts_with(m, '4F676753') OR substring(m, 9, 8) = '66747970' THEN 'media' WHEN starts_with(m, '7F454C46') OR starts_with(m, '4D5A') THEN 'code'
  WHEN h >= 6.5 THEN 'incompressible' WHEN q > 0.85 THEN 'text' ELSE 'binary' END AS class FROM d
UNION ALL SELECT doc_id, 'sparse' FROM documents WHERE text IS NULL OR text = ''""")
def classify_content(spark: SparkSession, sf: str) -> DataFrame:
    return storage.classified(_docs(spark, sf), "content").select("file_id", "class")


@query("""SELECT event_id AS file_id, true AS tabular FROM events WHERE event_id % 2 = 0 AND length(regexp_replace(props, '[^,"{}\\[\\]]', '', 'g')) > 0.01 * length(props)""")
def tabular_files(spark: SparkSession, sf: str) -> DataFrame:
    """F8 over events as files: every second one has the extension that the rule asks for."""
    path = F.concat(F.lit("/e/"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".JSON").otherwise(".php"))
    e = _t(spark, sf, "events").select(F.col("event_id").alias("file_id"), K.looks_tabular(path, F.encode("props", "utf-8")).alias("tabular"))
    return e.filter("tabular")


def _fixtures() -> list[tuple[str, bytes]]:
    import struct

    elf = b"\x7fELF" + bytes(14) + struct.pack("<H", 62) + bytes(40)
    fits = b"".join(c.ljust(80) for c in (b"SIMPLE  =                    T", b"BITPIX  =                   16", b"NAXIS   =                    2", b"END")).ljust(2880)
    wav = b"RIFF" + struct.pack("<I", 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 44_100, 88_200, 2, 16) + b"data" + struct.pack("<I", 0)
    return [("/a.elf", elf), ("/b.fits", fits), ("/c.wav", wav), ("/d.gz", b"\x1f\x8b\x08" + bytes(20)), ("/e.png", b"\x89PNG\r\n\x1a\n"), ("/f.zero", bytes(8192)), ("/g.txt", b"hello\n" * 50), ("/h.empty", b""), ("/i.bin", bytes(range(200)) * 2)]


def _special_files() -> list[tuple[str, bytes]]:
    """Files large enough for their format's codec to show: calls to a few places, noisy pixels, a noisy wave, rows, lines."""
    import random
    import struct

    rng = random.Random(5)
    elf = b"\x7fELF" + bytes(14) + struct.pack("<H", 62) + bytes(40)
    targets = [rng.randrange(1 << 20) for _ in range(40)]
    for _ in range(6000):
        elf += bytes([rng.randrange(0x40, 0x60), 0xE8])
        elf += struct.pack("<I", (rng.choice(targets) - len(elf) - 4) % 2**32)
    fits = b"".join(c.ljust(80) for c in (b"SIMPLE  =                    T", b"BITPIX  =                   16", b"NAXIS   =                    2", b"END")).ljust(2880)
    fits += b"".join(struct.pack(">h", int(rng.gauss(1000, 6))) for _ in range(40_000))
    level, samples = 0.0, []
    for _ in range(40_000):
        level += rng.gauss(0, 40) - level * 0.002
        samples.append(struct.pack("<h", int(max(-32_000, min(32_000, level * 8)))))
    wav = b"RIFF" + struct.pack("<I", 36 + 80_000) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 44_100, 88_200, 2, 16) + b"data" + struct.pack("<I", 80_000) + b"".join(samples)
    csv = b"".join(b"%d,r%d,%d\n" % (i, i % 5, i % 1000) for i in range(3000))
    return [("/a.elf", elf), ("/b.fits", fits), ("/c.wav", wav), ("/d.csv", csv), ("/e.txt", b"".join(b"line %d of words\n" % i for i in range(500)))]


@query("""SELECT * FROM (VALUES ('/a.elf', 'code', 'exec:x86-64'), ('/b.fits', 'text', 'fits:16'), ('/c.wav', 'binary', 'pcm:44100/1/16'), ('/d.gz', 'compressed', NULL), ('/e.png', 'media', NULL),
 ('/f.zero', 'sparse', NULL), ('/g.txt', 'text', NULL), ('/h.empty', 'sparse', NULL), ('/i.bin', 'incompressible', NULL)) t(path, class, category)""")
def special_formats(spark: SparkSession, sf: str) -> DataFrame:
    """F3, F7, F9 to F11 over files of the formats that the driver's tables lack."""
    made = S.stream(spark, _fixtures())
    return storage.classified(made, "content").select("path", "class", K.categorize(F.col("path"), F.col("content")).alias("category"))


@query("""WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
b AS (SELECT doc_id, h, array_to_string(list_transform(regexp_extract_all(h, '.'), lambda x: lpad(bin(CAST('0x' || x AS INTEGER)), 4, '0')), '') || '0000' AS bits FROM d)
SELECT doc_id AS file_id, h AS digest, 's2:' || array_to_string(list_transform(range(52), lambda k: 'abcdefghijklmnopqrstuvwxyz234567'[list_sum(list_transform(range(5), lambda j: CAST(substring(bits, k * 5 + j + 1, 1) AS INTEGER) << (4 - j)))::INTEGER + 1]), '') AS text FROM b""")
def text_digests(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("file_id", digest(F.col("content")).alias("digest"))
    return d.select("file_id", "digest", text_digest(F.col("digest")).alias("text"))


# Chunks, storage and reading

_CONTENT = "SELECT doc_id AS file_id, octet_length(encode(text)) AS size, sha256(text) AS drop_id FROM documents WHERE text <> ''"


def _sum_up(read: DataFrame) -> DataFrame:
    return read.select("file_id", F.octet_length("content").cast("long").alias("size"), digest(F.col("content")).alias("drop_id"))


@query(f"""{_CHUNKS} SELECT file_id, seq, file_start, file_end, drop_id, 0::INTEGER AS drop_start, (file_end - file_start)::INTEGER AS drop_len FROM k""")
def chunk_slices(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.slices(chunking.chunks(_docs(spark, sf), SIZES))


@query("SELECT doc_id AS file_id, octet_length(encode(text)) AS n, octet_length(encode(text)) AS last_end, 0::BIGINT AS gaps FROM documents WHERE text <> ''")
def slice_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets summed from lengths agree with the cuts and leave no gap."""
    cut = chunking.slices(chunking.chunks(_docs(spark, sf), SIZES))
    placed = chunking.running_offsets(cut, "file_id", "seq", "drop_len")
    gap = F.when((F.col("start") == F.col("file_start")) & (F.col("end") == F.col("file_end")), 0).otherwise(1)
    return placed.groupBy("file_id").agg(F.sum("drop_len").alias("n"), F.max("end").alias("last_end"), F.sum(gap).alias("gaps"))


@query(_CONTENT)
def build_and_read(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk, deduplicate, classify, encode, pack, then put every file together again."""
    built = storage.build(_docs(spark, sf), SIZES, select("balanced").tournament(), 1 << 20)
    return _sum_up(storage.read_files(built["slices"], built["drops"]))


@query(_CONTENT)
def whole_file_drops(spark: SparkSession, sf: str) -> DataFrame:
    cut = chunking.with_ids(chunking.chunks(_docs(spark, sf), SIZES, whole=True))
    return cut.select("file_id", F.col("file_end").alias("size"), "drop_id")


@query("""SELECT doc_id AS file_id, octet_length(encode(text)) AS size, least(100, greatest(0, octet_length(encode(text)) - 50)) AS n, substring(hex(encode(text)), 101, 200) AS part
FROM documents WHERE octet_length(encode(text)) > 50""")
def range_read(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes 50 to 149 of each file; slices outside are pruned before the join."""
    d = _docs(spark, sf)
    cut = written(chunking.with_ids(chunking.chunks(d, SIZES)), "cut")
    near = cut.filter("file_start < 150 and file_end > 50")  # no other drop is encoded
    drops = written(storage.encoded(storage.classified(storage.kept(near, None, "chunk"))).select("drop_id", "plain_len", "codec", "payload"), "encoded")
    part = storage.read_range(chunking.sliced(cut), drops, 50, 100)
    return part.join(d.select("file_id", F.octet_length("content").cast("long").alias("size")), "file_id").select("file_id", "size", F.octet_length("content").cast("long").alias("n"), F.hex("content").alias("part"))


@query()
def build_inspect(spark: SparkSession, sf: str) -> DataFrame:
    """A2; encoded sizes depend on the codecs' versions."""
    return reports.inspect(storage.build(_docs(spark, sf), SIZES, select("balanced").tournament(), 1 << 20)["drops"])


_SLABS = """u AS (SELECT sha256(text) drop_id, min(octet_length(encode(text))) plain_len, min(lang) slab FROM documents GROUP BY 1)"""


@query(f"""WITH {_SLABS} SELECT slab, count(*) AS n_drops, sum(plain_len)::BIGINT AS stored, sum(plain_len)::BIGINT AS plain, 1.0::DOUBLE AS ratio FROM u GROUP BY ROLLUP (slab)""")
def slab_report(spark: SparkSession, sf: str) -> DataFrame:
    """A3 over stored drops, a slab for each language of a content's first row, and the whole."""
    d = _docs(spark, sf).select(digest(F.col("content")).alias("drop_id"), F.octet_length("content").cast("long").alias("n"), "lang")
    u = d.groupBy("drop_id").agg(F.min("n").alias("plain_len"), F.min("n").alias("enc_len"), F.min("lang").alias("slab"))
    return reports.slab_totals(u)


@query(f"""WITH {_SLABS} SELECT slab, drop_id, count(*) AS n_drops, sum(plain_len - 1)::BIGINT AS stored, sum(plain_len)::BIGINT AS plain, sum(plain_len - 1) / sum(plain_len)::DOUBLE AS ratio FROM u WHERE plain_len > 0 GROUP BY ROLLUP (slab, drop_id)""")
def slab_drops(spark: SparkSession, sf: str) -> DataFrame:
    """A3 with a row for each drop; a byte less is stored of each."""
    d = _docs(spark, sf).select(digest(F.col("content")).alias("drop_id"), F.octet_length("content").cast("long").alias("n"), "lang").filter("n > 0")
    u = d.groupBy("drop_id").agg(F.min("n").alias("plain_len"), (F.min("n") - 1).alias("enc_len"), F.min("lang").alias("slab"))
    return reports.slab_drops(u)


@query(f"""WITH {_SLABS} SELECT drop_id, slab, coalesce(sum(plain_len) OVER (PARTITION BY slab ORDER BY drop_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM u""")
def offsets_in_slab(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select(digest(F.col("content")).alias("drop_id"), F.octet_length("content").cast("long").alias("enc_len"), "lang")
    u = d.groupBy("drop_id").agg(F.min("enc_len").alias("enc_len"), F.min("lang").alias("slab"))
    return storage.offsets_in_slab(u).select("drop_id", "slab", "offset")


@query("""WITH RECURSIVE o AS (SELECT o_orderkey, (o_orderkey * 37 % 900 + 1)::BIGINT AS n, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders),
p(k, o_orderkey, n, slab, used, off) AS (
  SELECT k, o_orderkey, n, 0::BIGINT, n + 49, 0::BIGINT FROM o WHERE k = 1 UNION ALL
  SELECT o.k, o.o_orderkey, o.n, CASE WHEN p.used + o.n + 49 > 19944 THEN p.slab + 1 ELSE p.slab END, CASE WHEN p.used + o.n + 49 > 19944 THEN o.n + 49 ELSE p.used + o.n + 49 END,
    CASE WHEN p.used + o.n + 49 > 19944 THEN 0 ELSE p.off + p.n END FROM p JOIN o ON o.k = p.k + 1)
SELECT o_orderkey, slab, off AS "offset" FROM p""")
def slab_packing(spark: SparkSession, sf: str) -> DataFrame:
    """W2 over orders as drops of made-up lengths."""
    d = _t(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 37 % 900 + 1).alias("enc_len"))
    return storage.pack(d, 20_000, order="o_orderkey").select("o_orderkey", "slab", "offset")


@query("""WITH s AS (SELECT DISTINCT lang FROM documents) SELECT sha256(text) AS drop_id, 'file:/slabs/' || min(lang) AS uri FROM documents GROUP BY 1""")
def drop_locators(spark: SparkSession, sf: str) -> DataFrame:
    """Drop to slab to the slab's first locator."""
    from ..sources.locators import locate

    d = _t(spark, sf, "documents").select(F.sha2("text", 256).alias("drop_id"), "lang").groupBy("drop_id").agg(F.min("lang").alias("slab"))
    index = d.select("slab").distinct().select(F.col("slab").alias("ordinal"), F.array(F.concat(F.lit("file:/slabs/"), "slab"), F.concat(F.lit("s3a://mirror/"), "slab")).alias("locators"))
    return locate(d, index).select("drop_id", "uri")


@query(f"SELECT doc_id AS file_id, octet_length(encode(text)) AS size, {len(CODECS)}::BIGINT AS n_same FROM documents")
def codec_round_trips(spark: SparkSession, sf: str) -> DataFrame:
    """Every codec over every document, decoded again."""

    @F.pandas_udf("long")
    def same(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: sum(round_trips(bytes(r))))

    return _spread(_docs(spark, sf).select("file_id", "content")).select("file_id", F.octet_length("content").cast("long").alias("size"), same(F.col("content")).alias("n_same"))


_DISTINCT = "SELECT sha256(text) AS drop_id, max(octet_length(encode(text))) AS plain_len, true AS sound"


@query(f"{_DISTINCT}, false AS larger FROM documents WHERE text <> '' GROUP BY 1")
def tournament(spark: SparkSession, sf: str) -> DataFrame:
    """Every choice decodes to its content and none is larger."""
    u = chunking.unique_drops(chunking.chunks(_docs(spark, sf), SIZES, whole=True))
    e = storage.encoded(storage.classified(u), select("max-ratio").tournament())
    ok = digest(storage.decode(F.col("payload"), F.col("codec"), F.col("plain_len"))) == F.col("drop_id")
    return e.select("drop_id", "plain_len", ok.alias("sound"), (F.col("enc_len") > F.col("plain_len")).alias("larger"))


@query(f"{_DISTINCT} FROM documents WHERE text <> '' GROUP BY 1")
def dictionary_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Dictionaries by class, drops encoded with them where that is smaller, decoded again."""
    u = written(storage.classified(chunking.unique_drops(chunking.chunks(_docs(spark, sf), SIZES, whole=True))), "drops", "zstd")
    e = storage.with_dictionaries(u, storage.train_dictionaries(u))
    back = F.coalesce(storage.decode_with_dictionary(F.col("dict_payload"), F.col("dictionary"), F.octet_length("chunk")), F.col("chunk"))
    return e.select("drop_id", F.octet_length("chunk").cast("long").alias("plain_len"), (digest(back) == F.col("drop_id")).alias("sound"))


@query("SELECT count(DISTINCT text) AS checked, count(DISTINCT text) AS passed, 0::BIGINT AS failed FROM documents")
def verify_content(spark: SparkSession, sf: str) -> DataFrame:
    """An empty text is a content as well, one that is null is none."""
    texts = _t(spark, sf, "documents").filter("text is not null").select(F.encode("text", "utf-8").alias("chunk"))
    return storage.verify(storage.encoded(storage.classified(chunking.unique_drops(texts))))


@query("""WITH f AS (SELECT substring(sha256(doc_id || ':' || sha256(text)), 1, 64) AS h FROM documents), b AS (SELECT substring(h, 1, 3) b, sha256(string_agg(h, '' ORDER BY h)) h FROM f GROUP BY 1),
s AS (SELECT sha256(string_agg(b || h, '' ORDER BY b)) AS h FROM b), g AS (SELECT sha256(r_name) AS h FROM region), gb AS (SELECT substring(h, 1, 3) b, sha256(string_agg(h, '' ORDER BY h)) h FROM g GROUP BY 1),
t AS (SELECT sha256(string_agg(b || h, '' ORDER BY b)) AS h FROM gb) SELECT sha256('lakecairn/v1' || s.h || t.h) AS root FROM s, t""")
def merkle_root(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    row = F.concat_ws(":", F.col("file_id").cast("string"), digest(F.col("content")))
    return storage.root_hash([("files", d, row), ("slabs", _t(spark, sf, "region"), F.col("r_name"))])


@query("""WITH d AS (SELECT sha256(text) AS drop_id, max((lang = 'en')::INTEGER) AS member FROM documents GROUP BY 1)
SELECT count(*) AS n, sum(member)::BIGINT AS members, sum(member)::BIGINT AS members_found, true AS few_false FROM d""")
def bloom_membership(spark: SparkSession, sf: str) -> DataFrame:
    """A filter of the English contents is asked for all; no member is missed, and at a rate of 0.01 no more than 0.05 of the rest pass."""
    d = _docs(spark, sf).groupBy(digest(F.col("content")).alias("drop_id")).agg(F.max((F.col("lang") == "en").cast("int")).alias("member"))
    d = written(d, "members")
    n = d.filter("member = 1").count()
    found = sketches.probe(d, sketches.build(d.filter("member = 1").select("drop_id"), n), n).join(d, "drop_id")
    yes = F.col("maybe").cast("long")
    false = F.coalesce(F.sum(yes * (1 - F.col("member"))), F.lit(0)) <= 0.05 * F.coalesce(F.sum(1 - F.col("member")), F.lit(0))
    return found.agg(F.count("*").alias("n"), F.sum(F.col("member").cast("long")).alias("members"), F.sum(yes * F.col("member")).alias("members_found"), false.alias("few_false"))


# Images


def _image(spark: SparkSession, files: DataFrame, profile: str = "max-speed"):  # noqa: ANN202
    from ..image import Image

    image = Image(spark, _scratch(spark, "image"))
    image.build(files.select("path", F.lit(0).cast("long").alias("mtime_ns"), "content"), profile)
    return image


@query("SELECT '/' || lang || '/' || source || '/' || doc_id AS path, octet_length(encode(text)) AS size, sha256(text) AS content_id FROM documents")
def image_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A whole image built, published and read back, inline and chunked files alike."""
    read = _image(spark, S.documents(spark, sf)).contents()
    return read.select("path", F.octet_length("content").cast("long").alias("size"), digest(F.col("content")).alias("content_id"))


@query("""SELECT '/' || lang || '/' || source || '/' || doc_id AS path, substring(hex(encode(text)), 2001, 1000) AS part FROM documents""")
def cat_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes 1000 to 1499 of every file in one pass."""
    files = S.documents(spark, sf)
    return _image(spark, files).cat_multi(files.select("path"), 1000, 500).select("path", F.hex("content").alias("part"))


@query("SELECT count(*) AS n_files, count(DISTINCT lang) + count(DISTINCT (lang, source)) + 1 AS n_dirs FROM documents")
def image_counters(spark: SparkSession, sf: str) -> DataFrame:
    return _image(spark, S.documents(spark, sf)).counters().select("n_files", "n_dirs")


@query("SELECT '/' || lang || '/' || source || '/' || doc_id AS path, octet_length(encode(text)) AS size, sha256(text) AS content_id, octet_length(encode(text)) > 4096 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE source IN ('src0', 'src1', 'src2')) AS in_base FROM documents")
def layered_image(spark: SparkSession, sf: str) -> DataFrame:
    """An image of all documents as whole files, stored on top of one of three sources and read with its base."""
    files = S.documents(spark, sf)
    base = _image(spark, files.filter(F.col("path").rlike("/src[0-2]/")), "max-write")
    from ..image import Image

    layer = Image(spark, _scratch(spark, "layer"))
    layer.build(files.select("path", F.lit(0).cast("long").alias("mtime_ns"), "content"), "max-write", base=base)
    taken = layer.references().select(F.col("drop_id").alias("content_id"), F.lit(True).alias("taken"))
    read = layer.contents(base=base).select("path", F.octet_length("content").cast("long").alias("size"), digest(F.col("content")).alias("content_id"))
    return read.join(taken, "content_id", "left").select("path", "size", "content_id", F.coalesce("taken", F.lit(False)).alias("in_base"))


@query("SELECT * FROM (VALUES ('bad_name', 0::BIGINT), ('duplicate_name', 0), ('orphan', 0), ('missing_file', 0), ('slice_gap', 0), ('missing_drop', 0), ('root', 0)) t(rule, n)")
def image_verify(spark: SparkSession, sf: str) -> DataFrame:
    return _image(spark, S.documents(spark, sf)).verify()


@query("""WITH large AS (SELECT doc_id, source, sha256(text) AS h FROM documents WHERE octet_length(encode(text)) > 4096)
SELECT 'missing_drop' AS rule, count(*) AS n FROM large WHERE h IN (SELECT h FROM large WHERE source = 'src1') UNION ALL SELECT 'root', (count(*) > 0)::BIGINT FROM large WHERE source = 'src1'""")
def damage_found(spark: SparkSession, sf: str) -> DataFrame:
    """An image of whole files that has lost the drops of one source."""
    files = S.documents(spark, sf)
    image = _image(spark, files, "max-write")
    lost = files.filter(F.col("path").rlike("^/[a-z]+/src1/")).select(digest(F.col("content")).alias("drop_id"))
    left = storage.layer(written(image.drops(), "drops"), lost)
    left.write.mode("overwrite").parquet(image.entry()["drops"][0])
    return image.verify().filter("rule in ('missing_drop', 'root')")


_BOTH = """a AS (SELECT '/' || lang || '/' || source || '/' || doc_id AS path, text FROM documents WHERE source <> 'src3'),
b AS (SELECT '/' || lang || '/' || source || '/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN text || ' more' ELSE text END AS text FROM documents WHERE source <> 'src1')"""


def _states(spark: SparkSession, sf: str):  # noqa: ANN202
    """Two images: without one source, and without another and with a seventh of the documents changed."""
    files = S.documents(spark, sf)
    changed = F.when(F.col("file_id") % 7 == 0, F.concat("content", F.lit(b" more"))).otherwise(F.col("content"))
    return _image(spark, files.filter(~F.col("path").rlike("^/[a-z]+/src3/"))), _image(spark, files.filter(~F.col("path").rlike("^/[a-z]+/src1/")).select("path", changed.alias("content")))


@query(f"""WITH {_BOTH} SELECT path, octet_length(encode(text)) AS size, sha256(text) AS content_id, path NOT IN (SELECT path FROM a) OR text <> (SELECT text FROM a WHERE a.path = b.path) AS in_delta FROM b""")
def delta_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The stored delta of two images, applied to the first, gives the second."""
    old, new = _states(spark, sf)
    delta = old.delta(new, _scratch(spark, "delta"))
    old.apply(delta)
    stored = delta.files().select("path", F.lit(True).alias("stored"))
    return old.contents().join(stored, "path", "left").select("path", F.octet_length("content").cast("long").alias("size"), digest(F.col("content")).alias("content_id"), F.coalesce("stored", F.lit(False)).alias("in_delta"))


@query(f"""WITH {_BOTH} SELECT path, octet_length(encode(text)) AS size, sha256(text) AS content_id FROM b UNION ALL SELECT path, octet_length(encode(text)), sha256(text) FROM a WHERE path NOT IN (SELECT path FROM b)""")
def flattened(spark: SparkSession, sf: str) -> DataFrame:
    """C4: two images as one, the second over the first."""
    from ..image import Image

    out = Image.flatten(list(_states(spark, sf)), _scratch(spark, "flat"))
    return out.contents().select("path", F.octet_length("content").cast("long").alias("size"), digest(F.col("content")).alias("content_id"))


@query("""SELECT '/' || lang || '/' || source || '/' || doc_id AS path, sha256(CASE WHEN doc_id % 11 = 0 THEN text || ' more' ELSE text END) AS content_id FROM documents WHERE doc_id % 11 <> 1
UNION ALL SELECT '/new/' || doc_id, sha256(text) FROM documents WHERE doc_id % 11 = 2""")
def committed(spark: SparkSession, sf: str) -> DataFrame:
    """A commit that updates, deletes and adds files; only its own contents are cut and stored."""
    files = S.documents(spark, sf)
    image = _image(spark, files)
    own = files.filter("file_id % 11 = 0").select("path", F.concat("content", F.lit(b" more")).alias("content"))
    own = own.unionByName(files.filter("file_id % 11 = 2").select(F.concat(F.lit("/new/"), F.col("file_id").cast("string")).alias("path"), "content"))
    image.merge(own.select("path", F.lit(0).cast("long").alias("mtime_ns"), "content"), files.filter("file_id % 11 in (0, 1)").select("path"), "max-speed")
    return image.contents().select("path", digest(F.col("content")).alias("content_id"))


@query(_CONTENT.replace(" FROM", ", true AS shared FROM"))
def dictionary_build(spark: SparkSession, sf: str) -> DataFrame:
    """A build whose profile has dictionaries; drops name theirs, and files are read with them."""
    rules = custom("max-read", candidates=("store", "zstd")).tournament()
    made = storage.build(_docs(spark, sf), SIZES, rules, 1 << 20, dictionaries=(16_384, 50))
    drops = written(made["drops"], "drops")
    read = storage.read_files(made["slices"], drops, dictionaries=made["dictionaries"])
    some = drops.agg((F.count("dict_id") > 0).alias("shared"))
    return _sum_up(read).crossJoin(F.broadcast(some))


@query("""SELECT * FROM (VALUES ('/a.elf', 33, true), ('/b.fits', 8, true), ('/c.wav', 7, true), ('/d.csv', 4, true), ('/e.txt', NULL, true)) t(path, codec, same)""")
def special_codecs(spark: SparkSession, sf: str) -> DataFrame:
    """Files of special formats are drops of their own, by their format's codec where that is smallest; e.txt is cut."""
    made = _special_files()
    files = S.stream(spark, made).withColumn("file_id", F.xxhash64("path"))
    built = storage.build(files, SIZES, select("max-ratio").tournament(), special=True)
    drops = written(built["drops"], "drops")
    read = storage.read_files(built["slices"], drops).join(files.select("file_id", "path", F.col("content").alias("plain")), "file_id")
    one = built["slices"].groupBy("file_id").agg(F.count("*").alias("n"), F.min("drop_id").alias("drop_id")).filter("n = 1").join(drops.select("drop_id", "codec"), "drop_id")
    return read.join(one.select("file_id", "codec"), "file_id", "left").select("path", "codec", (F.col("content") == F.col("plain")).alias("same"))


@query("SELECT * FROM (VALUES ('erasure', 3::BIGINT), ('sharing', 2), ('cipher', 5), ('codec', " + str(len(CODECS)) + ")) t(kind, n)")
def scheme_registry(spark: SparkSession, sf: str) -> DataFrame:
    from .registries import table

    return table(spark).groupBy("kind").agg(F.count("*").alias("n"))


# Versions

_NEW = "SELECT DISTINCT sha256(text) AS drop_id FROM documents WHERE source IN ('src1', 'src3') AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source NOT IN ('src1', 'src3'))"


@query(_NEW)
def layer_new_drops(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select(digest(F.col("content")).alias("drop_id"), "source")
    mine = F.col("source").isin("src1", "src3")
    return storage.layer(d.filter(mine).select("drop_id").distinct(), d.filter(~mine))


_GC = "u AS (SELECT p_partkey AS drop_id, p_size::BIGINT AS enc_len FROM part), s AS (SELECT DISTINCT l_partkey AS drop_id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)"


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    refs = _t(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("drop_id"))
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("drop_id"), F.col("p_size").cast("long").alias("enc_len")), refs


@query(f"WITH {_GC} SELECT count(*) AS total, count(s.drop_id) AS referenced, count(*) - count(s.drop_id) AS garbage, coalesce(sum(CASE WHEN s.drop_id IS NULL THEN enc_len END), 0)::BIGINT AS garbage_bytes FROM u LEFT JOIN s USING (drop_id)")
def gc_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.gc(*_parts(spark, sf))


@query(f"WITH {_GC} SELECT drop_id, enc_len FROM u WHERE drop_id IN (SELECT drop_id FROM s)")
def compacted(spark: SparkSession, sf: str) -> DataFrame:
    return storage.compact(_parts(spark, sf)[0], _parts(spark, sf)[1], 4096).select("drop_id", "enc_len")


@query("""WITH a AS (SELECT o_orderkey k, o_totalprice c FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END c FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01')
SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'A' WHEN b.k IS NULL THEN 'R' ELSE 'M' END AS op FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.c <> b.c""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    new = o.filter("o_orderdate >= timestamp '1994-01-01'").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return changes.diff(o.filter("o_orderstatus <> 'P'"), new, "o_orderkey", F.col("o_totalprice"))


def _nodes(files: DataFrame) -> DataFrame:
    dirs = S.directories(files).filter("path <> '/'").select("path", F.lit(2).alias("entry_type"), F.lit(None).cast("string").alias("c"))
    return files.select("path", F.lit(1).alias("entry_type"), "c").unionByName(dirs)


@query("""WITH a AS (SELECT '/' || lang || '/' || source p, '/' || lang || '/' || source || '/' || doc_id f, lang, source, doc_id, text FROM documents WHERE source NOT IN ('src2', 'src4')),
b AS (SELECT '/' || lang || '/' || source p, '/' || lang || '/' || source || '/' || doc_id f, lang, source, doc_id, text FROM documents WHERE source <> 'src5' AND lang <> 'es'),
la AS (SELECT DISTINCT '/' || lang d FROM a), lb AS (SELECT DISTINCT '/' || lang d FROM b), pa AS (SELECT DISTINCT p d, '/' || lang u FROM a), pb AS (SELECT DISTINCT p d, '/' || lang u FROM b)
SELECT d AS path, 'R' AS op FROM la WHERE d NOT IN (SELECT d FROM lb) UNION ALL SELECT d, 'A' FROM lb WHERE d NOT IN (SELECT d FROM la)
UNION ALL SELECT d, 'R' FROM pa WHERE d NOT IN (SELECT d FROM pb) AND u IN (SELECT d FROM lb) UNION ALL SELECT d, 'A' FROM pb WHERE d NOT IN (SELECT d FROM pa) AND u IN (SELECT d FROM la)
UNION ALL SELECT f, 'M' FROM b WHERE doc_id % 7 = 0 AND f IN (SELECT f FROM a)""")
def directory_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Nothing is listed below a directory that came or went."""
    d = S.documents(spark, sf).join(_t(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "lang", "source"), "file_id")
    a = d.filter(~F.col("source").isin("src2", "src4")).select("path", F.lit("same").alias("c"))
    b = d.filter("source <> 'src5' and lang <> 'es'").select("path", F.when(F.col("file_id") % 7 == 0, "new").otherwise("same").alias("c"))
    return changes.tree_diff(_nodes(a), _nodes(b), F.col("c"))


@query("""SELECT l_partkey, yr AS layer, l_orderkey, l_linenumber FROM (SELECT l_partkey, year(l_shipdate) AS yr, l_orderkey, l_linenumber,
 row_number() OVER (PARTITION BY l_partkey ORDER BY year(l_shipdate) DESC, l_orderkey DESC, l_linenumber DESC) r FROM lineitem) WHERE r = 1""")
def overlay_layers(spark: SparkSession, sf: str) -> DataFrame:
    li = _t(spark, sf, "lineitem").select("l_partkey", F.year("l_shipdate").cast("long").alias("layer"), "l_orderkey", "l_linenumber")
    return changes.overlay(li, "l_partkey", "layer")


@query("""WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events),
l AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'add' ELSE 'update' END op, value FROM e WHERE r = 1),
b AS (SELECT c_custkey AS user_id, c_acctbal AS value FROM customer)
SELECT coalesce(b.user_id, l.user_id) AS user_id, CASE WHEN l.op IS NULL THEN b.value ELSE l.value END AS value FROM b FULL JOIN l ON b.user_id = l.user_id WHERE l.op IS NULL OR l.op <> 'delete'""")
def change_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Events as changes (ours: signup adds, error deletes, the rest update) over customers."""
    base = _t(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    return changes.fold(base, _feed(_t(spark, sf, "events")), "user_id", "ts", "event_id")


def _feed(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "add").otherwise("update")
    return events.select("user_id", "ts", "event_id", op.alias("op"), "value")


@query("""WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events)
SELECT user_id, value FROM e WHERE r = 1 AND event_type <> 'error'""")
def streamed_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The feed as a stream, committed to a versioned store batch by batch."""
    root = _scratch(spark, "store")
    schema = _t(spark, sf, "events").schema
    feed = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    store = Store(spark, f"{root}/table", "user_id")
    run = follow(_feed(feed), store, "ts", "event_id", checkpoint=f"{root}/checkpoint")
    run.awaitTermination()
    return store.read()


@query("""SELECT event_id AS seq, event_type AS op, epoch_us(ts) // 1000000 AS ts, (event_id % 3)::INTEGER AS n_inputs, octet_length(encode(props))::INTEGER AS param_bytes FROM events""")
def history_listing(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("op"), (F.expr("timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', cast(ts AS timestamp_ntz))") * 1000).alias("ts_ns"), F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("event_id") % 3).cast("int")).alias("inputs"), F.col("props").alias("params"))
    return changes.history(e)


@query("SELECT user_id, count(*) AS n, count(*) - 1 AS sound, 1::BIGINT AS broken FROM events GROUP BY user_id")
def epoch_chain(spark: SparkSession, sf: str) -> DataFrame:
    """A chain of commits for each user, whose last epoch was tampered with."""
    e = _t(spark, sf, "events").select("user_id", "ts", "event_id", F.sha2(F.concat_ws("|", "event_type", F.col("value").cast("string")), 256).alias("ops_hash"))
    made = written(changes.chained(e, "user_id", "ts", "event_id"), "chain")
    last = made.groupBy("user_id").agg(F.max("sequence").alias("last"))
    tampered = made.join(last, "user_id").withColumn("ops_hash", F.when(F.col("sequence") == F.col("last"), F.lit("tampered")).otherwise(F.col("ops_hash"))).drop("last")
    found = changes.verify_chain(tampered, chain="user_id")
    return found.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("sound").cast("long")).alias("sound"), F.sum((~F.col("sound")).cast("long")).alias("broken"))


@query("""SELECT o_custkey AS root, '/moved/' || o_orderkey AS path, o_orderpriority AS drop_id, 384 AS mode FROM orders WHERE o_orderkey % 4 <> 0
UNION ALL SELECT DISTINCT o_custkey, '/moved', NULL, 493 FROM orders""")
def epoch_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders are added, changed, partly removed, and their directory renamed."""
    o = _t(spark, sf, "orders")
    path = F.concat(F.lit("/in/"), F.col("o_orderkey").cast("string"))
    none = F.lit(None).cast("string")

    def ops(epoch: int, op: str, where: str, *, p: Column = path, to: Column = none, drop: Column = none, mode: int | None = None) -> DataFrame:
        return o.filter(where).select(F.col("o_custkey").alias("root"), F.lit(epoch).alias("epoch"), F.col("o_orderkey").alias("pos"), F.lit(op).alias("op"), p.alias("path"), to.alias("to"), drop.alias("drop_id"), F.lit(mode).cast("int").alias("mode"))

    once = o.select(F.col("o_custkey")).distinct()

    def single(epoch: int, op: str, p: str, to: str | None, mode: int | None) -> DataFrame:
        return once.select(F.col("o_custkey").alias("root"), F.lit(epoch).alias("epoch"), F.lit(0).cast("long").alias("pos"), F.lit(op).alias("op"), F.lit(p).alias("path"), F.lit(to).cast("string").alias("to"), none.alias("drop_id"), F.lit(mode).cast("int").alias("mode"))

    parts = [single(0, "mkdir", "/in", None, 0o755), ops(1, "add", "true", drop=F.lit("first"), mode=0o644), ops(2, "modify", "true", drop=F.col("o_orderpriority")), ops(3, "chmod", "true", mode=0o600), ops(4, "remove", "o_orderkey % 4 = 0"), single(5, "rename", "/in", "/moved", None)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return changes.replay(every).select("root", "path", "drop_id", "mode")


# Redundancy and encryption

_SAME = "SELECT doc_id AS file_id, sha256(text) AS drop_id FROM documents"


@query(_SAME)
def aes_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """I3; the fixed key and the nonces from ids are fit for a test alone."""
    d = _docs(spark, sf)
    key = F.unhex(F.sha2(F.lit("example key"), 256))
    nonce = F.substring(F.unhex(F.sha2(F.col("file_id").cast("string"), 256)), 1, 12)
    bound = F.encode(F.col("file_id").cast("string"), "utf-8")
    sealed = d.select("file_id", redundancy.seal(F.col("content"), key, nonce, bound).alias("sealed"))
    return sealed.select("file_id", digest(redundancy.open_sealed(F.col("sealed"), key, bound)).alias("drop_id"))


@query(_SAME)
def erasure_repair(spark: SparkSession, sf: str) -> DataFrame:
    """4 + 2 shards of each file, two of them lost."""
    d = _docs(spark, sf).select("file_id", "content")
    shards = redundancy.erasure_encode(d, 4, 2, key="file_id")
    left = shards.filter((F.col("shard") != F.col("file_id") % 6) & (F.col("shard") != (F.col("file_id") + 1) % 6))
    return redundancy.erasure_repair(left, 4, 2, key="file_id").select("file_id", digest(F.col("content")).alias("drop_id"))


@query("SELECT c_custkey AS id, sha256(c_name) AS secret_hash FROM customer")
def shamir_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """3 of 5 shares; two are lost."""
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.encode("c_name", "utf-8").alias("secret"))
    shares = redundancy.share_rows(c, 3, 5, b"test seed", key="id", secret="secret")
    number = F.conv(F.hex(F.substring("share", 1, 1)), 16, 10).cast("int")
    left = shares.filter(((number + F.col("id")) % 5).isin(0, 2, 3))
    return redundancy.combine_rows(left, key="id").select("id", digest(F.col("secret")).alias("secret_hash"))


# Measurements


@query("""SELECT event_type, count(*) AS n, median(value) AS median, round(stddev_samp(value), 6) AS stdev, max(value) AS largest FROM events GROUP BY 1""")
def bench_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return reports.statistics(_t(spark, sf, "events"), ["event_type"], "value").withColumn("stdev", F.round("stdev", 6))


@query("""SELECT l_returnflag AS dataset, l_linestatus AS op, count(*) AS n, median(l_quantity) AS median, round(stddev_samp(l_quantity), 6) AS stdev, round(max(l_extendedprice) / median(l_quantity), 6) AS throughput,
 round(max(l_extendedprice * (1 - l_discount)) / max(l_extendedprice), 9) AS ratio, max(l_orderkey) AS rss FROM lineitem GROUP BY 1, 2""")
def bench_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A10 over lines as runs: quantity as seconds, price before and after the discount as bytes in and out."""
    li = _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("op"), F.col("l_quantity").alias("seconds"), F.col("l_extendedprice").alias("bytes_in"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("bytes_out"), F.col("l_orderkey").alias("rss"))
    return reports.bench_summary(li, "dataset", "op").withColumns({"stdev": F.round("stdev", 6), "throughput": F.round("throughput", 6), "ratio": F.round("ratio", 9)})


@query("""WITH m AS (SELECT user_id % 50 AS row, event_type, median(value) AS median FROM events GROUP BY 1, 2), b AS (SELECT *, min(median) OVER (PARTITION BY row) AS best FROM m)
SELECT event_type, sum(CASE WHEN median = best THEN 1 ELSE 0 END)::BIGINT AS n_wins, sum(CASE WHEN median <> best AND abs(median - best) / greatest(best, 1e-9) < 0.05 THEN 1 ELSE 0 END)::BIGINT AS n_ties FROM b GROUP BY 1""")
def win_matrix(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").withColumn("row", F.col("user_id") % 50)
    return reports.wins(reports.statistics(e, ["row", "event_type"], "value"), "row", "event_type")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS out_bytes, floor(sum(l_quantity) * 1000 / sum(l_quantity + l_linenumber))::BIGINT AS permille FROM lineitem GROUP BY 1, 2""")
def ratio_report(spark: SparkSession, sf: str) -> DataFrame:
    """F15 over lines as encoded and plain lengths."""
    g = _t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("out_bytes"), F.sum(F.col("l_quantity") + F.col("l_linenumber")).cast("long").alias("plain"))
    return g.select("l_returnflag", "l_linestatus", "out_bytes", P.permille(F.col("out_bytes"), F.col("plain")).alias("permille"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
