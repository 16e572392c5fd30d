"""Operator 4: benchmark decontamination with a distributed positional inverted index.

``index`` writes the documents' postings once: documents are gathered in segments, and
for every term of a segment there is a row with its places, documents apart by a gap.
Nothing in it depends on a benchmark, so any number of searches can share it.

A search sends its phrases (or proximity queries) to the index as tables. Terms are rated
by their count in the whole corpus; a phrase goes only to the segments that hold its
rarest term; there the lists of its terms, rarest first, shifted by the term's place in
the phrase, are intersected until the list is empty or all terms have agreed. Segments
are streamed one after the other, so a task holds the wanted postings of one segment and
a batch of phrases; a larger benchmark means more rows, not more passes over the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common as C

WINDOW = 13
#: Bytes of text in a segment, which bounds the memory of a task; a longer text is a segment of its own size.
SEGMENT_BYTES = 8_000_000
#: A document is contaminated if it has hits and 20 * n_hit >= n_words.
HIT_SHARE = 20
#: Phrases of an item that a task hands on at once.
ROWS = 20_000
#: Order of the rows of a segment in a task: documents, postings, queries.
DOCUMENT, POSTING, QUERY = 0, 1, 2


@dataclass(frozen=True)
class Index:
    """rows: segment, slot, doc_id, digest, n_words, start; postings: segment, term, n, places (see packed)."""

    rows: DataFrame
    postings: DataFrame


def segment_postings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, pa.Array]:
    """(words of each text, place of each text's first word, terms, their counts, their packed places)."""
    flat = b" ".join([*texts, b""]).translate(C.WORDS)
    solid = np.frombuffer(flat, np.uint8) != 32
    turns = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if len(solid) and solid[0]:
        turns = np.concatenate([[0], turns])
    begin, length = turns[::2], turns[1::2] - turns[::2]
    cuts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    sizes = np.diff(np.searchsorted(begin, cuts))
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    ends = np.cumsum(np.concatenate([[0], length])).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(flat.translate(None, b" "))])
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy()
    place = (np.arange(len(ids)) + np.repeat(np.arange(len(texts)), sizes))[np.argsort(ids, kind="stable")]
    counts = np.bincount(ids, minlength=len(coded.dictionary))
    return sizes, starts, coded.dictionary.cast(pa.string()), counts, packed(place, counts)


def packed(places: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The runs of rising places as binary values: the first, then the steps, each in groups of 7 bits, lowest first, all but the last with bit 7."""
    first = np.cumsum(counts) - counts
    steps = np.diff(places, prepend=0)
    steps[first] = places[first]
    size = 1 + sum((steps >= 1 << 7 * k).astype(np.int64) for k in range(1, 9))
    ends = np.cumsum(size)
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        flat[(ends - size)[own] + k] = (steps[own] >> 7 * k & 127) | np.where(size[own] > k + 1, 128, 0)
    cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])


def unpacked(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(raw, np.uint8)
    if flat.max(initial=0) < 128:
        return np.cumsum(flat, dtype=np.int64)
    last = np.flatnonzero(flat < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    group = np.arange(len(flat)) - np.repeat(first, last - first + 1)
    return np.cumsum(np.add.reduceat((flat & 127).astype(np.int64) << 7 * group, first))


def _indexer(id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    fields = [("segment", pa.int64()), ("slot", pa.int32()), ("doc_id", id_type), ("digest", pa.string()), ("n_words", pa.int64()), ("start", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("places", pa.binary())]
    names = [n for n, _ in fields]

    def batch(rows: int, **given: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[name] if name in given else pa.nulls(rows, t) for name, t in fields], names)

    def flush(segment: int, ids: list, digests: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        sizes, starts, terms, counts, places = segment_postings(texts)
        n, m = len(texts), len(terms)
        yield batch(n, segment=pa.array(np.full(n, segment)), slot=pa.array(np.arange(n, dtype=np.int32)), doc_id=pa.array(ids, id_type), digest=pa.array(digests, pa.string()), n_words=pa.array(sizes, pa.int64()), start=pa.array(starts, pa.int64()))
        if m:
            yield batch(m, segment=pa.array(np.full(m, segment)), term=terms, n=pa.array(counts, pa.int64()), places=places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, size = TaskContext.get().partitionId() << 24, 0
        ids, digests, texts = [], [], []
        for whole in batches:
            for at in range(0, whole.num_rows, C.SLICE_ROWS):
                part = whole.slice(at, C.SLICE_ROWS)
                for i, digest, raw in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    text = raw or b""
                    if texts and size + len(text) > SEGMENT_BYTES:
                        yield from flush(segment, ids, digests, texts)
                        segment, size = segment + 1, 0
                        ids, digests, texts = [], [], []
                    ids.append(i)
                    digests.append(digest)
                    texts.append(text)
                    size += len(text) + 64
        if texts:
            yield from flush(segment, ids, digests, texts)
        del ids, digests, texts
        C.give_back()

    return run


def index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> Index:
    """The postings of all terms of all texts, written once in the shared folder.

    A null text has no words. Repeated rows are indexed as often as they come, an empty
    table gives an empty index; other columns are not read. A text of any length is
    indexed whole, in the memory that its words take. ``digest`` is carried along.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), (F.lit(None).cast("string") if digest is None else digest).alias("digest"))
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([C.long("segment"), T.StructField("slot", T.IntegerType()), T.StructField("doc_id", kind), C.string("digest"), C.long("n_words"), C.long("start"), C.string("term"), C.long("n"), T.StructField("places", T.BinaryType())])
    table = C.written(rows.mapInArrow(_indexer(to_arrow_type(kind)), schema), "postings")
    return Index(table.filter("term is null").select("segment", "slot", "doc_id", "digest", "n_words", "start"), table.filter("term is not null").select("segment", "term", "n", "places"))


def phrase(postings: dict[int, np.ndarray], terms: list[int], shifts: list[int]) -> np.ndarray:
    """Places where the terms stand at their shifts from one another, rarest term first."""
    found = None
    for t, k in zip(terms, shifts, strict=True):
        other = postings.get(t)
        if other is None:
            return np.zeros(0, np.int64)
        if found is None:
            found = other - k
            continue
        at = np.searchsorted(other, found + k)
        found = found[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] == found + k)]
        if not len(found):
            break
    return found if found is not None else np.zeros(0, np.int64)


def near(postings: dict[int, np.ndarray], terms: list[int], width: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the rarest term with every other term at most ``width`` words away in the same document."""
    found = postings.get(terms[0], np.zeros(0, np.int64))
    for t in terms[1:]:
        other = postings.get(t)
        if other is None or not len(found):
            return np.zeros(0, np.int64)
        doc = np.searchsorted(starts, found, side="right") - 1
        low, high = np.maximum(found - width, starts[doc]), np.minimum(found + width, starts[doc] + sizes[doc] - 1)
        found = found[np.searchsorted(other, high, side="right") > np.searchsorted(other, low)]
    return found


def _intersecter(width: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hits (segment, slot, first, last, query) of the queries of each segment; rows come by segment and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, starts, sizes, postings = None, [], [], {}
        at_starts = at_sizes = np.zeros(0, np.int64)
        for whole in batches:
            if not whole.num_rows:
                continue
            segments, kinds = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            cuts = np.flatnonzero((segments[1:] != segments[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            out: list[tuple[np.ndarray, ...]] = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kinds)], strict=True):
                if segments[a] != segment:
                    segment, starts, sizes, postings = segments[a], [], [], {}
                part = whole.slice(a, b - a)
                if kinds[a] == DOCUMENT:
                    starts.append(part.column(4).to_numpy())
                    sizes.append(part.column(5).to_numpy())
                    at_starts, at_sizes = np.concatenate(starts), np.concatenate(sizes)
                    order = np.argsort(at_starts)
                    at_starts, at_sizes = at_starts[order], at_sizes[order]
                elif kinds[a] == POSTING:
                    for t, raw in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                        postings[t] = unpacked(raw)
                else:
                    for q, terms, shifts in zip(part.column(2).to_pylist(), part.column(6).to_pylist(), part.column(7).to_pylist(), strict=True):
                        found = phrase(postings, terms, shifts) if width is None else near(postings, terms, width, at_starts, at_sizes)
                        if len(found):
                            slot = np.searchsorted(at_starts, found, side="right") - 1
                            first = found - at_starts[slot]
                            out.append((np.full(len(found), segment), slot, first, first + len(terms), np.full(len(found), q)))
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["segment", "slot", "first", "last", "query"])
        del postings
        C.give_back()

    return run


def hits(held: Index, queries: DataFrame, width: int | None = None) -> DataFrame:
    """segment, slot, first, last, query for each occurrence of the queries (query, term, shift: one row for each term).

    Without ``width`` the terms stand at their shifts from one another (an exact phrase);
    with it, first is a place of the rarest term with all others within ``width`` words.
    The lists of the queries' terms, and no others, are dealt by segment once.
    """
    wanted = queries.select("term").distinct()
    counts = held.postings.select("term", "n").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("total"))
    counts = C.written(counts.withColumn("id", F.monotonically_increasing_id()), "counts")
    sizes = queries.groupBy("query").agg(F.count("*").alias("size"))
    order = F.sort_array(F.collect_list(F.struct("total", "shift", "id")))
    rated = queries.join(counts, "term").groupBy("query").agg(order.alias("order")).join(sizes, "query").filter(F.size("order") == F.col("size"))
    rated = C.written(rated.select("query", F.col("order.id").alias("terms"), F.col("order.shift").cast("array<bigint>").alias("shifts")), "queries")
    lists = held.postings.join(counts.select("term", "id"), "term").select("segment", "id", "places")
    asked = rated.withColumn("id", F.get("terms", F.lit(0))).join(lists.select("segment", "id"), "id").select("segment", "query", "terms", "shifts")
    none = lambda kind: F.lit(None).cast(kind)
    of_docs = held.rows.select("segment", F.lit(DOCUMENT).alias("kind"), none("bigint").alias("id"), none("binary").alias("places"), "start", "n_words", none("array<bigint>").alias("terms"), none("array<bigint>").alias("shifts"))
    of_lists = lists.select("segment", F.lit(POSTING).alias("kind"), "id", "places", none("bigint").alias("start"), none("bigint").alias("n_words"), none("array<bigint>").alias("terms"), none("array<bigint>").alias("shifts"))
    of_queries = asked.select("segment", F.lit(QUERY).alias("kind"), F.col("query").alias("id"), none("binary").alias("places"), none("bigint").alias("start"), none("bigint").alias("n_words"), "terms", "shifts")
    dealt = of_docs.unionByName(of_lists).unionByName(of_queries).repartition("segment").sortWithinPartitions("segment", "kind")
    return dealt.mapInArrow(_intersecter(width), "segment long, slot long, first long, last long, query long")


def _cutter(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                words = C.alnum_words(raw.as_py() or b"")
                size = min(window, len(words))
                for at in range(0, len(words) - size + 1 if words else 0, ROWS):
                    own = list(dict.fromkeys(b" ".join(words[i : i + size]) for i in range(at, min(at + ROWS, len(words) - size + 1))))
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(own), pa.string()), pa.array(own, pa.binary()).cast(pa.string())], ["item", "phrase"])

    return run


def search(held: Index, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """segment, slot, spans (start and end of each occurrence, in words), n_full (those of full windows), items (sorted), for documents with hits."""
    items = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    pairs = C.written(items.mapInArrow(_cutter(window), "item string, phrase string").distinct(), "windows")
    phrases = C.written(pairs.select("phrase").distinct().withColumn("query", F.monotonically_increasing_id()), "phrases")
    queries = phrases.select("query", F.posexplode(F.split("phrase", " ")).alias("shift", "term"))
    found = C.written(hits(held, queries), "hits")
    full = F.col("last") - F.col("first") >= window
    spans = found.groupBy("segment", "slot").agg(F.array_sort(F.collect_set(F.struct(F.col("first").alias("a"), F.col("last").alias("b")))).alias("spans"), F.coalesce(F.sum(full.cast("long")), F.lit(0)).alias("n_full"))
    own = found.select("segment", "slot", "query").distinct().join(pairs.join(phrases, "phrase").select("query", "item"), "query").select("segment", "slot", "item").distinct()
    return spans.join(own.groupBy("segment", "slot").agg(F.array_sort(F.collect_list("item")).alias("items")), ["segment", "slot"])


def verdicts(held: Index, found: DataFrame) -> DataFrame:
    """doc_id, digest, n_words, n_hit, n_items, items_sha256, contaminated, n_full for each document of the index. A fold over the sorted spans counts the hit words."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    add = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end"))
    hit = found.select("segment", "slot", F.aggregate("spans", zero, add, lambda s: s["n"]).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("said"), "n_full")
    out = held.rows.withColumn("slot", F.col("slot").cast("long")).join(hit, ["segment", "slot"], "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = out.select("doc_id", "digest", "n_words", count("n_hit"), count("n_items"), F.sha2(F.coalesce("said", F.lit("")), 256).alias("items_sha256"), count("n_full"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * HIT_SHARE >= F.col("n_words")))


def report(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs.

    Null texts have no words; an item without words has no window; an item shorter
    than a window is one. Repeated items or rows change nothing or repeat results.
    An empty benchmark gives no hits, an empty table no rows; other columns are not read.
    """
    held = index(docs, id_col=id_col, text_col=text_col)
    out = verdicts(held, search(held, benchmark, window=window))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a full window of an item anywhere, or are contaminated; columns unchanged, whatever their names.

    Windows of short items (fewer words than a window) are weak evidence and count only
    by their share. Equal texts have equal verdicts, so rows are taken out by a digest of
    the whole text; only digests that go are joined. Null and empty texts stay, repeated
    rows stay or go together, an empty table or benchmark changes nothing.
    """
    plain, name, back = C.shielded(docs, text_col)
    digest = F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    held = index(plain, id_col=name(id_col), digest=digest)
    gone = verdicts(held, search(held, benchmark, window=window)).filter("n_full > 0 or contaminated").select("digest").distinct()
    gone = C.written(gone, "contaminated")
    return back(plain.withColumn("digest", digest).join(gone, "digest", "left_anti"))


def proximity(held: Index, queries: DataFrame, width: int) -> DataFrame:
    """doc_id, query, n_places: places of each query's rarest term with all its other terms within ``width`` words.

    ``queries`` has query (its name) and text; names are distinct, of repeated terms one counts.
    """
    cut = F.array_distinct(F.split(F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")), " "))
    named = C.written(queries.select(F.col("query").alias("name"), cut.alias("terms")).withColumn("query", F.monotonically_increasing_id()), "asked")
    terms = named.select("query", F.posexplode("terms").alias("shift", "term")).filter("term <> ''")
    places = hits(held, terms, width).groupBy("segment", "slot", "query").agg(F.count("*").alias("n_places"))
    rows = held.rows.select("segment", F.col("slot").cast("long").alias("slot"), "doc_id")
    return places.join(rows, ["segment", "slot"]).join(named.select("query", "name"), "query").select("doc_id", F.col("name").alias("query"), "n_places")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
