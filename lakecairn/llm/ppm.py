"""Operator 1: language-model scoring by prediction by partial matching over bytes.

The pretrained model is the byte-context trie of the training texts up to ORDER bytes
of context. In a context with n occurrences of q distinct symbols, a symbol seen c
times has (2c - 1) / 2n and the escape q / 2n; after an escape the next shorter context is asked without the symbols that the
longer one had (symbol exclusion: they leave n and q), down to the uniform order of all 256 symbols.
Each text ends with an end symbol and begins in a context of end symbols, so the score
is the probability of the whole text. A context the training has never seen costs
nothing and hands on to the shorter one.

The trie is never in one place. Each task packs its texts into chunks of bounded size
and counts a chunk's distinct grams (context and symbol) and tokens; the corpus-wide
counts are summed by key; the trie is built in groups of grams that agree in the last
two bytes of context, which hold every context of order 2 and more of theirs, beside
the table of the byte pairs (at most 65,536 numbers); and each chunk gets back the code
lengths of its own grams and the counts of its own tokens, at most as many as its bytes.

``adaptive`` scores a text by a model that learns from this text alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common as C

#: Bytes of context; a gram is a context and a symbol.
ORDER = 4
GRAM = ORDER + 1
#: Ends a text and fills the context before it; no UTF-8 text holds this byte.
END = 255
SYMBOLS = 256
#: Bytes of text in a chunk, which bounds the memory of a task; a longer text is a chunk of its own size.
CHUNK_BYTES = 16_000_000
#: Texts whose grams are sorted out together.
PART_BYTES = 1_000_000
U8 = np.uint64(8)


def grams(raw: bytes) -> np.ndarray:
    """For each byte of the text and its end: ORDER bytes of context and the symbol as one number."""
    flat = np.frombuffer(bytes([END]) * ORDER + raw + bytes([END]), np.uint8)
    n = len(raw) + 1
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = (out << U8) | flat[k : k + n]
    return out.view(np.int64)


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size > PART_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _count(texts: list[bytes], learn: list[bool]) -> tuple[np.ndarray, np.ndarray, Counter]:
    """The distinct grams and tokens of a chunk with their counts in its training texts."""
    pieces: list[tuple[np.ndarray, np.ndarray]] = []
    tokens: Counter[bytes] = Counter()
    unlearned: set[bytes] = set()
    for a, b in _parts([len(t) for t in texts]):
        own = [grams(t) for t in texts[a:b]]
        weight = np.repeat(np.array(learn[a:b], np.int64), [len(g) for g in own])
        index = pa.array(np.concatenate(own)).dictionary_encode()
        held = index.dictionary.to_numpy()
        pieces.append((held, np.bincount(index.indices.to_numpy(), weights=weight, minlength=len(held))))
        for t, on in zip(texts[a:b], learn[a:b], strict=True):
            tokens.update(t.split()) if on else unlearned.update(t.split())
    held, at = np.unique(np.concatenate([k for k, _ in pieces]), return_inverse=True)
    counts = np.bincount(at, weights=np.concatenate([n for _, n in pieces]), minlength=len(held)).astype(np.int64)
    for w in unlearned:
        tokens.setdefault(w, 0)
    return held, counts, tokens


def _packed(id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks of a task's texts: a row with the texts, then one for each distinct gram and token."""
    names = ["chunk", "gram", "token", "n", "ids", "learn", "sizes", "texts"]

    def flush(chunk: int, ids: list, learn: list[bool], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        whole = [[chunk], [None], [None], [None], [ids], [learn], [[len(t) for t in texts]], [blob]]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(whole, kinds, strict=True)], names)
        del whole, blob
        held, counts, tokens = _count(texts, learn)
        words = list(tokens)
        for at in range(0, len(held), ROWS):
            n = min(ROWS, len(held) - at)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(held[at : at + n]), pa.nulls(n, pa.binary()), pa.array(counts[at : at + n]), *(pa.nulls(n, t) for t in kinds[4:])], names)
        for at in range(0, len(words), ROWS):
            own = words[at : at + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), chunk)), pa.nulls(len(own), pa.int64()), pa.array(own, pa.binary()), pa.array([tokens[w] for w in own], pa.int64()), *(pa.nulls(len(own), t) for t in kinds[4:])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 24, 0
        ids, learn, texts = [], [], []
        for batch in batches:
            for at in range(0, batch.num_rows, C.SLICE_ROWS):
                part = batch.slice(at, C.SLICE_ROWS)
                for i, on, raw in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    text = (raw or b"").translate(C.LOWER)
                    if texts and size + len(text) > CHUNK_BYTES:
                        yield from flush(chunk, ids, learn, texts)
                        chunk, size = chunk + 1, 0
                        ids, learn, texts = [], [], []
                    ids.append(i)
                    learn.append(on)
                    texts.append(text)
                    size += len(text) + 64
        if texts:
            yield from flush(chunk, ids, learn, texts)
        del ids, learn, texts
        C.give_back()

    return run


class Contexts:
    """Counts of the training by context at one order: for each context its total and number of symbols."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, counts  # grams (context and symbol), sorted, seen in training
        self.contexts, first = np.unique(keys >> 8, return_index=True)
        self.total = np.add.reduceat(counts, first) if len(counts) else np.zeros(0, np.int64)
        self.kinds = np.diff(np.append(first, len(keys)))

    def shorter(self, mask: int) -> tuple[np.ndarray, np.ndarray]:
        """Grams and counts with the first context byte dropped; exact, as every position has a full context."""
        keys, at = np.unique(self.keys & mask, return_inverse=True)
        return keys, np.bincount(at, weights=self.counts, minlength=len(keys)).astype(np.int64)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def code_lengths(wanted: np.ndarray, keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of the probability of each wanted gram.

    keys, counts: the training's grams that agree with the wanted ones in their last
    two bytes of context, sorted. pairs: the training's counts of (byte, symbol), 256 x 256.
    """
    order, contexts = {}, (keys, counts)
    for k in range(ORDER, 1, -1):
        order[k] = Contexts(*contexts)
        contexts = order[k].shorter((1 << (8 * k)) - 1)
    symbol = (wanted & 255).astype(np.int64)
    last = ((wanted >> 8) & 255).astype(np.int64)
    out = np.zeros(len(wanted))
    open_ = np.arange(len(wanted))
    # What the longer context, if seen, takes out of the next: occurrences there, and symbols.
    gone_n, gone_q = np.zeros(len(wanted)), np.zeros(len(wanted))

    def ask(total: np.ndarray, kinds: np.ndarray, own: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Codes the symbol where it is seen, else the escape; returns which rows are done."""
        n, q = total - gone_n[rows], kinds - gone_q[rows]
        some = q > 0
        done = own > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            out[rows] += np.where(done, np.log10((2 * own - 1) / (2 * n)), np.where(some, np.log10(q / (2 * n)), 0.0))
        return done

    below = {k: order[k - 1] for k in order if k - 1 in order}
    for k in range(ORDER, 1, -1):
        t = order[k]
        at, seen = _find(t.contexts, (wanted[open_] & ((1 << (8 * (k + 1))) - 1)) >> 8)
        rows = open_[seen]
        g, has = _find(t.keys, wanted[rows] & ((1 << (8 * (k + 1))) - 1))
        own = np.where(has, t.counts[g] if len(t.counts) else 0, 0)
        done = ask(t.total[at[seen]], t.kinds[at[seen]], own, rows)
        # The symbols of this context, as they count in the next shorter one.
        if len(t.keys):
            if k in below:
                lower = below[k].counts[_find(below[k].keys, t.keys & ((1 << (8 * k)) - 1))[0]]
            else:
                lower = pairs[(t.keys >> 8) & 255, t.keys & 255]
            first = np.flatnonzero(np.concatenate([[True], (t.keys[1:] >> 8) != (t.keys[:-1] >> 8)]))
            sums = np.add.reduceat(lower, first)
            left = rows[~done]
            where = at[seen][~done]
            gone_n[left], gone_q[left] = sums[where], t.kinds[where]
        open_ = np.concatenate([open_[~seen], rows[~done]])
    # Order 1, order 0 and the uniform order, from the table of pairs.
    total1, kinds1 = pairs.sum(axis=1), (pairs > 0).sum(axis=1)
    seen = total1[last[open_]] > 0
    rows = open_[seen]
    done = ask(total1[last[rows]], kinds1[last[rows]], pairs[last[rows], symbol[rows]], rows)
    single = pairs.sum(axis=0)
    gone_one = (pairs > 0) @ single
    left = rows[~done]
    gone_n[left], gone_q[left] = gone_one[last[left]], kinds1[last[left]]
    rows = np.concatenate([open_[~seen], left])
    if single.sum():
        done = ask(np.full(len(rows), single.sum()), np.full(len(rows), (single > 0).sum()), single[symbol[rows]], rows)
        rows = rows[~done]
    out[rows] -= math.log10(max(1, SYMBOLS - int((single > 0).sum())))
    return out


def _builder(pairs: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    def build(table: pa.Table) -> pa.Table:
        keys, counts = table.column("gram").to_numpy(), table.column("n").to_numpy()
        sort = np.argsort(keys)
        keys, counts = keys[sort], counts[sort]
        learned = counts > 0
        return pa.table({"gram": pa.array(keys), "value": pa.array(code_lengths(keys, keys[learned], counts[learned], pairs))})

    return build


def _scorer(n_all: int, distinct: int, ends: int, id_type: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores of a chunk's texts from the code lengths of its grams and the counts of its tokens."""
    floor = math.log10(n_all + 0.1 * (distinct + 1))

    def score(chunks: pa.Table, back: pa.Table) -> pa.Table:
        gram, value = back.column("gram").combine_chunks(), back.column("value").to_numpy()
        is_gram = gram.is_valid().to_numpy(zero_copy_only=False)
        keys = gram.drop_null().to_numpy()
        sort = np.argsort(keys)
        keys, bits = keys[sort], value[is_gram][sort]
        known = dict(zip((w.as_py() for w in back.column("token").combine_chunks().drop_null()), value[~is_gram].tolist(), strict=True))
        del back, gram, value, is_gram
        out: list[tuple] = []
        for row in chunks.to_pylist():
            sizes = row["sizes"]
            whole = zstandard.ZstdDecompressor().decompress(row.pop("texts"), max_output_size=sum(sizes) + 1)
            cuts = np.cumsum([0, *sizes]).tolist()
            for a, b in _parts(sizes):
                texts = [whole[i:j] for i, j in zip(cuts[a:b], cuts[a + 1 : b + 1], strict=True)]
                own = [grams(t) for t in texts]
                index = pa.array(np.concatenate(own)).dictionary_encode()
                each = bits[np.searchsorted(keys, index.dictionary.to_numpy())][index.indices.to_numpy()]
                starts = np.cumsum([0, *map(len, own)])[:-1]
                totals = np.add.reduceat(each, starts).tolist()
                for i, on, t, total in zip(row["ids"][a:b], row["learn"][a:b], texts, totals, strict=True):
                    counts = np.array([*map(known.__getitem__, t.split()), ends], float)
                    out.append((i, not on, len(counts), int((counts > 0).sum()), n_all, float(np.log10(counts + 0.1).sum()) - floor * len(counts), total))
        kinds = [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)

    return score


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
#: Rows of an Arrow batch that a task hands on.
ROWS = 50_000
#: Partitions for each chunk when chunks get back their code lengths.
SPREAD = 3


def score(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    ``learn`` says which rows the model learns from. A null text is empty (its end
    alone is scored). Without any training row all symbols are equally likely.
    Repeated rows give repeated results (and count as often in training), an empty
    table gives none; other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    kind = rows.schema["doc_id"].dataType
    fields = [("chunk", T.LongType()), ("gram", T.LongType()), ("token", T.BinaryType()), ("n", T.LongType()), ("ids", T.ArrayType(kind)), ("learn", T.ArrayType(T.BooleanType())), ("sizes", T.ArrayType(T.LongType())), ("texts", T.BinaryType())]
    packed = C.written(rows.mapInArrow(_packed(to_arrow_type(kind)), T.StructType([T.StructField(*f) for f in fields])), "packed", "zstd")
    grams_ = packed.filter("gram is not null").select("chunk", "gram", "n")
    totals = C.written(grams_.groupBy("gram").agg(F.sum("n").alias("n")), "grams", "zstd")
    pairs = np.zeros((256, 256), np.int64)
    for r in totals.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"] >> 8, r["pair"] & 255] = r["n"]
    build = _builder(pairs)
    suffix = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    bits = totals.groupBy(suffix.alias("suffix")).applyInArrow(build, "gram long, value double")
    of_grams = grams_.select("chunk", "gram").join(bits, "gram").select("chunk", "gram", F.lit(None).cast("binary").alias("token"), F.col("value"))
    words = packed.filter("token is not null")
    tokens = C.written(words.groupBy("token").agg(F.sum("n").alias("total")), "tokens", "zstd")
    seen = tokens.filter("total > 0").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    whole = packed.filter("texts is not null").agg(F.coalesce(F.sum(F.size(F.filter("learn", lambda x: x))), F.lit(0)).alias("ends"), F.count("*").alias("chunks")).first()
    ends = whole["ends"]
    of_tokens = words.select("chunk", "token").join(tokens, "token").select("chunk", F.lit(None).cast("long").alias("gram"), "token", F.col("total").cast("double").alias("value"))
    # Partitions follow the count of chunks, so that few chunks meet in a task however many there are.
    parts = max(SPREAD * whole["chunks"], int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    back = of_grams.unionByName(of_tokens).repartition(parts, "chunk")
    texts = packed.filter("texts is not null").select(F.col("chunk").alias("own"), "ids", "learn", "sizes", "texts").repartition(parts, "own")
    out = T.StructType([T.StructField("doc_id", kind), C.flag("held_out"), C.long("n_tokens"), C.long("n_known"), C.long("train_tokens"), C.double("base_score"), C.double("score")])
    scorer = _scorer(seen["n"] + ends, seen["v"] + (ends > 0), ends, to_arrow_type(kind))
    return texts.groupBy("own").cogroup(back.groupBy("chunk")).applyInArrow(scorer, out)


def adaptive(raw: bytes, order: int = ORDER) -> float:
    """log10 of the probability of one text, learned from its own bytes as they come."""
    seen: dict[bytes, Counter[int]] = {}
    past, total = bytes([END]) * order, 0.0
    for symbol in [*raw.translate(C.LOWER), END]:
        gone: set[int] = set()
        for k in range(order, -1, -1):
            counts = {s: c for s, c in seen.get(past[len(past) - k :], Counter()).items() if s not in gone}
            if not counts:
                continue
            n, q = sum(counts.values()), len(counts)
            if symbol in counts:
                total += math.log10((2 * counts[symbol] - 1) / (2 * n))
                break
            total += math.log10(q / (2 * n))
            gone |= counts.keys()
        else:
            total -= math.log10(SYMBOLS - len(gone)) if len(gone) < SYMBOLS else 0.0
        for k in range(order + 1):
            seen.setdefault(past[len(past) - k :], Counter())[symbol] += 1
        past = (past + bytes([symbol]))[-order:]
    return total


def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.table(spark, sf_dir, "documents"), C.id_remainder("doc_id", 10) != 0)
