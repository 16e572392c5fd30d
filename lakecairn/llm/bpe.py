"""Operator 2: byte-level BPE encoding and decoding on padded integer matrices.

Text is split by the pre-tokenizer pattern; each distinct piece is encoded once
per task. Pieces are bucketed by length and laid out as one padded matrix of
token ids per bucket. In each round every row looks up the ranks of its
adjacent pairs in an open-addressing hash table, merges its leftmost pair of
minimum rank, and the matrix is compacted by the one cell that each row lost.
Rows without a mergeable pair leave. Pieces over MATRIX_BYTES bytes follow the
same rule with a heap, so a very long piece costs n log n instead of n squared.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common as C

#: Widths of the padded matrices; a piece goes to the first that holds it.
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128)
MATRIX_BYTES = WIDTHS[-1]
#: Pieces in each of the two generations that a worker remembers; forgetting changes no result.
REMEMBERED = 150_000
#: Cells of one matrix at most.
CELLS = 1 << 18
NONE = np.int32(2**31 - 1)


class Ranks:
    """A rank file (base64 token, rank) as id tables and a hashed pair table."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        by_rank = {rank: token for token, rank in ranks.items()}
        tokens = [by_rank.get(r, b"") for r in range(max(by_rank) + 1)]
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self._hash(pairs)

    def _hash(self, pairs: list[tuple[int, int]]) -> None:
        self.bits = max(4, (3 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.merged = np.full(size, NONE, np.int32)
        keys = np.array([k for k, _ in pairs], np.int64)
        values = np.array([v for _, v in pairs], np.int32)
        at, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            placed = self.keys[at] == keys
            self.merged[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each merged pair, NONE where the pair is no token. Negative ids are padding."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.merged[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1) & (left >= 0) & (right >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.merged[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out


@lru_cache(maxsize=2)
def load_ranks(path: str) -> Ranks:
    return Ranks(path)


def merge_matrix(ranks: Ranks, pieces: list[bytes], width: int) -> list[bytes]:
    """The ids (little-endian unsigned 32-bit) of pieces of at most ``width`` bytes."""
    n = len(pieces)
    flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    ids = np.where(np.arange(width) < lengths[:, None], ranks.byte_ids[flat], np.int32(-1))
    pair = ranks.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
    rows, out = np.arange(n), [b""] * n
    while True:
        at = pair.argmin(axis=1) if pair.shape[1] else np.zeros(len(rows), np.int64)
        least = pair[np.arange(len(rows)), at] if pair.shape[1] else np.full(len(rows), NONE)
        done = least == NONE
        if done.any():
            ended = ids[done]
            raw, step = ended.astype("<i4").tobytes(), 4 * ended.shape[1]
            for i, (row, k) in enumerate(zip(rows[done].tolist(), (ended >= 0).sum(axis=1).tolist(), strict=True)):
                out[row] = raw[i * step : i * step + 4 * k]
            stay = ~done
            rows, ids, pair, at, least = rows[stay], ids[stay], pair[stay], at[stay], least[stay]
            if not len(rows):
                return out
        m, w = ids.shape
        line = np.arange(m)
        ids[line, at] = least
        keep = np.ones((m, w), bool)
        keep[line, at + 1] = False
        ids = ids[keep].reshape(m, w - 1)
        keep = np.ones((m, w - 1), bool)
        keep[line, at] = False
        pair = pair[keep].reshape(m, w - 2)
        if w > 2:
            has = np.flatnonzero(at > 0)
            pair[has, at[has] - 1] = ranks.pair_ranks(ids[has, at[has] - 1], ids[has, at[has]])
            has = np.flatnonzero(at < w - 2)
            pair[has, at[has]] = ranks.pair_ranks(ids[has, at[has]], ids[has, at[has] + 1])


def merge_long(ranks: Ranks, piece: bytes) -> bytes:
    """The same rule for one long piece: a heap of (rank, position) over linked parts."""
    ids = ranks.byte_ids[np.frombuffer(piece, np.uint8)]
    first = ranks.pair_ranks(ids[:-1], ids[1:])
    ids, n = ids.tolist(), len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i, r in enumerate(first.tolist()) if r != NONE]
    heapq.heapify(heap)
    known: dict[tuple[int, int], int] = {}

    def rank(i: int) -> int:
        if i < 0 or after[i] >= n:
            return int(NONE)
        key = (ids[i], ids[after[i]])
        if key not in known:
            known[key] = int(ranks.pair_ranks(np.array([key[0]], np.int32), np.array([key[1]], np.int32))[0])
        return known[key]

    while heap:
        r, i = heapq.heappop(heap)
        if ids[i] < 0 or rank(i) != r:
            continue
        gone = after[i]
        ids[i], ids[gone] = r, -1
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        for j in (before[i], i):
            if (new := rank(j)) != NONE:
                heapq.heappush(heap, (new, j))
    return np.array([x for x in ids if x >= 0], "<u4").tobytes()


def encode_pieces(ranks: Ranks, pieces: Iterable[bytes]) -> dict[bytes, bytes]:
    """Distinct pieces by their ids."""
    buckets: dict[int, list[bytes]] = {w: [] for w in WIDTHS}
    by_length = [next(buckets[w] for w in WIDTHS if k <= w) for k in range(MATRIX_BYTES + 1)]
    out: dict[bytes, bytes] = {}
    for p in pieces:
        if len(p) > MATRIX_BYTES:
            out[p] = merge_long(ranks, p)
        else:
            by_length[len(p)].append(p)
    for width, own in buckets.items():
        step = max(1, CELLS // width)
        for i in range(0, len(own), step):
            part = own[i : i + step]
            out.update(zip(part, merge_matrix(ranks, part, width), strict=True))
    return out


def plain_ranges(pattern: str, below: int) -> re.Pattern | None:
    r"""The pattern for texts of code points under ``below``, with \p{L}, \p{N}, \s and \S as plain ranges.

    None if it has any other property class.
    """
    every = "".join(map(chr, [*range(min(below, 0xD800)), *range(0xE000, below)]))

    def ranges(kind: str) -> str:
        return "".join(f"\\U{ord(m[0]):08x}-\\U{ord(m[-1]):08x}" for m in regex.findall(f"{kind}+", every))

    out, inside, i = [], False, 0
    while i < len(pattern):
        kind = next((k for k in (r"\p{L}", r"\p{N}", r"\s", r"\S") if pattern.startswith(k, i)), None)
        if kind == r"\S" and inside or kind is None and pattern.startswith((r"\p", r"\P"), i):
            return None
        if kind:
            own = ranges(kind.lower() if kind == r"\S" else kind)
            out.append(own if inside else f"[^{own}]" if kind == r"\S" else f"[{own}]")
            i += len(kind)
            continue
        step = 2 if pattern[i] == "\\" else 1
        inside = pattern[i] == "[" or inside and pattern[i] != "]"
        out.append(pattern[i : i + step])
        i += step
    return re.compile("".join(out))


WIDE = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(maxsize=4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """findall of the pattern, by ``re`` where its ranges fit the text, which is several times faster."""
    whole, ascii_, plane = regex.compile(pattern).findall, plain_ranges(pattern, 128), plain_ranges(pattern, 0x10000)
    if not ascii_ or not plane:
        return whole

    def split(text: str) -> list[str]:
        if text.isascii():
            return ascii_.findall(text)
        return whole(text) if WIDE.search(text) else plane.findall(text)

    return split


class Encoder:
    """Encodes and decodes whole texts; remembers the pieces it has met."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks, self.split = load_ranks(path), splitter(pattern)
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.split(t) for t in texts]
        if len(self.ids) > REMEMBERED:
            self.ids, self.older = {}, self.ids
        ids, older = self.ids, self.older
        new = {p for p in set(chain.from_iterable(cut)) if p not in ids}
        ids.update((p, older[p]) for p in new if p in older)
        raw = {p.encode(): p for p in new if p not in ids}
        ids.update((raw[p], own) for p, own in encode_pieces(self.ranks, raw).items())
        return [b"".join(map(ids.__getitem__, pieces)) for pieces in cut]

    def decode(self, texts: list[bytes]) -> list[bytes]:
        """The bytes of the tokens: one gather over the tokens' concatenated bytes for all texts."""
        ids = np.frombuffer(b"".join(texts), "<u4")
        if not len(ids):
            return [b""] * len(texts)
        starts, sizes = self.ranks.starts, self.ranks.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
        flat = self.ranks.flat[at].tobytes()
        cuts = [0, *np.concatenate([[0], ends])[np.cumsum([len(x) // 4 for x in texts])].tolist()]
        return [flat[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=1)
def _worker_encoder(path: str, pattern: str) -> Encoder:
    """A Python worker serves many tasks; what it remembers only saves time."""
    return Encoder(path, pattern)


def _encoder(path: str, pattern: str, with_ids: bool) -> Callable:
    def make() -> Callable[[list[bytes]], list[list]]:
        enc = _worker_encoder(path, pattern)

        def texts_of(texts: list[bytes]) -> list[list]:
            ids = enc.encode([t.decode("utf-8", "replace") for t in texts])
            out = [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x).hexdigest() for x in enc.decode(ids)]]
            return [*out, ids] if with_ids else out

        return texts_of

    return make


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256 (ids binary).

    A null text is empty: 0 tokens and the digests of no bytes. Repeated rows
    give repeated results, an empty table none; other columns are not read.
    ``path`` must be readable on every executor.
    """
    fields = [C.long("n_tokens"), C.string("ids_sha256"), C.string("decoded_sha256")] + [T.StructField("ids", T.BinaryType())] * with_ids
    return C.map_texts(C.text_rows(docs, id_col, text_col), _encoder(path, pattern, with_ids), fields)


def vocabulary() -> tuple[str, str]:
    """The rank file and the splitting pattern that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(C.table(spark, sf_dir, "documents"), *vocabulary())
