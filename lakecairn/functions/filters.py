"""Reversible transforms of content for special codecs: branch addresses, samples and frequent strings.

All of them work on NumPy arrays but the choice of branch places and the symbol strings,
which are sequential by their rules. Each gives any content back, whether or not it is of
the kind that the transform is made for. The stored forms are this library's own.
"""

from __future__ import annotations

import re
import struct

import numpy as np

#: Opcode bytes of relative calls and jumps, and the top six bits of a branch with link.
X86_BRANCHES = (0xE8, 0xE9)
ARM64_BRANCH = 0x25
#: Samples that share a Rice parameter.
RICE_BLOCK = 4096
#: Length of the longest symbol of a table, and the code that marks a byte without a symbol.
SYMBOL_BYTES = 8
ESCAPE = 255


def x86_branches(raw: bytes, *, back: bool = False) -> bytes:
    """Operands of calls and jumps from relative to absolute, or back. An operand holds no further branch, so both ways visit the same places."""
    data = np.frombuffer(raw, np.uint8).copy()
    places, free = [], 0
    for at in np.flatnonzero(np.isin(data[: max(0, len(data) - 4)], X86_BRANCHES)).tolist():
        if at >= free:
            places.append(at)
            free = at + 5
    if not places:
        return raw
    at = np.array(places)
    columns = at[:, None] + np.arange(1, 5)
    operands = data[columns].copy().view("<u4").ravel()
    shift = (at + 5).astype(np.uint32)
    moved = operands - shift if back else operands + shift
    data[columns] = moved.astype("<u4").view(np.uint8).reshape(-1, 4)
    return data.tobytes()


def arm64_branches(raw: bytes, *, back: bool = False) -> bytes:
    """Operands of branches with link, in aligned words, from relative to absolute, or back."""
    cut = len(raw) - len(raw) % 4
    words = np.frombuffer(raw[:cut], "<u4").copy()
    own = words >> 26 == ARM64_BRANCH
    place = np.arange(len(words), dtype=np.uint32)[own]
    operand = words[own] & 0x3FFFFFF
    words[own] = (words[own] & ~np.uint32(0x3FFFFFF)) | ((operand - place if back else operand + place) & 0x3FFFFFF)
    return words.astype("<u4").tobytes() + raw[cut:]


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    return ((values[:, None] >> np.arange(width - 1, -1, -1, dtype=values.dtype)) & 1).astype(np.uint8).ravel()


def rice(values: np.ndarray) -> bytes:
    """Unsigned 16-bit numbers in blocks: the parameter, the size of the unary part, quotients in unary, remainders in fixed width."""
    out = [struct.pack("<I", len(values))]
    for i in range(0, len(values), RICE_BLOCK):
        own = values[i : i + RICE_BLOCK].astype(np.uint32)
        k = max(0, int(np.log2(own.mean() + 1)))
        if int((own >> k).sum()) > 16 * len(own):
            k = 16  # no quotients: as many bits as they had
        ends = np.cumsum((own >> k) + 1) - 1
        unary = np.zeros(int(ends[-1]) + 1, np.uint8)
        unary[ends] = 1
        out += [struct.pack("<BI", k, len(unary)), np.packbits(unary).tobytes(), np.packbits(_bits(own & ((1 << k) - 1), k)).tobytes()]
    return b"".join(out)


def unrice(raw: bytes) -> np.ndarray:
    n, at = struct.unpack_from("<I", raw)[0], 4
    out = np.zeros(n, np.uint32)
    for i in range(0, n, RICE_BLOCK):
        size = min(RICE_BLOCK, n - i)
        k, unary = struct.unpack_from("<BI", raw, at)
        at += 5
        ends = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, (unary + 7) // 8, at))[:unary])
        at += (unary + 7) // 8
        part = (size * k + 7) // 8
        rest = np.unpackbits(np.frombuffer(raw, np.uint8, part, at))[: size * k].reshape(size, k).astype(np.uint32)
        at += part
        low = (rest << np.arange(k - 1, -1, -1, dtype=np.uint32)).sum(axis=1, dtype=np.uint32) if k else np.zeros(size, np.uint32)
        out[i : i + size] = (np.diff(ends, prepend=-1) - 1).astype(np.uint32) << np.uint32(k) | low
    return out.astype(np.uint16)


def predicted(raw: bytes, order: int, stride: int, kind: str) -> bytes:
    """16-bit samples as Rice codes of their differences of the given order, ``stride`` samples apart; a last odd byte stays."""
    cut = len(raw) - len(raw) % 2
    left = np.frombuffer(raw[:cut], kind).astype(np.uint16)
    for _ in range(order):
        more = left.copy()
        more[stride:] -= left[:-stride]
        left = more
    signed = left.view(np.int16).astype(np.int32)
    return struct.pack("<BB", order, stride) + raw[cut:].ljust(1, b"\0") + rice(((signed << 1) ^ (signed >> 15)).astype(np.uint16))


def unpredicted(raw: bytes, n: int, kind: str) -> bytes:
    order, stride = struct.unpack_from("<BB", raw)
    folded = unrice(raw[3:]).astype(np.int32)
    left = ((folded >> 1) ^ -(folded & 1)).astype(np.int16).view(np.uint16)
    for _ in range(order):
        for lane in range(stride):
            left[lane::stride] = np.cumsum(left[lane::stride], dtype=np.uint16)
    return left.astype(kind).tobytes() + (raw[2:3] if n % 2 else b"")


def best_prediction(raw: bytes, orders: tuple[int, ...], strides: tuple[int, ...], kind: str) -> bytes:
    return min((predicted(raw, o, s, kind) for o in orders for s in strides), key=len)


#: Symbols of a table: their bytes as the highest of a number, and their lengths.
Symbols = tuple[np.ndarray, np.ndarray]


def symbols(ahead: np.ndarray, rounds: int = 5) -> Symbols:
    """At most 255 strings of up to SYMBOL_BYTES bytes that save most: in each round neighbours in the cut by the last table may become one."""
    table: Symbols = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for _ in range(rounds):
        ends = _cut(ahead, table)
        starts = np.concatenate([ends[:1] * 0, ends[:-1]])
        sizes = ends - starts
        both = sizes[:-1] + sizes[1:]
        fits = both <= SYMBOL_BYTES
        table = _best(ahead, np.concatenate([starts, starts[:-1][fits]]), np.concatenate([sizes, both[fits]]))
    return table


def _ahead(raw: bytes) -> np.ndarray:
    """The SYMBOL_BYTES bytes from each place on as one number, the first the highest; zeros behind the end."""
    data = np.frombuffer(raw + bytes(SYMBOL_BYTES), np.uint8)
    return sum(data[k : k + len(raw)].astype(np.uint64) << np.uint64(56 - 8 * k) for k in range(SYMBOL_BYTES))


def _best(ahead: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Symbols:
    """Of the strings at the places those of most bytes in all, by bytes among equals."""
    keys = ahead[starts] >> (64 - 8 * sizes).astype(np.uint64) << (64 - 8 * sizes).astype(np.uint64)
    order = np.lexsort((sizes, keys))
    keys, sizes = keys[order], sizes[order]
    first = np.flatnonzero(np.concatenate([np.ones(len(keys[:1]), bool), (keys[1:] != keys[:-1]) | (sizes[1:] != sizes[:-1])]))
    keys, sizes, gain = keys[first], sizes[first], np.diff(first, append=len(keys)) * sizes[first]
    if len(gain) > ESCAPE:
        most = gain >= np.partition(gain, -ESCAPE)[-ESCAPE]
        keys, sizes, gain = keys[most], sizes[most], gain[most]
    best = np.argsort(-gain, kind="stable")[:ESCAPE]
    return keys[best], sizes[best]


def _cut(ahead: np.ndarray, table: Symbols) -> np.ndarray:
    """Ends of the content's symbols, the longest of the table that fits at each place, single bytes elsewhere."""
    keys, sizes = table
    n = len(ahead)
    if not np.any(sizes > 1):
        return np.arange(1, n + 1)
    longest = np.ones(n, np.uint8)
    for size in range(2, min(SYMBOL_BYTES, n) + 1):
        if len(own := np.sort(keys[sizes == size])):
            key = ahead[: n - size + 1] >> np.uint64(64 - 8 * size) << np.uint64(64 - 8 * size)
            near = np.zeros(1 << 16, bool)
            near[_mixed(own)] = True
            at = np.flatnonzero(near[_mixed(key)])
            key = key[at]
            longest[at[own[np.minimum(np.searchsorted(own, key), len(own) - 1)] == key]] = size
    step, ends, at = longest.tolist(), [], 0
    while at < n:
        at += step[at]
        ends.append(at)
    return np.array(ends, np.int64)


def _mixed(keys: np.ndarray) -> np.ndarray:
    """16 bits of a product, to pass over most keys that a table lacks."""
    return keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)


def with_symbols(raw: bytes) -> bytes:
    """The table of symbols, then the content as codes of its symbols; other bytes are escaped."""
    ahead = _ahead(raw)
    found = symbols(ahead)
    table = [k.to_bytes(SYMBOL_BYTES)[:n] for k, n in zip(*(x.tolist() for x in found), strict=True)]
    code = {s: bytes([i]) for i, s in enumerate(table)}
    ends = _cut(ahead, found).tolist()
    body = b"".join([code.get(p := raw[a:b]) or bytes([ESCAPE]) + p for a, b in zip([0, *ends], ends, strict=False)])
    return bytes([len(table)]) + b"".join(bytes([len(s)]) + s for s in table) + body


def without_symbols(raw: bytes) -> bytes:
    at, table = 1, []
    for _ in range(raw[0]):
        table.append(raw[at + 1 : at + 1 + raw[at]])
        at += 1 + raw[at]
    parts = re.compile(rb"\xff(.)|([^\xff])", re.DOTALL).findall(raw[at:])
    return b"".join([literal or table[code[0]] for literal, code in parts])
