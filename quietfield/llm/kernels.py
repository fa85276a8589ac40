"""Vectorised text kernels shared by the corpus operators.

Everything here works on the concatenated UTF-8 bytes of a batch of documents
(the buffers of an Arrow string array), so no per-row Python loop runs in the hot
path.

Two kinds of hash.  `word_hashes` hashes byte ranges (words, lines): every block of
eight bytes is scrambled together with its place, so no structure of the text cancels
out; two seeds give 128 bits.  `prefix_hash` is a rolling polynomial modulo 2**64.  It
is used over short ranges only: it picks anchors among windows of at most 255 symbols.
Over small symbol sets it can be made to collide in ranges of 1,024 symbols or more
(Thue-Morse sequences), so nothing is decided by it over raw bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
LOW32 = U64(0xFFFFFFFF)
HIGH32 = U64(0xFFFFFFFF00000000)
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


SYMBOL = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: masks of the first n bytes of eight, read little-endian or big-endian
KEEP_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)
KEEP_HIGH = np.array([((1 << 8 * n) - 1) << (64 - 8 * n) for n in range(9)], dtype=U64)
PLACE = mix(np.arange(101, 133, dtype=U64)) | U64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse (kept per process)."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for base in (BASE, BASE_INV):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
        del _powers[:-2]
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of values[j] * BASE**j for j < i."""
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in [begin, end), independent of where they stand."""
    inv = powers(len(prefix))[1]
    return (prefix[end] - prefix[begin]) * inv[begin]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string_view(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind, count=column.offset + n + 1)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def doc_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Index ranges of documents of about `limit` bytes together; a longer document stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def runs(mask: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal true runs of mask; a run never crosses a position in cuts."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = mask.copy()
    start[1:] &= ~mask[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(mask))]
    start[inner] = mask[inner]
    stop = mask.copy()
    stop[:-1] &= ~mask[1:]
    stop[inner - 1] = mask[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def words(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte of every word, and for each document the index of its first word (n+1 values)."""
    mask = ~IS_SPACE[raw] if is_word is None else is_word[raw]
    begin, end = runs(mask, offsets)
    return begin, end, np.searchsorted(begin, offsets)


def unaligned(raw: np.ndarray, kind: str, front: int = 0) -> np.ndarray:
    """The eight bytes from each position on as one number, `front` zero bytes before raw and eight behind."""
    padded = np.zeros(front + len(raw) + 8, np.uint8)
    padded[front : front + len(raw)] = raw
    return np.ndarray((front + len(raw) + 1,), dtype=kind, buffer=padded, strides=(1,))


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit value for each byte range, equal for equal bytes."""
    size = end - begin
    blocks = np.maximum((size + 7) >> 3, 1)
    if not len(blocks):
        return np.zeros(0, U64)
    eight = unaligned(raw, "<u8")
    start = U64((seed * 0xD6E8FEB86659FD93 + 0x9E3779B97F4A7C15) % (1 << 64))
    if int(blocks.sum()) == len(blocks):  # short words only
        left = size.astype(U64)
        value = eight[begin] & KEEP_LOW[np.minimum(size, 8)]
        return mix(mix(value ^ start) + left * U64(0xA24BAED4963EE407) + start)
    nth = spread(blocks)
    at = nth * 8 + np.repeat(begin, blocks)
    left = np.minimum(np.repeat(end, blocks) - at, 8)
    salt = mix(np.arange(int(blocks.max()), dtype=U64) * U64(0x9FB21C651E98DF25) + start)
    salt[0] = start
    total = np.add.reduceat(mix((eight[at] & KEEP_LOW[left]) ^ salt[nth]), np.cumsum(blocks) - blocks)
    return mix(total + size.astype(U64) * U64(0xA24BAED4963EE407) + start)


def joined(values: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of values[at], ..., values[at + width - 1], themselves hashes: each times an odd number of its place, summed."""
    out = np.full(len(at), width, dtype=U64)
    for d in range(width):
        out += values[at + d] * PLACE[d]
    return mix(out)


def spread(counts: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
    """For each i the values begin[i], begin[i]+1, ... (counts[i] of them), joined."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    ends = np.cumsum(counts)
    out = np.arange(total, dtype=np.int64) - np.repeat(ends - counts, counts)
    return out if begin is None else out + np.repeat(np.asarray(begin, dtype=np.int64), counts)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values, by doubling."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def multikey_order(count: int, word, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of `count` strings, one machine word of each at a time.

    word(d, index) gives the d-th word of the strings in index.  At each depth only
    strings that are still tied are sorted again, by their next word; the parts that
    compare less and greater are done.  Stable: equal strings keep their order.
    Returns the order, and whether each place begins a group of equal strings.
    """
    order = np.arange(count, dtype=np.int64)
    first = np.zeros(count, dtype=bool)
    if count:
        first[0] = True
    active = order.copy() if count > 1 else order[:0]
    for d in range(depth):
        if not len(active):
            break
        group = np.cumsum(first)[active]
        value = word(d, order[active])
        by = np.lexsort((value, group))
        order[active] = order[active][by]
        value = value[by]
        new = np.ones(len(active), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        first[active] |= new
        nxt = np.ones(count + 1, dtype=bool)
        nxt[:count] = first
        active = active[~(first[active] & nxt[active + 1])]
    return order, first
