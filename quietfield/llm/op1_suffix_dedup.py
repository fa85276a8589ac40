"""Suffix-array deduplication: cut out long byte strings that occur earlier in the corpus.

Sorting every suffix moves a corpus a hundred times over, so the array holds the suffixes
that begin at anchors (see repeats): equal windows of L bytes have the same anchor at the
same offset, hence show as neighbours about it.  A suffix is cut where the windows about
its anchor end, and carries the bytes before the anchor that they begin with.

1. Anchors that occur once are dropped: their hashes meet, a record of 40 bytes each.
2. The texts of the others make their suffixes.  Within a task suffixes of equal bytes
   are settled: the first goes on for all.
3. Splitters from a sample part the order of the suffixes into buckets of about
   BUCKET_BYTES.  The order is that of the bytes from the anchor on, then of those before it
   backwards, so a splitter can part any two suffixes that differ.
4. A bucket is sorted by multikey quicksort.  Equal suffixes settle; suffixes that share the
   anchor but differ give their windows, which are sorted in turn; the first of equal
   windows stays.
5. Anchors that a splitter falls into lie on both sides of a boundary.  What is first in
   its bucket of their windows is compared across: sorted anew over all buckets, by
   range of the whole window.

Bytes are compared wherever something is removed; hashes only find what to compare.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .repeats import LIMITS, NULL_ID, Limits, by_doc, byte_symbols, cover_lists, covered, dealt, gather, keyed, pieces, settle, small
from .runtime import in_few_files, table

LENGTH = 100
ANCHOR = 32
BUCKET_BYTES = 16 << 20  # suffix bytes of a bucket, on average
SLICE = 1 << 18  # windows sorted at once
MAX_BUCKETS = 1 << 16  # bounds the splitters: 16 MB at most are sent to the tasks
SAMPLE = 32  # suffixes sampled for each bucket
BLOCK_BYTES = 12 << 20  # suffix bytes settled at once before they leave a task

RUN = "doc long, sig long, pos long, width int"


def _anchors(L: int, K: int, limits: Limits):
    """A record per stretch.  The first of each anchor in a block is dealt by the anchor, the others evenly: they are known to repeat."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            h, doc, sig, pos, meta = (np.concatenate(x) for x in zip(*held, strict=True))
            order, new, _ = settle([h], doc, sig, pos, True)
            h, doc, sig, pos, meta = (x[order] for x in (h, doc, sig, pos, meta))
            once = np.append(new[1:], True) & new
            even = k.mix((doc ^ sig).astype(k.U64) + (pos.astype(k.U64) << k.U64(32)))
            route = np.where(new, h, even)
            flag = meta | ((~once).astype(np.int32) << 24)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (route.view(np.int64), h.view(np.int64), doc, sig, pos.astype(np.int32), flag)], names=["k", "h", "doc", "sig", "pos", "meta"])

        for doc, sig, begin, width, off, h, _ in pieces(byte_symbols, L, K, limits, batches):
            held.append((h, doc, sig, begin, (width * 256 + off).astype(np.int32)))
            if sum(len(x[0]) for x in held) >= limits.block:
                yield from flush()
                held = []
        if held:
            yield from flush()

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records whose anchor occurs more than once."""
    t = gather(batches)
    if t is None:
        return
    order = np.argsort(t["h"].to_numpy(), kind="stable")
    h = t["h"].to_numpy()[order]
    new = np.append(True, h[1:] != h[:-1])
    alone = new & np.append(new[1:], True)
    meta = t["meta"].to_numpy()[order]
    rows = order[~alone | (meta >> 24 == 1)]
    meta = t["meta"].to_numpy()[rows] & 0xFFFFFF
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t["doc"].to_numpy()[rows], t["sig"].to_numpy()[rows], t["pos"].to_numpy()[rows], meta)], names=["doc", "sig", "pos", "meta"])


class Suffixes:
    """Anchored suffixes over a buffer: [begin, end) of each, and its anchor; in order of the bytes from the anchor on, then backwards before it."""

    FRONT = 264  # no suffix has more bytes before its anchor

    def __init__(self, raw: np.ndarray, begin: np.ndarray, anchor: np.ndarray, end: np.ndarray, L: int):
        self.forward = k.unaligned(raw, ">u8", self.FRONT)
        self.backward = self.forward.view("<u8")  # of the same bytes
        self.begin, self.anchor, self.end = begin + self.FRONT, anchor + self.FRONT, end + self.FRONT
        after, before = int((end - anchor).max(initial=0)), int((anchor - begin).max(initial=0))
        self.right, self.left = -(-after // 8), -(-before // 8)
        self.depth = self.right + 1 + self.left

    def word(self, d: int, i: np.ndarray) -> np.ndarray:
        if d < self.right:
            at = self.anchor[i] + 8 * d
            return self.forward[np.minimum(at, len(self.forward) - 1)] & k.KEEP_HIGH[np.clip(self.end[i] - at, 0, 8)]
        if d == self.right:  # the lengths, so that padding is told from zero bytes
            return ((self.end[i] - self.anchor[i]) << 32 | (self.anchor[i] - self.begin[i])).astype(k.U64)
        at = self.anchor[i] - 8 * (d - self.right - 1)
        return self.backward[np.maximum(at - 8, 0)] & k.KEEP_HIGH[np.clip(at - self.begin[i], 0, 8)]

    def keys(self, i: np.ndarray, right: int, left: int) -> np.ndarray:
        """Byte strings that compare as the suffixes do, for widths that all tasks share."""
        out = np.zeros((len(i), right + 1 + left), ">u8")
        for d in range(min(right, self.right)):
            out[:, d] = self.word(d, i)
        out[:, right] = self.word(self.right, i)
        for d in range(min(left, self.left)):
            out[:, right + 1 + d] = self.word(self.right + 1 + d, i)
        return out.view(f"S{out.shape[1] * 8}").ravel()


def _widths(L: int, K: int) -> tuple[int, int]:
    """Words of eight bytes from the anchor on, and before it, that a suffix may have."""
    return -(-(2 * L - K) // 8), -(-(L - K) // 8)


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes [a, a + size) and [b, b + size) agree."""
    eight, same = k.unaligned(raw, "<u8"), np.ones(len(a), dtype=bool)
    for d in range(0, int(size.max(initial=0)), 8):
        keep = k.KEEP_LOW[np.clip(size - d, 0, 8)]
        at = np.minimum(d, size)
        same &= (eight[a + at] & keep) == (eight[b + at] & keep)
    return same


def _bodies(L: int, K: int, splitters, sampled: bool):
    """Rows (doc, text, places, sig) to suffixes; sampled: to their keys only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, left = _widths(L, K)
        parts = None if sampled else splitters.value
        for batch in batches:
            raw, offsets = k.text_buffers(batch.column(1))
            places = batch.column(2)
            ends, flat = places.offsets.to_numpy(), places.flatten()
            ids, sigs = (batch.column(c).to_numpy() for c in (0, 3))
            pos_all, meta_all = flat.field("pos").to_numpy().astype(np.int64), flat.field("meta").to_numpy()
            ends = ends - ends[0]
            rows = np.repeat(np.arange(len(ids)), np.diff(ends))
            step = max(1, BLOCK_BYTES // (2 * L))
            for s in range(0, len(rows), step):
                row, pos, meta = rows[s : s + step], pos_all[s : s + step], meta_all[s : s + step]
                width, off = (meta >> 8).astype(np.int64), (meta & 255).astype(np.int64)
                low, high = int(offsets[row[0]]), int(offsets[row[-1] + 1])
                part = raw[low:high]
                begin = offsets[row] - low + pos
                size = width + L - 1
                if sampled:
                    some = Suffixes(part, begin, begin + off, begin + size, L)
                    keys = some.keys(np.arange(len(begin)), right, left)
                    ends_at = np.arange(len(keys) + 1, dtype=np.int32) * keys.itemsize
                    yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends_at), pa.py_buffer(keys)])], names=["key"])
                    continue
                doc, sig = ids[row], sigs[row]
                order, new, later = settle([k.word_hashes(part, begin, begin + size), off * 65536 + width], doc, sig, pos, True)
                lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
                same = _equal(part, begin[order], begin[lead], size[order])
                again, on = order[later & same], order[new | ~same]
                some = Suffixes(part, begin[on], begin[on] + off[on], begin[on] + size[on], L)
                go = np.concatenate([again, on])
                where = np.concatenate([k.mix((doc ^ sig).astype(k.U64)[again] + pos.astype(k.U64)[again]) % k.U64(len(parts) + 1), _part(some, parts, right, left)]).astype(np.int32)
                body = np.zeros(len(go) + 1, np.int32)
                body[len(again) + 1 :] = np.cumsum(size[on])
                data = part[k.spread(size[on], begin[on])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where), pa.array(doc[go]), pa.array(sig[go]), pa.array(pos[go].astype(np.int32)), pa.array(meta[go]), pa.Array.from_buffers(pa.binary(), len(go), [None, pa.py_buffer(body), pa.py_buffer(data)])],
                    names=["part", "doc", "sig", "pos", "meta", "body"],
                )

    return run


def _part(some: Suffixes, parts: np.ndarray, right: int, left: int) -> np.ndarray:
    """The bucket of each suffix: by the first eight bytes, by all where a splitter begins with them."""
    i = np.arange(len(some.begin))
    if not len(parts) or not len(i):
        return np.zeros(len(i), np.int64)
    heads = parts.view(">u8").reshape(len(parts), -1)[:, 0].astype(k.U64)
    word = some.word(0, i)
    out = np.searchsorted(heads, word, side="right")
    close = np.flatnonzero((out > 0) & (heads[np.maximum(out, 1) - 1] == word))
    if len(close):
        out[close] = np.searchsorted(parts, some.keys(close, right, left), side="right")
    return out


def _bucket(L: int, K: int, splitters):
    """Sorts the suffixes of a bucket; returns runs of repeated windows, and the windows to compare across its boundaries with their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gather(batches)
        if t is None:
            return
        t = t.combine_chunks()
        doc, sig, pos, meta = (t[c].to_numpy() for c in ("doc", "sig", "pos", "meta"))
        pos, width, off = pos.astype(np.int64), (meta >> 8).astype(np.int64), (meta & 255).astype(np.int64)
        raw, offsets = k.text_buffers(t["body"])
        del t
        done = np.diff(offsets) == 0
        yield _runs(doc[done], sig[done], pos[done], width[done])
        rows = np.flatnonzero(~done)
        rows = rows[np.lexsort((pos[rows], sig[rows], doc[rows]))]
        doc, sig, pos, width, off, begin = (x[rows] for x in (doc, sig, pos, width, off, offsets[:-1]))
        if not len(rows):
            return
        some = Suffixes(raw, begin, begin + off, begin + width + L - 1, L)
        del raw  # the suffixes hold a copy, and no more than one is kept
        begin = some.begin
        order, first = k.multikey_order(len(rows), some.word, some.depth)
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        d, g, p = doc[order], sig[order], pos[order]
        again = (d > d[lead]) | (g != g[lead]) | (p > p[lead])
        yield _runs(d[again], g[again], p[again], width[order][again])
        # suffixes that differ but share the anchor's K bytes
        order = order[first]
        new = np.zeros(len(order), dtype=bool)
        new[0] = True
        for x in range(0, K, 8):
            keep = k.KEEP_HIGH[min(8, K - x)]
            w = some.word(x // 8, order) & keep
            new[1:] |= w[1:] != w[:-1]
        group = np.cumsum(new) - 1
        across = _split_anchors(some, order[new], splitters.value, K)[group]
        rim = np.flatnonzero((np.bincount(group)[group] > 1) | across)
        if not len(rim):
            return
        own, group, across = order[rim], group[rim], across[rim]
        for s in _slices(group, width[own]):
            # rows are in order of document and place, so windows of ascending rows are too
            rank = np.argsort(own[s], kind="stable")
            row, which, edge = own[s][rank], group[s][rank], across[s][rank]
            at = k.spread(width[row], begin[row])
            item = np.repeat(np.arange(len(row)), width[row])
            p = k.spread(width[row], pos[row])
            shift = (off[row] + begin[row])[item] - at
            d, g = doc[row][item], sig[row][item]
            again, by, first = _windows(some.forward, at, [(which[item] * 256 + shift).astype(k.U64)], L, d, g, p)
            yield _merged(d, g, p, again)
            o = by[first]
            o = o[edge[item[o]]]
            if len(o):
                yield _runs(d[o], g[o], p[o], np.ones(len(o), np.int64), _cut(some.forward, at[o], L))

    return run


def _slices(group: np.ndarray, width: np.ndarray) -> Iterator[slice]:
    """Ranges of rows of about SLICE windows that part no group."""
    total = np.cumsum(width)
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
    start = done = 0
    while start < len(group):
        past = int(np.searchsorted(total[ends - 1], done + SLICE, side="right"))
        stop = int(ends[max(past - 1, int(np.searchsorted(ends, start, side="right")))])
        yield slice(start, stop)
        start, done = stop, int(total[stop - 1])


def _split_anchors(some: Suffixes, heads: np.ndarray, parts: np.ndarray, K: int) -> np.ndarray:
    """Which anchors (one suffix each in heads) some splitter begins with."""
    out = np.zeros(len(heads), dtype=bool)
    if len(parts):
        wide = parts.view(">u8").reshape(len(parts), -1)
        at = np.flatnonzero(np.isin(some.word(0, heads), wide[:, 0].astype(k.U64)))
        n = -(-K // 8)
        last = k.KEEP_HIGH[K - 8 * (n - 1)]
        cut = {tuple(int(v) for v in (*r[: n - 1], r[n - 1] & last)) for r in wide[:, :n].astype(k.U64)}
        words = [some.word(d, heads[at]) & (last if d == n - 1 else k.KEEP_HIGH[8]) for d in range(n)]
        out[at] = [x in cut for x in zip(*(w.tolist() for w in words), strict=True)]
    return out


def _cut(eight: np.ndarray, at: np.ndarray, L: int) -> pa.Array:
    """The L bytes from each place of `at` on; eight: a view of the bytes, eight from each place."""
    words = np.zeros((len(at), -(-L // 8)), eight.dtype)
    for x in range(words.shape[1]):
        words[:, x] = eight[at + 8 * x]
    data = np.ascontiguousarray(words.view(np.uint8).reshape(len(at), -1)[:, :L]).ravel()
    ends = np.arange(len(at) + 1, dtype=np.int32) * L
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _windows(eight: np.ndarray, at: np.ndarray, lead: list[np.ndarray], L: int, d: np.ndarray, g: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of L bytes from `at` on come later than an equal one, their order, and the first of each group in it.

    eight: a view of the bytes, eight from each place.  Rows are in order of document and place.  Windows that differ in a
    word of lead are not compared.
    """
    n = -(-L // 8)
    last = k.KEEP_HIGH[L - 8 * (n - 1)]

    def word(x: int, i: np.ndarray) -> np.ndarray:
        if x < len(lead):
            return lead[x][i]
        x -= len(lead)
        w = eight[at[i] + 8 * x]
        return w & last if x == n - 1 else w

    by, first = k.multikey_order(len(at), word, n + len(lead))
    head = by[np.flatnonzero(first)[np.cumsum(first) - 1]]
    again = np.zeros(len(at), dtype=bool)
    again[by] = (d[by] > d[head]) | (g[by] != g[head]) | (p[by] > p[head])
    return again, by, first


def _runs(doc, sig, pos, width, key: pa.Array | None = None) -> pa.RecordBatch:
    key = pa.nulls(len(doc), pa.binary()) if key is None else key
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(sig), pa.array(pos.astype(np.int64)), pa.array(width.astype(np.int32)), key], names=["doc", "sig", "pos", "width", "key"])


def _merged(d: np.ndarray, g: np.ndarray, p: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
    """Marked windows, in order of document and place, as runs."""
    d, g, p = d[again], g[again], p[again]
    new = np.append(True, (d[1:] != d[:-1]) | (g[1:] != g[:-1]) | (p[1:] > p[:-1] + 1)) if len(d) else again[:0]
    b = np.flatnonzero(new)
    last = np.append(b[1:], len(d))[: len(b)] - 1
    return _runs(d[b], g[b], p[b], p[last] - p[b] + 1)


def _across(L: int):
    """A range of windows from all buckets: those later than an equal one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gather(batches)
        if t is None:
            return
        t = t.combine_chunks()
        d, g, p = (t[c].to_numpy() for c in ("doc", "sig", "pos"))
        raw, offsets = k.text_buffers(t["key"])
        rank = np.lexsort((p, g, d))
        d, g, p, at = (x[rank] for x in (d, g, p, offsets[:-1]))
        again, _, _ = _windows(k.unaligned(raw, ">u8"), at, [], L, d, g, p)
        yield _merged(d, g, p, again).select(["doc", "sig", "pos", "width"])

    return run


def repeated_windows(docs: DataFrame, L: int = LENGTH, K: int = ANCHOR, limits: Limits = LIMITS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Windows of L bytes of docs(doc, text, sig) that also start earlier, as runs (doc, sig, pos, width): starts pos .. pos+width-1."""
    assert 0 < K <= L and L - K < 255
    spark = docs.sparkSession
    rec = docs.select("doc", "text", "sig").mapInArrow(_anchors(L, K, limits), "k long, h long, doc long, sig long, pos int, meta int")
    met = dealt(rec, docs, limits.part_bytes, "k").mapInArrow(_repeated, "doc long, sig long, pos int, meta int")
    met = table(in_few_files(met, int(spark.conf.get("spark.sql.shuffle.partitions"))), "anchors", tidy=True)
    count = met.count()
    buckets = min(MAX_BUCKETS, max(1, math.ceil(count * (2 * L - K) * 0.8 / bucket_bytes)))
    places = lambda rows: rows.groupBy("doc", "sig").agg(F.collect_list(F.struct("pos", "meta")).alias("places"))
    parts = np.zeros(0, "S8")
    if buckets > 1:
        share = max(1, count // (SAMPLE * buckets))
        some = F.pmod(F.xxhash64("pos", "sig", "doc"), F.lit(share)) == 0  # single suffixes: those of one document are alike, and documents may be few
        keys = docs.join(F.broadcast(places(met.where(some))), ["doc", "sig"]).select("doc", "text", "places", "sig").mapInArrow(_bodies(L, K, None, True), "key binary")
        lows = table(keys, "sample", tidy=True).repartitionByRange(buckets, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("key"))
        right, left = _widths(L, K)
        size = (right + 1 + left) * 8
        found = sorted({bytes(r["key"]) for r in lows.collect()})[1:]  # a row a bucket
        parts = np.frombuffer(b"".join(found), dtype=f"S{size}") if found else parts
    splitters = spark.sparkContext.broadcast(parts)
    body = by_doc(docs).join(places(met).hint("shuffle_hash"), ["doc", "sig"]).select("doc", "text", "places", "sig")
    body = body.mapInArrow(_bodies(L, K, splitters, False), "part int, doc long, sig long, pos int, meta int, body binary")
    found = body.repartitionById(len(parts) + 1, F.col("part")).drop("part").mapInArrow(_bucket(L, K, splitters), RUN + ", key binary")
    found = table(in_few_files(found, len(parts) + 1), "suffixes", tidy=True)
    edge = found.where("key is not null")
    ranges = max(1, math.ceil(edge.count() * L / bucket_bytes))  # by volume: what is sized by shuffled bytes is a multiple of that, since windows overlap and compress well
    edge = edge.repartitionByRange(ranges, "key").mapInArrow(_across(L), RUN)
    return found.where("key is null").drop("key").union(edge)


def _digest(L: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            raw, offsets = k.text_buffers(batch.column(1))
            sizes = np.diff(offsets)
            gone = cover_lists(batch.column(2), offsets, L, sizes)
            b, e = k.runs(gone, offsets)
            owner = np.searchsorted(offsets, b, side="right") - 1
            removed = np.bincount(owner, weights=e - b, minlength=len(sizes)).astype(np.int64)
            spans = np.bincount(owner, minlength=len(sizes)).astype(np.int64)
            kept = raw[~gone].tobytes()
            ends = np.concatenate([[0], np.cumsum(sizes - removed)])
            texts = [kept[ends[i] : ends[i + 1]] for i in range(len(sizes))]
            ids = batch.column(0).to_numpy()
            arrays = [pa.array(ids, mask=ids == NULL_ID), pa.array(sizes), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(texts, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, limits: Limits = LIMITS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per document: bytes, bytes removed, runs removed, hash of (and with_text, also) the bytes kept.

    A byte goes if a string of `length` bytes that covers it also starts earlier: in
    a document of smaller id, or earlier in the same document.  A null or empty text
    has no bytes.  A null id counts as the largest.  Rows that repeat an id and text
    count as one document and each get its result; documents that share an id, or have
    none, but not their text are in a fixed order.  An empty table gives no rows.
    A very long text is handled in pieces, whole.  Columns other than id and text are not
    looked at.
    """
    base = keyed(docs, id_col, text_col)
    windows = repeated_windows(base, length, min(ANCHOR, length), limits, bucket_bytes)
    extra = ", kept binary" if with_text else ""
    return covered(base, windows).mapInArrow(_digest(length, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + extra)


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
bytes AS (SELECT doc_id, p, b[p:p] AS byte, CASE WHEN p <= octet_length(b) - 99 THEN b[p:p + 99] END AS g FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) + 1)) AS p FROM docs)),
marks AS (SELECT doc_id, p, byte, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1 AS again FROM bytes),
gone AS (SELECT doc_id, p, byte, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM marks),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM gone),
cut AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
         coalesce(string_agg(hex(byte), '' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM edges GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(from_hex(coalesce(kept, ''))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)
"""
