"""N-gram Jaccard join: linked groups of documents by exact similarity of word shingles.

Two documents that link share one of the first |x| - ceil(0.75 |x|) + 1 shingles of
either set in any fixed global order (prefix filter).  The order here is by hash,
with shingles that a bounded sample shows to be frequent put last.

1. One pass over the texts leaves, per document, the set size, a 128-bit set
   signature, a bitmap signature (parity of hashed positions) and the prefix.
   Equal sets are one class; one document of each, its head, goes on.
2. Prefix shingles meet; a shingle of one document only is dropped, the others give
   (smallest document, document).  All documents next to one such *pivot* form a
   group: any two documents that share a prefix shingle share its pivot's group.  A
   pair belongs to the smallest pivot that both have; their other groups skip it.
3. In a large group every member is first compared exactly with the group's leader (of
   the most frequent size band).  Members that link with it are settled: pairs of them
   are known to be connected.  A family of near copies is thus done in linear work.
4. Groups are cut into tiles by size band (a band and the one below it) and, when
   large, into tiles of unsettled members by all members.  In a tile the bit counts of two bitmaps bound
   the symmetric difference from below, so the overlap from above; documents
   without any possible partner leave.
5. The sets of what is left are fetched and intersected exactly, skipping pairs that
   are already connected.  Each merger of two parts gives one edge, so a group of n
   documents gives at most n-1, whatever its number of links.
6. Connected components over the edges, each named by its smallest document.

Inside, a document is a node: a 64-bit hash of id and text.  Rows share one only if both
are equal, so rows without an id, or of one id with other texts, stay apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .repeats import NULL_ID
from .runtime import components, lookup, table

SHINGLE = 5
TILE = 1024
LEAD = 256  # members of a group from which on they are first compared with its leader
BAND = 1.34  # a little over 4/3: documents that link are at most one band apart
SAMPLE_DOCS = 8192  # documents looked at for frequent shingles
FREQUENT = 3  # of those, to count as frequent
MAX_FREQUENT = 1 << 18
OWNERS = 16  # pivots of a document that its rows carry
LIST = 4096  # documents in one list of a pivot
TOKEN_ROWS = 2_500_000  # prefix shingles that one task sorts: 40 MB
SENT_IDS = 4_000_000  # ids of documents with a possible partner that may be sent to every task: 32 MB
TOKEN_BITS, DOC_BITS = 52, 12
TOKEN_MASK = np.uint64((1 << 51) - 1)
HOT_BIT = np.uint64(1 << 51)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, hot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document of a chunk, ascending, and the n+1 bounds.

    A shingle is a 51-bit hash; bit 51 is set for frequent ones.
    """
    low = k.LOWER[raw]
    b, e, first = k.words(low, offsets)
    sizes = np.diff(first)
    if not len(b):
        return np.zeros(0, k.U64), np.zeros(len(sizes) + 1, np.int64)
    word = k.word_hashes(low, b, e)
    counts = np.where(sizes > 0, np.maximum(sizes - SHINGLE + 1, 1), 0)
    begin = k.spread(counts, first[:-1])
    doc = np.repeat(np.arange(len(sizes)), counts)
    tok = np.empty(len(begin), dtype=k.U64)
    size = np.minimum(sizes, SHINGLE)[doc]
    for width in range(1, SHINGLE + 1):  # documents of fewer words have one shingle of all of them
        own = np.flatnonzero(size == width)
        tok[own] = k.joined(word, begin[own], width) & TOKEN_MASK
    if hot is not None and len(hot):
        lut = np.zeros(1 << 20, dtype=bool)
        lut[hot & np.uint64(0xFFFFF)] = True
        maybe = np.flatnonzero(lut[tok & np.uint64(0xFFFFF)])
        at = np.minimum(np.searchsorted(hot, tok[maybe]), len(hot) - 1)
        tok[maybe[hot[at] == tok[maybe]]] |= HOT_BIT
    tok |= doc.astype(k.U64) << np.uint64(TOKEN_BITS)
    tok.sort()
    new = np.ones(len(tok), dtype=bool)
    new[1:] = tok[1:] != tok[:-1]
    tok = tok[new]
    bounds = np.searchsorted(tok, np.arange(len(sizes) + 1, dtype=k.U64) << np.uint64(TOKEN_BITS))
    bounds[-1] = len(tok)
    return tok & np.uint64((1 << TOKEN_BITS) - 1), bounds


def small_chunks(offsets: np.ndarray):
    """doc_chunks of at most 2**DOC_BITS - 1 documents."""
    most = (1 << DOC_BITS) - 1
    for i, j in k.doc_chunks(offsets):
        for a in range(i, j, most):
            yield a, min(a + most, j)


def bitmap_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the signature of a set of n shingles: a power of two, about 2 n, from 256 to 65,536."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(2 * n, 2))).astype(np.int64), 256, 65536)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    off = np.zeros(len(ends) + 1, np.int32)
    off[1:] = ends
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def _features(hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            raw, offsets = k.text_buffers(batch.column(1))
            for i, j in small_chunks(offsets):
                tok, bounds = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hot)
                n = np.diff(bounds)
                doc = np.repeat(np.arange(j - i), n)
                sums = []
                for salt in (0x1234567, 0x89ABCDEF01):
                    total = np.concatenate([[k.U64(0)], np.cumsum(k.mix(tok ^ k.U64(salt)))])
                    sums.append(total[bounds[1:]] - total[bounds[:-1]])
                bits = bitmap_bits(n)
                base = np.cumsum(bits) - bits
                pos = base[doc] + (k.mix(tok) & (bits[doc] - 1).astype(k.U64)).astype(np.int64)
                parity = (np.bincount(pos, minlength=int(bits.sum())) & 1).astype(np.uint8)
                send = np.zeros(j - i, dtype=bool)
                for x, key in enumerate(zip(sums[0].tolist(), sums[1].tolist(), strict=True)):
                    if n[x] and key not in seen:
                        send[x] = True
                        seen.add(key)
                if len(seen) > 1 << 20:
                    seen.clear()
                lens = np.where(send, n - (3 * n + 3) // 4 + 1, 0)
                head = tok[k.spread(lens, bounds[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j]), batch.column(2).slice(i, j - i), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), _binary(np.packbits(parity, bitorder="little"), np.cumsum(bits // 8)), _binary(head, np.cumsum(lens) * 8)],
                    names=["doc", "id", "n", "s1", "s2", "bits", "head"],
                )

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = k.text_buffers(batch.column(1))
        if len(raw):
            yield pa.RecordBatch.from_arrays([pa.array(raw.view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), np.diff(offsets) // 8))], names=["tok", "doc"])


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    tok, doc = t["tok"].to_numpy(), t["doc"].to_numpy()
    order = np.lexsort((doc, tok))
    tok, doc = tok[order], doc[order]
    new = np.ones(len(tok), dtype=bool)
    new[1:] = tok[1:] != tok[:-1]
    start = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    shared = doc[np.append(start[1:], len(tok)) - 1] > doc[start]
    keep = shared[which]
    p, doc = doc[start][which][keep], doc[keep]
    order = np.lexsort((doc, p))
    p, doc = p[order], doc[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])
    p, doc = p[new], doc[new]
    if not len(p):
        return
    # one list of documents a pivot; a long list is cut by hash, so that no pivot's lists meet in one task
    start = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    many = np.repeat(np.diff(np.append(start, len(p))) > LIST, np.diff(np.append(start, len(p))))
    salt = np.where(many, 1 + (k.mix(doc.astype(k.U64)) % k.U64(64)).astype(np.int32), 0).astype(np.int32)
    order = np.lexsort((doc, salt, p))
    p, salt, doc = p[order], salt[order], doc[order]
    start = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (salt[1:] != salt[:-1])))
    yield pa.RecordBatch.from_arrays([pa.array(p[start]), pa.array(salt[start]), _binary(doc, np.append(start[1:], len(p)) * 8)], names=["p", "salt", "docs"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of a pivot from several tasks as rows (pivot, document), once each."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    raw, offsets = k.text_buffers(t["docs"])
    doc, p = raw.view(np.int64), np.repeat(t["p"].to_numpy(), np.diff(offsets) // 8)
    order = np.lexsort((doc, p))
    p, doc = p[order], doc[order]
    new = np.append(True, (p[1:] != p[:-1]) | (doc[1:] != doc[:-1]))
    yield pa.RecordBatch.from_arrays([pa.array(p[new]), pa.array(doc[new])], names=["p", "doc"])


def _by_key(batches: Iterator[pa.RecordBatch]):
    """The rows of a partition, and the ranges of their tiles (p, g, i, j)."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    keys = [t[c].to_numpy() for c in ("p", "g", "i", "j")]
    order = np.lexsort((t["doc"].to_numpy(), *keys[::-1]))
    keys = [x[order] for x in keys]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
    b = np.flatnonzero(new)
    yield t, order, b, np.append(b[1:], len(order))


LEFT, RIGHT, BOTH = 0, 1, 2


def _allowed(a, b, n, doc, side, below, settled):
    """Whether documents a (one) and b (many) of a tile are to be compared in it.

    A group of one tile has each document once (BOTH).  In others an unsettled document
    stands LEFT, any RIGHT; a pair of unsettled ones counts where the smaller is LEFT.
    """
    ok = (4 * np.minimum(n[a], n[b]) >= 3 * np.maximum(n[a], n[b])) & ~(below[a] & below[b]) & ~(settled[a] & settled[b])
    if side[a] == BOTH:
        return ok
    first = doc[a] < doc[b] if side[a] == LEFT else doc[b] < doc[a]
    other = settled[b] if side[a] == LEFT else settled[a]
    return ok & (side[a] != side[b]) & (doc[a] != doc[b]) & (first | other)


def _owned(a, b, p, flat, off):
    """Of the partners b of document a in the group of pivot p, those that share no smaller pivot with a."""
    own = flat[off[a] : off[a + 1]]
    own = own[own < p]
    if not len(own) or not len(b):
        return b
    n = off[b + 1] - off[b]
    hit = np.isin(flat[k.spread(n, off[b])], own)
    return b[~np.logical_or.reduceat(hit, np.cumsum(n) - n)]


def _pivot_lists(t: pa.Table, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pivots of the rows in the given order, joined, and the n+1 bounds; no list is empty."""
    heads = t["head"].chunk(0)
    off = heads.offsets.to_numpy().astype(np.int64)
    n = np.diff(off)[order]
    return heads.values.to_numpy()[k.spread(n, off[:-1][order])], np.concatenate([[0], np.cumsum(n)])


def _fold(rows: list[bytes]) -> np.ndarray:
    """Bitmaps of one length: longer ones are folded onto half by exclusive or."""
    least = min(map(len, rows))
    out = np.empty((len(rows), least // 8), dtype=k.U64)
    for x, r in enumerate(rows):
        v = np.frombuffer(r, dtype=k.U64)
        while len(v) > out.shape[1]:
            v = v[: len(v) // 2] ^ v[len(v) // 2 :]
        out[x] = v
    return out


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, order, starts, ends in _by_key(batches):
        cols = [t[c].to_numpy(zero_copy_only=False)[order] for c in ("n", "doc", "side", "below", "settled")]
        bits = t["bits"].chunk(0)
        flat, cuts = _pivot_lists(t, order)
        p_all = t["p"].to_numpy()[order]
        stay = np.zeros(len(order), dtype=bool)
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s < 2:
                continue
            own = [x[s:e] for x in cols]
            n = own[0]
            sig = _fold([bits[int(x)].as_py() for x in order[s:e]])
            for a in range(e - s - 1):
                b = np.arange(a + 1, e - s)
                b = b[_allowed(a, b, *own)]
                if stay[s + a]:  # it stays: only partners that are not yet known to stay matter
                    b = b[~stay[s + b]]
                if len(b):
                    apart = np.bitwise_count(sig[b] ^ sig[a]).sum(axis=1, dtype=np.int64)
                    b = _owned(s + a, s + b[7 * apart <= n[a] + n[b]], p_all[s], flat, cuts)
                    if len(b):
                        stay[s + a] = True
                        stay[b] = True
        if stay.any():
            yield from t.select(["p", "g", "i", "j", "side", "below", "settled", "doc", "head"]).take(pa.array(order[stay])).to_batches()


def _sets(hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = k.text_buffers(batch.column(1))
            places = batch.column(2)
            ends, flat, ids = places.offsets.to_numpy(), places.flatten(), batch.column(0).to_numpy()
            for i, j in small_chunks(offsets):
                tok, bounds = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hot)
                times = np.diff(ends[i : j + 1])
                row = np.repeat(np.arange(j - i), times)
                part = flat.slice(ends[i] - ends[0], int(times.sum()))
                lens = np.diff(bounds)[row]
                body = tok[k.spread(lens, bounds[:-1][row])]
                names = ["p", "g", "i", "j", "side", "below", "settled", "head"]
                yield pa.RecordBatch.from_arrays([*(part.field(c) for c in names), pa.array(ids[i:j][row]), _binary(body, np.cumsum(lens) * 8)], names=[*names, "doc", "body"])

    return run


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, order, starts, ends in _by_key(batches):
        cols = [t[c].to_numpy(zero_copy_only=False)[order] for c in ("doc", "side", "below", "settled")]
        raw, off = k.text_buffers(t["body"])
        toks, off = raw.view(k.U64), off // 8
        flat, heads = _pivot_lists(t, order)
        p_all = t["p"].to_numpy()[order]
        left, right = [], []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s < 2:
                continue
            rows = order[s:e]
            n = off[rows + 1] - off[rows]
            cuts = np.concatenate([[0], np.cumsum(n)])
            if not cuts[-1]:
                continue
            rank = np.unique(toks[k.spread(n, off[rows])], return_inverse=True)[1]
            doc, side, below, settled = (x[s:e] for x in cols)
            part = np.where(settled, np.argmax(settled), np.arange(e - s))
            mine = np.zeros(int(rank.max()) + 1, dtype=np.int64)
            for a in range(e - s - 1):
                b = np.arange(a + 1, e - s)
                b = b[(part[b] != part[a]) & (n[b] > 0)]
                b = b[_allowed(a, b, n, doc, side, below, settled)]
                b = _owned(s + a, s + b, p_all[s], flat, heads) - s
                if not len(b) or not n[a]:
                    continue
                own = rank[cuts[a] : cuts[a + 1]]
                mine[own] = 1
                both = np.add.reduceat(mine[rank[k.spread(n[b], cuts[:-1][b])]], np.concatenate([[0], np.cumsum(n[b])[:-1]]))
                mine[own] = 0
                hit = b[7 * both >= 3 * (n[a] + n[b])]
                if len(hit):
                    joined, one = np.unique(part[hit], return_index=True)
                    left += [doc[a]] * len(one)
                    right += doc[hit[one]].tolist()
                    low = min(int(joined[0]), int(part[a]))
                    part[np.isin(part, np.append(joined, part[a]))] = low
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(left, np.int64)), pa.array(np.array(right, np.int64))], names=["a", "b"])


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (RIGHT) of a tile that link with its leader (LEFT), as (p, leader, doc), the leader itself included."""
    for t, order, starts, ends in _by_key(batches):
        side, doc, p = (t[c].to_numpy()[order] for c in ("side", "doc", "p"))
        raw, off = k.text_buffers(t["body"])
        toks, off = raw.view(k.U64), off // 8
        out = []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            first = np.flatnonzero(side[s:e] == LEFT)
            if not len(first):
                continue
            a = order[s + first[0]]
            own = toks[off[a] : off[a + 1]]  # ascending
            at = np.arange(s, e)
            rows = order[s:e]
            n = off[rows + 1] - off[rows]
            some = toks[k.spread(n, off[rows])]
            hit = own[np.minimum(np.searchsorted(own, some), len(own) - 1)] == some
            total = np.concatenate([[0], np.cumsum(hit)])
            both = np.diff(total[np.concatenate([[0], np.cumsum(n)])])
            at = at[7 * both >= 3 * (n + len(own))]
            out.append((p[at], np.full(len(at), doc[s + first[0]]), doc[at]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["p", "lead", "doc"])


KEY = "p long, g int, i int, j int, side int, below boolean, settled boolean, head array<long>"


def _with_sets(base: DataFrame, rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """rows (KEY, doc), each with the shingles of its document as `body`.

    While the ids are few enough they are sent to the texts, so that other texts do not move.
    """
    place = rows.groupBy("doc").agg(F.collect_list(F.struct("p", "g", "i", "j", "side", "below", "settled", "head")).alias("places"))
    ids = rows.select("doc").distinct()
    texts = base.join(F.broadcast(ids), "doc", "left_semi") if rows.count() <= SENT_IDS else base
    return texts.join(place, "doc").select("doc", "text", "places").mapInArrow(_sets(hot), KEY + ", doc long, body binary")


def _settle_led(base: DataFrame, put: DataFrame, hot: np.ndarray) -> tuple[DataFrame, DataFrame | None]:
    """put(p, doc, n, band, head) with `settled`, and the edges from leaders of large groups to members that link with them."""
    bands = put.groupBy("p", "band").agg(F.count("*").alias("c"), F.min(F.struct("doc", "n")).alias("low"))
    large = bands.groupBy("p").agg(F.sum("c").alias("c"), F.max_by("low", F.struct("c", "band")).alias("low")).where(F.col("c") > LEAD)
    large = table(large.select("p", F.ceil(F.col("c") / TILE).cast("int").alias("m"), F.col("low.doc").alias("lead"), F.col("low.n").alias("lead_n")), "leaders")
    if not large.count():
        return put.withColumn("settled", F.lit(False)), None
    blank = [F.lit(0).alias("g"), F.lit(0).alias("j"), F.lit(False).alias("below"), F.lit(False).alias("settled"), F.expr("cast(array() as array<long>)").alias("head")]
    near = (4 * F.least("n", "lead_n") >= 3 * F.greatest("n", "lead_n")) & (F.col("doc") != F.col("lead"))
    members = lookup(put.select("p", "doc", "n"), large, ["p"], "inner").where(near)
    members = members.select("p", F.pmod(F.xxhash64("doc"), F.col("m")).cast("int").alias("i"), F.lit(RIGHT).alias("side"), "doc", *blank)
    leads = large.select("p", F.explode(F.expr("sequence(0, m - 1)")).alias("i"), F.lit(LEFT).alias("side"), F.col("lead").alias("doc"), *blank)
    names = ["p", "g", "i", "j", "side", "below", "settled", "head", "doc"]
    rows = table(members.select(*names).union(leads.select(*names)), "led")
    led = table(_with_sets(base, rows, hot).repartition("p", "g", "i", "j").mapInArrow(_led, "p long, lead long, doc long"), "led")
    known = led.select("p", "doc", F.lit(True).alias("settled")).distinct()
    return put.join(known, ["p", "doc"], "left").withColumn("settled", F.coalesce("settled", F.lit(False))), led.where("doc <> lead").select(F.col("lead").alias("a"), F.col("doc").alias("b"))


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles of at least FREQUENT of about SAMPLE_DOCS documents, MAX_FREQUENT at most.

    They only change the order of the prefix filter, which gives whole results under
    any order; the bound keeps what is sent to the tasks small.
    """
    total = docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc"), F.lit(max(1, total // SAMPLE_DOCS))) == 0)

    def run(batches):
        for batch in batches:
            raw, offsets = k.text_buffers(batch.column(1))
            for i, j in small_chunks(offsets):
                tok, _ = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], None)
                yield pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64))], names=["tok"])

    rows = some.mapInArrow(run, "tok long").groupBy("tok").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "tok").limit(MAX_FREQUENT).select("tok")
    return np.sort(rows.toArrow()["tok"].to_numpy().view(k.U64))


def node(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The node of a row: rows of equal id and text share it.  A null id counts as the largest."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), F.col(text_col).cast("string"))


def jaccard_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: node, id (NULL_ID for null), n (shingles), low_id and low_node (of what it reaches, the least by id, then node)."""
    base = docs.select(node(id_col, text_col).alias("doc"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"))
    hot = frequent_shingles(base)
    feat = table(base.mapInArrow(_features(hot), "doc long, id long, n long, s1 long, s2 long, bits binary, head binary"), "features")
    # as few tasks as memory allows: the fewer, the more pairs repeat within one and go out once
    tasks = math.ceil((feat.agg(F.sum(F.octet_length("head"))).first()[0] or 0) / 8 / TOKEN_ROWS) or 1
    near = feat.select("doc", "head").mapInArrow(_tokens, "tok long, doc long").repartition(tasks, "tok").mapInArrow(_pivots, "p long, salt int, docs binary")
    near = near.repartition("p", "salt").mapInArrow(_merged, "p long, doc long")
    pivots = near.groupBy("doc").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    classes = feat.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.when(F.octet_length("head") > 0, F.col("doc"))).alias("rep"), F.min(F.struct("id", F.col("doc").alias("node"))).alias("low"))
    classes = table(classes, "classes")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(BAND))).cast("int")
    one = feat.where("n > 0").join(classes.select(F.col("rep").alias("doc")), "doc", "left_semi").dropDuplicates(["doc"]).select("doc", "n", "bits", band.alias("band"))
    one = table(one, "heads")
    put = one.select("doc", "n", "band").join(pivots, "doc").select("doc", "n", "band", F.slice("ps", 1, OWNERS).alias("head"), F.explode("ps").alias("p"))
    put, led = _settle_led(base, table(put, "pivots"), hot)
    both = F.array(F.struct(F.col("band").alias("g"), F.lit(False).alias("below")), F.struct((F.col("band") + 1).alias("g"), F.lit(True).alias("below")))
    put = table(put.select("p", "doc", "n", "head", "settled", F.explode(both).alias("x")).select("p", "x.g", "x.below", "doc", "n", "head", "settled"), "members")
    count = put.groupBy("p", "g").agg(F.count("*").alias("c"), F.sum((~F.col("settled")).cast("long")).alias("u"), F.min("below").alias("lone")).where("c > 1 and u > 0 and not lone")
    put = lookup(put, count.select("p", "g", F.ceil(F.col("c") / TILE).cast("int").alias("m"), F.ceil(F.col("u") / TILE).cast("int").alias("mu")), ["p", "g"], "inner")
    # (side, i, j) of each row: once in a group of one tile, else unsettled ones by all
    place = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    mine, whose = F.pmod(F.xxhash64("doc"), F.col("m")), F.pmod(F.xxhash64("doc"), F.col("mu"))
    right = F.transform(F.expr("sequence(0, mu - 1)"), lambda i: place(RIGHT, i, mine))
    left = F.transform(F.expr("sequence(0, m - 1)"), lambda j: place(LEFT, whose, j))
    tiles = F.when(F.col("m") == 1, F.array(place(BOTH, F.lit(0), F.lit(0)))).when(F.col("settled"), right).otherwise(F.concat(right, left))
    put = put.select("p", "g", "below", "settled", "doc", "n", "head", F.explode(tiles).alias("x")).select("p", "g", "x.i", "x.j", "x.side", "below", "settled", "doc", "n", "head")
    put = put.join(one.select("doc", "bits"), "doc").repartition("p", "g", "i", "j")
    left = table(put.select("p", "g", "i", "j", "side", "below", "settled", "doc", "n", "bits", "head").mapInArrow(_possible, KEY.replace(", head array<long>", "") + ", doc long, head array<long>"), "possible")
    links = _with_sets(base, left, hot).repartition("p", "g", "i", "j").mapInArrow(_links, "a long, b long")
    comp = components(links if led is None else links.union(led))
    # the least node of a component is not among its nodes there
    comp = comp.union(comp.select("component", "component").distinct()).withColumnRenamed("node", "rep")
    classes = table(classes.join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "classes")
    low = classes.groupBy("component").agg(F.min("low").alias("least"))
    named = table(lookup(classes, low, ["component"]).select("s1", "s2", "n", "least"), "classes")
    out = lookup(feat.select(F.col("doc").alias("node"), "id", "n", "s1", "s2"), named, ["s1", "s2", "n"])
    return out.select("node", "id", "n", F.coalesce("least.id", "id").alias("low_id"), F.coalesce("least.node", "node").alias("low_node"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable by links, itself included).

    Words are runs of other than ASCII white space, A-Z lower-cased; a document's set
    holds its distinct five-word shingles, or its whole sequence if it has fewer
    words.  Two documents link when 100 * |intersection| >= 75 * |union|.  Null and
    blank texts have an empty set, which links with nothing.  A null id counts as the
    largest and comes back as null.  Only rows that repeat id and text are one document:
    rows without an id, or of one id with different texts, link by their own texts.
    An empty table gives no rows; other columns are not looked at.
    """
    named = lambda c: F.when(F.col(c) < NULL_ID, F.col(c))
    return jaccard_nodes(docs, id_col, text_col).select(named("id").alias("doc_id"), F.col("n").alias("n_shingles"), named("low_id").alias("component_id"))


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs),
grams AS (SELECT doc_id, n, p, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g FROM words),
shingles AS (SELECT DISTINCT doc_id, array_to_string(g, ' ') AS g FROM grams WHERE len(g) = 5 OR n < 5 AND p = 1),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * i >= 75 * (x.n + y.n - i)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM ways UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON r.other = w.a),
low AS (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY doc_id)
SELECT docs.doc_id, coalesce(sizes.n, 0) AS n_shingles, least(docs.doc_id, coalesce(least_id, docs.doc_id)) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN low USING (doc_id)
"""
