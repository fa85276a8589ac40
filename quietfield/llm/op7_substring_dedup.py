"""Substring deduplication: documents meet on winnowed anchors, matches are extended both ways, maximal repeats go.

1. Seeds: of every window of L words the K-gram of least hash (winnowing).  A record per
   seed has its hash and one of its context, the words of all windows about it.
2. Seeds of equal hash meet.  Seeds of one context are one match: the first document keeps
   it, the others repeat it.  A seed without a partner goes.
3. Seeds with different contexts fetch the words of theirs and are extended, all that share
   a seed at once: each step to the left, or to the right, parts those that agree so far by
   their next word.  A window of L words is repeated where its extension to the left and
   the one to the right are both those of an earlier document.  No pairs are formed.
4. The windows of a document that are repeated join to its maximal repeats of L words or
   more, whose words go.

A seed with very many contexts (a phrase in a third of all documents, each time in other
company) is too short to meet on in one task: it is lengthened to the whole window, and its
documents meet on each of these.  A bounded sample names such seeds; others that turn out
to have more than Limits.hot contexts are lengthened in step 3.

Words are compared by 64-bit hashes of their bytes, contexts and lengthened seeds by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .repeats import LIMITS, NULL_ID, Limits, by_doc, cover_lists, covered, dealt, gather, keyed, pieces, settle, small, word_symbols
from .runtime import table

LENGTH = 13
ANCHOR = 5
SEED = "k long, h long, s long, doc long, sig long, pos int, meta int"
MET = "doc long, sig long, pos int, width int, off int, kind int"
RUN = "doc long, sig long, pos long, width int"
LATER, LONE, REPEATED, RIM, LENGTHEN = 1 << 24, 1 << 25, 0, 1, 2


def common_seeds(docs: DataFrame, L: int, K: int, limits: Limits = LIMITS) -> np.ndarray:
    """Seeds with limits.sample_hot different contexts in about limits.sample_docs documents, limits.max_hot at most."""
    some = docs.where(F.pmod(F.xxhash64("doc", "sig"), F.lit(max(1, docs.count() // limits.sample_docs))) == 0)

    def run(batches):
        for *_, h, s in pieces(word_symbols, L, K, limits, batches):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.view(np.int64))], names=["h", "s"])

    many = some.select("doc", "text", "sig").mapInArrow(run, "h long, s long").distinct().groupBy("h").count().where(F.col("count") >= limits.sample_hot)
    rows = many.orderBy(F.desc("count"), "h").limit(limits.max_hot).select("h").collect()
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(k.U64))


def _is_in(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(values), dtype=bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _seeds(L: int, K: int, common: np.ndarray, limits: Limits):
    """A record per seed; what repeats an earlier context of its block is marked and dealt evenly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            h, s, doc, sig, pos, meta = (np.concatenate(x) for x in zip(*held, strict=True))
            order, _, later = settle([h, s], doc, sig, pos, False)
            h, s, doc, sig, pos, meta = (x[order] for x in (h, s, doc, sig, pos, meta))
            own = _is_in(h, common)
            even = k.mix((doc ^ sig).astype(k.U64) + (pos.astype(k.U64) << k.U64(32)))
            route = np.where(later, even, np.where(own, k.mix(h ^ k.mix(s)), h))
            flag = meta | np.where(later, LATER, 0).astype(np.int32) | np.where(own, LONE, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (route.view(np.int64), h.view(np.int64), s.view(np.int64), doc, sig, pos.astype(np.int32), flag)], names=["k", "h", "s", "doc", "sig", "pos", "meta"])

        for doc, sig, begin, width, off, h, s in pieces(word_symbols, L, K, limits, batches):
            held.append((h, s, doc, sig, begin, (width * 256 + off).astype(np.int32)))
            if sum(len(x[0]) for x in held) >= limits.block:
                yield from flush()
                held = []
        if held:
            yield from flush()

    return run


def _meet(limits: Limits):
    """Seeds of one hash: what repeats a context (REPEATED), and what has others beside it (RIM, or LENGTHEN where they are many)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gather(batches)
        if t is None:
            return
        h, s = (t[c].to_numpy().view(k.U64) for c in ("h", "s"))
        doc, sig, pos, meta = (t[c].to_numpy() for c in ("doc", "sig", "pos", "meta"))
        del t
        done = meta & LATER > 0
        out = [(doc[done], sig[done], pos[done], meta[done], np.full(done.sum(), REPEATED, np.int32))]
        h, s, doc, sig, pos, meta = (x[~done] for x in (h, s, doc, sig, pos, meta))
        order, new, later = settle([h, s], doc, sig, pos, False)
        h, doc, sig, pos, meta = (x[order] for x in (h, doc, sig, pos, meta))
        out.append((doc[later], sig[later], pos[later], meta[later], np.full(later.sum(), REPEATED, np.int32)))
        which = np.cumsum(np.append(True, h[1:] != h[:-1])[: len(h)]) - 1
        kinds = np.bincount(which[new], minlength=which[-1] + 1)[which] if len(h) else which
        # of a context that comes first at several places of one document, each place goes on
        own = meta & LONE > 0
        rim = ~later & ((kinds > 1) | own)
        out.append((doc[rim], sig[rim], pos[rim], meta[rim], np.where((kinds[rim] > limits.hot) | own[rim], LENGTHEN, RIM).astype(np.int32)))
        doc, sig, pos, meta, kind = (np.concatenate(x) for x in zip(*out, strict=True))
        meta = meta & (LATER - 1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, sig, pos, meta >> 8, meta & 255, kind)], names=["doc", "sig", "pos", "width", "off", "kind"])

    return run


def _contexts(L: int, K: int, limits: Limits):
    """Rows (doc, text, places, sig) to a row per context with its words, or per window of a lengthened seed with its hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            raw, offsets = k.text_buffers(batch.column(1))
            places = batch.column(2)
            ends, flat = places.offsets.to_numpy(), places.flatten()
            pos_all, meta_all = flat.field("pos").to_numpy().astype(np.int64), flat.field("meta").to_numpy()
            ends = ends - ends[0]
            ids, sigs = (batch.column(c).to_numpy() for c in (0, 3))
            for i, j in k.doc_chunks(offsets):
                sym, check, cuts = word_symbols(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = slice(ends[i], ends[j])
                row = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
                doc, sig, pos, meta = ids[i:j][row], sigs[i:j][row], pos_all[own], meta_all[own]
                width, off, long = meta >> 9, meta >> 1 & 255, meta & 1 == 1
                begin = cuts[row] + pos
                for s in range(0, int((~long).sum()), limits.block // 8):
                    r = np.flatnonzero(~long)[s : s + limits.block // 8]
                    size = (width[r] + L - 1).astype(np.int64)
                    seed = k.joined(sym, begin[r] + off[r], K)
                    bounds = np.zeros(len(r) + 1, np.int32)
                    bounds[1:] = np.cumsum(size)
                    words = pa.ListArray.from_arrays(pa.array(bounds), pa.array(sym[k.spread(size, begin[r])].view(np.int64)))
                    yield _context_rows(seed, np.zeros(len(r), k.U64), doc[r], sig[r], pos[r], meta[r], words)
                r = np.flatnonzero(long)
                if len(r):
                    times = width[r].astype(np.int64)
                    at, r, p = k.spread(times, begin[r]), np.repeat(r, times), k.spread(times, pos[r])
                    held.append((k.joined(sym, at, L), k.joined(check, at, L), doc[r], sig[r], p))
                    if sum(len(x[0]) for x in held) >= limits.block:
                        yield _lengthened(held)
                        held = []
        if held:
            yield _lengthened(held)

    return run


def _lengthened(held: list[tuple]) -> pa.RecordBatch:
    """Windows of lengthened seeds, settled among themselves: those that come later go on without a hash to meet by, dealt evenly."""
    h, h2, doc, sig, pos = (np.concatenate(x) for x in zip(*held, strict=True))
    order, _, later = settle([h, h2], doc, sig, pos, False)
    h, h2, doc, sig, pos = (x[order] for x in (h, h2, doc, sig, pos))
    none = pa.ListArray.from_arrays(pa.array(np.zeros(len(order) + 1, np.int32)), pa.array(np.zeros(0, np.int64)))
    even = k.mix((doc ^ sig).astype(k.U64) + pos.astype(k.U64))
    return _context_rows(np.where(later, even, h), h2, doc, sig, pos, (1 << 9) | (~later).astype(np.int32), none)


CONTEXT = "h long, h2 long, doc long, sig long, pos int, meta int, words array<long>"


def _context_rows(h, h2, doc, sig, pos, meta, words: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (h.view(np.int64), h2.view(np.int64), doc, sig, pos.astype(np.int32), meta.astype(np.int32))), words], names=["h", "h2", "doc", "sig", "pos", "meta", "words"])


def _classes(keys: list[np.ndarray]) -> np.ndarray:
    """Numbers of the classes of equal keys."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), dtype=bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _extend(L: int, K: int):
    """Extends the seeds of a partition both ways, word by word; returns runs of repeated windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gather(batches)
        if t is None:
            return
        t = t.combine_chunks()
        h, h2, doc, sig, pos, meta = (t[c].to_numpy() for c in ("h", "h2", "doc", "sig", "pos", "meta"))
        pos = pos.astype(np.int64)
        lists = t["words"].chunk(0)
        starts, words = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        del t
        whole = np.diff(starts) == 0
        settled = whole & (meta & 1 == 0)
        yield _rows(doc[settled], sig[settled], pos[settled])
        # lengthened seeds: whole windows that met by their hash
        r = np.flatnonzero(whole & ~settled)
        order, _, later = settle([h[r], h2[r]], doc[r], sig[r], pos[r], False)
        r = r[order[later]]
        yield _rows(doc[r], sig[r], pos[r])
        r = np.flatnonzero(~whole)
        doc, sig, pos, meta, begin = doc[r], sig[r], pos[r], meta[r], starts[:-1][r]
        width, off = meta >> 9, meta >> 1 & 255
        right = width + L - 1 - off - K  # words after the seed
        group = h[r]
        for d in range(K):
            group = _classes([words[begin + off + d], group])
        left_of, right_of = [group], [group]
        for d in range(1, L - K + 1):
            live = off >= d
            left_of.append(_step(left_of[-1], words, begin + off - d, live))
            live = right >= d
            right_of.append(_step(right_of[-1], words, begin + off + K - 1 + d, live))
        for d in range(L - K + 1):  # the windows with d words before the seed
            live = np.flatnonzero((off >= d) & (off - d < width) & (right >= L - K - d))
            order, _, later = settle([left_of[d][live], right_of[L - K - d][live]], doc[live], sig[live], pos[live], False)
            x = live[order[later]]
            yield _rows(doc[x], sig[x], pos[x] + off[x] - d)

    return run


def _step(so_far: np.ndarray, words: np.ndarray, at: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Classes after one more word; those that cannot be extended have none (-1)."""
    out = np.full(len(so_far), -1, np.int64)
    x = np.flatnonzero(live)
    out[x] = _classes([words[at[x]], so_far[x]])
    return out


def _rows(doc: np.ndarray, sig: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Repeated windows as maximal runs of starts."""
    order = np.lexsort((pos, sig, doc))
    doc, sig, pos = doc[order], sig[order], pos[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (sig[1:] != sig[:-1]) | (pos[1:] > pos[:-1] + 1))[: len(doc)]
    b = np.flatnonzero(new)
    last = np.append(b[1:], len(doc))[: len(b)] - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[b]), pa.array(sig[b]), pa.array(pos[b]), pa.array((pos[last] - pos[b] + 1).astype(np.int32))], names=["doc", "sig", "pos", "width"])


def repeated_words(docs: DataFrame, L: int = LENGTH, K: int = ANCHOR, limits: Limits = LIMITS) -> DataFrame:
    """Windows of L words of docs(doc, text, sig) that also start in an earlier document, as runs (doc, sig, pos, width)."""
    assert 0 < K <= L <= len(k.PLACE)
    common = common_seeds(docs, L, K, limits)
    rec = docs.select("doc", "text", "sig").mapInArrow(_seeds(L, K, common, limits), SEED)
    met = table(dealt(rec, docs, limits.part_bytes, "k").mapInArrow(_meet(limits), MET), "seeds")
    found = met.where(F.col("kind") == REPEATED).select("doc", "sig", F.col("pos").cast("long").alias("pos"), "width")
    meta = ((F.col("width") * 256 + F.col("off")) * 2 + (F.col("kind") == LENGTHEN).cast("int")).alias("meta")
    rim = met.where(F.col("kind") != REPEATED).groupBy("doc", "sig").agg(F.collect_list(F.struct("pos", meta)).alias("places"))
    body = by_doc(docs).join(rim.hint("shuffle_hash"), ["doc", "sig"]).select("doc", "text", "places", "sig").mapInArrow(_contexts(L, K, limits), CONTEXT)
    return found.union(dealt(body, docs, limits.part_bytes, "h").mapInArrow(_extend(L, K), RUN))


def _digest(L: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            raw, offsets = k.text_buffers(batch.column(1))
            begin, end, first = k.words(raw, offsets)
            sizes = np.diff(first)
            gone = cover_lists(batch.column(2), first, L, sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            removed = np.bincount(owner[gone], minlength=len(sizes)).astype(np.int64)
            b, e = k.runs(gone, first)
            spans = np.bincount(owner[b] if len(b) else owner[:0], minlength=len(sizes)).astype(np.int64)
            # kept words with one space before each; the leading space is cut per document
            b, e = begin[~gone], end[~gone]
            lens = e - b + 1
            idx = k.spread(lens, b - 1)
            body = raw[idx] if len(raw) else raw
            heads = np.cumsum(lens) - lens
            body[heads] = 0x20
            body = body.tobytes()
            per_doc = np.bincount(owner[~gone], weights=lens, minlength=len(sizes)).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(per_doc)])
            texts = [body[ends[i] + 1 : ends[i + 1]] for i in range(len(sizes))]
            ids = batch.column(0).to_numpy()
            arrays = [pa.array(ids, mask=ids == NULL_ID), pa.array(sizes), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
            names = ["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array([x.decode() for x in texts], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def substring_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, limits: Limits = LIMITS) -> DataFrame:
    """Per document: words, words removed, maximal runs removed, hash of (and with_text, also) the words kept.

    Documents meet on winnowed seeds, whose matches are extended both ways; what goes are
    the maximal repeats: each word covered by a window of `length` words that also starts
    in a document of smaller id.  Repeats inside one document do not count.  Null or
    blank texts have no words; a null id counts as the largest; rows that repeat an id
    and text count as one document and each get its result; documents that share an id,
    or have none, but not their text are in a fixed order; an empty table gives no rows;
    other columns are not looked at.
    """
    base = keyed(docs, id_col, text_col)
    windows = repeated_words(base, length, min(ANCHOR, length), limits)
    extra = ", kept string" if with_text else ""
    return covered(base, windows).mapInArrow(_digest(length, with_text), "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string" + extra)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs),
windows AS (SELECT doc_id, p, word, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g FROM words),
marks AS (SELECT doc_id, p, word, len(g) = 13 AND min(doc_id) OVER (PARTITION BY array_to_string(g, ' ')) < doc_id AS again FROM windows),
gone AS (SELECT doc_id, p, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM marks),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM gone),
cut AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
         coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM edges GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)
"""
