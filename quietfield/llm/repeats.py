"""Anchors of a corpus: what the operators on repeated passages share.

Each window of L symbols (bytes, words or lines) picks the K-gram of least hash in it (the
rightmost of equals) as its anchor, so equal windows pick the same anchor at the same
offset.  The windows that share an anchor lie side by side and together span a *stretch* of
the text: one record per stretch is kept, about 2/(L-K+2) of them per symbol.

A document is (doc, sig): its id, and a hash of its text that tells rows without an id, or
of one id, apart.  Documents are in order of doc, then sig, so that of a window that such
rows share one stays, and marks go only to the text they were found in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as k

NULL_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Limits:
    """Bounds on what a task holds.  They change the work, never the results."""

    piece: int = 1 << 20  # window starts of a long text handled at once
    block: int = 1 << 20  # records settled at once before they leave a task
    hot: int = 2048  # different contexts about one anchor before its windows are dealt singly
    sample_docs: int = 4096  # documents looked at for hot anchors
    sample_hot: int = 8  # different contexts in the sample that make an anchor hot
    max_hot: int = 4096  # hot anchors sent to the tasks
    part_bytes: int = 64 << 20  # text bytes whose records one task gathers, on average


LIMITS = Limits()


def stretches(symbols: np.ndarray, check: np.ndarray | None, cuts: np.ndarray, L: int, K: int) -> tuple[np.ndarray, ...]:
    """Stretches of concatenated sequences; cuts has the n+1 bounds.

    Returns (sequence, begin, width, offset of the anchor, anchor hash, stretch hash).
    The stretch hash comes from `check`, symbols hashed with another seed, so that both
    together are 128 bits; it is None without them.
    """
    n = len(symbols)
    counts = np.maximum(np.diff(cuts) - L + 1, 0)
    if not counts.sum():
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.view(k.U64), z.view(k.U64)
    prefix = k.prefix_hash(symbols)
    inv = k.powers(n + 1)[1]
    grams = k.mix((prefix[K:] - prefix[:-K]) * inv[: n - K + 1])
    key = (grams & k.HIGH32) | (k.LOW32 - np.arange(len(grams), dtype=k.U64))
    chosen = (k.LOW32 - (k.sliding_min(key, L - K + 1) & k.LOW32)).astype(np.int64)
    p = k.spread(counts, cuts[:-1])
    seq = np.repeat(np.arange(len(counts)), counts)
    at = chosen[p]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (seq[1:] != seq[:-1])
    b = np.flatnonzero(new)
    width = np.diff(np.append(b, len(p)))
    begin, anchor, seq = p[b], at[b], seq[b]
    off = anchor - begin
    s = None
    if check is not None:
        body = k.range_hash(k.prefix_hash(check), begin, begin + width + L - 1)
        s = k.mix(body ^ k.mix((off * 65536 + width).astype(k.U64)))
    return seq, begin, width, off, grams[anchor], s


def byte_symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, None, np.ndarray]:
    return k.SYMBOL[raw], None, offsets


def word_symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b, e, first = k.words(raw, offsets)
    return k.word_hashes(raw, b, e), k.word_hashes(raw, b, e, 1), first


def line_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte of every line that holds a word, and the n+1 bounds of the documents."""
    b, e = k.runs(raw != 0x0A, offsets)
    words = np.concatenate([[0], np.cumsum(~k.IS_SPACE[raw])])
    has = words[e] > words[b]
    b, e = b[has], e[has]
    return b, e, np.searchsorted(b, offsets)


def line_symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b, e, first = line_bounds(raw, offsets)
    return k.word_hashes(raw, b, e), k.word_hashes(raw, b, e, 1), first


def pieces(symbols: Callable, L: int, K: int, limits: Limits, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc, sig, begin, width, offset, anchor hash, stretch hash) of the stretches, some documents at a time.

    A long text is cut into pieces of limits.piece window starts.
    """
    for batch in batches:
        ids, sigs = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
        raw, offsets = k.text_buffers(batch.column(1))
        for i, j in k.doc_chunks(offsets):
            sym, check, cuts = symbols(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            longest = j - i == 1 and len(sym) > limits.piece + L - 1
            for base in range(0, len(sym) - L + 1, limits.piece) if longest else (0,):
                own = slice(base, base + limits.piece + L - 1) if longest else slice(None)
                part = sym[own]
                seq, begin, width, off, h, s = stretches(part, None if check is None else check[own], np.array([0, len(part)]) if longest else cuts, L, K)
                if len(seq):
                    yield ids[i:j][seq], sigs[i:j][seq], begin - (0 if longest else cuts[seq]) + base, width, off, h, s


def dealt(rows: DataFrame, docs: DataFrame, per_task: int, key: str) -> DataFrame:
    """rows dealt by key: as the session has it, or into more partitions, one for about per_task bytes of the text of docs."""
    wanted = -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // per_task)
    return rows.repartition(wanted, key) if wanted > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(key)


def settle(keys: list[np.ndarray], doc: np.ndarray, sig: np.ndarray, pos: np.ndarray, same_doc: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys, then document and place; where each group of equal keys begins; which rows start later than the first of theirs."""
    order = np.lexsort((pos, sig, doc, *keys[::-1]))
    doc, sig, pos = doc[order], sig[order], pos[order]
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
    later = (doc > doc[lead]) | (sig != sig[lead])
    if same_doc:
        later |= pos > pos[lead]
    return order, new, later


def small(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `limit` bytes of text (column 1), so that what is made of them stays small."""
    for batch in batches:
        for i, j in k.doc_chunks(k.text_buffers(batch.column(1))[1], limit):
            yield batch.slice(i, j - i)


def gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a partition, whose size the caller has bounded."""
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


def signature(text_col: str = "text") -> Column:
    """A hash of the text; a null text is empty."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text, sig).  A null id counts as the largest one."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text_col).cast("string").alias("text"), signature(text_col).alias("sig"))


def by_doc(docs: DataFrame) -> DataFrame:
    """docs dealt by (doc, sig): one exchange, which the joins on them of one plan share."""
    return docs.repartition("doc", "sig")


def covered(docs: DataFrame, windows: DataFrame, *carried: str) -> DataFrame:
    """docs(doc, text, sig) with the runs of each document as a list `cover` (null where it has none), then the carried columns."""
    per_doc = windows.groupBy("doc", "sig").agg(F.collect_list(F.struct("pos", "width")).alias("cover"))
    rows = docs if carried else by_doc(docs)
    return rows.join(per_doc.hint("shuffle_hash"), ["doc", "sig"], "left").select("doc", "text", "cover", *carried)


def cover_lists(column: pa.Array, offsets: np.ndarray, L: int, sizes: np.ndarray) -> np.ndarray:
    """Boolean per symbol of the batch: covered by a repeated window.  offsets: first symbol of each document."""
    total = int(offsets[-1])
    step = np.zeros(total + 1, np.int32)
    ends = column.offsets.to_numpy()
    flat = column.flatten()
    if len(flat):
        pos, width = flat.field("pos").to_numpy().astype(np.int64), flat.field("width").to_numpy().astype(np.int64)
        counts = np.where(np.asarray(column.is_valid()), np.diff(ends), 0)
        seq = np.repeat(np.arange(len(counts)), counts)
        b = np.minimum(pos, sizes[seq])
        e = np.minimum(pos + width + L - 1, sizes[seq])
        np.add.at(step, offsets[seq] + b, 1)
        np.add.at(step, offsets[seq] + e, -1)
    return np.cumsum(step[:-1]) > 0
