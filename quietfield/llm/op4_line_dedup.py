"""Line deduplication over three-line windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .repeats import LIMITS, NULL_ID, Limits, cover_lists, covered, dealt, gather, keyed, line_bounds, line_symbols, pieces, settle, signature, small
from .runtime import named, table

LINES = 3


def _windows(limits: Limits):
    """A record per window of LINES lines: 128 bits of hash and its place.

    Of the windows of a block that are equal only the first is dealt by its hash; the
    others are known to come later, so copies of one window never meet in one task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            h, s, doc, sig, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            order, _, later = settle([h, s], doc, sig, pos, True)
            h, s, doc, sig, pos = (x[order] for x in (h, s, doc, sig, pos))
            even = k.mix((doc ^ sig).astype(k.U64) + (pos.astype(k.U64) << k.U64(32)))
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (np.where(later, even, h).view(np.int64), s.view(np.int64), doc, sig, pos.astype(np.int32))), pa.array(later)], names=["h", "s", "doc", "sig", "pos", "later"])

        for doc, sig, begin, _, _, h, s in pieces(line_symbols, LINES, LINES, limits, batches):
            held.append((h, s, doc, sig, begin))
            if sum(len(x[0]) for x in held) >= limits.block:
                yield from flush()
                held = []
        if held:
            yield from flush()

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that start later than an equal one."""
    t = gather(batches)
    if t is None:
        return
    h, s, doc, sig, pos, known = (t[c].to_numpy() for c in ("h", "s", "doc", "sig", "pos", "later"))
    rest = np.flatnonzero(~known)
    order, _, later = settle([h[rest], s[rest]], doc[rest], sig[rest], pos[rest], True)
    out = np.concatenate([np.flatnonzero(known), rest[order[later]]])
    yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(sig[out]), pa.array(pos[out].astype(np.int64)), pa.array(np.ones(len(out), np.int32))], names=["doc", "sig", "pos", "width"])


def repeated_lines(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Windows of docs(doc, text, sig) that also start earlier, as runs (doc, sig, pos, width) of lines with a word."""
    rec = docs.select("doc", "text", "sig").mapInArrow(_windows(limits), "h long, s long, doc long, sig long, pos int, later boolean")
    return table(dealt(rec, docs, 4 * limits.part_bytes, "h").mapInArrow(_later, "doc long, sig long, pos long, width int"), "lines")


def _cut(text: str, gone: np.ndarray) -> str:
    """text without the lines with a word that are marked; gone has a mark for each such line."""
    marks, out = iter(gone.tolist()), []
    for line in text.split("\n"):
        has = any(c not in " \t\n\x0b\x0c\r" for c in line)
        if not (has and next(marks)):
            out.append(line)
    return "\n".join(out)


def _digest(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            raw, offsets = k.text_buffers(batch.column(1))
            _, _, first = line_bounds(raw, offsets)
            sizes = np.diff(first)
            gone = cover_lists(batch.column(2), first, LINES, sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            removed = np.bincount(owner[gone], minlength=len(sizes)).astype(np.int64)
            texts = [raw[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(sizes))]
            for i in np.flatnonzero(removed).tolist():
                texts[i] = _cut(texts[i].decode(), gone[first[i] : first[i + 1]]).encode()
            ids = batch.column(0).to_numpy()
            arrays = [pa.array(ids, mask=ids == NULL_ID), pa.array(sizes), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
            names = ["doc_id", "n_lines", "n_removed", "kept_sha256"]
            if with_text:
                arrays.append(pa.array([x.decode() for x in texts], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, limits: Limits = LIMITS) -> DataFrame:
    """Per document: lines with a word, lines removed, hash of (and with_text, also) the text kept.

    Lines are parts between \\n; only those with a word count, others stay.  A window
    is three such lines in a row, compared by 128 bits of hash.  A window that also starts in
    a document of smaller id, or earlier in the same document, is a later occurrence:
    the lines it covers go, overlaps merged.  Documents that share an id, or have none,
    but not their text are in a fixed order, by a hash of it.  What is kept is joined by \\n.  A document
    of fewer than three lines keeps all.  A null text is empty; a null id counts as the
    largest; rows that repeat an id and text count as one document and each get its
    result; an empty table gives no rows; other columns are not looked at.
    """
    base = keyed(docs, id_col, text_col)
    windows = repeated_lines(base, limits)
    extra = ", kept string" if with_text else ""
    return covered(base, windows).mapInArrow(_digest(with_text), "doc_id long, n_lines long, n_removed long, kept_sha256 string" + extra)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated lines cut from text, its length in n_chars; documents left without a word go.

    A document that had no word before stays as it is.  Ids need not be unique: marks
    belong to the id and the text.
    """
    names = docs.columns
    base = keyed(docs)
    windows = repeated_lines(base)
    carried = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.col("text").cast("string").alias("text"), signature().alias("sig"), *[named(c).alias(f"_c{n}") for n, c in enumerate(names) if c != "text"])
    rows = covered(carried, windows, *[c for c in carried.columns if c.startswith("_c")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            raw, offsets = k.text_buffers(batch.column(1))
            _, _, first = line_bounds(raw, offsets)
            sizes = np.diff(first)
            gone = cover_lists(batch.column(2), first, LINES, sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            removed = np.bincount(owner[gone], minlength=len(sizes))
            texts = batch.column(1).to_pylist()
            for i in np.flatnonzero(removed).tolist():
                texts[i] = _cut(texts[i], gone[first[i] : first[i + 1]])
            stay = (removed == 0) | (removed < sizes)
            out = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(removed > 0), *batch.columns[3:]], names=["text", "_cut", *batch.schema.names[3:]])
            yield out.filter(pa.array(stay))

    fields = [f for f in rows.schema.fields if f.name.startswith("_c")]
    out = rows.mapInArrow(run, ", ".join(["text string", "_cut boolean"] + [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]))
    cols = []
    for n, c in enumerate(names):
        if c == "text":
            cols.append(F.col("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col("_cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(f"_c{n}")).alias(c))
        else:
            cols.append(F.col(f"_c{n}").alias(c))
    return out.select(*cols)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS idx FROM documents),
full_lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
windows AS (
  SELECT doc_id, idx, n, line, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3
  FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
ranked AS (
  SELECT doc_id, idx, n, l3 IS NOT NULL AND row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, n) > 1 AS again
  FROM windows),
marks AS (
  SELECT doc_id, idx, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), false) AS gone
  FROM ranked),
joined AS (
  SELECT l.doc_id, count(m.idx) AS n_lines, coalesce(sum(CASE WHEN m.gone THEN 1 ELSE 0 END), 0)::BIGINT AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.idx) FILTER (WHERE NOT coalesce(m.gone, false)), '') AS kept
  FROM lines l LEFT JOIN marks m ON l.doc_id = m.doc_id AND l.idx = m.idx GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM joined
"""
