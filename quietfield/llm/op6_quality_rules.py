"""Quality rules with risk-controlled thresholds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .runtime import named, table

MIN_WORDS = 50
RISK = 0.02  # share of good documents that may be rejected, per stratum, all rules together
CONFIDENCE_LOSS = 0.05  # chance that any of the guarantees fails
STEPS = 24
#: rule -> its loosest and its tightest cutoff; a document is rejected when a value is above the cutoff
RULES = {
    "symbol_share": (0.5, 0.01),
    "mark_share": (0.6, 0.05),
    "upper_share": (0.98, 0.1),
    "dup_line_share": (0.9, 0.1),
    "repeat_share": (0.5, 0.1),
    "word_length": (40.0, 8.0),
}
#: the cutoffs of all rules at each step, from loose to tight by equal factors
SEQUENCE = [{rule: round(loose * (tight / loose) ** (i / (STEPS - 1)), 6) for rule, (loose, tight) in RULES.items()} for i in range(STEPS)]
SYMBOLS = np.zeros(256, dtype=np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
MARKS = np.zeros(256, dtype=np.int64)
MARKS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,"]] = 1
UPPER = np.zeros(256, dtype=np.int64)
UPPER[65:91] = 1
NOT_INSIDE = np.ones(256, dtype=np.int64)
NOT_INSIDE[0x80:0xC0] = 0  # continuation bytes: a code point counts at its first byte
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper"]


def _per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_counts(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each document of a chunk."""
    n_docs = len(offsets) - 1
    if not len(raw):
        return [np.zeros(n_docs, np.int64) for _ in COUNTS]
    points = NOT_INSIDE[raw]
    b, e, first = k.words(raw, offsets)
    n_words = np.diff(first)
    chars = _per_doc(np.where(k.IS_SPACE[raw], 0, points), offsets)
    # words in three-word windows that come twice or more
    repeat = np.zeros(n_docs, np.int64)
    counts = np.maximum(n_words - 2, 0)
    if counts.sum():
        wh = k.word_hashes(raw, b, e)
        at = k.spread(counts, first[:-1])
        doc = np.repeat(np.arange(n_docs), counts)
        v = k.mix(k.joined(wh, at, 3) ^ k.mix(doc.astype(k.U64)))
        s = np.sort(v)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if len(twice):
            lut = np.zeros(1 << 16, dtype=bool)
            lut[twice & k.U64(0xFFFF)] = True
            maybe = np.flatnonzero(lut[v & k.U64(0xFFFF)])
            i = np.minimum(np.searchsorted(twice, v[maybe]), len(twice) - 1)
            hit = at[maybe[twice[i] == v[maybe]]]
            mark = np.zeros(len(b), dtype=bool)
            for d in range(3):
                mark[hit + d] = True
            repeat = _per_doc(mark.astype(np.int64), first)
    # lines that hold a word, and those equal to an earlier one
    lb, le = k.runs(raw != 0x0A, offsets)
    has = np.searchsorted(b, le) > np.searchsorted(b, lb)
    lb, le = lb[has], le[has]
    owner = np.searchsorted(offsets, lb, side="right") - 1
    v = k.mix(k.word_hashes(raw, lb, le) ^ k.mix(owner.astype(k.U64)))
    order = np.argsort(v)
    again = owner[order[1:][v[order[1:]] == v[order[:-1]]]]
    dup = np.bincount(again, minlength=n_docs)
    lines = np.bincount(owner, minlength=n_docs)
    return [n_words, chars, _per_doc(SYMBOLS[raw], offsets), dup, repeat, lines, _per_doc(MARKS[raw], offsets), _per_doc(UPPER[raw], offsets)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = k.text_buffers(batch.column(0))
        parts = [text_counts(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in k.doc_chunks(offsets)]
        cols = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)] if parts else [pa.array([], pa.int64())] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(1, batch.num_columns)), *cols], names=[*batch.schema.names[1:], *COUNTS])


def binomial_tail(n: int, x: int, p: float) -> float:
    """Exact P(Bin(n, p) <= x)."""
    if x >= n:
        return 1.0
    lp, lq = math.log(p), math.log1p(-p)
    top = math.lgamma(n + 1)
    return min(1.0, math.fsum(math.exp(top - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq) for i in range(x + 1)))


def choose_steps(holdout: list[dict]) -> dict[str, int]:
    """The tightest step of SEQUENCE for each stratum whose false rejections are limited.

    holdout: per stratum its name, n (good holdout documents) and `above`, how many of them
    some rule rejects at each step.  The exact (Clopper-Pearson) upper bound on the share
    of good documents rejected is at most RISK exactly when the binomial tail at that risk
    is at most the level.  The level is divided by the number of strata (Bonferroni);
    within one, all rules tighten together and testing goes from loose to tight and stops
    at the first step that fails, which needs no further correction (fixed sequence).
    """
    level = CONFIDENCE_LOSS / max(1, len(holdout))
    out: dict[str, int] = {}
    for row in holdout:
        for step, x in enumerate(row["above"]):
            if row["n"] == 0 or binomial_tail(row["n"], x, RISK) > level:
                break
            out[row["stratum"]] = step
    return out


def _share(a: str, b: str):
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def _values() -> dict:
    return {
        "symbol_share": _share("n_symbols", "word_chars"),
        "mark_share": _share("n_marks", "word_chars"),
        "upper_share": _share("n_upper", "word_chars"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "word_length": _share("word_chars", "n_words"),
    }


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", keep_columns: bool = False) -> DataFrame:
    """Per document the counts, base_failed and kept; with keep_columns the rows of docs that are kept, as they are.

    base_failed: fewer than 50 words, or more than half of the words in repeated
    three-word windows.  kept is false if base_failed or if a rule's value is above its
    cutoff at the step chosen for the document's stratum (its language; null is a stratum
    of its own).  A stratum with too few good holdout documents to prove a step gets none.
    The holdout are all documents labelled good (quality 1) that pass the base rules;
    cutoffs are a fixed sequence, so none of them was fitted elsewhere.  Labels are joined
    by doc_id; of repeated labels the best counts; labels without id or document are
    ignored.  Null texts have no words and fail.  Null and repeated ids stay, a row for
    a row.  A very long text is counted whole.  An empty table gives no rows; without
    labels only the base rules act.  Texts are counted once: what is counted is written.
    """
    names = docs.columns if keep_columns else []
    plain = [F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("_stratum")]
    shape = docs.select(*plain, *[named(c).alias(f"_c{n}") for n, c in enumerate(names)])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in shape.schema.fields[1:]] + [f"{c} long" for c in COUNTS])
    counted = table(shape.mapInArrow(_count, schema), "counts")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    values = _values()
    good = labels.select(F.col("doc_id").cast("long").alias("_label"), F.col("quality").cast("int").alias("_q")).where("_label is not null").groupBy("_label").agg(F.max("_q").alias("_q")).where("_q = 1")
    slim = counted.where(~base).select("_id", "_stratum", *[v.alias(rule) for rule, v in values.items()])
    held = slim.join(good, slim["_id"] == good["_label"], "left_semi")
    above = [F.sum(reduce(or_, [F.col(rule) > c for rule, c in cuts.items()]).cast("long")).alias(f"above_{i}") for i, cuts in enumerate(SEQUENCE)]
    rows = held.groupBy("_stratum").agg(F.count("*").alias("n"), *above).collect()  # one row per language
    steps = choose_steps([{"stratum": r["_stratum"], "n": r["n"], "above": [r[f"above_{i}"] for i in range(STEPS)]} for r in rows])
    verdict = F.lit(False)
    if steps:
        for rule, value in values.items():
            limit = F.create_map(*[F.lit(x) for s, i in sorted(steps.items()) for x in (s, SEQUENCE[i][rule])])
            verdict = verdict | F.coalesce(value > F.element_at(limit, F.col("_stratum")), F.lit(False))
    kept = ~(base | verdict)
    if keep_columns:
        return counted.where(kept).select(*[F.col(f"_c{n}").alias(c) for n, c in enumerate(names)])
    return counted.select(F.col("_id").alias("doc_id"), *COUNTS[:5], base.alias("base_failed"), kept.alias("kept"))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: the share of good documents above, and the tail of the binomial, are worked out as in choose_steps
SQL = r"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words),
windows AS (SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS g FROM each),
twice AS (SELECT doc_id, p FROM windows WHERE len(g) = 3 QUALIFY count(*) OVER (PARTITION BY doc_id, array_to_string(g, ' ')) > 1),
repeated AS (SELECT doc_id, count(DISTINCT p + d) AS n FROM twice, (VALUES (0), (1), (2)) AS t(d) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (
  SELECT words.doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         coalesce(n_dup, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         len(regexp_extract_all(text, '[\x21-\x2B\x2D\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]')) AS n_marks, len(regexp_extract_all(text, '[A-Z]')) AS n_upper
  FROM words LEFT JOIN repeated USING (doc_id) LEFT JOIN lines USING (doc_id)),
shares AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars::DOUBLE ELSE 0.0::DOUBLE END AS symbol_share,
         CASE WHEN word_chars > 0 THEN n_marks::DOUBLE / word_chars::DOUBLE ELSE 0.0::DOUBLE END AS mark_share,
         CASE WHEN word_chars > 0 THEN n_upper::DOUBLE / word_chars::DOUBLE ELSE 0.0::DOUBLE END AS upper_share,
         CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines::DOUBLE ELSE 0.0::DOUBLE END AS dup_line_share,
         CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words::DOUBLE ELSE 0.0::DOUBLE END AS repeat_share,
         CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words::DOUBLE ELSE 0.0::DOUBLE END AS word_length FROM counts),
steps(step, c1, c2, c3, c4, c5, c6) AS (VALUES STEPS),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
tested AS (
  SELECT stratum, step, count(*) AS n, count(*) FILTER (WHERE symbol_share > c1 OR mark_share > c2 OR upper_share > c3 OR dup_line_share > c4 OR repeat_share > c5 OR word_length > c6) AS x
  FROM shares SEMI JOIN good USING (doc_id) CROSS JOIN steps WHERE NOT base_failed GROUP BY stratum, step),
tails AS (
  SELECT *, CASE WHEN x >= n THEN 1.0 ELSE list_sum(list_transform(range(0, x + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(RISK::DOUBLE) + (n - i) * ln(1.0::DOUBLE - RISK::DOUBLE)))) END AS tail,
         (SELECT count(DISTINCT stratum) FROM tested) AS strata FROM tested),
chosen AS (SELECT stratum, min(step) FILTER (WHERE tail > LOSS::DOUBLE / strata) AS failing FROM tails GROUP BY stratum),
limits AS (SELECT stratum, c1, c2, c3, c4, c5, c6 FROM chosen JOIN steps ON step = coalesce(failing, N_STEPS) - 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(symbol_share > c1 OR mark_share > c2 OR upper_share > c3 OR dup_line_share > c4 OR repeat_share > c5 OR word_length > c6, false) AS kept
FROM shares LEFT JOIN limits USING (stratum)
""".replace("N_STEPS", str(STEPS)).replace("STEPS", ", ".join(f"({i}, " + ", ".join(f"{c}::DOUBLE" for c in cuts.values()) + ")" for i, cuts in enumerate(SEQUENCE))).replace("RISK", str(RISK)).replace("LOSS", str(CONFIDENCE_LOSS))
