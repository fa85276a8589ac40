"""Language identification by compression with one raw-content dictionary per language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DICT_BYTES = 128 << 10  # bound on the dictionary of a language
TRAIN_DOCS = 400  # bound on the documents it is drawn from
TRAIN_BYTES = 1500  # bound on what one document gives to a dictionary
LEVEL = 3
MARGIN = 0.01  # a smaller relative margin is rejected
BLOCK = 1 << 20  # long texts are compressed in blocks of this size, all of them
FOLD = "held_out"
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The letters of a text, lower-cased, one space for anything between."""
    return OTHER.sub(" ", text.lower()).strip().encode()


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary), the most frequent language first.

    From a bounded sample by hash of the id of the documents outside the fold (crc32 of
    the id as text, mod 4, not 2) with text and language: TRAIN_DOCS a language,
    TRAIN_BYTES of each, DICT_BYTES in all.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.where("id is not null and lang is not null and text is not null and length(text) > 0").where(~held_out("id"))
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return []
    # the least hashes are wanted, so only rows below a bound that some 8 * TRAIN_DOCS of each language pass are ranked
    bound = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 8 * TRAIN_DOCS / n))])
    low = own.select("id", "lang").where((F.xxhash64("id").cast("double") / float(1 << 64) + 0.5) <= F.element_at(bound, F.col("lang")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    picked = low.withColumn("r", rank).where(F.col("r") <= TRAIN_DOCS).select("id").distinct()
    some = own.join(F.broadcast(picked), "id").select("id", "lang", F.substring("text", 1, TRAIN_BYTES).alias("text"))
    texts: dict[str, list] = {}
    for r in some.collect():  # at most languages * TRAIN_DOCS * TRAIN_BYTES
        texts.setdefault(r["lang"], []).append((r["id"], r["text"]))
    out = []
    for lang in sorted(texts, key=lambda x: (-sizes[x], x)):
        body = b""
        for _, t in sorted(texts[lang]):
            if len(body) < DICT_BYTES:
                body += letters(t)[:TRAIN_BYTES] + b"\n"
        out.append((lang, body[:DICT_BYTES]))
    return out


def held_out(column: str):
    """crc32 of the id as text, mod 4, is 2.  A null id counts as held out: nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(column).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _predict(model: list[tuple[str, bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = []
        for lang, body in model:
            d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            by.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
        for batch in batches:
            pred, score, reject = [], np.zeros(batch.num_rows), np.ones(batch.num_rows, dtype=bool)
            for row, text in enumerate(batch.column(1).to_pylist()):
                data = letters(text) if text else b""
                if not by or not data or not any(map(str.isalpha, text)):
                    pred.append("und")
                    continue
                blocks = [data] if len(data) <= BLOCK else [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
                sizes = [sum(len(c.compress(x)) for x in blocks) for _, c in by]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                pred.append(by[best][0])
                if len(sizes) > 1:
                    second = min(s for i, s in enumerate(sizes) if i != best)
                    margin = (second - sizes[best]) / second
                    score[row] = min(1.0, margin / (margin + 0.02))
                    reject[row] = margin < MARGIN
                else:
                    score[row], reject[row] = 1.0, False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pred, pa.string()), pa.array(score), pa.array(reject)], names=["doc_id", FOLD, "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: list[tuple[str, bytes]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (0 to 1, from the margin) and rejected.

    The letters of the whole text, lower-cased, are compressed with every dictionary; the smallest
    output names the language, the more frequent language on a tie.  rejected: the
    margin to the next is narrower than MARGIN (lang_pred still names the best).  und,
    score 0, rejected: the text is null or has no letter, or nothing was learned.
    Null and repeated ids stay, a row for a row.  A very long text is compressed in blocks,
    all of them.  Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"), held_out(id_col).alias(FOLD))
    return rows.mapInArrow(_predict(model), f"doc_id long, {FOLD} boolean, lang_pred string, score double, rejected boolean")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs))
