"""Corpus pipeline: quality rules, line dedup, similarity join, decontamination, source mix.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietfield.llm import op2_ngram_jaccard, op4_line_dedup, op6_quality_rules, op8_source_mix, op10_decontamination
from quietfield.llm.runtime import made, named, release, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a risk-controlled cutoff go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return op6_quality_rules.quality(docs, labels, keep_columns=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in repeated three-line windows are cut from the text; documents left without a word go."""
    return op4_line_dedup.without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each linked group the document of smallest id stays, one row of those that repeat its id and text.

    A null id counts as the largest.  Among rows of a group that share the smallest id, or
    have none, one text stays; rows without id and words are copies of nothing and all stay.
    """
    heads = op2_ngram_jaccard.jaccard_nodes(docs).where("node = low_node").select(F.col("node").alias("_head")).distinct()
    names = docs.columns
    lone = F.col("doc_id").isNull() & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    own = docs.where(~lone).select(op2_ngram_jaccard.node().alias("_node"), F.xxhash64(*[F.to_json(named(c)) if "map<" in t else named(c) for c, t in docs.dtypes]).alias("_tie"), F.struct(*[named(c) for c in names]).alias("_row"))
    stay = own.join(heads, F.col("_node") == F.col("_head")).groupBy("_node").agg(F.min_by("_row", "_tie").alias("_row"))
    return stay.select("_row.*").union(docs.where(lone))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; benchmark windows in others are cut."""
    return op10_decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; documents it takes nothing of go."""
    return op8_source_mix.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("taken > 0")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again as the next one's docs.

    Once that is written, the tables that the stage and the one before left are deleted.
    """
    docs, begin = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
        release(begin, made() - 1)
        begin = made() - 1
    return STAGES[-1][1](spark, docs, sf_dir)


_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _over(sql: str, table: str) -> str:
    return sql.replace("FROM documents", f"FROM {table}")


#: the stages one after another, each from the SQL of its operator, for tables whose ids are unique
ORACLE_SQL = f"""
WITH RECURSIVE good AS ({op6_quality_rules.SQL}),
kept1 AS (SELECT documents.* FROM documents JOIN good USING (doc_id) WHERE kept),
lines_cut AS ({_over(op4_line_dedup.SQL, "kept1").replace("sha256(kept) AS kept_sha256", "kept")}),
kept2 AS (
  SELECT kept1.* REPLACE (CASE WHEN n_removed > 0 THEN kept ELSE text END AS text) FROM kept1 JOIN lines_cut USING (doc_id)
  WHERE n_removed = 0 OR n_removed < n_lines),
linked AS ({_over(op2_ngram_jaccard.SQL, "kept2")}),
kept3 AS (SELECT kept2.* FROM kept2 JOIN linked USING (doc_id) WHERE component_id = doc_id),
verdicts AS ({_over(op10_decontamination.SQL, "kept3")}),
spans AS ({_over(op10_decontamination.SQL, "kept3").rsplit("SELECT doc_id, len(w) AS n_words", 1)[0]} SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS p, true AS hit FROM found),
parts AS (
  SELECT doc_id, string_split_regex(text, '{_WORD}') AS between, unnest(regexp_extract_all(text, '{_WORD}')) AS word, generate_subscripts(regexp_extract_all(text, '{_WORD}'), 1) AS p
  FROM kept3 SEMI JOIN spans USING (doc_id)),
marked AS (SELECT doc_id, p, word, between[1] AS head, between[p + 1] AS after, coalesce(hit, false) AS hit FROM parts LEFT JOIN spans USING (doc_id, p)),
ahead AS (SELECT *, coalesce(lead(hit) OVER (PARTITION BY doc_id ORDER BY p), false) AS again FROM marked),
cut AS (SELECT doc_id, any_value(head) || string_agg(CASE WHEN hit THEN '' ELSE word END || CASE WHEN hit AND again THEN '' ELSE after END, '' ORDER BY p) AS kept FROM ahead GROUP BY doc_id),
kept4 AS (
  SELECT kept3.* REPLACE (coalesce(cut.kept, text) AS text) FROM kept3 JOIN verdicts USING (doc_id) LEFT JOIN cut USING (doc_id) WHERE NOT contaminated)
SELECT * FROM ({_over(op8_source_mix.SQL, "kept4")}) WHERE taken > 0
"""
