"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import table

WEIGHTS = (5, 2, 1)
MOST = 3  # times a source, and so a document, may be taken
BUCKET = 2000  # documents of a source whose running sum one task takes, on average
WORD = r"[^\x20\x09-\x0D]+"
GOOD, BAD = 2.0, 0.5  # quality weights of labelled documents; others weigh 1


def uniform(column: Column, text: Column) -> Column:
    """A number in (0, 1) from an id, or from the text of a row without one, the same in every run and engine."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(column.cast("string"), text, F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes(source, source_size, n_docs) with the words to take from each source as `target`.

    Sources by code point, null last, weigh weights[0], weights[1], ... in turn.  All
    together take the words there are; a source stops at `most` times its size and its
    excess is shared by weight among the others.  That is one level: target is the
    least of most * size and level * weight, where the level is the largest of the
    levels that the sources, in order of the level at which each stops, would give.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.row_number().over(turn) - 1) % len(weights) + 1)
    weighed = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    stops = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(stops.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(stops.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    leveled = weighed.withColumn("stop_level", (total - before) / after)
    leveled = leveled.withColumn("level", F.max("stop_level").over(Window.partitionBy()))
    return leveled.select("source", "source_size", "n_docs", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, labels: DataFrame | None = None, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Per document: doc_id, source, size in words, source_size, target of its source, words taken.

    A source's target is first met by complete epochs (every document whole); what is
    left is filled in the order of the keys -ln(u) / quality, smallest first, which is
    Efraimidis-Spirakis sampling without replacement; the document at the edge gives the
    words that are missing.  quality: 2 for documents labelled good, 0.5 for bad, else 1.
    The running sums are two-level, so no source is gathered in one task: sums of
    buckets of keys, and sums inside a bucket.  Null texts have no words; a null source
    is a source; rows without an id, whose key is from their text, and rows that repeat an
    id are documents of their own, ordered by size where keys tie; a very long text counts
    whole; an empty table gives no rows; other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), uniform(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("u"))
    quality = F.lit(1.0)
    if labels is not None:
        marks = labels.select(F.col("doc_id").cast("long").alias("_label"), F.col("quality").cast("int").alias("_q")).where("_label is not null").groupBy("_label").agg(F.max("_q").alias("_q"))
        own = own.join(marks, own["doc_id"] == marks["_label"], "left")
        quality = F.when(F.col("_q") == 1, GOOD).when(F.col("_q") == 0, BAD).otherwise(1.0)
    own = table(own.select("doc_id", "source", "size", (-F.log("u") / quality).alias("key")), "sizes")
    sizes = own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    goal = table(targets(sizes, weights, most), "targets")
    # complete epochs, then the words left over
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("left", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long"))
    parts = F.ceil(F.col("n_docs") / F.lit(BUCKET)).cast("long")
    goal = goal.withColumn("parts", parts).withColumnRenamed("source", "_source")
    dealt = own.join(goal, own["source"].eqNullSafe(goal["_source"])).drop("_source", "n_docs")
    dealt = dealt.withColumn("bucket", F.least(F.col("parts") - 1, F.floor((1 - F.exp(-F.col("key"))) * F.col("parts")).cast("long")))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("_words"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("_words").over(running), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.join(sums, out["source"].eqNullSafe(sums["_s"]) & (out["bucket"] == sums["_b"]))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("_before") - F.col("_inside")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"))


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH labelled AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
own AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, d.text, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)
           / (CASE WHEN q = 1 THEN 2.0 WHEN q = 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS key
  FROM documents d LEFT JOIN labelled l ON d.doc_id = l.doc_id),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM own GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lv
  FROM weighed),
goal AS (SELECT source, source_size, least(cap::DOUBLE, max(lv) OVER () * w) AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM goal),
ranked AS (
  SELECT o.doc_id, o.source, o.size, p.source_size, p.target, p.epochs,
         floor(p.target - p.epochs * p.source_size + 0.5::DOUBLE)::BIGINT AS remaining,
         coalesce(sum(o.size) OVER (PARTITION BY o.source ORDER BY o.key, o.doc_id, o.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM own o JOIN plan p ON o.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target, (epochs * size + greatest(0, least(size, remaining - before)))::BIGINT AS taken FROM ranked
"""
