"""Data set preparation: splits, caps, statistics, mixed rows, generated evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..plans import simulate
from ..plans.simulate import draw, pick


def stratified_cap(df: DataFrame, max_rows: int, by: tuple = ("split", "feature_category"), key: str = "doc_id") -> DataFrame:
    """At most max_rows rows, the strata in proportion, one of each at least; rows with a null stratum go.

    Rows are taken in order of a digest of the key, numbered without gathering a stratum;
    only the rows wanted take part in the final ordering.
    """
    digest = F.md5(F.concat(F.lit("cap:"), F.col(key).cast("string")).cast("binary"))
    out = simulate.ranked(df.dropna(subset=list(by)), list(by), digest, key)
    total = out.sparkSession.range(1).select(df.dropna(subset=list(by)).agg(F.count("*")).scalar().alias("_t"))
    share = F.least(F.lit(1.0), F.lit(float(max_rows)) / F.col("_t").cast("double"))
    kept = out.join(F.broadcast(total)).where(F.col("_rn") <= F.greatest(F.lit(1.0), F.rint(F.col("_n").cast("double") * share)))
    return kept.withColumn("_d", digest).orderBy("_d", key).limit(max_rows).drop("_d", "_rn", "_n", "_t")


def species_stats(df: DataFrame) -> DataFrame:
    per = df.groupBy("animal").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_species"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.avg("n").alias("avg_n"), F.sum("n").alias("total"))


def category_distribution(df: DataFrame) -> DataFrame:
    return df.where("split <> 'mixed'").groupBy("feature_category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feature_category")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The all-evidence rows, one for each row of docs: species unknown, label 1."""
    own = docs.select("doc_id", (F.col("doc_id") + 1).alias("i")).withColumn("tag", simulate.leaky_tag()).withColumn("animal", F.lit("unknown"))
    return own.select(
        "doc_id",
        F.concat(F.lit("mixed_"), F.col("i").cast("string")).alias("image_id"),
        "animal",
        F.lit("mixed").alias("split"),
        F.lit("mixed_all").alias("feature_category"),
        F.concat(F.lit("all_"), "tag").alias("feature_type"),
        F.concat(F.lit("mixed_"), F.col("i").cast("string"), F.lit("_all_"), "tag", F.lit(".jpg")).alias("filename"),
        simulate.leaky_caption(F.col("animal")).alias("caption"),
        F.lit(1).alias("risk_label"),
    )


def with_serial(df: DataFrame, order: list[str], bucket: list[Column]) -> DataFrame:
    """serial = 1, 2, ... in the given order without gathering rows in one task.

    bucket: coarse keys that follow the order (its leading columns, or the first digits of
    a digest).  A row's number is its place in its bucket and the rows of those before.
    """
    names = [f"_b{n}" for n in range(len(bucket))]
    own = df.withColumns(dict(zip(names, bucket, strict=True)))
    sums = own.groupBy(*names).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    out = own.withColumn("_r", place).join(sums.select(*names, before.alias("_before")), names)
    return out.withColumn("serial", F.col("_before") + F.col("_r")).drop(*names, "_r", "_before")


def metadata_fields(full: bool = False) -> dict:
    """The injected fields: all of them (full), or 1 to 4 of ten; altitude and time need a position."""
    names = ["gps", "altitude", "timestamp", "camera", "serial", "owner", "description", "keywords", "datetime", "thumbnail"]
    if full:
        return {n: F.lit(True) for n in names}
    digests = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.struct(F.md5(F.concat(F.lit("field:"), n, F.col("doc_id").cast("string")).cast("binary")).alias("d"), n.alias("n")))
    chosen = F.transform(F.slice(F.array_sort(digests), F.lit(1), (draw("nfields", 4) + 1).cast("int")), lambda x: x["n"])
    return {n: F.array_contains(chosen, n) & (F.array_contains(chosen, "gps") if n in ("altitude", "timestamp") else F.lit(True)) for n in names}


def ocr_tokens(items: DataFrame, prefix: str = "img_", plus: int = 0) -> DataFrame:
    """Token rows for the items with text evidence: one to three stamps, read in three modes with small shifts.

    An image_id is prefix and doc_id plus `plus`.
    """
    own = items.where(F.col("parts").contains("B")).select("doc_id", F.concat(F.lit(prefix), (F.col("doc_id") + plus).cast("string")).alias("image_id"))
    stamps = F.transform(F.sequence(F.lit(0), draw("ntok", 3).cast("int")), lambda i: i)
    own = own.select("doc_id", "image_id", F.explode(stamps).alias("k"))
    salted = F.md5(F.concat(F.lit("tok:"), F.col("k").cast("string"), F.lit(":"), F.col("doc_id").cast("string")).cast("binary"))
    number = lambda a, m: F.conv(F.substring(salted, a, 6), 16, 10).cast("long") % m
    stamp = F.element_at(F.array(*[F.lit(t) for t in C.OCR_TOKENS]), (number(1, len(C.OCR_TOKENS)) + 1).cast("int"))
    own = own.withColumn("stamp", stamp).withColumn("x0", number(7, 300).cast("int")).withColumn("y0", number(13, 200).cast("int")).withColumn("c0", number(19, 100).cast("int"))
    own = own.select("*", F.posexplode(F.split("stamp", " ")).alias("j", "text"))
    own = own.withColumn("psm_order", F.explode(F.sequence(F.lit(0), F.lit(2))))
    shift = F.when(F.col("psm_order") == 2, 9).otherwise(F.col("psm_order"))
    return own.select(
        "image_id",
        F.element_at(F.array(*[F.lit(m) for m in C.OCR_MODES]), F.col("psm_order") + 1).alias("psm"),
        "psm_order",
        (F.col("k") * 10 + F.col("j")).alias("seq"),
        F.when(F.col("psm_order") == 1, F.lower("text")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("c0") < 5, F.lit(-1.0)).otherwise(F.col("c0").cast("double")).alias("conf"),
        (F.col("x0") + F.col("j") * 60 + shift).cast("int").alias("x"),
        (F.col("y0") + shift).cast("int").alias("y"),
        (F.length("text") * 9).cast("int").alias("w"),
        F.lit(14).alias("h"),
    )


def benign_caption_rows(items: DataFrame) -> DataFrame:
    return items.select("doc_id", simulate.benign_caption(F.col("animal")).alias("caption"))


__all__ = ["stratified_cap", "species_stats", "category_distribution", "mixed_rows", "with_serial", "metadata_fields", "ocr_tokens", "benign_caption_rows", "pick"]
