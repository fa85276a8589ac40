"""A manifest simulated from document ids.

The tables at hand hold no pictures, so every document stands for one: species, split,
injected category, name, caption and the signals a scan would find are drawn from
salted md5 digests of the id.  The same arithmetic is written in SQL in `oracles`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import context

ANIMALS = [
    "giraffe", "tiger", "snow leopard", "leopard", "elephant", "lion", "rhino", "zebra", "deer", "fox", "wolf", "bear",
    "eagle", "owl", "shark", "otter", "pangolin", "koala", "monkey", "quokka",
]
MULTI = ["A_B", "A_C", "A_E", "B_C", "B_E", "C_E", "A_B_C", "A_B_E", "A_C_E", "B_C_E"]
BENIGN = ["Grass and wind, nothing else", "One more afternoon outdoors", "First try with a longer lens", "Quiet light over the hills"]
META_TYPES = ["locationcoordinates", "camera_metadata", "device_metadata", "iptc_metadata", "metadata"]


def drawn(salt: str, n: int, key: str = "doc_id") -> str:
    """SQL of an independent draw from 0..n-1 for each salt.  One parsed text is far cheaper to build than its parts."""
    return f"cast(conv(substring(md5(concat('{salt}:', cast({key} as string))), 1, 8), 16, 10) as bigint) % {n}"


def draw(salt: str, n: int, key: str = "doc_id") -> Column:
    return F.expr(drawn(salt, n, key))


def pick(values: list[str], salt: str) -> Column:
    listed = ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)
    return F.expr(f"element_at(array({listed}), cast({drawn(salt, len(values))} as int) + 1)")


def species_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{k}', {v}D)" for k, v in C.SPECIES_SENSITIVITY.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(species, sensitivity)")


def with_sensitivity(df: DataFrame, animal: str = "animal") -> DataFrame:
    """Adds species_sensitivity by look-up with default; the table has 94 rows, so it is broadcast."""
    table = F.broadcast(species_table(df.sparkSession).withColumnRenamed("species", "_key"))
    out = df.withColumn("_species", context.species_key(F.col(animal)))
    return out.join(table, out["_species"] == table["_key"], "left").withColumn("species_sensitivity", F.coalesce("sensitivity", F.lit(C.UNKNOWN_SENSITIVITY))).drop("_key", "sensitivity", "_species")


def draw_category(u: Column, sensitivity: Column) -> Column:
    """Category of a draw out of 1000; the hard negatives need a sensitive species."""
    out = F.lit("multi")
    for name, cut in reversed(C.CATEGORY_CUTS[:-1]):
        value = F.when(sensitivity >= C.HIGH_SENSITIVITY, name).otherwise("clean") if name == "hard_negative_d" else F.lit(name)
        out = F.when(u < cut, value).otherwise(out)
    return out


def leaky_tag() -> Column:
    which = draw("pat", 3)
    number = lambda salt, n: (draw(salt, n) + 1).cast("string")
    reserve = pick(C.TAG_RESERVES, "res")
    return (
        F.when(which == 0, F.concat(pick(C.TAG_ZONE_WORDS, "zw"), number("num", 9), F.lit("_"), reserve))
        .when(which == 1, F.concat(F.lit("outpost"), number("gate", 6), F.lit("_"), reserve))
        .otherwise(F.concat(number("dist", 9), pick(C.TAG_UNITS, "unit"), F.lit("_near_waterhole")))
    )


def leaky_caption(species: Column) -> Column:
    reserve, n, unit = F.initcap(pick(C.TAG_RESERVES, "cres")), (draw("cdist", 9) + 1).cast("string"), pick(C.TAG_UNITS, "cunit")
    which = draw("ctpl", 3)
    return (
        F.when(which == 0, F.concat(F.lit("At dawn a "), species, F.lit(" drank "), n, F.lit(" "), unit, F.lit(" from the "), reserve, F.lit(" salt lick")))
        .when(which == 1, F.concat(F.initcap(species), F.lit(" tracks by "), reserve, F.lit(" compartment "), (draw("cbeat", 20) + 1).cast("string")))
        .otherwise(F.concat(F.lit("Den of a "), species, F.lit(", "), n, F.lit(" "), unit, F.lit(" near the buffer zone of "), reserve))
    )


def benign_caption(species: Column) -> Column:
    which = draw("btpl", 5)
    out = F.concat(F.lit("A "), species, F.lit(", as it was"))
    for i, text in enumerate(BENIGN):
        out = F.when(which == i, F.lit(text)).otherwise(out)
    return out


def leaky_filename(species: Column, serial: Column, ext: Column) -> Column:
    which = draw("fpat", 3)
    number = lambda salt, n: (draw(salt, n) + 1).cast("string")
    tag = (
        F.when(which == 0, F.concat(pick(C.TAG_ZONE_WORDS, "fzw"), number("fnum", 9)))
        .when(which == 1, F.concat(F.lit("grid"), number("fgate", 6)))
        .otherwise(F.concat(number("fdist", 9), pick(C.TAG_UNITS, "funit"), F.lit("_near_camp")))
    )
    return F.concat_ws("_", pick(C.TAG_RESERVES, "fres"), tag, species, F.concat(serial.cast("string"), F.lit("."), ext))


def benign_filename(serial: Column, ext: Column) -> Column:
    return F.concat(pick(C.BENIGN_PREFIXES, "bpre"), F.lit("_"), (draw("bnum", 9000) + 1000).cast("string"), F.lit("_"), serial.cast("string"), F.lit("."), ext)


def ranked(df: DataFrame, by: list[str], digest: Column, key: str = "doc_id") -> DataFrame:
    """Adds _rn, the place of each row of its stratum in order of a hex digest, then key, and _n, the stratum's rows.

    No stratum is gathered: rows are numbered within buckets of the digest's first two
    digits, and the rows of the buckets before are added.
    """
    own = df.withColumn("_d", digest).withColumn("_b", F.substring("_d", 1, 2))
    counts = own.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(c).alias(f"_k{n}") for n, c in enumerate(by)], F.col("_b").alias("_kb"), before.alias("_before"), F.sum("_c").over(whole).alias("_n"))
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_d", key))
    out = own.withColumn("_r", place)
    same = F.col("_b") == F.col("_kb")
    for n, c in enumerate(by):
        same = same & out[c].eqNullSafe(F.col(f"_k{n}"))
    return out.join(counts, same).withColumn("_rn", F.col("_r") + F.col("_before")).drop("_d", "_b", "_r", "_before", "_kb", *[f"_k{n}" for n in range(len(by))])


def stratified_split(df: DataFrame, by: str = "animal", key: str = "doc_id", ratios: dict = C.SPLIT_RATIOS) -> DataFrame:
    """Adds split: per stratum, in order of a digest of the key, the shares round half to even; the rest is test."""
    out = ranked(df, [by], F.md5(F.col(key).cast("string").cast("binary")), key)
    n = F.col("_n").cast("double")
    train, val = F.rint(n * F.lit(ratios["train"])), F.rint(n * F.lit(ratios["validate"]))
    return out.withColumn("split", F.when(F.col("_rn") <= train, "train").when(F.col("_rn") <= train + val, "validate").otherwise("test")).drop("_rn", "_n")


def settled(df: DataFrame) -> DataFrame:
    """df behind a generator of one row: predicates above it refer to its columns instead of repeating what they are made of."""
    return df.select(F.inline_outer(F.array(F.struct(*df.columns))))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document without split: identity, category, name and caption.  No shuffle."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    listed = ", ".join(f"'{a}'" for a in ANIMALS)
    animal = F.expr(f"element_at(array({listed}), cast(doc_id % {len(ANIMALS)} as int) + 1)")
    out = with_sensitivity(docs.withColumn("serial", F.col("doc_id") + 1).withColumn("animal", animal))
    out = out.withColumn("feature_category", draw_category(draw("cat", 1000), F.col("species_sensitivity")))
    out = out.withColumn("ext", F.when(draw("fmt", 1000) < 120, "png").otherwise("jpg"))
    out = out.withColumn("parts", F.when(F.col("feature_category") == "multi", pick(MULTI, "multi")).when(F.col("feature_category").startswith("category_"), F.upper(F.substring("feature_category", 10, 1))).otherwise(""))
    kind = (
        F.when(F.col("feature_category") == "clean", "clean")
        .when(F.col("feature_category") == "hard_negative_d", "species_sensitive_clean")
        .when(F.col("feature_category") == "category_a", pick(META_TYPES, "meta"))
        .when(F.col("feature_category") == "category_b", "ocrtext")
        .when(F.col("feature_category") == "category_c", leaky_tag())
        .when(F.col("feature_category") == "category_e", "steganography")
        .otherwise(F.concat(F.lit("multi_"), F.lower("parts")))
    )
    out = out.withColumn("feature_type", kind)
    out = out.withColumn("filename", F.concat(F.translate("animal", " ", "_"), F.lit("_"), F.col("serial").cast("string"), F.lit("_"), F.col("feature_type"), F.lit("."), F.col("ext")))
    out = out.withColumn("caption", F.when(F.col("parts").contains("C"), leaky_caption(F.col("animal"))).otherwise(""))
    positive = ~F.col("feature_category").isin("clean", "hard_negative_d")
    return settled(out.withColumn("injected", positive).withColumn("risk_label", positive.cast("int")))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stratified_split(items(spark, sf_dir))
    return out.withColumn("image_id", F.concat("split", F.lit("_"), F.col("serial").cast("string")))


def signals(df: DataFrame) -> DataFrame:
    """Adds what a scan of each item would find: metadata flags, hit counts and stego figures."""
    a, b, e = (F.col("parts").contains(x) for x in "ABE")
    flags = C.METADATA_SCORE_FLAGS + ["has_datetime_original", "has_iptc_creator", "has_thumbnail", "description_contains_location", "keywords_contain_location"]
    cols = {f: a & (draw(f, 2) == 1) for f in flags}
    cols["ocr_gps_regex_match"] = b & (draw("ogps", 3) == 0)
    cols["ocr_camtrap_id_match"] = b & (draw("ocam", 3) == 0)
    cols["ocr_location_keyword_match"] = b & (draw("ozone", 3) == 0)
    cols["trailing_byte_count"] = F.when(e & (draw("tr", 10) < 7), draw("trn", 2801) + 200).otherwise(F.lit(0)).cast("long")
    cols["lsb_variance_score"] = F.when(e, F.lit(0.2)).otherwise((draw("lsb", 70) + 10).cast("double") / F.lit(100.0))
    cols["suspicious_png_chunk_count"] = F.when((F.col("ext") == "png") & e, draw("chunk", 3)).otherwise(F.lit(0)).cast("long")
    out = df.withColumns(cols)
    hits = sum((F.col(c).cast("int") for c in ("ocr_gps_regex_match", "ocr_camtrap_id_match", "ocr_location_keyword_match")), F.lit(0))
    return out.withColumns({"n_hits": hits, "trailing_byte_count_norm": F.least(F.col("trailing_byte_count").cast("double") / F.lit(5000.0), F.lit(1.0)), "species": context.species_key(F.col("animal"))})


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with signals and context features: all that the policy reads.  One scan, no shuffle."""
    out = signals(items(spark, sf_dir))
    return out.withColumns(context.filename_features(F.col("filename"))).withColumns(context.caption_features(F.col("caption")))


def probability() -> Column:
    """Stand-in for a fitted model, from context scores alone."""
    return F.least(F.lit(1.0), F.lit(0.05) + F.lit(0.9) * F.greatest("filename_leak_score", "caption_leak_score"))
