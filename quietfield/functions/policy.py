"""Policy: category verdicts, blended score, decision and the codes of what was found."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .udf import arrow_udf


def level(score: Column, category: str) -> Column:
    high, medium = C.LEVELS[category]
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").when(score > 0, "LOW").otherwise("NONE")


def category_scores() -> dict[str, Column]:
    """Scores from the columns of a bundle (flags, hit count, context, species and stego columns)."""
    flags = sum((F.col(f).cast("int") for f in C.METADATA_SCORE_FLAGS), F.lit(0))
    return {
        "metadata": flags.cast("double") / F.lit(10.0),
        "ocr": F.when(F.col("n_hits") > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
        "context": F.greatest("filename_leak_score", "caption_leak_score"),
        "species": F.col("species_sensitivity"),
        "stego": F.greatest(F.col("lsb_variance_score"), F.least(F.col("trailing_byte_count_norm") * F.lit(1.2), F.lit(1.0))),
    }


def verdicts() -> Column:
    """Array of (category, level, score), in the order metadata, ocr, context, species, stego."""
    out = []
    for name, score in category_scores().items():
        lv = F.when(F.col("n_hits") > 0, "HIGH").otherwise("NONE") if name == "ocr" else level(score, name)
        out.append(F.struct(F.lit(name).alias("category"), lv.alias("level"), score.alias("score")))
    return F.array(*out)


def signal() -> Column:
    s = category_scores()
    return F.greatest(s["metadata"], s["ocr"], s["context"], s["stego"])


def blended(probability: Column, cfg: dict = C.POLICY) -> Column:
    part = F.lit(cfg["w_model"]) * probability + F.lit(cfg["w_signal"]) * signal() + F.lit(cfg["w_species"]) * F.col("species_sensitivity")
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), part * F.lit(100.0)))


def decide(score: Column, cfg: dict = C.POLICY) -> Column:
    return F.when(score >= cfg["quarantine_min"], "QUARANTINE").when(score > cfg["review_max"], "SANITIZE").when(score >= cfg["safe_max"], "REVIEW").otherwise("SAFE")


def strong_evidence() -> Column:
    return F.col("has_gps") | F.col("ocr_gps_regex_match") | F.col("ocr_camtrap_id_match")


def evaluate(df, probability: Column, cfg: dict = C.POLICY):
    """df with p, signal_score, base_decision, risk_score, decision (after the override) and verdicts."""
    out = df.withColumn("p", probability).withColumn("signal_score", signal())
    out = out.withColumn("blended_score", blended(F.col("p"), cfg)).withColumn("base_decision", decide(F.col("blended_score"), cfg))
    lift = strong_evidence() & (F.col("base_decision") == "SAFE")
    out = out.withColumn("overridden", lift)
    out = out.withColumn("decision", F.when(F.col("overridden"), "REVIEW").otherwise(F.col("base_decision")))
    return out.withColumn("risk_score", F.when(F.col("overridden"), F.greatest(F.col("blended_score"), F.lit(cfg["safe_max"]))).otherwise(F.col("blended_score"))).withColumn("verdicts", verdicts())


@arrow_udf("double")
def shown(score: pd.Series) -> pd.Series:
    """Scores with two digits, rounded as their binary value lies: 2.675 is a little less than it looks and gives 2.67."""
    return score.map(lambda x: None if x is None or x != x else round(float(x), 2))


def factors(hits: Column | None = None) -> Column:
    """Codes of the evidence present, in fixed order; hits is an array of (label, text), one code each."""
    hit = hits if hits is not None else F.expr("cast(array() as array<struct<label:string,text:string>>)")
    name = F.create_map(F.lit("gps_coordinate_stamp"), F.lit("OCR_GPS:"), F.lit("camera_trap_id"), F.lit("OCR_CAMERA:"), F.lit("zone_marker"), F.lit("OCR_MARKER:"))
    c = F.col

    def one(flag, code):
        return F.when(flag, code if isinstance(code, Column) else F.lit(code))

    before = F.array(
        one(c("has_gps"), "GPS_EXIF"),
        one(c("has_gps_altitude") | c("has_gps_timestamp"), "GPS_DETAIL"),
        one(c("has_camera_make") | c("has_camera_model"), "CAMERA"),
        one(c("has_serial_number"), "SERIAL"),
        one(c("has_owner_name"), "OWNER"),
        one(c("description_contains_location") | c("keywords_contain_location"), "METADATA_WORDING"),
        one(c("has_thumbnail"), "THUMBNAIL"),
    )
    after = F.array(
        one(c("filename_has_location_keyword"), "FILENAME_LOCATION"),
        one(c("filename_has_distance_pattern"), "FILENAME_DISTANCE"),
        one(c("caption_has_location_keyword") | c("caption_has_distance_pattern"), "CAPTION_LOCATION"),
        one(c("trailing_byte_count") > 0, F.concat(F.lit("TRAILING_BYTES:"), c("trailing_byte_count").cast("string"))),
        one(c("lsb_variance_score") > 0.6, "LSB_PATTERN"),
        one(c("suspicious_png_chunk_count") > 0, "ODD_CHUNKS"),
        one(c("species_sensitivity") >= 0.7, F.concat(F.lit("SPECIES:"), c("species"))),
    )
    return F.filter(F.concat(before, F.transform(hit, lambda h: F.concat(F.element_at(name, h["label"]), h["text"])), after), lambda x: x.isNotNull())
