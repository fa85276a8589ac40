"""Golden cases of names and captions, and redaction."""

import pytest
from pyspark.sql import functions as F

from quietfield.functions import context, redact

GOLDEN = [
    ("IMG_4092.jpg", None, 0.02, 0.0, (False, False, False, False)),
    ("tiger_bandipur_zone3.jpg", None, 0.67, 0.0, (True, False, False, False)),
    ("antelope_5km_from_checkpoint.jpg", None, 0.47, 0.0, (True, True, False, False)),
    ("photo.jpg", "Spotted 2 km from the Bandipur checkpost", 0.12, 0.87, (False, False, True, True)),
    ("photo.jpg", "Beautiful morning in the forest", 0.12, 0.0, (False, False, False, False)),
    (None, "at 12.9716, 77.5946 today", 0.12, 0.45, (False, False, False, False)),
    ("giraffe.png", "", 0.57, 0.0, (True, False, False, False)),
    ("zone 4.png", "", 0.52, 0.0, (True, False, False, False)),
]


def test_golden_scores(spark):
    df = spark.createDataFrame([g[:2] for g in GOLDEN], "f string, c string")
    out = df.select(*[v.alias(k) for k, v in (context.filename_features(F.col("f")) | context.caption_features(F.col("c"))).items()]).collect()
    for row, (_, _, name, caption, flags) in zip(out, GOLDEN, strict=True):
        assert row.filename_leak_score == pytest.approx(name) and row.caption_leak_score == pytest.approx(caption)
        assert (row.filename_has_location_keyword, row.filename_has_distance_pattern, row.caption_has_location_keyword, row.caption_has_distance_pattern) == flags


def test_stem_entropy_species(spark):
    df = spark.createDataFrame([("a.b.jpg",), (".hidden",), ("..x",), ("noext",), ("",), ("x.",)], "f string")
    got = [tuple(r) for r in df.select(context.stem(F.col("f")), F.round(context.entropy(context.stem(F.col("f"))), 6)).collect()]
    assert [g[0] for g in got] == ["a.b", ".hidden", "..x", "noext", "", "x"]
    assert got[4][1] == 0.0 and got[0][1] == pytest.approx(1.584963)
    keys = spark.createDataFrame([(" Snow_Leopard ",), (None,), ("",)], "s string").select(context.species_key(F.col("s"))).collect()
    assert [k[0] for k in keys] == ["snow leopard", "unknown", "unknown"]


def test_redaction(spark):
    df = spark.createDataFrame([("Spotted this tiger 2 km from the Bandipur core zone checkpost",), (None,), ("",), ("giraffe in the garden",)], "c string")
    got = [r[0] for r in df.select(redact.redact_caption(F.col("c"))).collect()]
    assert got == ["Spotted this tiger [REDACTED DISTANCE] the [REDACTED LOCATION] core [REDACTED] [REDACTED]", "", "", "[REDACTED LOCATION]affe in the gar[REDACTED]"]


def test_names_and_boxes(spark):
    df = spark.createDataFrame([("a.JPG",), ("a.tar.gif",), ("png",), ("x.jpeg",)], "n string")
    assert [r[0] for r in df.select(redact.allowed_file(F.col("n"))).collect()] == [True, False, False, True]
    lit = F.lit
    row = spark.range(1).select(redact.padded_box(lit(2), lit(3), lit(30), lit(40), lit(35), lit(100)).alias("a"), redact.padded_box(lit(0), lit(0), lit(0), lit(0), lit(9), lit(9)).alias("b"), redact.random_safe_filename(lit("PNG")).alias("n")).first()
    assert tuple(row.a) == (0, 0, 35, 49, 15) and row.b is None
    assert row.n.startswith("sanitized_") and row.n.endswith(".png") and len(row.n) == len("sanitized_20240101_000000_abcdef.png")
