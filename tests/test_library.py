"""Policy, text tokens, data sets, metrics, models, sources, sinks and the stream."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quietfield import constants as C
from quietfield.functions import containers as K
from quietfield.functions import ocr, policy
from quietfield.operators import datasets, metrics, models, vector
from quietfield.plans import simulate
from quietfield.sources import readers, writers
from quietfield.streaming import uploads

FLAGS = [*C.METADATA_SCORE_FLAGS, "has_thumbnail", "description_contains_location", "keywords_contain_location", "ocr_gps_regex_match", "ocr_camtrap_id_match", "filename_has_location_keyword", "filename_has_distance_pattern", "caption_has_location_keyword", "caption_has_distance_pattern"]


def bundle(spark, **kw):
    base = dict.fromkeys(FLAGS, False) | {"n_hits": 0, "filename_leak_score": 0.0, "caption_leak_score": 0.0, "species_sensitivity": 0.4, "lsb_variance_score": 0.0, "trailing_byte_count": 0, "trailing_byte_count_norm": 0.0, "suspicious_png_chunk_count": 0, "species": "unknown"}
    return spark.createDataFrame([base | kw])


@pytest.mark.parametrize(("kw", "p", "decision", "score"), [
    ({}, 0.0, "SAFE", 8.0),
    ({"has_gps": True}, 0.0, "REVIEW", 30.0),
    ({"filename_leak_score": 1.0}, 1.0, "SANITIZE", 88.0),
    ({"filename_leak_score": 1.0, "species_sensitivity": 0.95}, 1.0, "QUARANTINE", 99.0),
    ({"species_sensitivity": 0.5, "filename_leak_score": 0.5}, 0.0, "REVIEW", 30.0),
    ({"filename_leak_score": 0.75, "species_sensitivity": 0.0}, 1.0, "REVIEW", 70.0),
])
def test_decisions(spark, kw, p, decision, score):
    r = policy.evaluate(bundle(spark, **kw), F.lit(p)).first()
    assert r.decision == decision and r.risk_score == pytest.approx(score)


def test_levels_and_factors(spark):
    df = bundle(spark, has_gps=True, has_gps_altitude=True, has_camera_make=True, has_owner_name=True, has_serial_number=True, n_hits=1, trailing_byte_count=700, trailing_byte_count_norm=0.14, lsb_variance_score=0.61, suspicious_png_chunk_count=1, species="tiger", species_sensitivity=0.95)
    r = policy.evaluate(df, F.lit(0.5)).first()
    assert [(v.category, v.level) for v in r.verdicts] == [("metadata", "HIGH"), ("ocr", "HIGH"), ("context", "NONE"), ("species", "HIGH"), ("stego", "MEDIUM")]
    hits = F.array(F.struct(F.lit("camera_trap_id").alias("label"), F.lit("CAM-1").alias("text")))
    assert df.select(policy.factors(hits)).first()[0] == ["GPS_EXIF", "GPS_DETAIL", "CAMERA", "SERIAL", "OWNER", "OCR_CAMERA:CAM-1", "TRAILING_BYTES:700", "LSB_PATTERN", "ODD_CHUNKS", "SPECIES:tiger"]


def test_tokens(spark):
    rows = [("i", 0, 0, "CAM-123", 90.0, 10, 10, 50, 12), ("i", 1, 0, "cam-123", 20.0, 12, 13, 50, 12), ("i", 0, 1, " ", 5.0, 0, 0, 1, 1), ("i", 0, 2, "ZONE", -1.0, 100, 10, 40, 12), ("i", 0, 3, "4", 70.0, 145, 11, 9, 12), ("j", 0, 0, "12°34'56.7\"N", 50.0, 5, 5, 90, 12)]
    df = spark.createDataFrame(rows, "image_id string, psm_order int, seq int, text string, conf double, x int, y int, w int, h int")
    read = {r.image_id: r for r in ocr.per_image(ocr.dedupe(df)).withColumn("hits", ocr.hits(F.col("raw_text"))).collect()}
    assert read["i"].raw_text == "CAM-123 ZONE 4" and read["i"].num_text_boxes == 3 and read["i"].mean_confidence == 80.0
    assert [tuple(h) for h in read["i"].hits] == [("camera_trap_id", "CAM-123"), ("zone_marker", "ZONE 4")]
    assert [h.label for h in read["j"].hits] == ["gps_coordinate_stamp"]
    box = ocr.per_image(ocr.dedupe(df)).where("image_id = 'i'").select(ocr.locate(F.col("tokens"), F.lit("ZONE 4")).alias("a"), ocr.locate(F.col("tokens"), F.lit("nowhere at all here now")).alias("b")).first()
    assert box.a == [100, 10, 54, 13] and box.b == [0, 0, 0, 0]
    out = ocr.features(spark.createDataFrame([("i",), ("k",)], "image_id string"), df)
    got = {r.image_id: r for r in out.collect()}
    assert got["i"].ocr_camtrap_id_match and got["i"].ocr_suspicious_token_count_norm == 0.4 and not got["k"].ocr_text_detected
    off = ocr.features(spark.createDataFrame([("i",)], "image_id string"), df, F.lit(False)).first()
    assert not off.ocr_text_detected and off.hits == []


def test_split_cap_serial(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 100, "a").when(F.col("id") < 197, "b").otherwise("c").alias("animal"))
    out = simulate.stratified_split(df)
    counts = {(r.animal, r.split): r["count"] for r in out.groupBy("animal", "split").count().collect()}
    assert counts[("a", "train")] == 70 and counts[("a", "validate")] == 15 and counts[("b", "train")] == round(97 * 0.7) and counts[("c", "train")] == 2
    capped = datasets.stratified_cap(out.withColumn("feature_category", F.col("animal")), 40)
    assert 38 <= capped.count() <= 40
    assert datasets.stratified_cap(out.withColumn("feature_category", F.col("animal")), 1000).count() == 200
    serial = [r.serial for r in datasets.with_serial(out, ["split", "doc_id"], [F.col("split"), F.floor(F.col("doc_id") / 20)]).orderBy("split", "doc_id").collect()]
    assert serial == list(range(1, 201))


def test_metrics(spark):
    r = np.random.default_rng(1)
    y, s = r.integers(0, 2, 300), np.round(r.random(300), 1)
    df = spark.createDataFrame([(int(a), float(b), int(b >= 0.5)) for a, b in zip(y, s, strict=True)], "y int, score double, pred int")
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert metrics.roc_auc(df).first().auc == pytest.approx(want)
    one = spark.createDataFrame([(1, 0.5, 0)], "y int, score double, pred int")
    assert metrics.roc_auc(one).first().auc is None
    m = metrics.binary_metrics(one).first()
    assert (m.accuracy, m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0, 0.0)
    rep = {x["class"]: x for x in metrics.classification_report(df).collect()}
    assert rep["weighted avg"].support == 300 and rep["macro avg"].f1 == pytest.approx((rep["0"].f1 + rep["1"].f1) / 2)
    assert metrics.class_weight(spark.createDataFrame([(0,)] * 3, "y int")).first().scale_pos_weight == pytest.approx(3 * 1.15)


def test_model(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 10 / 10).alias("a"), (F.col("id") % 7 / 7).alias("b"), (F.col("id") % 10 >= 5).cast("int").alias("risk_label"))
    model = models.train(df, ["a", "b"], trees=3, depth=2)
    out = metrics.binary_metrics(models.predict(model, df).withColumnRenamed("risk_label", "y")).first()
    assert out.accuracy == 1.0 and models.importances(model)[0][0] == "a"
    model.write().overwrite().save(str(tmp_path / "m"))
    assert models.load(str(tmp_path / "m")).stages[0].getInputCols() == ["a", "b"]
    (tmp_path / "bad" / "metadata").mkdir(parents=True)
    (tmp_path / "bad" / "metadata" / "part-00000").write_text("nonsense")
    with pytest.raises(models.ModelMissing):
        models.load(str(tmp_path / "none"))
    with pytest.raises(models.ModelCorrupt):
        models.load(str(tmp_path / "bad"))
    with pytest.raises(RuntimeError):
        models.check_vector(df)
    assert models.rows_in_budget(90, 1.0) == 4590 and models.rows_in_budget(1, 10) == 200


def test_sources_sinks_stream(spark, tmp_path):
    root = tmp_path / "animals"
    for name in ("tiger/a.PNG", "tiger/b.jpg", "fox/c.jpeg", "fox/d.txt", "merged/e.png", "deep/x/f.png"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if name.endswith("b.jpg") else K.encode_png(np.zeros((8, 8, 3))))
    got = readers.checked(readers.pictures(spark, str(root))).select("species", "format", "error").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("tiger", "PNG", None), ("fox", "PNG", None)]))
    bad = readers.checked(spark.createDataFrame([(bytearray(b""),), (bytearray(b"GIF89a"),)], "content binary")).select("error").collect()
    assert [r.error for r in bad] == ["EMPTY", "FORMAT"]
    assert readers.merged(spark, str(root)).count() == 1 and readers.merged(spark, str(tmp_path / "other")).count() == 0
    assert readers.first_existing(spark, None, str(tmp_path / "no"), str(root)) == str(root)
    rows = spark.createDataFrame([("train_1", "o", "n", "fox", "train", "clean", "clean", False, '{"a": "x, \\"y\\""}', 0, 0.3, None)], readers.MANIFEST)
    for kind in ("csv", "json", "parquet"):
        writers.write_manifest(rows, str(tmp_path / kind), kind)
        back = readers.manifest(spark, str(tmp_path / kind), kind).first()
        assert back.caption == "" and back.injection_parameters == '{"a": "x, \\"y\\""}' and back.animal == "fox"
    (tmp_path / "s.json").write_text('{\n "tiger": 0.95,\n "unknown": 0.4}')
    assert {tuple(r) for r in readers.species_table(spark, str(tmp_path / "s.json")).collect()} == {("tiger", 0.95), ("unknown", 0.4)}
    (tmp_path / "p.json").write_text('{"thresholds": {"safe_max": 30, "review_max": 70, "quarantine_min": 90}, "weights": {"model_probability": 0.4, "deterministic_signals": 0.4, "species_sensitivity": 0.2}}')
    assert readers.policy(spark, str(tmp_path / "p.json")) == C.POLICY
    files = readers.pictures(spark, str(root)).where("length > 0").select(F.concat("species", F.lit("/out.png")).alias("name"), "content")
    assert writers.write_files(files, str(tmp_path / "out")).count() == 2 and os.path.exists(tmp_path / "out/fox/out.png")
    q = uploads.start(spark, str(root / "tiger"), str(tmp_path / "table"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    done = spark.read.parquet(str(tmp_path / "table"))
    assert done.count() == 1 and done.first().format == "PNG"


def test_vector_order(spark):
    files = spark.createDataFrame([("a", "tiger_zone3.png", "", "tiger", bytearray(K.encode_png(np.full((8, 8, 3), 1))))], "image_id string, filename string, caption string, animal string, content binary")
    tokens = spark.createDataFrame([], "image_id string, psm_order int, seq int, text string, conf double, x int, y int, w int, h int")
    out = vector.feature_vector(files, tokens)
    assert out.columns == ["image_id", *C.FEATURES] and len(C.FEATURES) == 47
    row = out.first()
    assert row.species_sensitivity == 0.95 and row.lsb_mean_deviation == 1.0 and row.filename_leak_score == pytest.approx(0.22)
    assert all(v is not None and not math.isnan(v) for v in row[1:])


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["analyse_decisions", "strong_evidence_override", "flagged_factors", "stratified_cap", "mixed_union", "caption_redaction", "ocr_hits", "lsb_score", "verify_status", "tamper_detection", "roc_auc", "document_redaction", "conversation_caption_scores", "global_serial", "stratified_split", "gps_decimal", "ocr_bbox", "ocr_redaction_boxes", "exif_gps_decode", "injected_fields"])
def test_queries_match_sql(spark, name):
    from quietfield import catalog

    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
