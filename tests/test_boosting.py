"""Boosted trees made in one job against Spark's own trainer, and the queries over them."""

import os

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quietfield import catalog
from quietfield.operators import boosting, models

SF = os.environ.get("ENTRY_SF_DIR", "/root/testdata/sf0.001")
NAMES = [f"f{i}" for i in range(8)]


@pytest.fixture(scope="module")
def rows(spark):
    kinds = [0, 0, 2, 2, 3, 5, 40, 1]
    df = spark.range(0, 700, 1, 3).select("id", *[(F.rand(i) if k == 0 else (F.rand(i) * k).cast("int")).alias(f"f{i}") for i, k in enumerate(kinds)], F.rand(99).alias("r"))
    return df.withColumn("risk_label", (F.col("f0") + F.col("f1") * F.col("f2") + F.col("f5") / 5 + F.col("r") > 1.7).cast("int")).drop("r").cache()


def _jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("tasks", [1, 2])
def test_same_trees_as_sparks_trainer_when_nothing_is_drawn(spark, rows, tasks):
    setup = GBTClassifier(maxIter=6, maxDepth=4, stepSize=0.06, weightCol="weight", seed=42)
    together = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows).withColumn("label", F.col("risk_label").cast("double")).withColumn("weight", F.when(F.col("risk_label") == 1, 1.7).otherwise(1.0))
    want, got = setup.fit(together), boosting.fit(rows, NAMES, "risk_label", 1.7, 700, setup, tasks)
    assert got.treeWeights == want.treeWeights and got.extractParamMap() == want.extractParamMap()
    told = [{r.id: r.rawPrediction[1] for r in m.transform(together).select("id", "rawPrediction").collect()} for m in (want, got)]
    assert len(told[1]) == 700 and told[1] == pytest.approx(told[0], abs=1e-9)
    assert list(got.featureImportances.toArray()) == pytest.approx(list(want.featureImportances.toArray()), abs=0.01)


def test_jobs_do_not_grow_with_trees(spark, rows):
    few, n = _jobs(spark, "few", lambda: models.train(rows, NAMES, trees=2))
    many, m = _jobs(spark, "many", lambda: models.train(rows, NAMES, trees=60))
    assert (len(few.stages[-1].trees), len(many.stages[-1].trees)) == (2, 60)
    assert m <= n + 5
    again = models.train(rows, NAMES, trees=60)
    assert again.stages[-1].toDebugString.split("\n", 1)[1] == many.stages[-1].toDebugString.split("\n", 1)[1]


def test_what_cannot_be_learnt_from_is_refused(spark, rows):
    with pytest.raises(ValueError, match="no rows"):
        models.train(rows.where("id < 0"), NAMES, trees=2)
    for bad in (rows.withColumn("f1", F.when(F.col("id") != 9, F.col("f1"))), rows.withColumn("f1", F.when(F.col("id") == 9, F.lit(float("nan"))).otherwise(F.col("f1")))):
        with pytest.raises(Exception, match="null or nan"):
            models.train(bad, NAMES, trees=2)
    with pytest.raises(Exception, match="labels are 0 or 1"):
        models.train(rows.withColumn("risk_label", F.when(F.col("id") == 9, 2).otherwise(F.col("risk_label"))), NAMES, trees=2)


def test_one_class_and_columns_without_bins(spark, rows):
    model = models.train(rows.where("risk_label = 1"), ["f7"], trees=3)
    assert {r.pred for r in models.predict(model, rows).select("pred").collect()} == {1}


def test_thresholds_by_weight():
    import numpy as np

    assert boosting.thresholds(np.array([1.0, 2.0, 4.0]), np.ones(3), 31).tolist() == [1.5, 3.0]
    assert boosting.thresholds(np.arange(8.0), np.ones(8), 3).tolist() == [1.5, 3.5, 5.5]


def test_every_item_is_analysed_in_few_jobs(spark):
    catalog._fitted.clear()
    catalog._vectors.clear()
    ids = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    out, jobs = _jobs(spark, "analysed", lambda: catalog.queries()["analyse_with_model"](spark, SF).collect())
    assert sorted(r.doc_id for r in out) == sorted(ids) and jobs < 100
    own = catalog._labelled(spark, SF, "train").unionByName(catalog._labelled(spark, SF, "held out"))
    whole = catalog.queries()["feature_vector_47"](spark, SF)
    assert own.drop("split", "risk_label").exceptAll(whole).count() == 0 and own.count() == whole.count()


def test_importances_parse_no_picture_but_those_learnt_from(spark):
    catalog._fitted.clear()
    catalog._vectors.clear()
    top, jobs = _jobs(spark, "top", lambda: catalog.queries()["importance_topk"](spark, SF).collect())
    assert [r.place for r in top] == list(range(1, 11)) and jobs < 60
    assert [k[2] for k in catalog._vectors] == ["train"]


def test_every_row_is_measured_from_tables(spark):
    out = catalog.queries()["gbt_train_eval"](spark, SF)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().toString()  # vectors are not planned anew for each split
    measured = {r.split: r.n for r in out.collect()}
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert measured["mixed"] == n and sum(measured.values()) == 2 * n


def test_a_jpeg_with_overlong_amplitudes_is_broken():
    import numpy as np

    from quietfield.functions import jpeg

    data = bytearray(jpeg.encode_jpeg(np.arange(256, dtype=np.uint8).reshape(16, 16), 90))
    at = data.find(b"\xff\xc4")
    first = at + 5 + 16  # the first DC symbol
    data[first] = 200
    assert jpeg.decode_jpeg(bytes(data)) is None
