"""Analysis with a fitted model: the vector of each item, the model's probability, then the policy."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import policy
from ..operators import models


def analyse(vectors: DataFrame, bundles: DataFrame, model: PipelineModel, key: str = "image_id") -> DataFrame:
    """bundles scored by the policy with the model's probability for the vector of the same key.

    A bundle without a vector is left out, as an item that could not be read is.
    """
    names = model.stages[0].getInputCols()
    models.check_vector(vectors, names)
    scored = models.predict(model, vectors.select(key, *names)).select(key, F.col("p").alias("_p"))
    return policy.evaluate(bundles.join(scored, key), F.col("_p")).drop("_p")


