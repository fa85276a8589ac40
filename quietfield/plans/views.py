"""What a report shows of an item: a projection of scored bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def analysis_view(scored: DataFrame, factors: Column) -> DataFrame:
    """Score with two digits and as a share of 100, decision, the category grid and what was found."""
    return scored.select(
        "doc_id",
        "filename",
        "decision",
        F.round("risk_score", 2).alias("risk_score"),
        (F.col("risk_score") / 100.0).alias("ring"),
        F.map_from_entries(F.transform("verdicts", lambda v: F.struct(v["category"], v["level"]))).alias("grid"),
        factors.alias("factors"),
        F.col("decision").isin("SANITIZE", "QUARANTINE").alias("sanitize_now"),
        (F.col("decision") == "REVIEW").alias("ask"),
    )


def provenance_status(verified: Column) -> Column:
    """NO PROVENANCE, VALID or COMPROMISED from a verification struct."""
    return F.when(~verified["provenance_found"], "NO PROVENANCE").when(verified["valid"], "VALID").otherwise("COMPROMISED")
