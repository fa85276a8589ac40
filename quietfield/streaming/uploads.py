"""Uploads as a stream: every micro-batch is sanitized and appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import containers, provenance
from ..sources import readers


def scan_batch(files: DataFrame) -> DataFrame:
    """Metadata flags and the sanitized file of each upload."""
    good = readers.checked(files).where("error is null")
    out = provenance.sanitize(good, stamp=F.col("modificationTime"))
    return out.withColumn("metadata", containers.metadata("content")).select("path", "length", "format", "metadata", "h0", "h1", "h2", "safe_name", "sanitized")


def start(spark: SparkSession, folder: str, table_path: str, checkpoint: str, once: bool = False):
    """Start the stream; with once it stops when what is there has been processed."""
    stream = readers.uploads(spark, folder)

    def sink(batch: DataFrame, _: int) -> None:
        scan_batch(batch).write.mode("append").parquet(table_path)

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
