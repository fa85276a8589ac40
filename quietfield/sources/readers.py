"""Sources: picture folders, manifests, tables of configuration, uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C

MANIFEST = (
    "image_id string, original_path string, new_path string, animal string, split string, feature_category string, "
    "feature_type string, injected boolean, injection_parameters string, risk_label int, species_sensitivity double, caption string"
)
UPLOAD = "path string, modificationTime timestamp, length long, content binary"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, *paths: str | None) -> str | None:
    """The first of the candidate folders that exists."""
    return next((p for p in paths if p and _exists(spark, p)), None)


def pictures(spark: SparkSession, root: str, excluded: tuple = ("merged",)) -> DataFrame:
    """Files one folder below root with a picture extension in any case: path, species (the folder), length, content.

    Empty folders give no rows, and Spark's scan passes over empty files.  content is read only if it is selected.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    base = root.rstrip("/").split("/")[-1]
    species = F.element_at(parts, -2)
    keep = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(C.IMAGE_EXTENSIONS) & (F.element_at(parts, -3) == base) & ~F.lower(species).isin(*excluded)
    return files.where(keep).select("path", species.alias("species"), "length", "content")


def merged(spark: SparkSession, root: str, name: str = "merged") -> DataFrame:
    """Pictures of the folder of mixed ones: explicit, nested or next to root; no rows without it."""
    where = first_existing(spark, name if "/" in name else None, f"{root}/{name}", f"{root.rstrip('/').rsplit('/', 1)[0]}/{name}")
    if where is None:
        return spark.createDataFrame([], "path string, length long, content binary")
    files = spark.read.format("binaryFile").load(where)
    return files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(C.IMAGE_EXTENSIONS)).select("path", "length", "content")


def checked(files: DataFrame) -> DataFrame:
    """Adds format, sniffed from the content, and error for what is empty or neither JPEG nor PNG."""
    jpeg = F.substring("content", 1, 2) == F.unhex(F.lit("FFD8"))
    png = F.substring("content", 1, 8) == F.unhex(F.lit("89504E470D0A1A0A"))
    fmt = F.when(jpeg, "JPEG").when(png, "PNG")
    error = F.when(F.col("content").isNull() | (F.octet_length("content") == 0), "EMPTY").when(fmt.isNull(), "FORMAT")
    return files.withColumn("format", fmt).withColumn("error", error)


def manifest(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    reader = spark.read.schema(MANIFEST)
    df = reader.csv(path, header=True, multiLine=True, escape='"') if kind == "csv" else reader.json(path) if kind == "json" else reader.parquet(path)
    return df.na.fill("", ["caption"])


def with_files(rows: DataFrame, files: DataFrame, path: str = "new_path") -> tuple[DataFrame, DataFrame]:
    """Manifest rows with format and content of their file, and, apart, the rows without a usable one and why.

    Paths meet without their scheme.  A row's error is MISSING, EMPTY or FORMAT.
    """
    bare = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    own = checked(files).select(bare(F.col("path")).alias("_path"), "content", "format", "error")
    both = rows.withColumn("_path", bare(F.col(path))).join(own, "_path", "left")
    both = both.withColumn("error", F.when(F.col("format").isNull(), F.coalesce("error", F.lit("MISSING"))))
    return both.where("error is null").drop("_path", "error"), both.where("error is not null").select(*rows.columns, "error")


def species_table(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of species and sensitivity as rows."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,double>")).alias("species", "sensitivity"))


def policy(spark: SparkSession, path: str) -> dict:
    schema = "thresholds struct<safe_max:double,review_max:double,quarantine_min:double>, weights struct<model_probability:double,deterministic_signals:double,species_sensitivity:double>"
    r = spark.read.schema(schema).json(path, multiLine=True).first()
    return {"safe_max": r.thresholds.safe_max, "review_max": r.thresholds.review_max, "quarantine_min": r.thresholds.quarantine_min, "w_model": r.weights.model_probability, "w_signal": r.weights.deterministic_signals, "w_species": r.weights.species_sensitivity}


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """A stream of new files in a folder, within the size limit."""
    return spark.readStream.format("binaryFile").schema(UPLOAD).load(path).where(F.col("length") <= C.UPLOAD_LIMIT)
