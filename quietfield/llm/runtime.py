"""Session helpers for the corpus operators: shared scratch tables and components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS, HOT_KEYS = 256, 4096
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset (tests in local mode) a folder is made and set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = jdir.get() if jdir.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        where = "file://" + tempfile.mkdtemp(prefix="quietfield-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def named(column: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


@contextlib.contextmanager
def _tidied(spark: SparkSession):
    was = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY) if was is None else spark.conf.set(TIDY, was)


def table(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    tidy: what was shuffled for it is deleted once it is written, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _tidied(spark) if tidy else contextlib.nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def in_few_files(df: DataFrame, parts: int, together: int = 8) -> DataFrame:
    """df, of `parts` partitions, in fewer tasks: each does up to `together` of them one after another, holding one at a time.

    Every file written to a local folder starts a `chmod` or more, whose process shows for a moment as much memory as the
    JVM that it was forked from.
    """
    return df.coalesce(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-parts // together)))


def made() -> int:
    """How many tables there are so far."""
    return len(_made)


def release(begin: int, end: int) -> None:
    """Delete the tables made from begin up to end, when nothing is to be read from them any more."""
    for spark, path in _made[begin:end]:
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    release(0, len(_made))


def lookup(rows: DataFrame, of: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """rows joined with of, whose keys are unique, where a few keys may hold most rows.

    Keys with more than a 4,096th of the rows are 4,096 at most, so what belongs to them is
    broadcast; the others meet by key.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    total = rows.count()
    hot = table(counts.where(F.col("_rows") > max(HOT_ROWS, total // HOT_KEYS)).select(*keys), "hot")
    if hot.isEmpty():
        return rows.join(of, keys, how)
    some = F.broadcast(hot)
    few = F.broadcast(of.join(some, keys, "left_semi"))
    return rows.join(some, keys, "left_semi").join(few, keys, how).unionByName(rows.join(some, keys, "left_anti").join(of, keys, how))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b) as (node, component), component the smallest node.

    Alternating large-star and small-star steps; every step is an aggregate and a
    look-up by node, written to the shared folder.  No list of neighbours is gathered; a
    node with very many gets their least one by broadcast.  Nodes without an edge do
    not appear.  Ends when a pair of steps changes nothing (of the order of log n).
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = table(e, "edges")

    def state(df: DataFrame):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    was = state(e)
    for _ in range(rounds):
        if was[0] == 0:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = lookup(both, low, ["a"], "inner").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = table(large, "edges")
        small = lookup(large, large.groupBy("a").agg(F.min("b").alias("m")), ["a"], "inner")
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        e = table(small, "edges")
        now = state(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), F.least("a", "component").alias("component"))
