"""Sinks: manifests and files."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_manifest(df: DataFrame, path: str, kind: str = "parquet", append: bool = False) -> None:
    """CSV with header, JSON lines or Parquet (by split and animal, so that reads prune)."""
    w = df.write.mode("append" if append else "overwrite")
    if kind == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif kind == "json":
        w.json(path)
    else:
        w.partitionBy("split", "animal").parquet(path)


def write_files(df: DataFrame, root: str, name: str = "name", content: str = "content") -> DataFrame:
    """Write each row's bytes to root/name from the tasks; gives name, bytes written.  root must be mounted everywhere.

    A file is written under another name and moved, so a task that runs twice leaves one whole file.
    """

    def run(frames):
        for pdf in frames:
            sizes = []
            for n, body in zip(pdf["name"], pdf["content"], strict=True):
                target = os.path.join(root, *[p for p in n.split("/") if p not in ("", "..")])
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(f"{target}.{os.getpid()}.part", "wb") as f:
                    f.write(body)
                os.replace(f"{target}.{os.getpid()}.part", target)
                sizes.append(len(body))
            yield pd.DataFrame({"name": pdf["name"], "bytes": sizes})

    return df.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInPandas(run, "name string, bytes long")


def relocate(df: DataFrame, root: str, source: str = "path", name: str = "name") -> DataFrame:
    """Move each file to root/name, from the tasks; gives name and whether it was moved.

    Both places must be mounted everywhere.  A file that is gone already, as when a task
    runs twice, counts as moved if it stands at its new place.
    """

    def run(frames):
        for pdf in frames:
            done = []
            for at, n in zip(pdf["source"], pdf["name"], strict=True):
                old, new = at.removeprefix("file:").replace("//", "/"), os.path.join(root, *[p for p in n.split("/") if p not in ("", "..")])
                os.makedirs(os.path.dirname(new), exist_ok=True)
                try:
                    os.replace(old, new)
                except OSError:
                    pass
                done.append(os.path.exists(new) and not os.path.exists(old))
            yield pd.DataFrame({"name": pdf["name"], "moved": done})

    return df.select(F.col(source).alias("source"), F.col(name).alias("name")).mapInPandas(run, "name string, moved boolean")
