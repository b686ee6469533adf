"""Session factory and dataset resolver."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", name: str = "rinkspark", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use underscores for dots."""
    builder = SparkSession.builder.master(master).appName(name)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"}
    for key, value in (fixed | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoints(spark: SparkSession) -> None:
    """Sets the folder that lineage is cut off in: the one that the session names, or where all runs in one process a local one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or "/tmp/checkpoints")


class Dataset:
    """Named tables of one folder: ``data.orders`` or ``data["orders"]``, read when asked for.

    A folder may hold Parquet files or folders ``<name>.parquet``, or CSV files ``<name>.csv`` whose
    columns all stay text.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "parquet"):
        if kind not in ("parquet", "csv"):
            raise ValueError(f"unknown kind of dataset: {kind}")
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind

    def __getitem__(self, name: str) -> DataFrame:
        if self.kind == "csv":
            from rinkspark.sources.csv_in import read_csv

            return read_csv(self.spark, f"{self.path}/{name}.csv")
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __iter__(self) -> Iterator[str]:
        return (n.removesuffix(f".{self.kind}") for n in sorted(os.listdir(self.path)) if n.endswith(f".{self.kind}"))

    def views(self) -> None:
        """Registers every table under its name for ``spark.sql``."""
        for name in self:
            self[name].createOrReplaceTempView(name)
