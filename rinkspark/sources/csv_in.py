"""CSV in: columns from the header, all text, empty fields null, ragged rows tolerated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The file's rows. A missing file, an empty one and a blank header are errors; a BOM is not."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(path)
    head = spark.read.text(path).limit(1).collect()
    if not head:
        raise ValueError(f"{path} is empty")
    if not head[0].value.lstrip("﻿").strip(", \t"):
        raise ValueError(f"{path} has no header")
    options = {"header": "true", "inferSchema": "false", "mode": "PERMISSIVE", "quote": '"', "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false"}
    df = spark.read.options(**options).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
