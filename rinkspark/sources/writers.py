"""Text reports: RFC 4180 CSV with a BOM, JSON, DOT graphs, chart data, captures stored once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.functions.text import csv_field, dot_string
from rinkspark.operators import export


def csv_lines(df: DataFrame) -> DataFrame:
    """(line) of each row, quoted where needed, in the frame's order."""
    fields = [csv_field(F.col(f"`{c}`").cast("string")) for c in df.columns]
    return df.select(F.concat_ws(",", *fields).alias("line"))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"' if any(c in name for c in '",\r\n') else name


def _write_merged(lines: DataFrame, path: str, head: str, end: str, between: bool = False, tail: str = "") -> None:
    """One file of all lines, in the frame's order: tasks write parts, and the file system joins their bytes.

    ``end`` follows every line, or stands between two of them. Parts are written beside the file under
    Spark's commit protocol and go once it is whole; where a task fails, nothing is left of either.
    """
    spark = lines.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mark = uuid.uuid4().hex
    target, parts, whole = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.parts-{mark}", f"{path}.whole-{mark}"))
    fs = target.getFileSystem(conf)
    fs.setWriteChecksum(False)
    try:
        lines.select("line").write.option("lineSep", end).text(parts.toString())
        out = fs.create(whole, True)
        out.write(head.encode())
        named = [f for f in fs.listStatus(parts) if f.getPath().getName().startswith("part-") and f.getLen()]
        named.sort(key=lambda f: int(f.getPath().getName().split("-")[1].split(".")[0]))
        for i, part in enumerate(named):
            read = fs.open(part.getPath())
            last = between and i == len(named) - 1
            some = jvm.org.apache.commons.io.input.BoundedInputStream(read, part.getLen() - len(end.encode())) if last else read
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(some, out, conf, False)
            read.close()
        out.write(tail.encode())
        out.close()
        fs.delete(target, False)
        if not fs.rename(whole, target):
            raise OSError(f"{path} can't be replaced")
    finally:
        fs.delete(parts, True)
        fs.delete(whole, False)
        fs.setWriteChecksum(True)


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a BOM and CRLF line ends; rows are written in parallel."""
    _write_merged(csv_lines(df), path, "\ufeff" + ",".join(map(_quoted, df.columns)) + "\r\n", "\r\n")


def export_csv(df: DataFrame, path: str, ordinal: str) -> None:
    """Flattened rows by ``ordinal``; columns as rows first have them, those without values left out."""
    flat = export.flattened(df)
    columns = export.seen_columns(flat, ordinal)
    write_csv(flat.orderBy(ordinal).select(*[F.col(f"`{c}`") for c in columns if c != ordinal]), path)


def json_lines(df: DataFrame) -> DataFrame:
    """(line): each row as an object, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


def _indented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [json.dumps(json.loads(x), indent=2, ensure_ascii=False) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["line"])


def write_json(df: DataFrame, path: str, pretty: bool = False) -> None:
    """An array of objects, in the frame's order; rows are written, and indented, by the tasks."""
    lines = json_lines(df)
    if pretty:
        _write_merged(lines.mapInArrow(_indented, "line string"), path, "[\n", ",\n", True, "\n]")
    else:
        _write_merged(lines, path, "[", ",", True, "]")


def dot_graph(edges: DataFrame, name: str = "recruitment", directed: bool = True) -> DataFrame:
    """(ordinal, line): a node a recruiter and member, an edge with the member's TPE."""
    arrow = " -> " if directed else " -- "
    node = lambda c: dot_string(F.col(c))
    nodes = edges.select(F.col("recruiter_key").alias("n")).union(edges.select("username")).distinct()
    head = edges.sparkSession.createDataFrame([(0, "", ("digraph " if directed else "graph ") + name + " {"), (3, "", "}")], "part int, key string, line string")
    body = nodes.select(F.lit(1).alias("part"), F.col("n").alias("key"), F.concat(F.lit("  "), node("n"), F.lit(";")).alias("line"))
    lines = edges.select(F.lit(2).alias("part"), F.concat_ws("\u0001", "recruiter_key", "username").alias("key"), F.concat(F.lit("  "), node("recruiter_key"), F.lit(arrow), node("username"), F.lit(" [label="), dot_string(F.col("career_tpe").cast("string")), F.lit("];")).alias("line"))
    return head.unionByName(body).unionByName(lines).orderBy("part", "key")


def write_lines(lines: DataFrame, path: str) -> None:
    _write_merged(lines, path, "", "\n")


def chart_data(tallies: DataFrame, top: int = 20) -> dict[str, DataFrame]:
    """What the bar charts show: the leading recruiters by three measures, and the categories."""
    named = tallies.where(F.col("category") != 3)
    best = lambda by: named.orderBy(F.col(by).desc(), F.lower("recruiter_key"), "category").limit(top)
    return {by: best(by) for by in ("users", "tpe", "lineage_tpe") if by in tallies.columns} | {"categories": tallies.groupBy("category").agg(F.sum("users").alias("users"))}


def stored_once(new: DataFrame, store: DataFrame, key: str, order: Iterable[str]) -> DataFrame:
    """New rows whose content hash the store lacks, the first of each; the rest are duplicates."""
    rest = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*").select(*new.columns)
    return first.join(store.select(key), key, "left_anti").select(*new.columns)


def write_seasons(ratings: DataFrame, path: str) -> None:
    """Ratings as Parquet by league and season; the seasons in the frame are replaced, others stay."""
    partitions = ratings.repartition("league_id", "season")
    partitions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("league_id", "season").parquet(path)
