"""Named analysis flows: a registry, a runner with exit codes, and the flows."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark.functions.codecs import position_short
from rinkspark.functions.vectors import normalised
from rinkspark.operators import clusters, latest, lineage, recruitment
from rinkspark.operators.search import position_filter
from rinkspark.session import Dataset
from rinkspark.sources import writers
from rinkspark.sources.csv_in import read_csv

CSV, TABLES = "csv", "tables"


class FlowError(ValueError):
    """An argument or the data do not allow a flow to run."""


def parse_arguments(items: list[str]) -> dict[str, str]:
    """``key=value`` items; the first = splits, keys in any case, an empty or repeated key is an error."""
    out: dict[str, str] = {}
    for item in items:
        key, equals, value = item.partition("=")
        key = key.strip().lower()
        if not equals or not key:
            raise FlowError(f"not key=value: {item}")
        if key in out:
            raise FlowError(f"given twice: {key}")
        out[key] = value
    return out


@dataclass
class Context:
    """What a flow runs on: its rows or tables, its arguments and where reports go."""

    spark: SparkSession
    arguments: dict[str, str] = field(default_factory=dict)
    data: DataFrame | None = None
    tables: Dataset | None = None

    def integer(self, key: str, default: int | None = None) -> int:
        text = self.arguments.get(key)
        if text is None:
            if default is None:
                raise FlowError(f"{key} is required")
            return default
        try:
            return int(text)
        except ValueError:
            raise FlowError(f"{key} is not a whole number: {text}") from None


@dataclass(frozen=True)
class Flow:
    name: str
    about: str
    run: Callable[[Context], dict[str, DataFrame]]
    source: str = CSV


class Registry:
    """Flows by name, in any case; a name is registered once."""

    def __init__(self):
        self._flows: dict[str, Flow] = {}

    def add(self, flow: Flow) -> None:
        if flow.name.lower() in self._flows:
            raise FlowError(f"registered twice: {flow.name}")
        self._flows[flow.name.lower()] = flow

    def get(self, name: str) -> Flow | None:
        return self._flows.get(name.lower())

    def listed(self) -> list[tuple[str, str]]:
        return [(f.name, f.about) for _, f in sorted(self._flows.items())]


def run(registry: Registry, spark: SparkSession, name: str, arguments: list[str], source: str | None, out: str | None = None) -> int:
    """Runs a flow and writes its tables as CSV: 0 done, 1 failed, 130 interrupted."""
    try:
        flow = registry.get(name)
        if flow is None:
            raise FlowError(f"no such flow: {name}; there are {', '.join(n for n, _ in registry.listed())}")
        if not source:
            raise FlowError("an input is required")
        context = Context(spark, parse_arguments(arguments))
        if flow.source == CSV:
            context.data = read_csv(spark, source)
        else:
            context.tables = Dataset(spark, source)
        for table, df in flow.run(context).items():
            if out:
                writers.write_csv(df, f"{out}/{table}.csv")
            else:
                df.show(truncate=False)
        return 0
    except KeyboardInterrupt:
        return 130
    except (FlowError, OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


def kmeans_centroids(context: Context) -> dict[str, DataFrame]:
    """Centroid and medoid of each cluster, skaters and goaltenders apart; groups smaller than k are left out."""
    k = context.integer("k")
    if k < 1:
        raise FlowError(f"k has to be at least 1: {k}")
    seed = context.integer("seed", -1) if "seed" in context.arguments else None
    out = {}
    for group, prefix in (("skater", "skaterAttributes."), ("goaltender", "goaltenderAttributes.")):
        features = clusters.feature_columns(context.data, prefix)
        if not features:
            continue
        usable, _ = clusters.vectors(clusters.members(context.data, features), features)
        if usable.limit(k).count() < k:
            continue
        marked = clusters.clustered(usable, k, seed).persist()
        best = clusters.medoids(marked, len(features), "playerId", k)
        names = marked.select(F.col("playerId").alias("medoid"), F.col("name").alias("medoid_name"))
        centre = [F.col("centroid")[i].alias(f) for i, f in enumerate(features)]
        out[f"{group}-centroids"] = best.select("cluster", "members", *centre).orderBy("cluster")
        out[f"{group}-medoids"] = best.join(names, "medoid", "left").select("cluster", "members", "medoid", "medoid_name", "distance").orderBy("cluster")
    if not out:
        raise FlowError(f"no group has {k} members")
    return out


def player_summary(players: DataFrame) -> DataFrame:
    """(position, players, average_tpe) in order of position code, the average with one decimal."""
    by = players.groupBy("position").agg(F.count(F.lit(1)).alias("players"), F.avg(F.col("total_tpe").cast("double")).alias("_a"))
    return by.orderBy("position").select(position_short(F.col("position")).alias("position"), "players", F.format_string("%.1f", "_a").alias("average_tpe"))


def recruitment_tables(players: DataFrame, users: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, lineage totals) of the stored tables: one pass for the latest TPE, one for the owners."""
    tpe = latest.latest(events, ["player_id"], ["task_date"], ["total_tpe"]).withColumnRenamed("total_tpe", "latest_tpe")
    rows = latest.with_value(players, tpe, ["player_id"], "latest_tpe")
    members = users.select("name", F.col("user_id").alias("ordinal"))
    edges = recruitment.classified(recruitment.consolidated(rows), members)
    return edges, lineage.totals(edges)


def recruitment_flow(context: Context) -> dict[str, DataFrame]:
    """Tallies, summary, edges and the data of the charts."""
    t = context.tables
    edges, reached = recruitment_tables(t.player_information, t.users, t.tpe_events)
    tallies = recruitment.tallies(edges, reached)
    charts = {f"chart-{k}": v for k, v in writers.chart_data(tallies, context.integer("top", 20)).items()}
    ordered = edges.select("category", "recruiter_key", "user_id", "username", "career_tpe").orderBy("category", "recruiter_key", F.col("career_tpe").desc(), F.lower("username"), "user_id")
    return {"recruiters": recruitment.in_order(tallies), "summary": recruitment.summary(tallies), "edges": ordered, "graph": writers.dot_graph(edges)} | charts


def export_players(players: DataFrame, positions: str | None = None, norm: str = "none", attributes: str = "attributes") -> DataFrame:
    """Players by id, of some positions, with their stat vector normalised."""
    codes = position_filter(positions)
    out = players if codes is None else players.where(F.col("position").isin(codes))
    return out.withColumn(attributes, normalised(F.col(attributes), norm)).orderBy("player_id")


def centroid_recipe(players: DataFrame, k: int, positions: str, least_tpe: int = 250, seed: int = 1) -> DataFrame:
    """L1-normalised vectors of established players of some positions, clustered: the medoids."""
    rows = export_players(players, positions, "l1").where(F.col("total_tpe") >= least_tpe)
    marked = clusters.clustered(rows.withColumn("features", F.transform("attributes", lambda x: x.cast("float"))), k, seed)
    return clusters.medoids(marked, len(rows.first().attributes), "player_id", k)


def registry() -> Registry:
    out = Registry()
    out.add(Flow("kmeans-centroids", "Clusters players by stat vector: each cluster's centroid and medoid.", kmeans_centroids))
    out.add(Flow("player-summary", "Players and average TPE by position.", lambda c: {"summary": player_summary(c.tables.player_information)}, TABLES))
    out.add(Flow("recruitment", "Who recruited whom: tallies, lineage, graph and chart data.", recruitment_flow, TABLES))
    return out
