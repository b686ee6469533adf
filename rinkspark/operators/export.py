"""Export shapes: nested rows flattened, constant columns dropped, attributes as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark.functions.codecs import total_inches
from rinkspark.functions.text import split_pascal


def _leaves(schema: T.StructType, before: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    out = []
    for f in schema.fields:
        path = (*before, f.name)
        out += _leaves(f.dataType, path) if isinstance(f.dataType, T.StructType) else [(path, f.dataType)]
    return out


def flattened(df: DataFrame) -> DataFrame:
    """Structs as dotted columns, arrays and maps as JSON text, the rest as it is."""

    def column(path: tuple[str, ...], kind: T.DataType) -> Column:
        c = F.col(".".join(f"`{p}`" for p in path))
        return (F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType)) else c).alias(".".join(path))

    return df.select(*[column(*leaf) for leaf in _leaves(df.schema)])


def player_records(df: DataFrame, height: str = "height") -> DataFrame:
    """Players as exports have them: the height is one number of inches, other structs are flattened."""
    return flattened(df.withColumn(height, total_inches(F.col(height))))


def seen_columns(df: DataFrame, ordinal: str) -> list[str]:
    """Columns that any row has a value in, in the order in which rows by ``ordinal`` first have one."""
    rest = [c for c in df.columns if c != ordinal]
    first = df.agg(*[F.min(F.when(F.col(f"`{c}`").isNotNull(), F.col(ordinal))).alias(f"c{i}") for i, c in enumerate(rest)]).first()
    seen = [(first[f"c{i}"], i, c) for i, c in enumerate(rest) if first[f"c{i}"] is not None]
    return [c for _, _, c in sorted(seen)]


def without_fields(df: DataFrame, struct: str, names: list[str]) -> DataFrame:
    """A struct column without fields that are the same for all, such as the mental attributes."""
    return df.withColumn(struct, F.col(struct).dropFields(*names))


def unpivoted(df: DataFrame, keys: list[str], values: list[str], exclude: tuple[str, ...] = ()) -> DataFrame:
    """(keys, name, label, value): one row an attribute, the label its name in words."""
    kept = [v for v in values if v not in exclude]
    long = df.unpivot(keys, [F.col(f"`{v}`").cast("double").alias(v) for v in kept], "name", "value") if kept else df.limit(0)
    return long.select(*keys, "name", split_pascal(F.concat(F.upper(F.substring("name", 1, 1)), F.substring("name", 2, 1000))).alias("label"), "value")


def grouped_attributes(long: DataFrame, categories: DataFrame) -> DataFrame:
    """Attribute rows with the category of a literal dimension (name, category); others have none."""
    return long.join(F.broadcast(categories), "name", "left")


def union_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def page_meta(df: DataFrame, name: str, subtitle: str, tpe: str) -> DataFrame:
    """(title, description) of a player's page."""
    return df.select(F.col(name).alias("title"), F.format_string("%s, %s TPE", F.col(subtitle), F.format_number(tpe, 0)).alias("description"))
