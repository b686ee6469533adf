"""Search: optional predicates joined by and, sorting with a unique last key, paging, autocomplete."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkspark import schemas
from rinkspark.functions.text import match_rank

PAGE_SIZE = 25
LARGEST_PAGE = 100


def contains(columns: Iterable[str], term: str | None) -> Column | None:
    """Any of the columns holds the trimmed term, in any case; a null column never does."""
    if not term or not term.strip():
        return None
    low = term.strip().lower()
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(low)) for c in columns])


def one_of(column: str, values: Iterable | None) -> Column | None:
    """The column is among the values; a null column never is; no values is no predicate."""
    values = list(dict.fromkeys(values or []))
    return F.col(column).isNotNull() & F.col(column).isin(values) if values else None


def equal(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == F.lit(value)


def between(column: str, least=None, most=None) -> Column | None:
    """Bounds are inclusive; a missing one doesn't count."""
    parts = ([F.col(column) >= least] if least is not None else []) + ([F.col(column) <= most] if most is not None else [])
    return reduce(lambda a, b: a & b, parts) if parts else None


def positions(column: str, codes: Iterable[str] | None) -> Column | None:
    """Short or long position names; unknown ones are ignored, and if none is known there is no predicate."""
    known = {form.lower(): code for code, forms in schemas.POSITIONS.items() for form in forms}
    return one_of(column, [known[c.strip().lower()] for c in codes or [] if c.strip().lower() in known])


def position_filter(spec: str | None) -> list[int] | None:
    """Codes of a comma-separated list of positions or the groups F and D; none for a blank list.

    Tokens that are neither raise an error that names all of them.
    """
    if not spec or not spec.strip():
        return None
    known = {form.lower(): [code] for code, forms in schemas.POSITIONS.items() for form in forms}
    known |= {"f": [4, 5, 6], "d": [1, 2]}
    tokens = [t.strip() for t in spec.split(",") if t.strip()]
    if wrong := [t for t in tokens if t.lower() not in known]:
        raise ValueError(f"not a position: {', '.join(wrong)}")
    return list(dict.fromkeys(code for t in tokens for code in known[t.lower()]))


def filtered(df: DataFrame, predicates: Iterable[Column | None]) -> DataFrame:
    """All predicates that are there, as one condition that reaches the scan."""
    given = [p for p in predicates if p is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def ordered(df: DataFrame, key: str | Column, descending: bool = False, last: str = "id") -> DataFrame:
    """By ``key``, nulls lowest, and by the unique ``last``, ascending."""
    key = F.col(key) if isinstance(key, str) else key
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), F.col(last).asc())


def page(df: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 1) of an ordered frame; the size is held within 1 and 100."""
    size = min(max(size, 1), LARGEST_PAGE)
    return df.offset((max(number, 1) - 1) * size).limit(size)


def search(df: DataFrame, predicates: Iterable[Column | None], key: str | Column, last: str, descending: bool = False, number: int = 1, size: int = PAGE_SIZE) -> tuple[DataFrame, DataFrame]:
    """(one page, the total as one row ``total``) of the rows that all predicates hold for."""
    found = filtered(df, predicates)
    return page(ordered(found, key, descending, last), number, size), found.agg(F.count(F.lit(1)).alias("total"))


def id_or_name(id_column: str, name_column: str, key: str) -> Column:
    """A whole number is an id, anything else an exact name."""
    return F.col(id_column) == int(key) if key.strip().lstrip("-").isdigit() else F.col(name_column) == key


def gated(df: DataFrame, column: str, allowed: bool) -> DataFrame:
    """``df`` with a private column emptied unless it is allowed."""
    return df if allowed else df.withColumn(column, F.lit(None).cast(df.schema[column].dataType))


def autocomplete(df: DataFrame, term: str | None, limit: int, name: str, username: str | None, last: str) -> DataFrame:
    """The best matches: by place of the term, then name in any case; a blank term gives the first names."""
    if limit <= 0:
        return df.limit(0)
    by = [F.lower(F.col(name)), F.col(last)]
    if not term or not term.strip():
        return df.orderBy(*by).limit(limit)
    rank = match_rank(term.strip(), F.col(name), F.col(username) if username else None)
    return df.withColumn("match_rank", rank).where("match_rank is not null").orderBy("match_rank", *by).limit(limit)


# Keys that a profile's players are sorted by, and their columns.
PROFILE_KEYS = {
    "created": "creation_time",
    "name": "name",
    "status": "status",
    "position": "position",
    "tpe": "total_tpe",
    "bank": "bank_balance",
    "season": "draft_season",
    "league": "current_league",
}


def profile_ordered(players: DataFrame, key: str = "created", descending: bool = True, last: str = "player_id") -> DataFrame:
    """A user's players by one of eight keys, the newest first unless another is given; names in any case."""
    if key not in PROFILE_KEYS:
        raise ValueError(f"not a sort key: {key}")
    column = F.col(PROFILE_KEYS[key])
    return ordered(players, F.lower(column) if key == "name" else column, descending, last)


def to_query_string(values: Mapping[str, object], defaults: Mapping[str, list[str]], every: str = "all") -> str:
    """The way back from ``from_query_string``: keys at their default are left out, an emptied default is ``every``."""
    from urllib.parse import urlencode

    out: list[tuple[str, str]] = []
    for key, value in values.items():
        given = [str(v) for v in (value if isinstance(value, (list, tuple)) else [] if value is None else [value])]
        if given != list(defaults.get(key, [])):
            out += [(key, v) for v in given or [every]]
    return urlencode(out)


def from_query_string(query: str, defaults: Mapping[str, list[str]], every: str = "all") -> dict[str, list[str]]:
    """Values of a query string by lower-cased key; a key not given has its default, ``every`` means no filter."""
    from urllib.parse import parse_qsl

    given: dict[str, list[str]] = {}
    for key, value in parse_qsl(query.lstrip("?"), keep_blank_values=True):
        given.setdefault(key.lower(), []).append(value)
    out = {k: list(v) for k, v in defaults.items()} | given
    return {k: [] if every in [x.lower() for x in v] else v for k, v in out.items()}
