"""Content hashes, redaction and version keys."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _lines(prefix: str, values: Column) -> Column:
    entries = F.array_sort(F.map_entries(values))
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lit(f"{prefix}."), e["key"], F.lit("="), e["value"].cast("string"), F.lit("\n"))), "")


def capture_hash(attributes: Column, roles: Column, numbers: Column) -> Column:
    """SHA-256 of the sorted ``prefix.key=value`` lines; who was captured, and when, has no part in it."""
    parts = [F.coalesce(_lines(p, c), F.lit("")) for p, c in (("attr", attributes), ("role", roles))]
    return F.sha2(F.concat(*parts, F.coalesce(_number_lines("num", numbers), F.lit(""))), 256)


def _number_lines(prefix: str, values: Column) -> Column:
    # whole doubles are written without a fraction
    text = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    return F.array_join(F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(F.lit(f"{prefix}."), e["key"], F.lit("="), text(e["value"]), F.lit("\n"))), "")


def archive_hash(content: Column) -> Column:
    """SHA-256 as binary; no content, no hash."""
    return F.unhex(F.sha2(content, 256))


def redacted(value: Column) -> Column:
    """MD5 in upper-case hex, in place of personal data."""
    return F.upper(F.md5(value))


def version_key(last_updated: Column, request: Column) -> Column:
    """First eight bytes of the SHA-256 of version and request, in hex."""
    return F.substring(F.sha2(F.concat(last_updated, F.lit("|"), request), 256), 1, 16)


@F.pandas_udf(StringType())
def canonical_json(payload: pd.Series) -> pd.Series:
    """JSON with the keys of every object sorted, arrays in their order; null stays null."""
    return payload.map(lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False))
