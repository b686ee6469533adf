"""Text parsers: recognised screen text, id lists, excerpts, ranks of matches, quoting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that recognition confuses with digits, in order, and the digits.
CONFUSABLE = "lI|![]OQSBZGT"
MEANT = "1111110058267"


def trimmed(text: Column) -> Column:
    """Without any white space at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normal_text(text: Column) -> Column:
    """Trimmed, runs of white space as one blank; null as empty."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def loose_integer(text: Column) -> Column:
    """Digits of recognised text after mending confusable letters.

    A minus counts only before any digit; without a digit, or beyond 32 bits, the result is null.
    """
    mended = F.translate(text, CONFUSABLE, MEANT)
    digits = F.regexp_replace(mended, r"[^0-9]", "")
    sign = F.when(mended.rlike(r"^[^0-9]*-[^0-9]*[0-9]"), "-").otherwise("")
    return F.when(digits != "", F.concat(sign, digits).try_cast("int"))


def loose_decimal(text: Column) -> Column:
    """The first number, thousands separators dropped."""
    return F.replace(F.regexp_extract(text, r"-?\d[\d,]*(\.\d+)?", 0), F.lit(","), F.lit("")).try_cast("double")


def bio_line(text: Column) -> Column:
    """Struct (position, feet, inches, total_inches, weight) of ``C | … | 5' 11 - 190 LBS``."""
    position = F.nullif(F.trim(F.regexp_extract(text, r"^([^|]*)\|", 1)), F.lit(""))
    feet, inches = (F.regexp_extract(text, r"(\d+)\s*['’]\s*(\d+)", g).try_cast("int") for g in (1, 2))
    weight = F.regexp_extract(text, r"(?i)(\d+)\s*LBS", 1).try_cast("int")
    return F.struct(position.alias("position"), feet.alias("feet"), inches.alias("inches"), (feet * 12 + inches).alias("total_inches"), weight.alias("weight"))


def split_pascal(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", " ")


def id_list(text: Column) -> Column:
    """The integers of a comma-separated list, each once, in order; other tokens are dropped."""
    numbers = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda x: x.isNotNull()))


def bulk_tokens(text: Column) -> Column:
    """Array of (ordinal, id, name): one token a line; positive integers are ids, others names."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: trimmed(x)), lambda x: x != "")
    number = lambda x: F.when(x.try_cast("int") > 0, x.try_cast("int"))
    return F.transform(lines, lambda x, i: F.struct(i.alias("ordinal"), number(x).alias("id"), F.when(number(x).isNull(), x).alias("name")))


def match_rank(term: str, name: Column, username: Column | None = None) -> Column:
    """0 name starts with the term, 1 username does, 2 name holds it, 3 username does; else null."""
    low = term.lower()
    at_name = F.locate(low, F.lower(name))
    at_user = F.locate(low, F.lower(username)) if username is not None else F.lit(0)
    inside = 2 if username is not None else 1
    rank = F.when(at_name == 1, 0)
    if username is not None:
        rank = rank.when(at_user == 1, 1)
    rank = rank.when(at_name > 0, inside)
    return rank.when(at_user > 0, 3) if username is not None else rank


def excerpt(markdown: Column, most: int = 200) -> Column:
    """Plain text without the title, cut at the last blank within ``most`` characters."""
    body = F.regexp_replace(markdown, r"(?m)\A\s*#\s.*$", "")
    body = F.regexp_replace(body, r"!\[[^\]]*\]\([^)]*\)", " ")
    body = F.regexp_replace(body, r"\[([^\]]*)\]\([^)]*\)", "$1")
    body = F.regexp_replace(body, r"(?m)^\s{0,3}(#{1,6}|>|[-*+]|\d+\.)\s+", "")
    body = normal_text(F.regexp_replace(body, r"<[^>]*>|[*_`~]+", ""))
    head = F.substring(body, 1, most)
    cut = F.when(F.locate(" ", head) > 0, F.regexp_replace(head, r"\s+\S*$", "")).otherwise(head)
    return F.when(F.char_length(body) <= most, body).otherwise(F.concat(cut, F.lit("…")))


def csv_field(text: Column) -> Column:
    """Quoted only if it holds a quote, a comma or a line break; null as empty."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\r\n]'), quoted).otherwise(text), F.lit(""))


def dot_string(text: Column) -> Column:
    """A quoted string of the DOT language."""
    escaped = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def is_username(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9._]{2,32}$")


def holds_anchors(texts: Column, anchors: Column) -> Column:
    """Whether each anchor's expected text is in the recognised text of the same place, in any case."""
    pairs = F.arrays_zip(texts.alias("seen"), anchors.alias("expected"))
    return F.forall(pairs, lambda p: F.contains(F.lower(F.coalesce(p["seen"], F.lit(""))), F.lower(p["expected"])))


def short_date(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def long_date(moment: Column) -> Column:
    return F.date_format(moment, "MMMM d, yyyy")


def short_date_time(moment: Column) -> Column:
    """In the session's time zone, with a twelve-hour clock."""
    return F.date_format(moment, "M/d/yyyy h:mm a")
