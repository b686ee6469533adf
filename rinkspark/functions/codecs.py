"""Codes and labels: positions, leagues, game types, statuses, slugs, heights, dates, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rinkspark import schemas


def mapped(key: Column, pairs: dict) -> Column:
    """The value of ``key`` in a literal dimension, null where it isn't there."""
    items = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.try_element_at(F.create_map(*items), key)


def required(value: Column, given: Column, what: str) -> Column:
    """``value``, or an error that names what ``given`` is not."""
    return F.when(value.isNull() & given.isNotNull(), F.raise_error(F.concat(F.lit(f"not a {what}: "), given.cast("string"))).cast("string")).otherwise(value.cast("string"))


def _fold(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


# positions: bit 0 left, bit 1 right, bit 2 forward; no bit at all is the goalie
def position_code(text: Column) -> Column:
    forms = {form.lower(): code for code, names in schemas.POSITIONS.items() for form in names}
    return mapped(_fold(text), forms)


def position_short(code: Column) -> Column:
    return mapped(code, {k: v[0] for k, v in schemas.POSITIONS.items()})


def position_long(code: Column) -> Column:
    return mapped(code, {k: v[1] for k, v in schemas.POSITIONS.items()})


def is_forward(code: Column) -> Column:
    return code.bitwiseAND(4) != 0


def is_defense(code: Column) -> Column:
    """Not a forward; the goalie counts, see ``is_skater_defense``."""
    return ~is_forward(code)


def is_left(code: Column) -> Column:
    return code.bitwiseAND(1) != 0


def is_right(code: Column) -> Column:
    return code.bitwiseAND(2) != 0


def is_goalie(code: Column) -> Column:
    return is_defense(code) & ~is_left(code) & ~is_right(code)


def is_skater_defense(code: Column) -> Column:
    return is_defense(code) & ~is_goalie(code)


# leagues
def league_id(text: Column, exact: bool = False) -> Column:
    """Code of an abbreviation; any case unless ``exact``, null if unknown."""
    forms = {abbr: code for code, (abbr, _) in schemas.LEAGUE_CODES.items()}
    return mapped(text if exact else F.upper(text), forms)


def league_abbreviation(code: Column) -> Column:
    return mapped(code, {k: v[0] for k, v in schemas.LEAGUE_CODES.items()})


def league_name(code: Column) -> Column:
    return mapped(code, {k: v[1] for k, v in schemas.LEAGUE_CODES.items()})


def nullable_league(text: Column) -> Column:
    """Blank is no league; anything else must be an abbreviation, or the query fails."""
    blank = text.isNull() | (F.trim(text) == "")
    return F.when(blank, F.lit(None).cast("int")).otherwise(required(league_id(text, exact=True), text, "league").cast("int"))


# game types
def game_type_id(text: Column) -> Column:
    return mapped(F.lower(text), {label.lower(): code for code, (label, _) in schemas.GAME_TYPES.items()})


def game_type_label(code: Column) -> Column:
    return mapped(code, {k: v[0] for k, v in schemas.GAME_TYPES.items()})


def game_type_short(code: Column) -> Column:
    return mapped(code, {k: v[1] for k, v in schemas.GAME_TYPES.items()})


def player_status_id(text: Column) -> Column:
    return mapped(F.lower(text), {v.lower(): k for k, v in schemas.PLAYER_STATUS.items()})


def player_status_label(code: Column) -> Column:
    return mapped(code, schemas.PLAYER_STATUS)


def task_status(text: Column) -> Column:
    """The label in its own case, whatever case it came in."""
    return mapped(F.lower(text), {v.lower(): v for v in schemas.TASK_STATUS})


def handedness_id(text: Column) -> Column:
    return mapped(F.lower(text), {v.lower(): k for k, v in schemas.HANDEDNESS.items()})


# game slugs: season 2, league 1, type 1, day 2, month 2, home 2, away 2 digits
_SLUG = (("season", 1, 2), ("league_id", 3, 1), ("game_type", 4, 1), ("day", 5, 2), ("month", 7, 2), ("home_team_id", 9, 2), ("away_team_id", 11, 2))


def parse_slug(slug: Column) -> Column:
    """Struct of a slug's numbers; null unless it is twelve digits with a known league and type."""
    parts = [F.substring(slug, at, n).cast("int").alias(name) for name, at, n in _SLUG]
    league, kind = F.substring(slug, 3, 1), F.substring(slug, 4, 1)
    return F.when(slug.rlike(r"^[0-9]{12}$") & league.isin("0", "1", "2", "3") & kind.isin("1", "2", "3"), F.struct(*parts))


def format_slug(season: Column, league: Column, kind: Column, day: Column, month: Column, home: Column, away: Column) -> Column:
    """The slug of its numbers; a number with too many digits is an error, a null gives null."""
    numbers = (season, league, kind, day, month, home, away)
    fits = [x.between(0, 10**n - 1) for x, (_, _, n) in zip(numbers, _SLUG)]
    ok = fits[0]
    for f in fits[1:]:
        ok = ok & f
    text = F.concat(*[F.lpad(x.cast("string"), n, "0") for x, (_, _, n) in zip(numbers, _SLUG)])
    return F.when(ok, text).when(~ok, F.raise_error(F.lit("a slug's number has too many digits")).cast("string"))


def resolved_game_type(text: Column, slug: Column) -> Column:
    """The label's code, else the slug's; neither is an error."""
    found = F.coalesce(game_type_id(text), parse_slug(slug)["game_type"])
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no game type: "), F.coalesce(text, F.lit("")))).cast("int"))


def game_ending(played: Column, overtime: Column, shootout: Column) -> Column:
    return F.when(~played, None).when(overtime, "Overtime").when(shootout, "Shootout").when(played, "Regulation")


def game_ending_short(ending: Column) -> Column:
    return mapped(ending, schemas.GAME_ENDINGS)


def game_text(away: Column, home: Column, date: Column, away_score: Column, home_score: Column, ending: Column) -> Column:
    """``away @ home on date: a-h OT``."""
    short = F.coalesce(game_ending_short(ending), F.lit(""))
    line = F.format_string("%s @ %s on %s: %d-%d", away, home, F.date_format(date, "yyyy-MM-dd"), away_score, home_score)
    return F.when(short == "", line).otherwise(F.concat(line, F.lit(" "), short))


# heights
_HEIGHT = r"(?i)(\d+)(ft\.?|'|’)\s*(\d+)(in\.?|\"|”)"


def parse_height(text: Column) -> Column:
    """Struct of feet and inches under twelve; null where no height is found."""
    feet, inches = (F.regexp_extract(text, _HEIGHT, g).try_cast("int") for g in (1, 3))
    return F.when(text.rlike(_HEIGHT), F.struct((feet + F.floor(inches / 12)).cast("int").alias("feet"), (inches % 12).alias("inches")))


def total_inches(height: Column) -> Column:
    return height["feet"] * 12 + height["inches"]


def total_centimetres(height: Column) -> Column:
    """Rounded half to even."""
    return F.bround(total_inches(height) * 2.54, 0).cast("int")


# payload values
def loose_date(text: Column) -> Column:
    """The first ``year-month-day`` in the text, digits not padded; null where it is no date."""
    part = [F.regexp_extract(text, r"(\d+)-(\d+)-(\d+)", g).try_cast("int") for g in (1, 2, 3)]
    padded = F.format_string("%04d-%02d-%02d", *part)
    return F.when(text.rlike(r"\d+-\d+-\d+"), F.try_to_timestamp(padded, F.lit("yyyy-MM-dd")).cast("date"))


def flag(number: Column) -> Column:
    """Any number but zero is true."""
    return number != 0


def loose_float(text: Column) -> Column:
    """A number, or a number in a string."""
    return F.regexp_replace(text, r'^\s*"|"\s*$', "").try_cast("float")


def is_goaltender_json(payload: Column) -> Column:
    return payload.rlike(r'"[bB]locker"\s*:')


def is_skater_json(payload: Column) -> Column:
    return payload.rlike(r'"[cC]hecking"\s*:')


def hex_colour(red: Column, green: Column, blue: Column) -> Column:
    return F.format_string("#%02X%02X%02X", red, green, blue)


def parse_colour(text: Column) -> Column:
    """Struct of red, green and blue of ``#RRGGBB``."""
    part = [F.conv(F.substring(text, at, 2), 16, 10).cast("int").alias(n) for n, at in (("red", 2), ("green", 4), ("blue", 6))]
    return F.when(text.rlike(r"^#[0-9A-Fa-f]{6}$"), F.struct(*part))


def text_colour(background: Column, candidates: list[str], least: float = 4.5) -> Column:
    """The first candidate with enough contrast to the background, else black or white by contrast."""

    def luminance(rgb: Column) -> Column:
        linear = lambda x: F.when(x / 255 <= 0.03928, x / 255 / 12.92).otherwise(F.pow((x / 255 + 0.055) / 1.055, F.lit(2.4)))
        return 0.2126 * linear(rgb["red"]) + 0.7152 * linear(rgb["green"]) + 0.0722 * linear(rgb["blue"])

    def contrast(other: Column) -> Column:
        a, b = luminance(parse_colour(background)), luminance(parse_colour(other))
        return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)

    fallback = F.when(contrast(F.lit("#000000")) >= contrast(F.lit("#FFFFFF")), "#000000").otherwise("#FFFFFF")
    return F.coalesce(*[F.when(contrast(F.lit(c)) >= least, c) for c in candidates], fallback)


def season_label(season: Column) -> Column:
    return F.coalesce(F.concat(F.lit("S"), season.cast("string")), F.lit("—"))
