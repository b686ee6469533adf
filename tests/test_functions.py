import datetime

import pytest
from pyspark.sql import functions as F

from rinkspark.functions import codecs, elo, hashes, text, vectors


def one(spark, column, **values):
    """The value of a column expression over one row of the given values."""
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(("raw", "inches", "cm"), [("6'2\"", 74, 188), ("5'11\"", 71, 180), ("6'0\"", 72, 183), ("6’4”", 76, 193), ("4ft. 20in.", 68, 173)])
def test_heights(spark, raw, inches, cm):
    h = codecs.parse_height(F.col("s"))
    assert one(spark, codecs.total_inches(h), s=raw) == inches
    assert one(spark, codecs.total_centimetres(h), s=raw) == cm


def test_no_height(spark):
    assert one(spark, codecs.parse_height(F.col("s")), s="tall") is None
    assert tuple(one(spark, codecs.parse_height(F.col("s")), s="4ft. 20in.")) == (5, 8)


@pytest.mark.parametrize(("slug", "want"), [("650210100002", (65, 0, 2, 10, 10, 0, 2)), ("652210100212", (65, 2, 2, 10, 10, 2, 12)), ("650312150304", (65, 0, 3, 12, 15, 3, 4))])
def test_slugs(spark, slug, want):
    assert tuple(one(spark, codecs.parse_slug(F.col("s")), s=slug)) == want
    made = codecs.format_slug(*[F.lit(x) for x in want])
    assert one(spark, made) == slug


def test_bad_slugs(spark):
    for slug in ("65021010000", "6502101000021", "x50210100002", "654210100002", "650410100002"):
        assert one(spark, codecs.parse_slug(F.col("s")), s=slug) is None
    assert one(spark, codecs.format_slug(*[F.lit(x) for x in (65, 2, 3, 5, 3, 9, 12)])) == "652305030912"
    with pytest.raises(Exception, match="too many digits"):
        one(spark, codecs.format_slug(*[F.lit(x) for x in (165, 2, 3, 5, 3, 9, 12)]))


def test_positions(spark):
    code = codecs.position_code(F.col("s"))
    assert [one(spark, code, s=x) for x in (" LW ", "goalie", "Right Defense", "F", "")] == [5, 0, 2, None, None]
    assert one(spark, codecs.is_defense(F.lit(0))) and one(spark, codecs.is_goalie(F.lit(0)))
    assert not one(spark, codecs.is_skater_defense(F.lit(0)))
    assert one(spark, codecs.position_long(F.lit(6))) == "Right Wing"


def test_leagues_and_types(spark):
    assert one(spark, codecs.league_id(F.lit("smjhl"))) == 1
    assert one(spark, codecs.league_id(F.lit("smjhl"), exact=True)) is None
    assert one(spark, codecs.nullable_league(F.lit(" "))) is None
    with pytest.raises(Exception, match="not a league"):
        one(spark, codecs.nullable_league(F.lit("NHL")))
    assert one(spark, codecs.resolved_game_type(F.lit("playoffs"), F.lit(None).cast("string"))) == 3
    with pytest.raises(Exception, match="no game type"):
        one(spark, codecs.resolved_game_type(F.lit("x"), F.lit("y")))
    assert one(spark, codecs.game_type_short(F.lit(2))) == "rs"


def test_payload_values(spark):
    assert one(spark, codecs.loose_date(F.lit("on 2024-3-7T"))) == datetime.date(2024, 3, 7)
    assert one(spark, codecs.loose_date(F.lit("2024-13-7"))) is None
    assert one(spark, codecs.loose_float(F.lit('"0.5"'))) == 0.5
    assert one(spark, codecs.flag(F.lit(-1))) and not one(spark, codecs.flag(F.lit(0)))
    assert one(spark, codecs.parse_colour(F.lit("#0a0B0c")))["blue"] == 12
    assert one(spark, codecs.text_colour(F.lit("#101010"), ["#202020", "#EEEEEE"])) == "#EEEEEE"
    assert one(spark, codecs.text_colour(F.lit("#FFFFFF"), ["#EEEEEE"])) == "#000000"


@pytest.mark.parametrize(("raw", "want"), [("rating: 12", 12), ("-3", -3), ("1o2", 12), ("l4", 14), ("I4", 14), ("|4", 14), ("S", 5), ("B", 8), ("Z", 2), ("O", 0), ("", None), ("abc", None), ("99999999999", None), ("4-2", 42)])
def test_loose_integers(spark, raw, want):
    assert one(spark, text.loose_integer(F.col("s")), s=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("3.5", 3.5), ("$775,000", 775000.0), ("243 LBS", 243.0), ("-1.25", -1.25), ("rating 2.75/5", 2.75), ("none", None)])
def test_loose_decimals(spark, raw, want):
    assert one(spark, text.loose_decimal(F.col("s")), s=raw) == want


def test_texts(spark):
    assert one(spark, text.normal_text(F.lit("  hello \n world "))) == "hello world"
    assert one(spark, text.normal_text(F.lit(None).cast("string"))) == ""
    assert tuple(one(spark, text.bio_line(F.lit("C  |  TEAM | x |  5' 11  -  190  LBS x")))) == ("C", 5, 11, 71, 190)
    assert one(spark, text.id_list(F.lit("3, x,1,3,,2"))) == [3, 1, 2]
    assert [tuple(x) for x in one(spark, text.bulk_tokens(F.lit("12\n\n Bob \r\n-3")))] == [(0, 12, None), (1, None, "Bob"), (2, None, "-3")]
    assert one(spark, text.split_pascal(F.lit("faceoffWinPct"))) == "faceoff Win Pct"
    long = one(spark, text.excerpt(F.lit("# Title\n\nSome **bold** [link](http://x) " + "word " * 60)))
    assert long.startswith("Some bold link word") and long.endswith("word…") and len(long) <= 201
    assert one(spark, text.csv_field(F.lit('a "b", c'))) == '"a ""b"", c"'
    assert one(spark, text.dot_string(F.lit('a"\\\n'))) == '"a\\"\\\\\\n"'
    assert one(spark, codecs.season_label(F.lit(None).cast("int"))) == "—"


def test_vectors(spark):
    v = F.array(*[F.lit(float(x)) for x in (3, -4, 0)])
    assert one(spark, vectors.l1_norm(v)) == 7 and one(spark, vectors.l2_norm(v)) == 5
    assert one(spark, vectors.normalised(v, "l2")) == [0.6, -0.8, 0]
    assert one(spark, vectors.normalised(F.array(F.lit(0.0)), "l1")) == [0]
    assert one(spark, vectors.squared_distance(v, F.array(*[F.lit(1.0)] * 3))) == 4 + 25 + 1
    bits = "1100" + "0" * 40 + "1"
    words = vectors.bit_string_words(F.lit(bits))
    assert one(spark, words) == [3, 1 << 12]
    assert one(spark, vectors.words_bit_string(words, F.lit(len(bits)))) == bits
    assert one(spark, vectors.hamming(F.array(F.lit(3), F.lit(1)), F.array(F.lit(1), F.lit(0)))) == 2


def test_elo(spark):
    even = elo.expected(F.lit(1000), F.lit(1000))
    k = elo.standard_factor(F.lit(1000), F.lit(0))
    assert one(spark, elo.updated(F.lit(1000), k, F.lit(1.0), even)) == 1050
    assert one(spark, elo.updated(F.lit(1000), k, F.lit(0.0), even)) == 950
    assert one(spark, elo.updated(F.lit(110), k, F.lit(0.0), F.lit(0.9))) == 100
    assert [one(spark, elo.standard_factor(F.lit(r), F.lit(g))) for r, g in ((1700, 29), (1700, 30), (1800, 0))] == [100, 50, 10]
    assert one(spark, elo.score_share(F.lit(0), F.lit(0))) == 0.5


def test_hashes(spark):
    def capture(attributes, numbers):
        m = lambda d, f: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, f(v))])
        return one(spark, hashes.capture_hash(m(attributes, int), m({"r": 1}, int), m(numbers, float)))

    assert capture({"a": 1, "b": 2}, {"w": 1}) == capture({"b": 2, "a": 1}, {"w": 1})
    assert capture({"a": 1, "b": 2}, {"w": 1}) != capture({"a": 1, "b": 3}, {"w": 1})
    assert one(spark, hashes.canonical_json(F.lit('{"b":1,"a":{"d":1,"c":[2,1]}}'))) == '{"a":{"c":[2,1],"d":1},"b":1}'
    assert one(spark, hashes.archive_hash(F.lit(None).cast("string"))) is None
