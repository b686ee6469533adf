"""Files as tables: dated Markdown documents, JSON templates and profiles, raw pages, images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(slug, date, title, body) of the ``*.md`` files, newest first, then by title in any case.

    The date is the yyyyMMdd that starts the file's name, the title the first top heading.
    """
    files = spark.read.text(f"{path}/*.md", wholetext=True).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    date = F.try_to_timestamp(F.regexp_extract("file", r"^(\d{8})", 1), F.lit("yyyyMMdd")).cast("date")
    out = files.select(F.regexp_replace("file", r"\.md$", "").alias("slug"), date.alias("date"), F.trim(F.regexp_extract("value", r"(?m)^#\s+(.+)$", 1)).alias("title"), F.col("value").alias("body"))
    return out.orderBy(F.col("date").desc_nulls_last(), F.lower("title"))


def templates(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, label, words) of a JSON list of {label, bits}."""
    from rinkspark.functions.vectors import bit_string_words

    # one small document: its order is kept by position
    raw = spark.read.text(path, wholetext=True)
    listed = raw.select(F.posexplode(F.from_json(F.col("value"), "array<struct<label:string,bits:string>>")).alias("ordinal", "t"))
    return listed.select("ordinal", "t.label", bit_string_words(F.col("t.bits")).alias("words"))


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """(profile, region, kind, x, y, width, height) of JSON layout profiles, ratios of the screen."""
    raw = spark.read.option("multiLine", True).schema("name string, regions array<struct<name:string,kind:string,x:double,y:double,width:double,height:double>>").json(path)
    return raw.select(F.col("name").alias("profile"), F.explode("regions").alias("r")).select("profile", F.col("r.name").alias("region"), "r.kind", "r.x", "r.y", "r.width", "r.height")


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, content, content_hash) of saved responses; the hash is empty where there is no content."""
    from rinkspark.functions.hashes import archive_hash

    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.nullif("value", F.lit("")).alias("content"))
    return raw.select("url", "content", archive_hash(F.col("content")).alias("content_hash"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, length) of image files, for a decoder in a pandas UDF."""
    return spark.read.format("binaryFile").load(path).select("path", "content", "length")


def pixel_box(width, height, x, y, w, h):
    """Pixel rectangle of a ratio rectangle, held inside the image: rounded, one pixel at least."""
    left = F.least(F.greatest(F.bround(width * x, 0), F.lit(0)), width - 1)
    top = F.least(F.greatest(F.bround(height * y, 0), F.lit(0)), height - 1)
    wide = F.least(F.greatest(F.bround(width * w, 0), F.lit(1)), width - left)
    high = F.least(F.greatest(F.bround(height * h, 0), F.lit(1)), height - top)
    return F.struct(left.cast("int").alias("left"), top.cast("int").alias("top"), wide.cast("int").alias("width"), high.cast("int").alias("height"))


def upscale(short, least: int = 40, most: int = 8):
    """The whole factor that brings a short side to ``least`` pixels, within 1 and ``most``."""
    return F.least(F.greatest(F.ceil(F.lit(least) / short), F.lit(1)), F.lit(most)).cast("int")
