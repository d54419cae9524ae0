"""Readers and writers of collections, source files and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 40 * 1024 * 1024
CARD_SCHEMA = "array<struct<number:int,question:string,answer:string>>"


def read_collection(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON collection with a declared schema; a record that is not JSON stops the query instead of reading as empty."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_collection(df: DataFrame, path: str) -> None:
    """Replaces a collection; readers see it whole or not at all, by the writer's commit."""
    df.write.mode("overwrite").json(path)


def read_sources(spark: SparkSession, path: str, patterns: str = "*.{pdf,png,jpg,jpeg,webp,bmp}", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Source files of the accepted kinds up to max_bytes, with their extension; the size filter reaches the scan."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", patterns).load(path)
    return files.where(F.col("length") <= max_bytes).withColumn("extension", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))


def glyphs(runs: DataFrame) -> DataFrame:
    """Glyphs of positioned text runs (text, transform, width): blank runs go; the scale is the length of the text's vertical axis, 12 where that is 0."""
    t = lambda i: F.get("transform", F.lit(i))
    scale = F.hypot(t(2), t(3))
    return runs.where(F.trim("text") != "").select(
        "doc_id", "page_index", "glyph_seq", t(4).alias("x"), t(5).alias("y"), F.col("width").alias("w"), F.when(scale == 0, F.lit(12.0)).otherwise(scale).alias("scale"), F.col("text").alias("s")
    )


def write_report(lines: DataFrame, path: str) -> None:
    """Report texts (deck_id, text) as text files, one folder a deck."""
    lines.write.mode("overwrite").partitionBy("deck_id").text(path)


def parse_cards(replies: DataFrame) -> DataFrame:
    """Rows of (page, number, question, answer) from model replies: fences are cut, replies that are no JSON array give none."""
    bare = F.regexp_replace(F.trim("reply"), r"^```(?:json)?\s*|\s*```$", "")
    return replies.select("page", F.explode(F.from_json(bare, CARD_SCHEMA, {"mode": "PERMISSIVE"})).alias("c")).select("page", "c.*")
