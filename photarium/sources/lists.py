"""Plain-text indexes, folders of files, and dictionaries kept in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photarium.functions.dates import stamp
from photarium.functions.text import file_extension


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A text index: one path a line; blank lines and those of a section head or key=value are left out."""
    lines = spark.read.text(path).select(F.btrim("value", F.lit("\r\n \t﻿")).alias("fullPath"))
    kept = lines.where((F.col("fullPath") != "") & ~F.col("fullPath").rlike(r"^\[.*\]$") & ~F.col("fullPath").rlike(r"^[A-Za-z_]\w*=") )
    return kept.select("fullPath", F.regexp_extract("fullPath", r"^(.*)[\\/][^\\/]*$", 1).alias("imgfolder"), F.regexp_extract("fullPath", r"([^\\/]*)$", 1).alias("imgfile"))


def write_list(files: DataFrame, path: str, column: str = "fullPath") -> None:
    files.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def scan_folder(spark: SparkSession, path: str, recursive: bool = True, pattern: str | None = None, content: bool = False) -> DataFrame:
    """An index of the files below a folder: path, name, folder, size, time stamp and extension. Contents are read only if asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(path)
    kept = [F.col("content")] if content else []
    return rows.select(
        F.col("path").alias("fullPath"), F.regexp_extract("path", r"([^/]*)$", 1).alias("imgfile"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("imgfolder"),
        F.col("length").alias("fsize"), stamp(F.col("modificationTime")).alias("fmodified"), file_extension(F.col("path")).alias("extension"), *kept,
    )


def write_dictionary(entries: DataFrame, path: str, key: str = "key", value: str = "value") -> None:
    entries.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value")).write.mode("overwrite").parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, value string").parquet(path)


def parse_dictionary(text: DataFrame, column: str, between: str = "\n", sign: str = "=") -> DataFrame:
    """(key, value) rows of packed text; of equal keys the last by value."""
    import re

    pairs = F.str_to_map(F.col(column), F.lit(re.escape(between)), F.lit(re.escape(sign)))
    return text.select(F.explode(pairs)).groupBy("key").agg(F.max("value").alias("value"))


def has_key(rows: DataFrame, column: str, entries: DataFrame) -> DataFrame:
    return rows.join(entries.select(F.col("key").alias(column)), column, "left_semi")


def has_value(rows: DataFrame, column: str, entries: DataFrame) -> DataFrame:
    return rows.join(entries.select(F.col("value").alias(column)).distinct(), column, "left_semi")


def copy_from(entries: DataFrame, other: DataFrame) -> DataFrame:
    """Union of two dictionaries; where both have a key, that of `other`."""
    both = entries.withColumn("_n", F.lit(0)).unionByName(other.withColumn("_n", F.lit(1)))
    return both.groupBy("key").agg(F.max_by("value", "_n").alias("value"))
