"""Incremental collection: files that appear in a folder are decoded once and merged into the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from photarium.sources.images import FEATURES, features

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, most_files: int = 1000, pattern: str | None = None) -> DataFrame:
    """A stream of files below a folder; at most that many a batch."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)


def collect(spark: SparkSession, folder: str, table: str, checkpoint: str, most_files: int = 1000, pattern: str | None = None, tag: str = "collect") -> StreamingQuery:
    """Decode what is new, append its features to the table (a Parquet folder), and stop. A restart goes on after the last whole batch;
    a batch that is written again replaces itself, so a file's features are never there twice."""

    def write(batch: DataFrame, number: int) -> None:
        features(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    stream = watch(spark, folder, most_files, pattern)
    return stream.writeStream.queryName(tag).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(FEATURES + ", batch long").parquet(table)


def views_by_window(seen: DataFrame, when: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts of views in windows of event time; works on streams and tables."""
    return seen.withWatermark(when, late).groupBy(F.window(when, window)).agg(F.count("*").alias("views")).select(F.col("window.start").alias("start"), "views")


def cancel(spark: SparkSession, tag: str = "collect") -> None:
    """Stop the stream of that name and the jobs with that tag."""
    for query in spark.streams.active:
        if query.name == tag:
            query.stop()
    spark.sparkContext.cancelJobsWithTag(tag)
