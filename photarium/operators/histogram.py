"""Statistics of 256-level gray histograms, given as rows (key, level, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _round5(x):
    return F.floor(x * 100000.0 + 0.5) / 100000.0


def histogram_of(pixels: DataFrame, keys: list[str], level: str) -> DataFrame:
    """(keys, level, n): counts of levels."""
    return pixels.groupBy(*keys, F.col(level).cast("int").alias("level")).agg(F.count("*").alias("n"))


def histogram_statistics(histogram: DataFrame, keys: list[str], pixels: str | None = None) -> DataFrame:
    """One row a key: avg, median, peak, low, rms, range, mode and minu, as shares of 256 levels with 5 decimals.

    pixels: a column with the bitmap's number of pixels, which may exceed the histogram's sum; the sum itself if not given. The median is
    the first level at which the running count exceeds half the pixels, 0 levels if none does. Mode and rarest level keep the lowest of
    equals; a histogram of one level that has all pixels leaves the rarest at level 0.
    """
    rows = histogram.where("n > 0")
    total = F.max(pixels) if pixels else F.sum("n")
    running = F.sum("n").over(Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.max(pixels).over(Window.partitionBy(*keys)) if pixels else F.sum("n").over(Window.partitionBy(*keys))
    rows = rows.withColumns({"_running": running, "_whole": whole})
    level, n = F.col("level"), F.col("n")
    stats = rows.groupBy(*keys).agg(
        total.cast("double").alias("_t"),
        F.sum(n * (level + 1)).cast("double").alias("_s"),
        F.sum(n * level * level).cast("double").alias("_q"),
        F.min(F.when(F.col("_running") > F.floor(F.col("_whole") / 2), level)).alias("_median"),
        F.max(level).alias("_peak"),
        F.min(level).alias("_low"),
        F.min_by(level, F.struct(-n, level)).alias("_mode"),
        F.min_by(F.when(n < F.col("_whole"), level), F.when(n < F.col("_whole"), F.struct(n, level))).alias("_minu"),
    )
    mean = F.col("_s") / F.col("_t") - 1.0
    variance = F.col("_q") / F.col("_t") - mean * mean
    share = lambda c: _round5((c + 1).cast("double") / 256.0)
    return stats.select(
        *keys,
        _round5((mean + 1.0) / 256.0).alias("avg"),
        share(F.coalesce(F.col("_median"), F.lit(-1))).alias("median"),
        share(F.col("_peak")).alias("peak"),
        share(F.col("_low")).alias("low"),
        _round5(F.sqrt(F.greatest(variance, F.lit(0.0))) / 256.0).alias("rms"),
        share(F.col("_peak") - F.col("_low")).alias("range"),
        share(F.col("_mode")).alias("mode"),
        share(F.coalesce(F.col("_minu"), F.lit(0))).alias("minu"),
    )


def uniformity(histogram: DataFrame, keys: list[str], pixels: str | None = None, share: float = 0.0065) -> DataFrame:
    """(keys, uniform, avg_level): a bitmap is uniform if its second most frequent level has at most share * pixels + 1 of them.
    avg_level: unweighted mean of the levels that occur."""
    rows = histogram.where("n > 0")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "level"))
    total = F.max(pixels) if pixels else F.sum("n")
    stats = rows.withColumn("_p", place).groupBy(*keys).agg(total.alias("_t"), F.max(F.when(F.col("_p") == 2, F.col("n"))).alias("_second"), F.avg("level").alias("avg_level"))
    return stats.select(*keys, (F.coalesce("_second", F.lit(0)) <= F.col("_t") * share + 1).alias("uniform"), "avg_level")


def equalized(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level, n, share): each level's share of its bitmap."""
    return histogram.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
