"""Pages, orders and row callbacks over a result, without bringing it to one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photarium.operators.merge import renumbered

#: Orders of a list of files, by name of the service. Similarity is a column that a search adds.
ORDERS = {
    "path": ("imgfolder", "imgfile"), "folder": ("imgfolder",), "name": ("imgfile",), "size": ("fsize",), "modified": ("fmodified",), "created": ("fcreated",),
    "resolution": ("imgmegapix",), "ratio": ("imgwhratio",), "format": ("imgpixfmt",), "dpi": ("imgdpi",), "frames": ("imgframes",), "average": ("imgavg",),
    "median": ("imgmedian",), "similarity": ("similarity",),
}


def sorted_list(files: DataFrame, by: str, key: str = "imgidu", down: bool = False) -> DataFrame:
    """Adds position 1, 2, ... in one of ORDERS: text by its lower case, nulls first, ties by key. Numbered by ranges."""
    texts = {c for c, kind in files.dtypes if kind == "string"}
    order = [F.lower(c) if c in texts else F.col(c) for c in ORDERS[by]] + [F.col(key)]
    placed = renumbered(files, order, "position")
    if not down:
        return placed
    last = F.broadcast(placed.agg((F.max("position") + 1).alias("_end")))  # one row
    return placed.join(last).withColumn("position", F.col("_end") - F.col("position")).drop("_end")


def fetch(rows: DataFrame, order: list[Column], first: int, most: int) -> DataFrame:
    """The rows from place `first` on (the first row is 0), `most` of them, with `place`."""
    placed = renumbered(rows, order, "place", start=0)
    return placed.where((F.col("place") >= first) & (F.col("place") < first + most))


def get_table(rows: DataFrame, most: int = 0, order: list[Column] | None = None) -> tuple[DataFrame | None, int, list[str]]:
    """(rows, their number, column names): all rows for 0, none but their number for -1, and names too for -2; the first `most` otherwise."""
    if most < 0:
        return None, rows.count(), rows.columns if most == -2 else []
    found = rows if most == 0 else (rows.orderBy(*order) if order else rows).limit(most)
    return found, found.count(), found.columns


def unique_numbers(rows: DataFrame, column: str, down: bool = True) -> DataFrame:
    """Distinct numbers of a text or number column with their place, the largest first if `down`; what is no number is left out."""
    number = F.col(column).cast("string").try_cast("double").alias("number")
    distinct = rows.select(number).where("number is not null").distinct()
    return renumbered(distinct, [-F.col("number") if down else F.col("number")], "place")


def until(rows: DataFrame, order: list[Column], stop: Column) -> DataFrame:
    """What a row callback sees that ends the query: the rows in order up to the first one for which `stop` is true, that one included."""
    placed = renumbered(rows.withColumn("_stop", F.coalesce(stop, F.lit(False))), order, "place")
    end = F.broadcast(placed.agg(F.min(F.when(F.col("_stop"), F.col("place"))).alias("_end")))  # one row
    return placed.join(end).where(F.col("_end").isNull() | (F.col("place") <= F.col("_end"))).drop("_stop", "_end")


def hash_counts(files: DataFrame, known: str, length: str, wanted: int) -> DataFrame:
    """(written, failed, skipped) of a run over files without a hash: fingerprints of the wanted length, of another one, and none."""
    todo = files.where(F.col(known).isNull())
    size = F.col(length)
    return todo.agg(F.count_if(size == wanted).alias("written"), F.count_if(size != wanted).alias("failed"), F.count_if(size.isNull()).alias("skipped"))


def collect_counts(outcome: DataFrame) -> DataFrame:
    """(written, failed) of a collection run, from its rows' `decoded`."""
    return outcome.agg(F.count_if("decoded").alias("written"), F.count_if(~F.col("decoded")).alias("failed"))


def without_listed(found: DataFrame, listed: DataFrame, key: str = "imgidu") -> DataFrame:
    """Duplicates that are not in the list yet; whole groups go if fewer than two of their members are left."""
    left = found.join(listed.select(key).distinct(), key, "left_anti")
    alive = left.groupBy("group_id").agg(F.count("*").alias("_n")).where("_n > 1").select("group_id")
    return left.join(alive, "group_id", "left_semi")
