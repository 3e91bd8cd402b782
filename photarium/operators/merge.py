"""Merging indexes: keyed union with precedence, upserts, updates that keep what they don't know, and anti-join collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photarium.functions.text import nocase
from photarium.session import settled


def truthy(column: str | Column, kind: str) -> Column:
    """What an import takes over: not null, not '' and not 0."""
    c = F.col(column) if isinstance(column, str) else column
    if kind in ("string",):
        return c.isNotNull() & (c != "")
    if kind in ("binary",):
        return c.isNotNull() & (F.octet_length(c) > 0)
    return c.isNotNull() & (c != 0)


def import_merge(main: DataFrame, other: DataFrame, key: Column, id_column: str, order: list[str] | None = None) -> DataFrame:
    """Full outer merge of two indexes with equal columns by a key: the imported value wins where it is truthy, ids are given anew from 1,
    main's rows first. old_main and old_other hold the ids of both sides."""
    values = [c for c in main.columns if c != id_column]
    kinds = dict(main.dtypes)
    m = main.withColumn("_key", key).alias("m")
    o = other.withColumn("_key", key).alias("o")
    joined = m.join(o, F.col("m._key") == F.col("o._key"), "full_outer")
    picked = [F.when(truthy(F.col(f"o.{c}"), kinds[c]), F.col(f"o.{c}")).otherwise(F.coalesce(F.col(f"m.{c}"), F.col(f"o.{c}"))).alias(c) for c in values]
    rows = joined.select(F.col(f"m.{id_column}").alias("old_main"), F.col(f"o.{id_column}").alias("old_other"), *picked)
    return renumbered(rows, [F.col("old_main").isNull(), F.coalesce("old_main", "old_other")], id_column)


def renumbered(rows: DataFrame, order: list[Column], id_column: str, start: int = 1) -> DataFrame:
    """Ids start, start + 1, ... in the given order, numbered by ranges: each is sorted on its own, and starts where the ones before end.

    The ranges are settled first: sampled anew for each use, they could differ.
    """
    ordered = rows.withColumn("_o", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)])).repartitionByRange("_o").withColumn("_part", F.spark_partition_id())
    ordered = settled(ordered)
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_m"))
    before = counts.select("_part", F.coalesce(F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = ordered.withColumn("_p", F.row_number().over(Window.partitionBy("_part").orderBy("_o")))
    return placed.join(before, "_part").withColumn(id_column, (F.col("_p") + F.col("_before") + (start - 1)).cast("long")).drop("_o", "_part", "_p", "_before")


def sums_before(rows: DataFrame, key: str, value: str, name: str, block: int = 65536) -> DataFrame:
    """(key, name): the sum of value over all smaller keys, for whole numbers as keys: within blocks of keys, and over the blocks."""
    own = rows.withColumn("_b", F.floor(F.col(key) / block))
    blocks = own.groupBy("_b").agg(F.sum(value).alias("_s"))
    earlier = blocks.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_e"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("_i", inside).join(earlier, "_b").select(key, (F.col("_i") + F.col("_e")).alias(name))


def merge_blobs(merged: DataFrame, main: DataFrame, other: DataFrame, id_column: str, blobs: list[str]) -> DataFrame:
    """The side table of a merged index: each blob from the other index, else from main; ids without any blob have no row."""
    m = main.select(F.col(id_column).alias("old_main"), *[F.col(b).alias(f"m_{b}") for b in blobs])
    o = other.select(F.col(id_column).alias("old_other"), *[F.col(b).alias(f"o_{b}") for b in blobs])
    both = merged.select(id_column, "old_main", "old_other").join(m, "old_main", "left").join(o, "old_other", "left")
    out = both.select(id_column, *[F.coalesce(f"o_{b}", f"m_{b}").alias(b) for b in blobs])
    return out.where(F.coalesce(*blobs).isNotNull())


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """INSERT OR REPLACE: of rows with equal keys the new one, of several new ones the last by all other columns."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    others = [F.col(c).desc_nulls_last() for c in table.columns if c not in key]
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_new"), *others))).where("_n = 1").drop("_n", "_new")


def coalesce_update(table: DataFrame, results: DataFrame, key: str, keep: list[str], overwrite: list[str]) -> DataFrame:
    """UPDATE from results: columns of `keep` change only where the result has a value, those of `overwrite` in any case."""
    r = results.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_r_{c}") for c in keep + overwrite])
    joined = table.join(r, key, "left")
    values = {c: F.coalesce(F.col(f"_r_{c}"), F.col(c)) for c in keep} | {c: F.when(F.col("_hit"), F.col(f"_r_{c}")).otherwise(F.col(c)) for c in overwrite}
    return joined.withColumns(values).select(*table.columns)


def missing(rows: DataFrame, side: DataFrame, key: str, present: Column | None = None) -> DataFrame:
    """Rows without a present entry in the side table."""
    return rows.join(side.where(present) if present is not None else side, key, "left_anti")


def next_page(rows: DataFrame, key: str, last, n: int) -> DataFrame:
    """Keyset page: the n rows after `last`."""
    return rows.where(F.col(key) > F.lit(last)).orderBy(key).limit(n)


def mark_dead(images: DataFrame, outcome: DataFrame, key: str = "imgidu") -> DataFrame:
    """isDeleted = 1 for files whose outcome is that they can't be decoded; a failure after decoding marks nothing."""
    dead = outcome.where("not decoded").select(key, F.lit(1).alias("_dead"))
    return images.join(dead, key, "left").withColumn("isDeleted", F.coalesce("_dead", "isDeleted")).drop("_dead")


def path_key(folder: str = "imgfolder", file: str = "imgfile") -> Column:
    return nocase(F.concat_ws("\\", folder, file))
