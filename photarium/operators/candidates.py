"""Candidate groups: files that agree in a set of keys.

Groups of two or more are counted with partial sums and get ordinals by key; the files meet them in an equi-join and get a sequence within
their group. Members of groups beyond HOT_GROUP are numbered by ranges of their order, so that no group has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photarium import schema
from photarium.functions.bits import is_hex, parse_hex
from photarium.functions.text import nocase
from photarium.operators.merge import renumbered, sums_before


#: Members of a group up to which one task numbers them.
HOT_GROUP = 1 << 20


def key_column(name: str, precision: int) -> Column:
    """Text folded where it compares without case, other columns rounded unless they are compared as they are."""
    c = F.col(name)
    if name in schema.NOCASE:
        return nocase(c)
    return c if name in schema.VERBATIM else F.round(c.cast("double"), precision) + F.lit(0.0)


def candidate_groups(files: DataFrame, keys: dict[str, Column], order: list[Column], live: Column | None = None) -> DataFrame:
    """files with group_id and cand_seq, rows outside groups of two or more left out. A null in any key leaves a row out."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = files.where(live) if live is not None else files
    keyed = rows.withColumns(dict(zip(names, keys.values()))).dropna(subset=names)
    groups = renumbered(keyed.groupBy(*names).agg(F.count("*").alias("_n")).where("_n > 1"), [F.col(n) for n in names], "group_id")
    members = keyed.join(groups, names).drop(*names)
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(*order))
    if not groups.where(F.col("_n") > HOT_GROUP).limit(1).count():
        return members.withColumn("cand_seq", place).drop("_n")
    usual = members.where(F.col("_n") <= HOT_GROUP).withColumn("cand_seq", place).drop("_n")
    hot = groups.where(F.col("_n") > HOT_GROUP).select("group_id", "_n")
    placed = renumbered(members.where(F.col("_n") > HOT_GROUP).drop("_n"), [F.col("group_id"), *order], "_at")
    within = placed.join(sums_before(hot, "group_id", "_n", "_before"), "group_id")
    return usual.unionByName(within.withColumn("cand_seq", (F.col("_at") - F.col("_before")).cast("int")).drop("_at", "_before"))


def image_candidates(images: DataFrame, columns: tuple[str, ...], precision: int = 2, hash_column: str | None = None, id_order: str = "imgidu") -> DataFrame:
    """Candidates of an image index: live rows, with a usable hash if one is named, grouped by the columns."""
    rows = images.where(F.coalesce("isDeleted", F.lit(0)) == 0)
    if hash_column:
        rows = rows.where(is_hex(F.col(hash_column))).withColumn("hash", parse_hex(F.col(hash_column)))
    return candidate_groups(rows, {c: key_column(c, precision) for c in columns}, [F.col("imgmegapix"), F.col("fsize"), F.col(id_order)])


def strict_runs(images: DataFrame, columns: tuple[str, ...], precision: int, hash_column: str) -> DataFrame:
    """As image_candidates, but a row with an unusable hash inside a run of equal keys splits the run in two."""
    names = [f"_k{i}" for i in range(len(columns))]
    rows = images.where((F.coalesce("isDeleted", F.lit(0)) == 0) & (F.coalesce(F.col(hash_column), F.lit("")) != ""))
    rows = rows.withColumns(dict(zip(names, [key_column(c, precision) for c in columns]))).dropna(subset=names)
    order = Window.partitionBy(*names).orderBy("imgmegapix", "fsize", "imgidu")
    bad = (~is_hex(F.col(hash_column))).cast("int")
    island = rows.withColumn("_island", F.sum(bad).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(is_hex(F.col(hash_column)))
    keyed = island.withColumn("_n", F.count("*").over(Window.partitionBy(*names, "_island"))).where("_n > 1").drop("_n")
    ordinals = renumbered(keyed.select(*names, "_island").distinct(), [F.col(n) for n in (*names, "_island")], "group_id")
    out = keyed.join(ordinals, [*names, "_island"]).withColumn("hash", parse_hex(F.col(hash_column)))
    return out.withColumn("cand_seq", F.row_number().over(Window.partitionBy("group_id").orderBy("imgmegapix", "fsize", "imgidu"))).drop(*names, "_island")


def keep_mask(candidates: DataFrame, keep: Column, id_base: int = 0) -> DataFrame:
    """Candidates after a row filter: groups keep their ordinals, even of one member, and rows get new ids id_base + 1, ... in order."""
    kept = candidates.where(keep)
    counts = kept.groupBy("group_id").agg(F.count("*").alias("_m"))
    before = sums_before(counts, "group_id", "_m", "_before")
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("cand_seq"))
    return kept.withColumn("_place", place).join(before, "group_id").withColumn("row_id", (F.col("_before") + F.col("_place") + id_base).cast("long")).drop("_place", "_before")


def comparisons(candidates: DataFrame) -> DataFrame:
    """(groups, rows, planned): how many comparisons a sweep plans."""
    sizes = candidates.groupBy("group_id").agg(F.count("*").alias("m"))
    return sizes.agg(F.count("*").alias("groups"), F.coalesce(F.sum("m"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.expr("m * (m - 1) div 2")), F.lit(0)).alias("planned"))
