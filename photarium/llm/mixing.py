"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key. Within its source the rows are ordered by that key; its leading hex digits cut the order into
ranges of even size, whatever the source's share of the rows. Prefix sums are taken in two steps: over the ranges of a source, from
a pre-aggregated table of at most `ranges` rows a source, and within each range. The budget of a source is then cut exactly: whole
epochs first, the rest from the head of the order, the row on the boundary in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photarium.llm.common import WORD

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
#: Hex digits of the key that name a range: 16 ** 3 ranges a source.
RANGE_DIGITS = 3
SEED = "mix-1"


def words(text: Column) -> Column:
    """Number of words, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weights repeat over the sources by code point, null last.

    Water-filling in closed form: with sources by capacity per unit of weight, the level of the sources that stay below their capacity
    is what the full ones leave, by the weight that remains; the first source below its own capacity fixes it.
    The table has one row a source.
    """
    at = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((at - 1) % len(weights) + 1).cast("int"))
    capped = sizes.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * F.lit(float(epochs))).alias("_cap"))
    everything = Window.partitionBy(F.lit(1))
    fill = Window.partitionBy(F.lit(1)).orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = capped.withColumns(
        {
            "_level": (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
            / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))),
        }
    ).withColumn("_at", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_level"))).over(everything)["_level"])
    return level.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_at") * F.col("_w"), F.col("_cap"))).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, rows: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row; with rows=True also the whole input row as struct `row`.

    Null or empty texts have size 0 and nothing taken; a null source is a source of its own, the last; rows with equal keys follow each
    other by size, so repeated rows are interchangeable and reruns agree; an empty table gives no rows; other columns are not read
    unless rows=True, and then their names cannot clash.
    """
    own = docs.select(
        "doc_id", "source", (words(F.col("text")) if size is None else size).alias("size"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if rows else [])
    )
    own = own.withColumns(
        {
            "_src": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")),
            "_key": F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))),
        }
    ).withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))
    by_range = own.groupBy("_src", "_range").agg(F.sum("size").alias("_sum"), F.first("source").alias("source"))
    sizes = by_range.groupBy("_src").agg(F.sum("_sum").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, epochs)
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("_src"), "source_size", "target")
    earlier = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.select("_src", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_src", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(starts.join(targets, "_src"), ["_src", "_range"])
    budget = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - full * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_start") - F.col("_inside")))
    out = ["doc_id", "source", "size", "source_size", "target", (full * F.col("size") + part).cast("long").alias("taken")]
    return joined.select(*out, *(["row"] if rows else []))


def materialize(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows themselves, with the columns of docs: a row stands as often as the mix takes it, the last time in part if the
    budget ends inside it. A text taken in part ends after its last taken word. Rows of which nothing is taken go.
    """
    size, taken = F.col("size"), F.col("taken")
    copies = F.when(size > 0, F.ceil(taken / size)).otherwise(F.lit(0)).cast("int")
    each = mix(docs, rows=True, **options).where(taken > 0).select("row", "size", "taken", F.explode(F.sequence(F.lit(1), copies)).alias("nth"))
    left = F.least(size, taken - (F.col("nth") - 1) * size)
    text = F.when(left == size, F.col("row.text")).otherwise(head(F.col("row.text"), left))
    return each.select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def head(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word. Only rows on a budget's edge get here, one a source at most."""
    gaps = F.regexp_extract_all(text, F.lit(r"(?s)([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(gaps, F.lit(1), n.cast("int")), "")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB SQL for op1_mix_sources. Keys are MD5 in both engines; targets add whole numbers and quarters of them, exact in doubles.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER f, 0)) / ((sum(w) OVER ()) - coalesce(sum(w) OVER f, 0)) AS level
  FROM w WINDOW f AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT arg_min(level, cap / w) AS lev FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT lev FROM m) * w, cap)) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, round(t.target)::BIGINT AS budget,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS fulls FROM p)
SELECT doc_id, size, source_size, target, (fulls * size + greatest(0, least(size, budget - fulls * source_size - before)))::BIGINT AS taken FROM e
"""
