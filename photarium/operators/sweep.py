"""Pairs of a group's members whose hashes are near: directly, inverted or mirrored.

Within a group the join is by bands: two hashes that differ in fewer than t of the compared bits agree in one of t bands, whole. So rows
meet by (group, variant, band, its bits) and never all with all; the exact distance follows, and a pair found under several bands counts
once. Thresholds that leave no band of useful width, and small groups, are joined by group alone, its rows dealt out in tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photarium.functions.bits import NO_SCORE, ham_mask, hamming, msd
from photarium.operators.merge import renumbered

#: Rows of a tile.
TILE = 256


def _bands(mask: int, parts: int) -> list[int]:
    """The compared bits in `parts` bands, as signed masks."""
    bits = [k for k in range(64) if mask >> k & 1]
    cuts = [bits[len(bits) * k // parts : len(bits) * (k + 1) // parts] for k in range(parts)]
    values = [sum(1 << b for b in own) for own in cuts]
    return [v - (1 << 64) if v >> 63 else v for v in values]


def sweep(candidates: DataFrame, threshold: int, left_crop: int = 0, right_crop: int = 0, inverted: bool = False, flipped: bool = False, banded: bool = True) -> DataFrame:
    """candidates(group_id, cand_seq, id, hash[, flip]) to pairs (group_id, id_a, id_b, seq_a, seq_b, variant, ham_dist).

    id_a is the later row, id_b the earlier one. variant: 0 direct, 1 inverted, 2 flipped (the earlier row's mirrored hash against the
    later row's hash; its own hash where the mirrored one is missing). A pair may have up to three rows. Kept: ham_dist < threshold.
    """
    mask = ham_mask(left_crop, right_crop)
    width = bin(mask & ((1 << 64) - 1)).count("1")
    if threshold <= 0:
        threshold = 0
    variants = [(0, "hash", False)] + [(1, "hash", True)] * inverted + [(2, "flip", False)] * flipped
    rows = candidates.select("group_id", "cand_seq", "id", "hash", (F.coalesce("flip", "hash") if flipped else F.col("hash")).alias("flip"))
    sides = []
    for variant, column, invert in variants:
        outer = F.bitwise_not(F.col(column)) if invert else F.col(column)
        sides.append(rows.select("group_id", "cand_seq", "id", F.lit(variant).alias("variant"), outer.alias("probe")))
    outer = sides[0]
    for other in sides[1:]:
        outer = outer.union(other)
    inner = rows.select("group_id", "cand_seq", "id", "hash")
    if banded and 0 < threshold <= width // 4:
        bands = [F.lit(b).cast("long") for b in _bands(mask, threshold)]

        def keyed(df: DataFrame, value: str) -> DataFrame:
            parts = F.array(*[F.struct(F.lit(k).alias("band"), F.col(value).bitwiseAND(b).alias("bits")) for k, b in enumerate(bands)])
            return df.select("*", F.explode(parts).alias("_b")).select(*df.columns, F.col("_b.band").alias("band"), F.col("_b.bits").alias("bits"))

        a, b = keyed(outer, "probe").alias("o"), keyed(inner, "hash").alias("i")
        on = (F.col("o.group_id") == F.col("i.group_id")) & (F.col("o.band") == F.col("i.band")) & (F.col("o.bits") == F.col("i.bits"))
        differ = F.col("o.probe").bitwiseXOR(F.col("i.hash"))
        on = on & (F.col("o.band") == F.coalesce(*[F.when(differ.bitwiseAND(b) == 0, F.lit(k)) for k, b in enumerate(bands)]))
    else:
        # tiles: rows of a group in blocks, each earlier block against itself and the later ones
        blocks = rows.groupBy("group_id").agg(F.ceil(F.count("*") / TILE).cast("int").alias("_blocks"))
        outer = outer.join(blocks, "group_id").withColumn("_o", F.pmod(F.col("cand_seq"), F.col("_blocks"))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        inner = inner.join(blocks, "group_id").withColumn("_i", F.pmod(F.col("cand_seq"), F.col("_blocks"))).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        a, b = outer.alias("o"), inner.alias("i")
        on = (F.col("o.group_id") == F.col("i.group_id")) & (F.col("o._o") == F.col("i._o")) & (F.col("o._i") == F.col("i._i"))
    distance = hamming(F.col("o.probe"), F.col("i.hash"), mask)
    return a.join(b, on & (F.col("o.cand_seq") < F.col("i.cand_seq")) & (distance < threshold)).select(
        F.col("o.group_id").alias("group_id"), F.col("i.id").alias("id_a"), F.col("o.id").alias("id_b"), F.col("i.cand_seq").alias("seq_a"),
        F.col("o.cand_seq").alias("seq_b"), F.col("o.variant").alias("variant"), distance.cast("int").alias("ham_dist"),
    )


#: The order in which a sweep lists its pairs.
PAIR_ORDER = ("group_id", "seq_b", "seq_a", "variant")


def with_scores(pairs: DataFrame, pixels: DataFrame, level: int = 1) -> DataFrame:
    """Adds mse from pixels(id, values), an array of gray values; only pairs that survived the distance are joined."""
    scored = pairs.join(pixels.select(F.col("id").alias("id_a"), F.col("values").alias("_a")), "id_a", "left").join(pixels.select(F.col("id").alias("id_b"), F.col("values").alias("_b")), "id_b", "left")
    return scored.withColumn("mse", msd(F.col("_a"), F.col("_b"), level)).drop("_a", "_b")


def without_scores(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("mse", F.lit(NO_SCORE))


def have_scores(pairs: DataFrame, pair_order: list[str] | None = None) -> DataFrame:
    """(have_msd): whether at least two pairs among the first half, two at least, of the ordered list have a score."""
    placed = renumbered(pairs.select(*(pair_order or PAIR_ORDER), "mse"), [F.col(c) for c in pair_order or PAIR_ORDER], "_at")
    half = placed.agg(F.greatest(F.lit(2), F.floor(F.count("*") / 2)).alias("_half"))
    first = placed.join(F.broadcast(half)).where("_at <= _half")  # half: one row
    return first.agg((F.count_if(F.col("mse") < NO_SCORE) >= 2).alias("have_msd"))
