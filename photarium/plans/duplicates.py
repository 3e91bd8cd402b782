"""The flagship query: duplicates of an image index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photarium.functions.bits import NO_SCORE, bytes_of, parse_hex
from photarium.operators import candidates, cluster, sweep
from photarium.schema import with_derived


@dataclass(frozen=True)
class Search:
    """What a run looks for."""

    columns: tuple[str, ...] = ("imgwhratio", "imgframes")
    precision: int = 2
    hash_column: str = "dHash"
    threshold: int = 6
    left_crop: int = 0
    right_crop: int = 0
    inverted: bool = False
    flipped: bool = False
    scores: bool = False
    level: int = 1
    ham: tuple[int, int] = (0, 64)
    mse: tuple[int, int] = (0, NO_SCORE)
    incremental: bool = False
    singles: int = 0
    strict: bool = False


def find_pairs(images: DataFrame, pixels: DataFrame | None, search: Search) -> DataFrame:
    """Pairs before any bounds; persist it to try several of them."""
    rows = images if "imgwhratio" in images.columns else with_derived(images)
    find = candidates.strict_runs if search.strict else candidates.image_candidates
    found = find(rows, search.columns, search.precision, search.hash_column)
    flip = parse_hex(F.col(f"H{search.hash_column}")) if search.flipped else F.col("hash")
    members = found.select("group_id", "cand_seq", F.col("imgidu").alias("id"), "hash", flip.alias("flip"))
    pairs = sweep.sweep(members, search.threshold, search.left_crop, search.right_crop, search.inverted, search.flipped)
    if search.scores and pixels is not None:
        big = pixels.select(F.col("imgidu").alias("id"), F.when(F.octet_length("big") == 1024, bytes_of(F.col("big"))).alias("values"))
        return sweep.with_scores(pairs, big, search.level)
    return sweep.without_scores(pairs)


def find_duplicates(images: DataFrame, pixels: DataFrame | None = None, search: Search = Search(), keep_ids: DataFrame | None = None) -> DataFrame:
    """(group_id, id, root, tag, ham_dist, mse, position, sort_key, gid) of all images in a duplicate group; list them by sort_key."""
    pairs = find_pairs(images, pixels, search)
    return cluster.apply_filter(pairs, search.ham, search.mse, search.incremental, search.singles, keep_ids)
