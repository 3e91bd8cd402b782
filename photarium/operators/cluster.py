"""From pairs to duplicate groups: bounds, clustering, removal of singles, order.

Pairs never leave a candidate group, so each candidate group is clustered on its own. Groups within TASK_PAIRS pairs go through one
grouped pass; larger ones have their components found by DataFrame rounds, so no task holds an unbounded group. Only the incremental
labelling, which is a fold over the ordered pairs by definition, needs a group's pairs in one place.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photarium.functions.bits import NO_SCORE
from photarium.functions.text import group_label, pad9
from photarium.operators.merge import sums_before
from photarium.operators.sweep import PAIR_ORDER
from photarium.session import settled

TASK_PAIRS = 200_000
ROW = "group_id long, id long, root long, tag int, ham_dist int, mse int"


def within_bounds(pairs: DataFrame, ham: tuple[int, int] = (0, 64), mse: tuple[int, int] = (0, NO_SCORE), keep_ids: DataFrame | None = None) -> DataFrame:
    """Pairs within both bounds, ends included. The score's bounds hold only if the first two pairs of the whole list have scores.
    keep_ids(id): a filter on the first image of a pair, id_a, alone."""
    first = pairs.orderBy(*PAIR_ORDER).limit(2).agg((F.count_if(F.col("mse") < NO_SCORE) == 2).alias("use")).first()
    kept = pairs.where(F.col("ham_dist").between(*ham))
    if first["use"]:
        kept = kept.where(F.col("mse").between(*mse))
    return kept.join(keep_ids.select(F.col("id").alias("id_a")), "id_a", "left_semi") if keep_ids is not None else kept


def _label(pairs: pd.DataFrame) -> pd.DataFrame:
    """Union-find over one group: root is the smallest member, distances the nearest of each image, tag the nearest of the root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(pairs["id_a"], pairs["id_b"]):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    both = pd.concat([pairs.rename(columns={"id_a": "id"})[["id", "ham_dist", "mse"]], pairs.rename(columns={"id_b": "id"})[["id", "ham_dist", "mse"]]])
    out = both.groupby("id", as_index=False).min()
    out["root"] = [find(x) for x in out["id"]]
    out["tag"] = out.groupby("root")["ham_dist"].transform("min")
    out["group_id"] = pairs["group_id"].iloc[0]
    return out[["group_id", "id", "root", "tag", "ham_dist", "mse"]]


def _incremental(pairs: pd.DataFrame) -> pd.DataFrame:
    """One pass over the ordered pairs: new pairs found a group at their smaller id, a pair with one labelled image joins its group, and
    a pair of labelled images only takes over the pair's values."""
    root: dict[int, int] = {}
    state: dict[int, list[int]] = {}
    ordered = pairs.sort_values(["seq_b", "seq_a", "variant"], kind="stable")
    for a, b, ham, mse in zip(ordered["id_a"], ordered["id_b"], ordered["ham_dist"], ordered["mse"]):
        if a in root and b in root:
            state[a], state[b] = [ham, ham, mse], [ham, ham, mse]
        elif a not in root and b not in root:
            root[a] = root[b] = min(a, b)
            state[a], state[b] = [ham, ham, mse], [ham, ham, mse]
        else:
            root[a] = root[b] = root.get(a, root.get(b))
            seen = [state.get(x, [0, 100, NO_SCORE]) for x in (a, b)]
            state[a] = [ham, min(ham, seen[0][1], seen[1][1]), min(mse, seen[0][2], seen[1][2])]
            state[b] = [ham, ham, mse]
    rows = [(pairs["group_id"].iloc[0], x, root[x], *state[x]) for x in root]
    return pd.DataFrame(rows, columns=["group_id", "id", "root", "tag", "ham_dist", "mse"])


def _large(pairs: DataFrame) -> DataFrame:
    """The same as _label for groups too large for a task: the smallest label of the neighbourhood and its own label's label, until nothing changes."""
    both = pairs.select("group_id", F.col("id_a").alias("id"), F.col("id_b").alias("other"), "ham_dist", "mse")
    both = both.union(pairs.select("group_id", F.col("id_b"), F.col("id_a"), "ham_dist", "mse"))
    labels = both.groupBy("group_id", "id").agg(F.min("ham_dist").alias("ham_dist"), F.min("mse").alias("mse")).withColumn("root", F.col("id"))
    links = both.select("id", "other").distinct()
    changed = 1
    while changed:
        near = links.join(labels.select(F.col("id").alias("other"), "root"), "other").groupBy("id").agg(F.min("root").alias("least"))
        stepped = labels.join(near, "id").withColumn("new", F.least("root", "least"))
        jump = labels.select(F.col("id").alias("new"), F.col("root").alias("further"))
        stepped = stepped.join(jump, "new", "left").withColumn("next", F.least("new", F.coalesce("further", "new")))
        stepped = stepped.select("group_id", "id", "ham_dist", "mse", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        stepped = settled(stepped)
        changed = stepped.where("moved").limit(1).count()
        labels = stepped.drop("moved")
    tags = labels.groupBy("root").agg(F.min("ham_dist").alias("tag"))
    return labels.join(tags, "root").select("group_id", "id", "root", "tag", "ham_dist", "mse")


def cluster(pairs: DataFrame, incremental: bool = False, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(group_id, id, root, tag, ham_dist, mse) for every image of a pair."""
    if incremental:
        return pairs.groupBy("group_id").applyInPandas(_incremental, ROW)
    sized = pairs.groupBy("group_id").agg(F.count("*").alias("n"))
    large = sized.where(F.col("n") > task_pairs).select("group_id")
    if not large.limit(1).count():
        return pairs.groupBy("group_id").applyInPandas(_label, ROW)
    small = pairs.join(large, "group_id", "left_anti").groupBy("group_id").applyInPandas(_label, ROW)
    return small.unionByName(_large(pairs.join(large, "group_id", "left_semi")))


def drop_singles(rows: DataFrame, singles: int = 0) -> DataFrame:
    """Members are counted by root in order of id; labels that no member after the first `singles` of its root carries go, as a whole."""
    labelled = rows.withColumn("gid", group_label(F.col("root"), F.col("tag")))
    place = F.row_number().over(Window.partitionBy("root").orderBy("id"))
    alive = labelled.withColumn("_p", place).where(F.col("_p") > max(0, singles)).select("gid").distinct()
    return labelled.join(alive, "gid", "left_semi")


def in_result_order(rows: DataFrame) -> DataFrame:
    """Adds sort_key: result rows are listed by root, then label and position as text, so label 5_10 comes before 5_1."""
    counts = rows.withColumn("_part", F.floor(F.col("id") / 65536)).groupBy("_part").agg(F.count("*").alias("_m"))
    before = sums_before(counts, "_part", "_m", "_before")
    placed = rows.withColumn("_part", F.floor(F.col("id") / 65536)).withColumn("_p", F.row_number().over(Window.partitionBy("_part").orderBy("id")))
    numbered = placed.join(before, "_part").withColumn("position", (F.col("_p") + F.col("_before")).cast("long")).drop("_part", "_p", "_before")
    gid = group_label(F.col("root"), F.col("tag"))
    return numbered.withColumn("sort_key", F.concat(pad9(F.col("root")), F.lit("y"), gid, F.lit("z"), pad9(F.col("position"))))


def nearest(pairs: DataFrame) -> DataFrame:
    """(id, ham_dist, mse): the nearest distances of each image."""
    both = pairs.select(F.col("id_a").alias("id"), "ham_dist", "mse").union(pairs.select(F.col("id_b"), "ham_dist", "mse"))
    return both.groupBy("id").agg(F.min("ham_dist").alias("ham_dist"), F.min("mse").alias("mse"))


def apply_filter(pairs: DataFrame, ham=(0, 64), mse=(0, NO_SCORE), incremental: bool = False, singles: int = 0, keep_ids: DataFrame | None = None) -> DataFrame:
    """Bounds, clustering, order and removal of singles in one; positions count before the removal.

    The pairs are kept in memory or on disk for the passes over them, and for other bounds tried later.
    """
    pairs = pairs.persist()
    rows = in_result_order(cluster(within_bounds(pairs, ham, mse, keep_ids), incremental))
    return drop_singles(rows, singles)
