"""Near-duplicate embeddings: NN-descent connects them, an exact check counts all links and connects what it has missed. One way for labels
of any size.

The state is a neighbour graph: for each distinct vector the list of its K nearest known ones with the same label. It starts from random
projections: by each of TABLES sign codes the vectors of a label are sorted, and neighbours in that order are compared. Each round then
compares vectors with the neighbours of some of their neighbours, and keeps what is nearer than a list's last. Lists hold nothing beyond
twice the angle of a link, since what is farther has no linked neighbour in common. Rounds end when links stop coming.

What the graph links is one component. The check compares all vectors of a label, block against block, from these components on: it counts
the links of each vector and joins components between which there is a link. So results do not depend on how much the descent finds, nor on
a label's size; the check's cost grows with the square of that size. A pair is decided once, in single precision where that is beyond doubt
and in double precision near the threshold.

Equal vectors are one node with a multiplicity. Blocks and lists are bounded, so no task grows with a label's or a cluster's share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photarium.llm.common import cut, drop, release, store
from photarium.llm.components import connected_components

THRESHOLD = 0.93
#: Sign codes, bits of a code, rows of a sorted run compared at once, nearest kept of each.
TABLES = 4
CODE_BITS = 40
BLOCK = 128
NEAREST = 4
#: Neighbours in a list, neighbours through which a vector looks further; most vectors that look through the same one, and most that offer
#: the same one.
K = 8
MIDDLE = 6
CROWD = 64
ROUNDS = 10
#: Gain of links, as a share, at which rounds end.
GAIN = 0.002
#: Vectors of a block in the check, and of a part of it that is compared at once.
EXACT_BLOCK = 32768
TILE = 2048
#: Values of a comparison that are held at once.
CELLS = 1 << 22
#: More than what sums of products in another order differ by, in double precision.
ROUNDING = 1e-12


def nodes_of(rows: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """Stored (id, node, label, vec): vec holds float64 values; node is null for vectors that link with nothing."""
    array = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(array, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col(f"`{label}`").isNotNull() & array.isNotNull() & F.coalesce(finite & F.exists(array, lambda x: x != 0), F.lit(False))
    single = dict(rows.dtypes)[vector] == "array<float>"

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.asarray(x, "<f4" if single else "<f8").tobytes() for x in vectors], dtype=object)

    named = rows.select(F.col(f"`{id_column}`").alias("id"), F.when(usable, F.col(f"`{label}`")).alias("label"), F.when(usable, F.col(f"`{vector}`")).alias("v"))
    vec = named.select("id", "label", packed("v").alias("vec"))
    return store(vec.withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec"))), "embeddings")


def unit(vecs: list[bytes], size: int) -> np.ndarray:
    """Unit vectors in double precision."""
    raw = np.frombuffer(b"".join(vecs), "<f4" if size == 4 else "<f8").astype(np.float64).reshape(len(vecs), -1)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # squares of large or tiny values stay finite
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _codes(nodes: DataFrame, table: int, size: int) -> DataFrame:
    """(node, label, vec, code)."""

    @F.pandas_udf("long")
    def of(vecs: pd.Series) -> pd.Series:
        out = np.empty(len(vecs), np.int64)
        by_length: dict[int, list[int]] = {}
        for i, x in enumerate(vecs):
            by_length.setdefault(len(x), []).append(i)
        for length, own in by_length.items():
            v = unit([vecs.iloc[i] for i in own], size)
            planes = np.random.default_rng([table, length]).standard_normal((v.shape[1], CODE_BITS))
            out[own] = (v @ planes > 0) @ (1 << np.arange(CODE_BITS - 1, -1, -1, dtype=np.int64))
        return pd.Series(out)

    return nodes.select("node", "label", "vec", of("vec").alias("code"))


def _lists(u: np.ndarray, w: np.ndarray, sim: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"u": u, "w": w, "sim": sim})


LIST = "u long, w long, sim double"


def project(nodes: DataFrame, table: int, size: int, far: float) -> DataFrame:
    """Candidate lists (u, w, sim) from a sorted sign code, sim being at least `far`."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for batch in batches:
            held = pd.concat([held, batch], ignore_index=True)
            if len(held) >= 16 * BLOCK:
                keep = len(held) - BLOCK // 2
                yield from compare(held)
                held = held.iloc[keep:].reset_index(drop=True)
        if len(held):
            yield from compare(held)

    def compare(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        label, vecs, node = rows["label"].to_numpy(), rows["vec"].tolist(), rows["node"].to_numpy()
        length = np.array([len(x) for x in vecs])
        edge = np.flatnonzero((label[1:] != label[:-1]) | (length[1:] != length[:-1])) + 1
        for part in np.split(np.arange(len(rows)), edge):
            for at in range(0, max(1, len(part) - BLOCK // 2), BLOCK // 2):
                own = part[at : at + BLOCK]
                if len(own) > 1:
                    v = unit([vecs[i] for i in own], size)
                    sims = v @ v.T
                    np.fill_diagonal(sims, -2)
                    best = np.argpartition(-sims, min(NEAREST, len(own) - 1) - 1, axis=1)[:, :NEAREST]
                    sims = np.take_along_axis(sims, best, axis=1)
                    i, j = np.nonzero(sims >= far)
                    yield _lists(node[own][i], node[own][best[i, j]], sims[i, j])

    coded = _codes(nodes, table, size).repartitionByRange("label", "code", "node").sortWithinPartitions("label", "code", "node")
    return coded.select("label", "node", "vec").mapInPandas(runs, LIST).where("u != w")


def keep_nearest(lists: DataFrame) -> DataFrame:
    """The K nearest of each list."""
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "w"))
    return lists.groupBy("u", "w").agg(F.max("sim").alias("sim")).withColumn("_n", rank).where(F.col("_n") <= K).select("u", "w", "sim")


def step(graph: DataFrame, nodes: DataFrame, size: int, turn: int, far: float) -> DataFrame:
    """New candidates (u, w, sim), nearer than the last of u's list: neighbours of MIDDLE neighbours of each vector."""
    last = graph.groupBy("u").agg(F.when(F.count("*") < K, F.lit(far)).otherwise(F.min("sim")).alias("low"))
    known = nodes.select(F.col("node").alias("u"), "vec").join(last, "u", "left").withColumn("low", F.coalesce("low", F.lit(far)))
    pick = F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "w", F.lit(turn))))
    looking = graph.withColumn("_n", pick).where(F.col("_n") <= MIDDLE).select("u", F.col("w").alias("middle"), F.lit(True).alias("looks"))
    # a middle offers its list and itself's known neighbours the other way round are those that look through it
    offered = graph.select(F.col("w").alias("u"), F.col("u").alias("middle"), F.lit(False).alias("looks"))
    crowd = [F.row_number().over(Window.partitionBy(x).orderBy(F.xxhash64("middle", "u", F.lit(turn)))) for x in ("middle", "u")]
    looking, offered = (x.withColumn("_n", n).where(F.col("_n") <= CROWD).drop("_n") for x, n in zip((looking, offered), crowd))
    around = looking.union(offered).join(known, "u").select("middle", "looks", "u", "low", "vec")

    def joins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            middle = held["middle"].to_numpy()
            whole = int(np.searchsorted(middle, middle[-1]))  # the last one may go on in the next batch
            if whole:
                yield from compare(held.iloc[:whole])
                held = held.iloc[whole:].reset_index(drop=True)
        if held is not None and len(held):
            yield from compare(held)

    def compare(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        middle, looks, node, low, vecs = rows["middle"].to_numpy(), rows["looks"].to_numpy(), rows["u"].to_numpy(), rows["low"].to_numpy(), rows["vec"].tolist()
        out: list[tuple] = []
        for own in np.split(np.arange(len(rows)), np.flatnonzero(middle[1:] != middle[:-1]) + 1):
            a, b = own[looks[own]], own[~looks[own]]
            if not len(a) or not len(b):
                continue
            va, vb = unit([vecs[i] for i in a], size), unit([vecs[i] for i in b], size)
            block = max(1, CELLS // len(b))
            for at in range(0, len(a), block):
                part = a[at : at + block]
                sims = va[at : at + block] @ vb.T
                other = node[part][:, None] != node[b][None, :]
                for one, two, near in ((part, b, sims > low[part][:, None]), (b, part, (sims > low[b][None, :]).T)):
                    i, j = np.nonzero(near & (other if one is part else other.T))
                    out.append((node[one][i], node[two][j], (sims if one is part else sims.T)[i, j]))
            if sum(len(x[0]) for x in out) > 1 << 18:
                yield _lists(*(np.concatenate(x) for x in zip(*out)))
                out = []
        if out:
            yield _lists(*(np.concatenate(x) for x in zip(*out)))

    return around.repartition("middle").sortWithinPartitions("middle").mapInPandas(joins, LIST)


def search(nodes: DataFrame, size: int, threshold: float) -> DataFrame:
    """The neighbour graph (u, w, sim) of nodes(node, label, vec), stored. What it replaces is deleted."""
    far = 2 * threshold**2 - 1 if threshold > 0 else -1.0
    graph = None
    for table in range(TABLES):
        lists = project(nodes, table, size, far)
        graph = _replaced(graph, lists if graph is None else graph.union(lists))
    links = 0
    for turn in range(ROUNDS):
        found = graph.where(F.col("sim") >= threshold).count()
        if found - links <= GAIN * links:
            break
        links = found
        graph = _replaced(graph, graph.union(step(graph, nodes, size, turn, far)))
    return graph


def _replaced(graph: DataFrame | None, lists: DataFrame) -> DataFrame:
    new = store(keep_nearest(lists), "nn-graph")
    if graph is not None:
        drop(graph)
    release(new.sparkSession)
    return new


def merged(up: np.ndarray, near: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """up, the least group that each group is connected with, after links `near` between rows of the groups one and rows of the groups two."""
    while True:
        a, b, new = up[one], up[two], up.copy()
        np.minimum.at(new, a, np.where(near, b[None, :], len(up)).min(axis=1))
        np.minimum.at(new, b, np.where(near, a[:, None], len(up)).min(axis=0))
        while (new[new] != new).any():
            new = new[new]
        if (new == up).all():
            return up
        up = new


def compare_all(nodes: DataFrame, size: int, threshold: float) -> DataFrame:
    """(u, others, a, b) of nodes(node, label, length, vec, times, root, n), n being the size of a group: all vectors of a group, block against
    block.

    A vector's links are the sum of its others; a is its root and b one that is connected with it, so that all (a, b) join the roots.
    """
    span = TILE
    blocks = F.ceil(F.col("n") / EXACT_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    placed = nodes.where("n > 1").select("label", "length", "node", "vec", "times", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    tiled = placed.select("label", "length", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "vec", "times", "root")

    def linked(v: np.ndarray, short: np.ndarray, x: slice, y: slice) -> np.ndarray:
        sims = short[x] @ short[y].T
        margin = (v.shape[1] + 4) * 2.0**-22  # beyond the rounding of single precision
        near = sims >= threshold - margin
        if x == y:  # both directions of a pair from one value
            near = np.triu(near, 1)
        if near.any():
            i, j = np.nonzero(near & (sims < threshold + margin))
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                near[p, q] = np.einsum("ij,ij->i", v[x][p], v[y][q]) >= threshold
        return near

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("own", kind="stable")
        node, times, v = rows["node"].to_numpy(), rows["times"].to_numpy(), unit(rows["vec"].tolist(), size)
        short = v.astype(np.float32)
        root, group = np.unique(rows["root"].to_numpy(), return_inverse=True)
        others, up = np.zeros(len(rows), np.int64), np.arange(len(root))
        same = rows["i"].iloc[0] == rows["j"].iloc[0]
        # rows of one block against those of the other, or a block against itself
        half = len(rows) if same else int((rows["own"] == rows["i"]).sum())
        for at in range(0, half, span):
            for to in range(at if same else half, len(rows), span):
                near = linked(v, short, slice(at, min(at + span, half)), slice(to, min(to + span, len(rows))))
                a, b = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                if len(a):
                    near, a, b = near[np.ix_(a, b)], a + at, b + to
                    others[a] += near @ times[b]
                    others[b] += times[a] @ near
                    up = merged(up, near, group[a], group[b])
        has = others > 0
        return pd.DataFrame({"u": node[has], "others": others[has], "a": root[group[has]], "b": root[up[group[has]]]})

    return tiled.groupBy("label", "length", "i", "j").applyInPandas(tile, "u long, others long, a long, b long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors that are null, zero, or hold null or non-finite values, and rows without a label, link with nothing: no links, their own
    component. Equal vectors of a label link with each other and share their links. Vectors of different length never link. Rows without
    an id take part; their component may be null. An empty table gives no rows; other columns are not read.
    """
    every = nodes_of(rows, id_column, vector, label)
    size = 4 if dict(rows.dtypes)[vector] == "array<float>" else 8
    nodes = store(every.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("times")), "nn-nodes")
    times = nodes.select("node", "times")
    graph = search(nodes.select("node", "label", "vec"), size, threshold)
    # what rounding may decide otherwise is left to the check
    roots = cut(connected_components(graph.where(F.col("sim") >= threshold + ROUNDING), "u", "w"))
    drop(graph)
    groups = cut(nodes.groupBy("label", F.length("vec").alias("length")).agg(F.count("*").alias("n")))
    sized = nodes.withColumn("length", F.length("vec")).join(groups, ["label", "length"]).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = cut(compare_all(sized, size, threshold))
    joined = cut(connected_components(found, "a", "b"))
    counted = found.groupBy(F.col("u").alias("node")).agg(F.sum("others").alias("others"))
    own = times.join(counted, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = own.join(joined.select(F.col("node").alias("root"), F.col("root").alias("least_root")), "root", "left")
    own = own.select("node", (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least_root", "root").alias("root"))
    least = every.where("node is not null").groupBy("node").agg(F.min("id").alias("least")).join(own, "node")
    named = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "n_links", "component_id")
    out = every.select("id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
