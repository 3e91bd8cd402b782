import random

import pytest
from pyspark.sql import functions as F

from photarium.operators import candidates, cluster, sweep
from photarium.plans.duplicates import Search, find_duplicates
from photarium.schema import IMAGES, with_derived


def members(seed, groups=6):
    rng, rows = random.Random(seed), []
    for g in range(1, groups + 1):
        base = [rng.getrandbits(64) for _ in range(3)]
        for k in range(rng.choice((2, 4, 40))):
            h = rng.choice(base)
            for _ in range(rng.randrange(6)):
                h ^= 1 << rng.randrange(64)
            f = None if rng.random() < 0.3 else h ^ (1 << rng.randrange(64))
            rows.append((g, k + 1, len(rows) + 1, h - (1 << 64) if h >> 63 else h, f - (1 << 64) if f and f >> 63 else f))
    return rows


def brute(rows, threshold, left, right, inverted, flipped):
    full = 2**64 - 1
    mask = full if left + right >= 64 else sum(1 << k for k in range(left, 64 - right))
    out = set()
    for g, sa, ia, ha, fa in rows:
        for g2, sb, ib, hb, _ in rows:
            if g == g2 and sa < sb:
                a, b = ha & full, hb & full
                ways = [(0, a)] + [(1, ~a & full)] * inverted + [(2, (fa if fa is not None else ha) & full)] * flipped
                for v, x in ways:
                    d = bin((x ^ b) & mask).count("1")
                    if d < threshold:
                        out.add((g, ib, ia, v, d))
    return out


@pytest.mark.parametrize("threshold,left,right,inverted,flipped", [(4, 0, 0, False, False), (6, 0, 0, True, True), (3, 20, 10, False, True), (22, 0, 0, True, False), (8, 40, 30, False, False), (0, 0, 0, False, False)])
@pytest.mark.parametrize("seed", [1, 2])
def test_sweep_finds_the_pairs_of_all_with_all(spark, seed, threshold, left, right, inverted, flipped):
    rows = members(seed)
    df = spark.createDataFrame(rows, "group_id long, cand_seq int, id long, hash long, flip long")
    got = sweep.sweep(df, threshold, left, right, inverted, flipped).collect()
    assert len(got) == len(set(got))
    assert {(r["group_id"], r["id_a"], r["id_b"], r["variant"], r["ham_dist"]) for r in got} == brute(rows, threshold, left, right, inverted, flipped)


def fold(pairs):
    root, state = {}, {}
    for _, a, b, ham, mse in pairs:
        if a in root and b in root:
            state[a] = state[b] = (ham, ham, mse)
        elif a not in root and b not in root:
            root[a] = root[b] = min(a, b)
            state[a] = state[b] = (ham, ham, mse)
        else:
            root[a] = root[b] = root.get(a, root.get(b))
            old = [state.get(x, (0, 100, 2500)) for x in (a, b)]
            state[a], state[b] = (ham, min(ham, old[0][1], old[1][1]), min(mse, old[0][2], old[1][2])), (ham, ham, mse)
    return {x: (root[x], *state[x]) for x in root}


def union(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, a, b, _, _ in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    out = {}
    for x in parent:
        own = [(h, m) for _, a, b, h, m in pairs if x in (a, b)]
        out[x] = [find(x), min(h for h, _ in own), min(m for _, m in own)]
    tags = {}
    for r, h, _ in out.values():
        tags[r] = min(h, tags.get(r, 99))
    return {x: (r, tags[r], h, m) for x, (r, h, m) in out.items()}


def pair_list(seed):
    rng = random.Random(seed)
    n = 4 + seed % 22
    clusters, out = 1 + n // 6, []
    for a in range(1, n + 1):
        for b in range(1, a):
            if a % clusters == b % clusters and rng.random() < 0.5:
                out.append((a % clusters, a, b, rng.randrange(13), 2500 if rng.random() < 1 / 15 else rng.randrange(400)))
    return sorted(out, key=lambda p: (p[0], p[2], p[1]))


@pytest.mark.parametrize("seed", range(3, 12, 2))
@pytest.mark.parametrize("incremental", [False, True])
def test_clusters(spark, seed, incremental):
    pairs = pair_list(seed)
    df = spark.createDataFrame([(g, a, b, a, b, 0, h, m) for g, a, b, h, m in pairs], "group_id long, id_a long, id_b long, seq_a int, seq_b int, variant int, ham_dist int, mse int")
    got = {r["id"]: (r["root"], r["tag"], r["ham_dist"], r["mse"]) for r in cluster.cluster(df, incremental).collect()}
    assert got == (fold(pairs) if incremental else union(pairs))
    if not incremental:
        assert {r["id"]: (r["root"], r["tag"], r["ham_dist"], r["mse"]) for r in cluster.cluster(df, task_pairs=1).collect()} == got


def test_chain_of_three_is_one_group(spark):
    df = spark.createDataFrame([(1, 9, 5, 2, 1, 0, 1, 7), (1, 9, 2, 2, 0, 0, 1, 7)], "group_id long, id_a long, id_b long, seq_a int, seq_b int, variant int, ham_dist int, mse int")
    assert {(r["id"], r["root"]) for r in cluster.cluster(df).collect()} == {(2, 2), (5, 2), (9, 2)}


def test_score_bounds_need_scores_of_the_first_two_pairs(spark):
    schema = "group_id long, id_a long, id_b long, seq_a int, seq_b int, variant int, ham_dist int, mse int"
    scored = spark.createDataFrame([(1, 2, 1, 2, 1, 0, 3, 10), (1, 3, 1, 3, 1, 0, 3, 900)], schema)
    assert cluster.within_bounds(scored, mse=(0, 500)).count() == 1
    half = spark.createDataFrame([(1, 2, 1, 2, 1, 0, 3, 2500), (1, 3, 1, 3, 1, 0, 3, 900)], schema)
    assert cluster.within_bounds(half, mse=(0, 500)).count() == 2
    assert cluster.within_bounds(half, ham=(3, 3)).count() == 2 and cluster.within_bounds(half, ham=(4, 9)).count() == 0


def test_labels_sort_as_text(spark):
    rows = spark.createDataFrame([(1, 5, 5, 10, 1, 1), (1, 6, 5, 1, 1, 1), (1, 7, 5, 2, 1, 1)], cluster.ROW)
    got = [r["tag"] for r in cluster.in_result_order(rows).orderBy("sort_key").collect()]
    assert got == [10, 1, 2]


def images(spark, hashes, **more):
    names = [f.name for f in IMAGES.fields]
    rows = []
    for i, h in enumerate(hashes):
        d = dict.fromkeys(names) | {"imgidu": i + 1, "imgfile": f"f{i}.jpg", "imgfolder": "C:\\p", "imgwidth": 640, "imgheight": 480, "imgframes": 1, "isDeleted": 0, "fsize": 10 + i, "dHash": h} | {k: v[i] for k, v in more.items()}
        rows.append(tuple(d[n] for n in names))
    return with_derived(spark.createDataFrame(rows, IMAGES))


def test_null_keys_and_dead_rows_are_no_candidates(spark):
    df = images(spark, ["1", "1", "1", "1", ""], imgframes=[1, 1, None, 1, 1], isDeleted=[0, 0, 0, 2, 0])
    assert {r["imgidu"] for r in candidates.image_candidates(df, ("imgwhratio", "imgframes"), 2, "dHash").collect()} == {1, 2}


def test_a_bad_hash_splits_a_strict_run(spark):
    df = images(spark, ["1", "1", "nonsense", "1", "1"])
    loose = candidates.image_candidates(df, ("imgwhratio",), 2, "dHash").select("group_id").distinct().count()
    strict = candidates.strict_runs(df, ("imgwhratio",), 2, "dHash")
    assert (loose, strict.select("group_id").distinct().count(), strict.count()) == (1, 2, 4)


def test_zero_height_gives_no_ratio(spark):
    assert images(spark, ["1"], imgheight=[0]).first()["imgwhratio"] is None


@pytest.mark.parametrize("partitions", ["1", "3", "8"])
def test_the_result_does_not_depend_on_partitions(spark, partitions):
    rng = random.Random(4)
    df = images(spark, [format(rng.choice((0, 2**20 - 1, (2**20 - 1) << 40)) ^ (1 << rng.randrange(64)), "x") for _ in range(30)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = [(r["id"], r["root"], r["gid"]) for r in find_duplicates(df, search=Search(threshold=4)).orderBy("sort_key").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 30 and len({r for _, r, _ in got}) == 3


def test_flagship_with_scores(spark):
    df = images(spark, ["1", "3", "1"])
    pixels = spark.createDataFrame([(1, bytes([10] * 1024)), (2, bytes([12] * 1024)), (3, b"short")], "imgidu long, big binary")
    pairs = find_duplicates(df, pixels, Search(scores=True, threshold=3))
    assert {r["id"]: (r["ham_dist"], r["mse"]) for r in pairs.collect()} == {1: (0, 3), 2: (1, 3), 3: (0, 2500)}


def test_functions_fold_only_ascii(spark):
    from photarium.functions.text import nocase

    assert spark.createDataFrame([("ÀB",)], "t string").select(nocase(F.col("t"))).first()[0] == "Àb"
