import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from photarium.functions import bits, hashes

random.seed(7)


def rows(spark, values, schema):
    return spark.createDataFrame([(v,) for v in values], schema)


@pytest.mark.parametrize("left,right", [(0, 0), (3, 5), (44, 0), (0, 63), (32, 32), (40, 40)])
def test_mask_drops_low_and_high_bits(left, right):
    mask = bits.ham_mask(left, right) & (2**64 - 1)
    kept = [k for k in range(64) if mask >> k & 1]
    assert kept == (list(range(64)) if left + right >= 64 else list(range(left, 64 - right)))


def test_hex_hashes(spark):
    texts = ["0", "ff", "FFFFFFFFFFFFFFFF", "8000000000000000", "", "xyz", "12345678901234567", None, "0a"]
    got = [r[0] for r in rows(spark, texts, "t string").select(bits.parse_hex(F.col("t"))).collect()]
    assert got == [0, 255, -1, -(2**63), None, None, None, None, 10]
    back = [r[0] for r in rows(spark, [0, -1, 255, -(2**63)], "v long").select(bits.to_hex(F.col("v"))).collect()]
    assert back == ["0", "f" * 16, "ff", "8000000000000000"]


@pytest.mark.parametrize("level", [1, 2, 3, 9])
def test_score_is_the_rounded_root_over_half_the_values(spark, level):
    pairs = [([random.randrange(256) for _ in range(64)], [random.randrange(256) for _ in range(64)]) for _ in range(20)] + [([5] * 64, None), ([1], [2, 3])]
    got = [r[0] for r in spark.createDataFrame(pairs, "a array<int>, b array<int>").select(bits.msd(F.col("a"), F.col("b"), level)).collect()]
    for (a, b), score in zip(pairs, got):
        if b is None or len(a) != len(b):
            assert score == 2500
        else:
            q = lambda v: math.floor(v / level + 0.5)
            total = sum((q(x) - q(y)) ** 2 for x, y in zip(a, b))
            assert score == math.floor(math.sqrt(total * level * level / (len(a) / 2)) + 0.5)


def fingerprints(n):
    kinds = [lambda: random.randrange(256), lambda: random.randrange(126, 131), lambda: random.choice((0, 255)), lambda: random.randrange(6), lambda: random.randrange(250, 256)]
    return [bytes(kinds[k % len(kinds)]() for _ in range(n)) for k in range(15)] + [bytes(i * 37 % 256 for i in range(n))]


@pytest.mark.parametrize("level", [1, 3])
def test_difference_and_local_mean_hash(spark, level):
    prints = fingerprints(72)
    df = rows(spark, prints, "p binary").withColumn("v", bits.bytes_of(F.col("p")))
    got = df.select(bits.to_hex(hashes.d_hash(F.col("v"), level)), bits.to_hex(hashes.l_hash(F.col("v"), level))).collect()
    for raw, (d, local) in zip(prints, got):
        p = [math.floor(x / level + 0.5) * level for x in raw]
        want = "".join("1" if p[i] < p[i + 1] else "0" for i in range(72) if (i + 1) % 9)
        assert d == format(int(want, 2), "x")
        row = [sum(p[r * 9 + c] for c in range(8)) / 8 for r in range(8)]
        col = [sum(p[r * 9 + c] for r in range(8)) / 8 for c in range(8)]
        want = "".join("1" if p[r * 9 + c] > (row[r] + col[c]) / 2 else "0" for r in range(8) for c in range(8))
        assert local == format(int(want, 2), "x")


@pytest.mark.parametrize("mode", [0, 1])
def test_cosine_hash_by_the_definition(mode):
    raw = np.frombuffer(b"".join(fingerprints(1024)), np.uint8).astype(np.int64).reshape(-1, 1024)
    got = hashes.p_hash_values(raw, mode).view(np.uint64)
    for values, bits_ in zip(raw.reshape(-1, 32, 32), got):
        table = [[math.cos(i * math.pi * (j + 0.5) / 32) * math.sqrt(2 / 32) * (1 / math.sqrt(2) if i == 0 else 1) for j in range(32)] for i in range(8)]
        step = [[sum(values[y][x] * table[u][x] for x in range(32)) for u in range(8)] for y in range(32)]
        low = [sum(step[y][u] * table[v][y] for y in range(32)) for u in range(8) for v in range(8)]
        term = np.median(low) if mode == 1 else sum(low[1:]) / 63
        want = sum(1 << k for k, x in enumerate(low) if x > term)
        odd = bin(want ^ int(bits_)).count("1")
        assert odd == 0 or all(abs(low[k] - term) < 1e-9 for k in range(64) if (want ^ int(bits_)) >> k & 1)


def test_cosine_hash_column_refuses_other_lengths(spark):
    prints = fingerprints(1024)[:3] + [b"short", None]
    got = [r[0] for r in rows(spark, prints, "p binary").select(hashes.p_hash(F.col("p"))).collect()]
    assert got[3:] == [None, None] and all(isinstance(x, int) for x in got[:3])
    # a discretised 256 counts as 0
    a = rows(spark, [bytes([255] * 512 + [0] * 512)], "p binary").select(hashes.p_hash(F.col("p"), 1, 2)).first()[0]
    b = rows(spark, [bytes(1024)], "p binary").select(hashes.p_hash(F.col("p"), 1, 2)).first()[0]
    assert a == b


def test_stored_hash_keeps_what_is_known(spark):
    df = spark.createDataFrame([("ab", 5, 72), (None, 5, 72), (None, 5, 71), (None, None, None)], "old string, new long, n int")
    got = [r[0] for r in df.select(hashes.stored_hash(F.col("old"), F.col("new"), F.col("n"), 72)).collect()]
    assert got == ["ab", "5", "", None]
