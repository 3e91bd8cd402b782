"""Perceptual hashes of gray fingerprints: difference and local-mean hash of 9 x 8 values, cosine-transform hash of 32 x 32."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from photarium.functions.bits import discretize, to_hex

SMALL, BIG = 72, 1024


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _bits(places: Column, test) -> Column:
    """A bit for each place, most significant first."""
    return F.aggregate(places, F.lit(0).cast("long"), lambda bits, k: F.shiftleft(bits, 1).bitwiseOR(F.when(test(k), F.lit(1)).otherwise(F.lit(0)).cast("long")))


def _span(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def d_hash(values: Column, level: int = 1) -> Column:
    """values: 72 gray values, 8 rows of 9. A bit for each value that is less than its right neighbour."""
    v = F.transform(values, lambda x: discretize(x, level))
    places = F.filter(_span(SMALL), lambda i: (i + 1) % 9 != 0)
    return F.when(F.size(values) == SMALL, _let(v, lambda a: _bits(places, lambda i: F.get(a, i) < F.get(a, i + 1))))


def l_hash(values: Column, level: int = 1) -> Column:
    """A bit for each value of the left 8 x 8 block above the mean of its row's and its column's mean."""
    v = F.transform(values, lambda x: discretize(x, level).cast("double"))
    add = lambda t, x: t + x

    def hashed(a: Column) -> Column:
        rows = F.transform(_span(8), lambda r: F.aggregate(F.slice(a, r * 9 + 1, 8), F.lit(0.0), add) / 8.0)
        columns = F.transform(_span(8), lambda c: F.aggregate(_span(8), F.lit(0.0), lambda t, r: t + F.get(a, r * 9 + c)) / 8.0)
        row = lambda k: F.shiftright(k, 3)
        return _let(F.struct(rows.alias("r"), columns.alias("c")), lambda m: _bits(_span(64), lambda k: F.get(a, row(k) * 9 + k % 8) > (F.get(m["c"], k % 8) + F.get(m["r"], row(k))) / 2.0))

    return F.when(F.size(values) == SMALL, _let(v, hashed))


def threshold_hash(values: Column, n: int = 64) -> Column:
    """A bit for each of n values above their mean, most significant first; for vectors that stand in for fingerprints."""
    v = F.transform(values, lambda x: x.cast("double"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / n
    return F.when(F.size(values) == n, _let(v, lambda a: _let(mean(a), lambda m: _bits(_span(n), lambda k: F.get(a, k) > m))))


def _cosines(size: int = 32) -> np.ndarray:
    i, j = np.arange(size)[:, None], np.arange(size)[None, :]
    table = np.cos(i * np.pi * (j + 0.5) / size) * np.sqrt(2.0 / size)
    table[0] /= np.sqrt(2.0)
    return table


def p_hash_values(pixels: np.ndarray, mode: int = 1) -> np.ndarray:
    """pixels: n x 1024. Bits of the 8 x 8 lowest frequencies, transposed, least significant first, above their median (mode 1) or
    above the mean of all but the first (any other mode). Values count modulo 256, as bytes hold them."""
    table = _cosines()
    block = table @ (pixels.reshape(-1, 32, 32) & 0xFF).astype(np.float64) @ table.T
    low = block[:, :8, :8].transpose(0, 2, 1).reshape(-1, 64)
    term = np.median(low, axis=1) if mode == 1 else low[:, 1:].sum(axis=1) / 63
    return np.packbits((low > term[:, None])[:, ::-1], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def p_hash(binary: Column, mode: int = 1, level: int = 1) -> Column:
    """Of a binary of 1024 gray values; null where it has another length."""

    @F.pandas_udf("long")
    def of(rows: pd.Series) -> pd.Series:
        good = [i for i, x in enumerate(rows) if x is not None and len(x) == BIG]
        out = pd.Series([None] * len(rows), dtype="Int64")
        if good:
            values = np.frombuffer(b"".join(rows.iloc[i] for i in good), np.uint8).astype(np.int64).reshape(-1, BIG)
            if level > 1:
                values = np.floor(values / level + 0.5).astype(np.int64) * level
            out.iloc[good] = p_hash_values(values, mode)
        return out

    return of(binary)


def stored_hash(known: Column, fresh: Column, length: Column, wanted: int) -> Column:
    """What the hash column holds after a run: what it had, else the new hash in text, '' for a fingerprint of another length, null for none."""
    return F.when(known.isNotNull(), known).when(length.isNull(), F.lit(None).cast("string")).when(length != wanted, F.lit("")).otherwise(to_hex(fresh))
