"""64-bit hashes: text form, masks, Hamming distances, and the score of two fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Score of a pair of which a fingerprint is missing.
NO_SCORE = 2500


def popcount(x: Column) -> Column:
    return F.bit_count(x)


def ham_mask(left: int = 0, right: int = 0) -> int:
    """Signed 64-bit mask without the `left` lowest and `right` highest bits; all bits if that leaves none."""
    if left + right >= 64:
        return -1
    mask = ((1 << 64) - 1) >> (left + right) << left
    return mask - (1 << 64) if mask >> 63 else mask


def hamming(a: Column, b: Column, mask: int = -1) -> Column:
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(mask).cast("long")))


def is_hex(text: Column) -> Column:
    """1 to 16 hexadecimal digits."""
    return F.coalesce(text.rlike(r"^[0-9A-Fa-f]{1,16}$"), F.lit(False))


def parse_hex(text: Column) -> Column:
    """The bits of a hexadecimal hash as a signed long; null where it isn't one."""
    return F.when(is_hex(text), F.conv(F.when(is_hex(text), text), 16, -10).cast("long"))


def to_hex(bits: Column) -> Column:
    """Lower case, unsigned, without leading zeros."""
    return F.lower(F.hex(bits))


def round_half_away(x: Column) -> Column:
    """Of a value that isn't negative."""
    return F.floor(x + 0.5)


def discretize(value: Column, level: int) -> Column:
    """The nearest multiple of level; may be 256."""
    return (F.floor(value / F.lit(float(level)) + 0.5) * level).cast("int") if level > 1 else value.cast("int")


def quotient(value: Column, level: int) -> Column:
    return F.floor(value / F.lit(float(level)) + 0.5).cast("int") if level > 1 else value.cast("int")


def sum_squares(a: Column, b: Column) -> Column:
    """Sum of squared differences of two arrays of whole numbers."""
    squares = F.zip_with(a, b, lambda x, y: (x - y).cast("long") * (x - y).cast("long"))
    return F.aggregate(squares, F.lit(0).cast("long"), lambda t, x: t + x)


def msd_score(total: Column, count: Column, level: int = 1) -> Column:
    """Rounded root of the sum of squares over half the number of values, at the scale of the compressor level."""
    return F.floor(F.sqrt(total * (level * level) / (count / 2.0)) + 0.5).cast("int")


def msd(a: Column, b: Column, level: int = 1) -> Column:
    """Score of two arrays of gray values; NO_SCORE where one is missing or their lengths differ."""
    x, y = F.transform(a, lambda v: quotient(v, level)), F.transform(b, lambda v: quotient(v, level))
    known = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(F.coalesce(known, F.lit(False)), msd_score(sum_squares(x, y), F.size(a), level)).otherwise(F.lit(NO_SCORE))


def bytes_of(binary: Column) -> Column:
    """Array of the unsigned bytes of a binary."""
    text = F.hex(binary)
    return F.when(F.octet_length(binary) > 0, F.transform(F.sequence(F.lit(1), F.octet_length(binary)), lambda i: F.conv(F.substring(text, i * 2 - 1, F.lit(2)), 16, 10).cast("int")))
