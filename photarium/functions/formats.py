"""Names of pixel formats and loaders, file properties, and fingerprints of an older form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a fingerprint of the older text form adds to a gray value.
LEGACY = 161


def _name(names: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in names]), index.cast("int"))


def index_of(key: Column, keys: list[str]) -> Column:
    """Place of a key in a list that counts from 1, whatever its case and braces; 0 for one that isn't there."""
    plain = F.upper(F.translate(key, "{}", ""))
    return F.coalesce(F.array_position(F.array(*[F.lit(k.upper().strip("{}")) for k in keys]), plain), F.lit(0)).cast("int")


def pixel_format(loader: Column, code: Column, bits: Column, colour: Column, toned: Column, names: list[str], colours: list[str], loaders: list[str]) -> Column:
    """Name of a file's pixel format. Loader 1: names[code], names[0] for codes beyond them; loader 2 with known bits and colour: bits and
    colours[colour], and whether it was, or can be, tone-mapped; otherwise loaders[loader], '' without one."""
    first = _name(names, F.when((code > 0) & (code < len(names)), code).otherwise(F.lit(0))) if names else F.lit("")
    note = F.when(toned == 1, " (TONE-MAPPED)").when(toned == 2, " (TONE-MAPPABLE)").otherwise("")
    second = F.concat(bits.cast("string"), F.lit("-"), _name(colours, colour), note)
    other = F.when((loader > 0) & (loader < len(loaders)), _name(loaders, loader)).otherwise("")
    return F.when(loader == 1, first).when((loader == 2) & (bits > 0) & (colour >= 0) & (colour < len(colours)), second).otherwise(other)


def legacy_values(text: Column, level: int = 1) -> Column:
    """Gray values of a fingerprint in the older text form, a character each; null where its first character marks it as absent."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c) - LEGACY)
    values = F.transform(codes, lambda v: F.floor(F.greatest(F.lit(0), F.least(F.lit(255), v)) / float(max(1, level)) + 0.5).cast("int"))
    return F.when(F.ascii(F.substring(text, 1, 1)) >= LEGACY, values)


def properties(text: Column, between: str = "\n", sign: str = "=") -> Column:
    """Array of struct(number, name, value) from packed text, numbers from 1 in the order of the text; parts without a sign have no value."""
    import re

    parts = F.filter(F.split(text, re.escape(between)), lambda p: F.btrim(p) != "")
    split = lambda p, k: F.btrim(F.get(F.split(p, re.escape(sign), 2), F.lit(k)))
    return F.transform(parts, lambda p, i: F.struct((i + 1).alias("number"), split(p, 0).alias("name"), split(p, 1).alias("value")))


def property_by_name(found: Column, name: str) -> Column:
    """Value of the first property of that name, case aside."""
    return F.get(F.filter(found, lambda p: F.lower(p["name"]) == name.lower()), F.lit(0))["value"]


def property_by_number(found: Column, number: int) -> Column:
    return F.get(found, F.lit(number - 1))["value"]


def properties_as_csv(found: Column) -> Column:
    """name,value lines, quoted where they hold commas or quotes."""
    quoted = lambda x: F.when(x.rlike('[",]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(x, F.lit("")))
    return F.array_join(F.transform(found, lambda p: F.concat(quoted(p["name"]), F.lit(","), quoted(p["value"]))), "\n")
