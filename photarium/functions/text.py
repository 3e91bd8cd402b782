"""Text, paths and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def nocase(text: Column) -> Column:
    """Folds A-Z only."""
    return F.translate(text, UPPER, LOWER)


def file_extension(path: Column) -> Column:
    """What follows the last dot, if it comes after the last separator; in lower case."""
    return F.lower(F.regexp_extract(path, r"\.([^.\\/]*)$", 1))


def split_extensions(text: Column) -> Column:
    """A list of extensions separated by | , or ;, without blanks, dots and stars around them, empty and repeated ones dropped."""
    parts = F.transform(F.split(text, r"[|,;]"), lambda x: F.lower(F.regexp_replace(x, r"^[\s.*]+|[\s.*]+$", "")))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def trimmer(text: Column, chars: str = "\r\n \t\f\x0b\x08") -> Column:
    return F.btrim(text, F.lit(chars))


def attribute_value(content: Column, name: str) -> Column:
    """Value of an XML attribute, '' if absent."""
    return F.regexp_extract(content, rf'(?is)\b{name}\s*=\s*["\']([^"\']*)["\']', 1)


def is_number(text: Column) -> Column:
    return F.expr("true") & F.coalesce(text.try_cast("double").isNotNull(), F.lit(False))


#: Pixels of a unit, to be rounded. vmin is read as inches.
UNITS = {"pt": 1.33333, "pc": 16.0, "cm": 37.795275591, "mm": 3.7795275591, "in": 96.0, "vmin": 96.0}
_LENGTH = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)?.*?(px|pt|pc|cm|mm|in|vw|vh|vmin|vmax|%|$)"


def svg_pixels(length: Column, screen_width: float = 1920, screen_height: float = 1080) -> Column:
    """Pixels of an SVG length, a number and a unit. Lengths that depend on the view use a screen of the given size; what has no number
    and no unit is as large as twice the mean of the screen's sides."""
    larger, mean = max(screen_width, screen_height), float(int((screen_width + screen_height) / 2 + 0.5))
    view = {"vw": screen_width * 2.0, "vh": screen_height * 2.0, "vmax": larger * 2.0}
    table = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    text = F.lower(F.regexp_replace(length, " ", ""))
    number = F.coalesce(F.regexp_extract(text, _LENGTH, 1).try_cast("double"), F.lit(0.0))
    unit = F.regexp_extract(text, _LENGTH, 2)
    plain = (unit == "px") | (text.rlike(r"^[0-9.+\-e]+$") & (number > 0))
    share = F.greatest(F.lit(0.1), F.least(F.lit(1.0), number / 200.0))
    of_view = F.when(unit == "%", F.floor(share * larger + 0.5) * 3.0).otherwise(F.try_element_at(table(view), unit))
    rounded = F.floor(number * F.try_element_at(table(UNITS), unit) + 0.5).cast("double")
    return F.when(plain, number).otherwise(F.coalesce(rounded, of_view, F.lit(mean * 2.0)))


def group_label(root: Column, tag: Column) -> Column:
    return F.concat_ws("_", root.cast("string"), tag.cast("string"))


def pad9(x: Column) -> Column:
    return F.when(F.length(x.cast("string")) >= 9, x.cast("string")).otherwise(F.lpad(x.cast("string"), 9, "0"))


def contains_any(text: Column, values: list[str]) -> Column:
    """Whether one of the values is a part of the text, case aside."""
    out = F.lit(False)
    for v in values:
        out = out | F.lower(text).contains(v.lower())
    return out


def equals_any(text: Column, values: list[str]) -> Column:
    return F.lower(text).isin(*[v.lower() for v in values]) if values else F.lit(False)


def renamed(name: Column, counter: Column | None = None, prefix: str = "", suffix: str = "", search: str | None = None, replace: str = "", digits: int = 3) -> Column:
    """A new file name: search and replace in the stem, prefix and suffix around it, then a counter; the extension stays."""
    stem, extension = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^.*?(\.[^.]*)?$", 1)
    if search:
        stem = F.replace(stem, F.lit(search), F.lit(replace))
    parts = [F.lit(prefix), stem, F.lit(suffix)] + ([F.lpad(counter.cast("string"), digits, "0")] if counter is not None else [])
    return F.concat(*parts, extension)
