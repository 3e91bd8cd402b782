"""Points, rectangles, polygons and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_rectangle(x: Column, y: Column, left: Column, right: Column, top: Column, bottom: Column) -> Column:
    return x.between(left, right) & y.between(top, bottom)


def in_circle(x: Column, y: Column, cx: Column, cy: Column, radius: Column) -> Column:
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= radius * radius


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd rule over an array of struct(x, y), whose coordinates count as whole numbers."""
    n = F.size(points)
    at = lambda i: F.get(points, F.pmod(i, n).cast("int"))

    def crosses(i: Column) -> Column:
        p, q = at(i), at(i - 1 + n)
        xi, yi, xj, yj = (c.cast("long") for c in (p["x"], p["y"], q["x"], q["y"]))
        run = F.try_divide((xj - xi) * (y - yi), yj - yi).cast("long")
        return F.coalesce(((yi > y) != (yj > y)) & (x < run + xi), F.lit(False))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), lambda t, i: t != crosses(i))).otherwise(F.lit(False))


def angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees in [0, 360) from the first point to the second."""
    return F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)) + 360.0, F.lit(360.0))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def intersection(x1: Column, y1: Column, x2: Column, y2: Column, x3: Column, y3: Column, x4: Column, y4: Column) -> Column:
    """struct(x, y) where the lines through two pairs of points meet; null if they are parallel."""
    d = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    a, b = x1 * y2 - y1 * x2, x3 * y4 - y3 * x4
    return F.when(d != 0, F.struct(F.try_divide(a * (x3 - x4) - (x1 - x2) * b, d).alias("x"), F.try_divide(a * (y3 - y4) - (y1 - y2) * b, d).alias("y")))


def clamp(value: Column, low: Column, high: Column, wrap: bool = False) -> Column:
    """Within low and high; with wrap, a value beyond one end becomes the other end."""
    return F.when(value < low, high if wrap else low).when(value > high, low if wrap else high).otherwise(value)


def in_range(value: Column, a: Column, b: Column) -> Column:
    """Ends included, in either order."""
    return value.between(F.least(a, b), F.greatest(a, b))


def weigh(a: Column, b: Column, weight: Column) -> Column:
    return a * weight + b * (1 - weight)


def fit_size(width: Column, height: Column, box_width: Column, box_height: Column) -> Column:
    """struct(w, h): the size at which an image fits a box, of two: as wide as the box, or as high as wanted, the other side following by
    the ratio at 5 decimals. Images smaller than the box are enlarged to it, others are as high as they are, or as the box."""
    share = lambda a, b: F.floor(F.try_divide(a.cast("double"), b.cast("double")) * 1e5 + 0.5) / 1e5
    whole = lambda x: F.floor(x + 0.5).cast("int")
    ratio, smaller = share(width, height), (width <= box_width) & (height <= box_height)
    wide = F.struct(box_width.cast("int").alias("w"), whole(F.try_divide(box_width.cast("double"), ratio)).alias("h"))
    wanted = F.when(smaller, box_height).otherwise(F.least(height, box_height)).cast("int")
    high = F.struct(whole(wanted * ratio).alias("w"), wanted.alias("h"))
    use_wide = F.when(smaller, wide["h"] <= box_height).otherwise(ratio > share(box_width, box_height))
    as_is = F.struct(width.cast("int").alias("w"), height.cast("int").alias("h"))
    size = F.when(F.least(width, height, box_width, box_height) < 1, as_is).when(use_wide, wide).otherwise(high)
    return F.struct(*[F.greatest(F.lit(1), size[c]).alias(c) for c in ("w", "h")])


def dots_per_inch(dots_per_metre: Column) -> Column:
    return F.round(dots_per_metre * 0.0254).cast("int")
