"""Steps of a colour adjustment on pixels of 16 bits a channel, as expressions; a pixel is a tuple of three columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from photarium.functions.colour import GRAY, hsl_to_rgb, rgb_to_hsl
from photarium.functions.geometry import weigh

TOP = 65535
Pixel = tuple[Column, Column, Column]


def _each(pixel: Pixel, f) -> Pixel:
    return tuple(f(c) for c in pixel)


def _whole(x: Column) -> Column:
    """Without decimals, as a cast of the value would leave it."""
    return x.cast("long")


def _within(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(TOP), x))


def offset(pixel: Pixel, by: tuple[int, int, int], clamped: bool = True) -> Pixel:
    moved = tuple(c + d for c, d in zip(pixel, by))
    return _each(moved, _within) if clamped else moved


def threshold(pixel: Pixel, levels: tuple[int, int, int], low: int | None = 0, high: int | None = TOP) -> Pixel:
    """Channels above their level become high, others low; None keeps the value. A negative level leaves its channel alone."""
    put = lambda value, c: c if value is None else F.lit(value)
    return tuple(c if level < 0 else F.when(c > level, put(high, c)).otherwise(put(low, c)) for c, level in zip(pixel, levels))


def invert(pixel: Pixel) -> Pixel:
    return _each(pixel, lambda c: F.lit(TOP) - c)


def black_point(pixel: Pixel, level: int) -> Pixel:
    return _each(pixel, lambda c: F.greatest(c, F.lit(level)))


def white_point(pixel: Pixel, level: int) -> Pixel:
    return _each(pixel, lambda c: F.least(c, F.lit(level)))


def gray16(pixel: Pixel) -> Column:
    """Of values that may lie outside 0..65535: the darkest negative one counts as zero, and the brightest is the limit."""
    low, high = F.least(*pixel, F.lit(0)), F.greatest(*pixel, F.lit(TOP))
    return F.least(_whole(sum(((c - low) * w for c, w in zip(pixel, GRAY)), F.lit(0.0))), high)


def shadows(pixel: Pixel, strength: float, strong: bool = False) -> Pixel:
    """Brightens by strength, the more the darker the pixel."""
    top = F.greatest(*pixel, F.lit(TOP))
    share = 1.0 - gray16(pixel) * (1.0 if strong else 2.0) / top
    return _each(pixel, lambda c: _whole(weigh(_whole(c + c * strength), c, share)))


def highlights(pixel: Pixel, strength: float, strong: bool = False) -> Pixel:
    """Brightens by strength, the more the brighter the pixel."""
    top = F.greatest(*pixel, F.lit(TOP))
    share = gray16(pixel) * (1.25 if strong else 0.8) / (top / 1.5)
    return _each(pixel, lambda c: _whole(weigh(_whole(c + c * strength), c, share)))


def desaturate(pixel: Pixel, level: int) -> Pixel:
    """Towards gray, wholly at 65535."""
    return _each(pixel, lambda c: _whole(weigh(gray16(pixel), c, F.lit(abs(level) / TOP))))


def _turned(pixel: Pixel, h: Column | None, s: Column | None) -> Pixel:
    own = rgb_to_hsl(*pixel, top=float(TOP))
    out = hsl_to_rgb(own["h"] if h is None else h, own["s"] if s is None else s, own["l"], top=float(TOP))
    return tuple(out[c] for c in "rgb")


def hue_rotate(pixel: Pixel, degrees: int) -> Pixel:
    """Turns the hue; turns of up to 15 degrees mix old and new by a share of the turn."""
    own = rgb_to_hsl(*pixel, top=float(TOP))
    turned = _turned(pixel, F.pmod(own["h"] + float(degrees) + 360.0, F.lit(360.0)), F.least(F.lit(1.0), own["s"] + 0.01))
    share = F.lit(min(1.0, abs(degrees) / 15.0))
    return tuple(_whole(weigh(F.floor(t), c, share)) for t, c in zip(turned, pixel))


def tint(pixel: Pixel, degrees: int, level: int) -> Pixel:
    """The pixel's lightness in a hue of half saturation, mixed in by level of 65535."""
    turned = _turned(pixel, F.lit(float(degrees)), F.lit(0.5))
    return tuple(_whole(weigh(F.floor(t), c, F.lit(level / TOP))) for t, c in zip(turned, pixel))
