"""Colour conversions and blends, as expressions over channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from photarium.functions.geometry import clamp

#: Weights of red, green and blue in gray.
GRAY = (0.299701, 0.587130, 0.114180)
#: Linear sRGB to XYZ, over the D65 white point.
TO_XYZ = (
    (0.4123955889674142, 0.3575834307637148, 0.1804926473817016),
    (0.2125862307855956, 0.7151703037034108, 0.0722004986433362),
    (0.0192972154917469, 0.1191838645808485, 0.9504971251315798),
)
WHITE = (0.95047, 1.0, 1.08883)
#: Below these, the cube root gives way to a line. Not those of the standard, by intention.
LAB_EDGE = 0.00885645167903563082e-3
LUMA_EDGE = 8.88564517


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def gray(r: Column, g: Column, b: Column) -> Column:
    """0..255, rounded half away from zero."""
    lo, hi = F.lit(0), F.lit(255)
    total = clamp(r, lo, hi) * GRAY[0] + clamp(g, lo, hi) * GRAY[1] + clamp(b, lo, hi) * GRAY[2]
    return clamp(F.round(total).cast("int"), lo, hi)


def fast_gray(rgb: Column) -> Column:
    """From a packed 0xRRGGBB, by the high four bits of each channel."""
    return F.shiftright(rgb.bitwiseAND(F.lit(0xF0F0F0)).cast("long") * 0x20A05, 20).bitwiseAND(F.lit(255).cast("long")).cast("int")


def brightness(value: Column, intensity: float) -> Column:
    return clamp((value + F.round(value * intensity)).cast("int"), F.lit(0), F.lit(255))


def contrast(value: Column, intensity: float, deviation: float = 128.0) -> Column:
    return clamp((F.floor((value - 128.0) * intensity) + deviation).cast("int"), F.lit(0), F.lit(255))


def gamma(value: Column, exponent: float) -> Column:
    return F.round(F.pow(clamp(value, F.lit(0), F.lit(255)) / 255.0, exponent) * 255.0).cast("int")


def linear(value: Column) -> Column:
    """Linear light, 0..1, of an sRGB channel 0..255."""
    x = value / 255.0
    return F.when(x > 0.0404482362771076, F.pow((x + 0.055) / 1.055, 2.4)).otherwise(x / 12.92)


def lab_f(y: Column) -> Column:
    return F.when(y >= LAB_EDGE, F.cbrt(y)).otherwise(y * (841.0 / 108.0) + 4.0 / 29.0)


def luma_f(y: Column) -> Column:
    return F.when(y >= LUMA_EDGE, F.cbrt(y)).otherwise(y * 7.7870370 + 0.1379310)


def rgb_to_xyz(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    channels = [linear(x) for x in (r, g, b)]
    return tuple(sum((m * c for m, c in zip(row[1:], channels[1:])), channels[0] * row[0]) / w for row, w in zip(TO_XYZ, WHITE))


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """struct(L, a, b)."""
    x, y, z = (lab_f(c) for c in rgb_to_xyz(r, g, b))
    return F.struct((y * 116.0 - 16.0).alias("L"), ((x - y) * 500.0).alias("a"), ((y - z) * 200.0).alias("b"))


def lab_hue(a: Column, b: Column) -> Column:
    """Degrees."""
    turn = F.when(a < 0, 180.0).when((a > 0) & (b < 0), 360.0).otherwise(0.0)
    return (
        F.when((a >= 0) & (b == 0), 0.0).when((a < 0) & (b == 0), 180.0).when((a == 0) & (b > 0), 90.0).when((a == 0) & (b < 0), 270.0)
        .otherwise(F.degrees(F.atan(F.try_divide(b.cast("double"), a.cast("double")))) + turn)
    )


def delta_e2000(l1: Column, a1: Column, b1: Column, l2: Column, a2: Column, b2: Column, kl: float = 1.0, kc: float = 1.0, kh: float = 1.0) -> Column:
    """CIEDE2000 difference of two Lab colours, by its published formula."""
    seventh = 25.0**7
    mean_c = (F.hypot(a1, b1) + F.hypot(a2, b2)) / 2
    g = (1 - F.sqrt(F.pow(mean_c, 7.0) / (F.pow(mean_c, 7.0) + seventh))) * 0.5 + 1
    p1, p2 = a1 * g, a2 * g
    c1, c2 = F.hypot(p1, b1), F.hypot(p2, b2)
    hue = lambda p, b: F.when((p == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, p)) + 360.0, F.lit(360.0)))
    h1, h2 = hue(p1, b1), hue(p2, b2)
    none, turn = (c1 * c2) == 0, h2 - h1
    dh = F.when(none, 0.0).when(F.abs(turn) <= 180, turn).when(turn > 180, turn - 360).otherwise(turn + 360)
    big_h = F.sqrt(c1 * c2) * 2 * F.sin(F.radians(dh / 2))
    total = h1 + h2
    mean_h = F.when(none, total).when(F.abs(h1 - h2) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
    t = 1 - F.cos(F.radians(mean_h - 30)) * 0.17 + F.cos(F.radians(mean_h * 2)) * 0.24 + F.cos(F.radians(mean_h * 3 + 6)) * 0.32 - F.cos(F.radians(mean_h * 4 - 63)) * 0.20
    mean_c2, mean_l = (c1 + c2) / 2, (l1 + l2) / 2 - 50
    turned = F.exp(-F.pow((mean_h - 275) / 25, 2.0)) * 60
    rc = F.sqrt(F.pow(mean_c2, 7.0) / (F.pow(mean_c2, 7.0) + seventh)) * 2
    rt = -F.sin(F.radians(turned)) * rc
    dl = (l2 - l1) / ((mean_l * mean_l * 0.015 / F.sqrt(mean_l * mean_l + 20) + 1) * kl)
    dc = (c2 - c1) / ((mean_c2 * 0.045 + 1) * kc)
    dhn = big_h / ((mean_c2 * t * 0.015 + 1) * kh)
    return F.sqrt(dl * dl + dc * dc + dhn * dhn + rt * dc * dhn)


def rgb_to_cmyk(r: Column, g: Column, b: Column) -> Column:
    """struct(c, m, y, k), 0..255."""
    k = F.least(255.0 - r, 255.0 - g, 255.0 - b)
    part = lambda x: F.when(k >= 255, 0.0).otherwise(F.try_divide((255.0 - x - k) * 255.0, 255.0 - k))
    return F.struct(part(r).alias("c"), part(g).alias("m"), part(b).alias("y"), k.alias("k"))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    part = lambda x: 255.0 - k - x * (255.0 - k) / 255.0
    return F.struct(part(c).alias("r"), part(m).alias("g"), part(y).alias("b"))


def rgb_to_hsl(r: Column, g: Column, b: Column, top: float = 255.0) -> Column:
    """struct(h, s, l): hue in degrees, the rest 0..1."""
    x, y, z = (c / top for c in (r, g, b))
    low, high = F.least(x, y, z), F.greatest(x, y, z)
    d, light = high - low, (F.least(x, y, z) + F.greatest(x, y, z)) / 2
    s = F.when(d == 0, 0.0).when(light < 0.5, F.try_divide(d, high + low)).otherwise(F.try_divide(d, 2.0 - high - low))
    sixth = F.when(d == 0, 0.0).when(x == high, F.try_divide(y - z, d)).when(y == high, F.try_divide(z - x, d) + 2).otherwise(F.try_divide(x - y, d) + 4)
    return F.struct(F.pmod(sixth * 60 + 360.0, F.lit(360.0)).alias("h"), s.alias("s"), light.alias("l"))


def hsl_to_rgb(h: Column, s: Column, light: Column, top: float = 255.0) -> Column:
    """struct(r, g, b) as doubles, 0..top."""
    two = F.when(light < 0.5, light * (1 + s)).otherwise(light + s - s * light)
    one = light * 2 - two

    def channel(shift: float) -> Column:
        t = F.pmod(h / 360.0 + shift + 1.0, F.lit(1.0))
        v = F.when(t * 6 < 1, one + (two - one) * 6 * t).when(t * 2 < 1, two).when(t * 3 < 2, one + (two - one) * (2.0 / 3 - t) * 6).otherwise(one)
        return F.when(s <= 0, light * top).otherwise(clamp(v * top, F.lit(0.0), F.lit(top)))

    return F.struct(channel(1.0 / 3).alias("r"), channel(0.0).alias("g"), channel(-1.0 / 3).alias("b"))


class Blend:
    """Blends by composition, over any algebra: Spark columns here, arrays in the image kernels.

    pick(condition, then, otherwise), least and greatest of two, root, size (absolute value) and share(a, b) = a / b, which may be anything
    where b is 0.
    """

    def __init__(self, pick, least, greatest, root, size, share):
        self.pick, self.least, self.greatest, self.root, self.size, self.share = pick, least, greatest, root, size, share
        #: The numbers of the modes.
        self.modes = {
            1: least, 2: self.multiply, 3: self.linear_burn, 4: self.burn, 5: greatest, 6: self.screen, 7: self.plus, 8: self.hard, 9: self.soft,
            10: lambda top, under: self.hard(under, top), 11: lambda top, under: pick(top > 1.0 - under, top * 0 + 1.0, top * 0),
            12: lambda top, under: self.linear_burn(top * 2, under), 13: self.dodge, 14: self.vivid, 15: lambda top, under: self.between(top, under, 0.5),
            16: lambda top, under: pick(top > 0, share(under, top), top * 0 + 1.0), 17: lambda top, under: self.screen(top, under) - self.multiply(top, under),
            18: lambda top, under: size(under - top), 19: lambda top, under: under - top, 22: lambda top, under: 1.0 - size(under - top),
        }

    def __call__(self, mode: int, top, under):
        """Within 0..1; an unknown number leaves the top one."""
        out = self.modes[mode](top, under) if mode in self.modes else top
        return self.least(self.greatest(out, out * 0), out * 0 + 1.0)

    def between(self, a, b, share):
        return a + (b - a) * share

    def multiply(self, top, under):
        return top * under

    def screen(self, top, under):
        return 1.0 - self.multiply(1.0 - top, 1.0 - under)

    def plus(self, top, under):
        return top + under

    def linear_burn(self, top, under):
        return self.plus(top, under) - 1.0

    def dodge(self, top, under):
        return self.pick(top < 1, self.share(under, 1.0 - top), top * 0 + 1.0)

    def burn(self, top, under):
        return self.pick(top > 0, 1.0 - self.share(1.0 - under, top), top * 0)

    def halves(self, dark, light):
        """dark(2 top, under) for the darker half of top, light(2 top - 1, under) for the other."""
        return lambda top, under: self.pick(top < 0.5, dark(top * 2, under), light(top * 2 - 1.0, under))

    def hard(self, top, under):
        return self.halves(self.multiply, self.screen)(top, under)

    def vivid(self, top, under):
        return self.halves(self.burn, self.dodge)(top, under)

    def soft(self, top, under):
        return self.halves(lambda t, u: self.between(u * u, u, t), lambda t, u: self.between(u, self.root(u), t))(top, under)


_columns = Blend(lambda c, a, b: F.when(c, a).otherwise(b), F.least, F.greatest, F.sqrt, F.abs, F.try_divide)


def blend(mode: int, top: Column, bottom: Column) -> Column:
    """Blends channels 0..1 by number of mode; an unknown number leaves the top one."""
    return _columns(mode, top.cast("double"), bottom.cast("double"))


def luminosity(r: Column, g: Column, b: Column, alternate: bool = False) -> Column:
    """Gray value by weights (alternate), or half of a lightness on a scale of its own."""
    if alternate:
        return gray(r, g, b)
    y = luma_f(rgb_to_xyz(r, g, b)[1])
    return F.round((y * 116.0 - 16.0) / 2).cast("int")

