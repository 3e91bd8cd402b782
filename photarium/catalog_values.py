"""More named queries with their DuckDB twins: colours, 16-bit steps, text, dates, geometry, formats and image kernels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photarium.catalog import _CHANNELS, _GRAYS, _channels, _grays, query, table
from photarium.functions import adjust, bits, colour, dates, formats, geometry, text
from photarium.operators import kernels

# colours


@query(
    f"WITH {_CHANNELS} SELECT p_partkey, greatest(0, least(255, r + round(r * 0.25::DOUBLE)))::BIGINT AS brighter, greatest(0, least(255, r + round(r * -0.4::DOUBLE)))::BIGINT AS darker, "
    "round(pow(g / 255.0::DOUBLE, 0.45::DOUBLE) * 255)::BIGINT AS gamma, greatest(0, least(255, floor((b - 128) * 0.6::DOUBLE) + 100))::BIGINT AS flat FROM ch"
)
def tone_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    found = {"brighter": colour.brightness(r, 0.25), "darker": colour.brightness(r, -0.4), "gamma": colour.gamma(g, 0.45), "flat": colour.contrast(b, 0.6, 100.0)}
    return _channels(spark, sf_dir).select("p_partkey", *[c.cast("long").alias(n) for n, c in found.items()])


_LAB = (
    f"{_CHANNELS}, l AS (SELECT p_partkey, r, g, b, list_transform([r, g, b], lambda v: CASE WHEN v / 255.0::DOUBLE > 0.0404482362771076::DOUBLE THEN ((v / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4 ELSE v / 255.0::DOUBLE / 12.92 END) AS c FROM ch), "
    + "z AS (SELECT *, "
    + ", ".join(f"(c[1] * {m[0]}::DOUBLE + c[2] * {m[1]}::DOUBLE + c[3] * {m[2]}::DOUBLE) / {w}::DOUBLE AS {n}" for n, m, w in zip("xyz", colour.TO_XYZ, colour.WHITE))
    + f" FROM l), f AS (SELECT *, list_transform([x, y, z], lambda t: CASE WHEN t >= {colour.LAB_EDGE:.22f}::DOUBLE THEN cbrt(t) ELSE t * 841 / 108.0 + 4 / 29.0::DOUBLE END) AS f FROM z), "
    "lab AS (SELECT p_partkey, f[2] * 116 - 16 AS ll, (f[1] - f[2]) * 500 AS aa, (f[2] - f[3]) * 200 AS bb FROM f)"
)


@query(f"WITH {_LAB} SELECT p_partkey, round(aa, 4) AS a, round(bb, 4) AS b, CASE WHEN abs(aa) + abs(bb) > 0.01 THEN round(degrees(atan2(bb, aa)) + CASE WHEN bb < 0 THEN 360 ELSE 0 END, 3) END AS hue FROM lab")
def lab_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour axes and their angle."""
    rows = _channels(spark, sf_dir).select("p_partkey", colour.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")).alias("c"))
    a, b = F.col("c.a"), F.col("c.b")
    return rows.select("p_partkey", F.round(a, 4).alias("a"), F.round(b, 4).alias("b"), F.when(F.abs(a) + F.abs(b) > 0.01, F.round(colour.lab_hue(a, b), 3)).alias("hue"))


@query(
    f"WITH {_CHANNELS}, p AS (SELECT p_partkey, r / 2.55::DOUBLE AS l1, g - 128.0::DOUBLE AS a1, b - 128.0::DOUBLE AS b1, g / 2.55::DOUBLE AS l2, b - 128.0::DOUBLE AS a2, r - 128.0::DOUBLE AS b2 FROM ch), "
    "c AS (SELECT *, (sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2 AS cm FROM p), g AS (SELECT *, 1 + 0.5 * (1 - sqrt(cm ** 7 / (cm ** 7 + 25.0::DOUBLE ** 7))) AS g FROM c), "
    "d AS (SELECT *, a1 * g AS p1, a2 * g AS p2 FROM g), e AS (SELECT *, sqrt(p1 * p1 + b1 * b1) AS c1, sqrt(p2 * p2 + b2 * b2) AS c2, (degrees(atan2(b1, p1))::DOUBLE + 360) % 360 AS h1, (degrees(atan2(b2, p2))::DOUBLE + 360) % 360 AS h2 FROM d), "
    "h AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 > h1 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh, CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm, "
    "(c1 + c2) / 2 AS cc, (l1 + l2) / 2 AS lm FROM e), t AS (SELECT *, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.2 * cos(radians(4 * hm - 63)) AS t FROM h), "
    "x AS (SELECT *, (l2 - l1) / (1 + 0.015 * (lm - 50) ** 2 / sqrt(20 + (lm - 50) ** 2)) AS x, (c2 - c1) / (1 + 0.045 * cc) AS y, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * cc * t) AS z, "
    "-2 * sqrt(cc ** 7 / (cc ** 7 + 25.0::DOUBLE ** 7)) * sin(radians(60 * exp(0 - pow((hm - 275) / 25, 2)))) AS rt FROM t) SELECT p_partkey, round(sqrt(x * x + y * y + z * z + rt * y * z), 4) AS delta FROM x"
)
def colour_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    delta = colour.delta_e2000(r / 2.55, g - 128.0, b - 128.0, g / 2.55, b - 128.0, r - 128.0)
    return _channels(spark, sf_dir).select("p_partkey", F.round(delta, 4).alias("delta"))


#: Each mode by its formula: o above, u below.
_BLENDS = {
    1: "least(o, u)", 2: "o * u", 3: "o + u - 1", 4: "CASE WHEN o > 0 THEN 1 - (1 - u) / o ELSE 0 END", 5: "greatest(o, u)", 6: "1 - (1 - o) * (1 - u)", 7: "o + u", 8: "CASE WHEN o < 0.5 THEN 2 * o * u ELSE 1 - 2 * (1 - o) * (1 - u) END",
    9: "CASE WHEN o < 0.5 THEN (1 - 2 * o) * u * u + 2 * o * u ELSE 2 * u * (1 - o) + sqrt(u) * (2 * o - 1) END", 10: "CASE WHEN u < 0.5 THEN 2 * o * u ELSE 1 - 2 * (1 - o) * (1 - u) END", 11: "CASE WHEN o > 1 - u THEN 1 ELSE 0 END",
    12: "2 * o + u - 1", 13: "CASE WHEN o < 1 THEN u / (1 - o) ELSE 1 END", 14: "CASE WHEN o < 0.5 THEN CASE WHEN o > 0 THEN 1 - (1 - u) / (2 * o) ELSE 0 END WHEN o < 1 THEN u / (2 * (1 - o)) ELSE 1 END", 15: "(o + u) / 2",
    16: "CASE WHEN o > 0 THEN u / o ELSE 1 END", 17: "o + u - 2 * o * u", 18: "abs(u - o)", 19: "u - o", 22: "1 - abs(o - u)", 99: "o",
}


@query(
    f"WITH {_CHANNELS}, x AS (SELECT p_partkey, r / 255.0::DOUBLE AS o, g / 255.0::DOUBLE AS u FROM ch) SELECT p_partkey, "
    + ", ".join(f"round(greatest(0, least(1, {sql}))::DOUBLE, 6) AS mode_{k}" for k, sql in _BLENDS.items())
    + " FROM x"
)
def blended_by_all_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _channels(spark, sf_dir).select("p_partkey", *[F.round(colour.blend(k, F.col("r") / 255.0, F.col("g") / 255.0), 6).alias(f"mode_{k}") for k in _BLENDS])


@query(
    f"WITH {_CHANNELS}, x AS (SELECT p_partkey, r, g, b, greatest(r, g, b)::DOUBLE AS hi, least(r, g, b)::DOUBLE AS lo FROM ch), h AS (SELECT *, hi - lo AS d, (hi + lo) / 510 AS l FROM x) "
    "SELECT p_partkey, round(CASE WHEN d = 0 THEN 0 WHEN r = hi THEN (360 + 60 * (g - b) / d) % 360 WHEN g = hi THEN 120 + 60 * (b - r) / d ELSE 240 + 60 * (r - g) / d END, 6)::DOUBLE AS hue, "
    "round(CASE WHEN d = 0 THEN 0 WHEN l < 0.5 THEN d / (hi + lo) ELSE d / (510 - hi - lo) END, 6)::DOUBLE AS saturation, round(l, 6) AS lightness FROM h"
)
def hsl_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _channels(spark, sf_dir).withColumn("h", colour.rgb_to_hsl(F.col("r"), F.col("g"), F.col("b")))
    return rows.select("p_partkey", *[F.round(f"h.{c}", 6).alias(n) for c, n in (("h", "hue"), ("s", "saturation"), ("l", "lightness"))])


_W = "w AS (SELECT p_partkey, (r * 257)::BIGINT AS r, (g * 257)::BIGINT AS g, (b * 257)::BIGINT AS b FROM ch), y AS (SELECT *, trunc(r * 0.299701::DOUBLE + g * 0.587130::DOUBLE + b * 0.114180::DOUBLE) AS y FROM w)"


def _mixed(strength: str, share: str) -> str:
    return f"trunc(trunc(r + r * {strength}::DOUBLE) * {share} + r * (1 - {share}))::BIGINT"


@query(
    f"WITH {_CHANNELS}, {_W} SELECT p_partkey, greatest(0, least(65535, r + 9000))::BIGINT AS moved, b - 9000 AS free, CASE WHEN r > 30000 THEN 65535 ELSE 0 END::BIGINT AS split, CASE WHEN r > 30000 THEN r ELSE 0 END::BIGINT AS above, "
    "CASE WHEN r > 30000 THEN 65535 ELSE r END::BIGINT AS below, g AS spared, 65535 - r AS inverted, greatest(r, 12000) AS black, least(r, 50000) AS white, y::BIGINT AS gray, "
    f"{_mixed('0.3', '(1 - y * 2 / 65535.0::DOUBLE)')} AS shadow, {_mixed('0.3', '(y * 0.8::DOUBLE / (65535.0::DOUBLE / 1.5))')} AS highlight, trunc(y * 0.5::DOUBLE + r * 0.5::DOUBLE)::BIGINT AS pale FROM y"
)
def adjusted_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a colour adjustment, seen in one channel each."""
    rows = _channels(spark, sf_dir).select("p_partkey", *[(F.col(c) * 257).cast("long").alias(c) for c in "rgb"])
    p = (F.col("r"), F.col("g"), F.col("b"))
    found = {
        "moved": adjust.offset(p, (9000, 0, -9000))[0], "free": adjust.offset(p, (9000, 0, -9000), clamped=False)[2], "split": adjust.threshold(p, (30000, -1, 0))[0], "above": adjust.threshold(p, (30000, -1, 0), high=None)[0],
        "below": adjust.threshold(p, (30000, -1, 0), low=None)[0], "spared": adjust.threshold(p, (30000, -1, 0))[1], "inverted": adjust.invert(p)[0], "black": adjust.black_point(p, 12000)[0], "white": adjust.white_point(p, 50000)[0],
        "gray": adjust.gray16(p), "shadow": adjust.shadows(p, 0.3)[0], "highlight": adjust.highlights(p, 0.3)[0], "pale": adjust._whole(geometry.weigh(adjust.gray16(p), p[0], F.lit(0.5))),
    }
    return rows.select("p_partkey", *[c.cast("long").alias(n) for n, c in found.items()])


@query(
    f"WITH {_CHANNELS} SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size BETWEEN 1 AND 2 THEN 'x' WHEN p_size BETWEEN 1 AND 3 THEN ['UNKNOWN', '24bppBGR', '32bppBGRA', '8bppGray'][p_size + 1] ELSE 'UNKNOWN' END "
    "WHEN p_size % 3 = 1 THEN (p_size + 8)::VARCHAR || '-' || ['MINISWHITE', 'MINISBLACK', 'RGB'][p_size % 2 + 1] || CASE WHEN p_size % 4 = 1 THEN ' (TONE-MAPPED)' WHEN p_size % 4 = 2 THEN ' (TONE-MAPPABLE)' ELSE '' END ELSE 'GDI+' END AS name, "
    "CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS place FROM part JOIN ch USING (p_partkey)"
)
def pixel_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of pixel formats by loader and code, and places of identifiers in a list."""
    size = F.col("p_size")
    loader = F.when(size % 3 == 0, 1).when(size % 3 == 1, 2).otherwise(3)
    name = formats.pixel_format(loader, size, size + 8, size % 2, size % 4, ["UNKNOWN", "24bppBGR", "32bppBGRA", "8bppGray"], ["MINISWHITE", "MINISBLACK", "RGB"], ["", "WIC", "FIM", "GDI+"])
    key = F.when(size % 3 == 0, "{6fddc324-4e03-4bfe-b185-3d77768dc90c}").otherwise("{00000000-0000-0000-0000-000000000000}")
    place = formats.index_of(key, ["{6FDDC324-4E03-4BFE-B185-3D77768DC90D}", "{6FDDC324-4E03-4BFE-B185-3D77768DC90C}"])
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), place.cast("long").alias("place"))


# text, dates, geometry


@query(
    "SELECT p_partkey, array_to_string(['jpg', 'png', lower(substr(p_brand, 1, 3))], ',') AS extensions, p_name AS trimmed, 'Q' || p_partkey::VARCHAR AS attribute, p_size > 25 AS number, contains(lower(p_name), 'a') OR contains(lower(p_name), 'xyz') AS holds, "
    "lower(p_brand) IN ('brand#11', 'brand#23') AS equals, CASE p_partkey % 6 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN floor(p_size * 1.33333::DOUBLE + 0.5) WHEN 2 THEN p_size * 96 WHEN 3 THEN 3840 "
    "WHEN 4 THEN floor(least(1.0::DOUBLE, greatest(0.1::DOUBLE, p_size / 200.0::DOUBLE)) * 1920 + 0.5) * 3 ELSE floor(p_size * 37.795275591::DOUBLE + 0.5) END::DOUBLE AS pixels FROM part"
)
def text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of extensions, trimming, attributes, numbers, membership and units."""
    brand, name, size, key = F.col("p_brand"), F.col("p_name"), F.col("p_size").cast("string"), F.col("p_partkey")
    length = F.when(key % 6 == 0, F.concat(size, F.lit(".5px"))).when(key % 6 == 1, F.concat(size, F.lit(" pt"))).when(key % 6 == 2, F.concat(size, F.lit("IN"))).when(key % 6 == 3, F.concat(size, F.lit("vw")))
    length = length.when(key % 6 == 4, F.concat(size, F.lit("%"))).otherwise(F.concat(size, F.lit("cm")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(text.split_extensions(F.concat(F.lit("*.jpg| .PNG;;"), F.substring(brand, 1, 3), F.lit(",jpg"))), ",").alias("extensions"),
        text.trimmer(F.concat(F.lit("\t \r\n"), name, F.lit(" \n"))).alias("trimmed"), text.attribute_value(F.concat(F.lit('<svg Width = "Q'), key.cast("string"), F.lit('" x="1">')), "width").alias("attribute"),
        text.is_number(F.when(F.col("p_size") > 25, F.concat(size, F.lit(".25e1"))).otherwise(F.concat(size, F.lit("x")))).alias("number"), text.contains_any(name, ["A", "xyz"]).alias("holds"),
        text.equals_any(brand, ["BRAND#11", "brand#23"]).alias("equals"), text.svg_pixels(length).alias("pixels"),
    )


@query("SELECT p_partkey, 4::BIGINT AS n, p_name AS by_name, p_brand AS by_number, 'Name,' || p_name || chr(10) || 'Brand,' || p_brand || chr(10) || 'Note,\"a, \"\"b\"\"\"' || chr(10) || 'Empty,' AS csv FROM part")
def file_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of a file from packed text: by name, by number, as CSV."""
    packed = F.concat(F.lit("Name= "), F.col("p_name"), F.lit("\n\nBrand="), F.col("p_brand"), F.lit('\nNote=a, "b"\nEmpty'))
    rows = table(spark, sf_dir, "part").select("p_partkey", formats.properties(packed).alias("p"))
    found = F.col("p")
    return rows.select("p_partkey", F.size(found).cast("long").alias("n"), formats.property_by_name(found, "NAME").alias("by_name"), formats.property_by_number(found, 2).alias("by_number"), formats.properties_as_csv(found).alias("csv"))


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS folder, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE date_trunc('minute', o_orderdate) END AS parsed, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 19700101000000 + o_orderkey % 60 END::BIGINT AS stamp FROM orders"
)
def civil_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders by month, days from their number, stamps read back, and counts of ticks that are not usable."""
    ts, key = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")
    stamp = F.when(key % 3 == 0, F.lit(123).cast("long")).otherwise(dates.stamp(ts, 12))
    ticks = F.when(key % 2 == 0, -key).otherwise((F.lit(dates.EPOCH) + key % 60 * 1_000_000) * 10)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.month_folder(dates.stamp(ts)).alias("folder"), dates.civil_from_days(F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))).alias("day"), dates.parse_stamp(stamp).alias("parsed"), dates.file_time(ticks).alias("stamp"),
    )


@query(
    "WITH s AS (SELECT p_partkey, p_partkey * 7 % 100 AS x, p_partkey * 13 % 100 AS y, p_size AS z FROM part) SELECT p_partkey, greatest(20, least(60, x))::BIGINT AS clamped, CASE WHEN x < 20 THEN 60 WHEN x > 60 THEN 20 ELSE x END::BIGINT AS wrapped, "
    "x BETWEEN least(y, z) AND greatest(y, z) AS ranged, round(x * 0.3::DOUBLE + y * 0.7::DOUBLE, 6) AS weighed, round(x * 100 * 0.0254::DOUBLE)::BIGINT AS dpi, round(sqrt((x * x + y * y)::DOUBLE), 6) AS far, "
    "CASE WHEN x + y > 0 THEN round(degrees(atan2(y::DOUBLE, x::DOUBLE)), 6) END AS angle, CASE WHEN x <> 0 THEN round(y * 50.0::DOUBLE / x, 6) END AS meets FROM s"
)
def plane_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamping, ranges, weights, resolutions, distances, angles, and where lines meet: that through the point and the origin, at x = 50."""
    x, y, z = F.col("p_partkey") * 7 % 100, F.col("p_partkey") * 13 % 100, F.col("p_size")
    zero, fifty, one = F.lit(0.0), F.lit(50.0), F.lit(1.0)
    meets = geometry.intersection(zero, zero, x.cast("double"), y.cast("double"), fifty, zero, fifty, one)
    return table(spark, sf_dir, "part").select(
        "p_partkey", geometry.clamp(x, F.lit(20), F.lit(60)).cast("long").alias("clamped"), geometry.clamp(x, F.lit(20), F.lit(60), wrap=True).cast("long").alias("wrapped"), geometry.in_range(x, y, z).alias("ranged"),
        F.round(geometry.weigh(x, y, F.lit(0.3)), 6).alias("weighed"), geometry.dots_per_inch(x * 100).cast("long").alias("dpi"), F.round(geometry.distance(zero, zero, x, y), 6).alias("far"),
        F.when(x + y > 0, F.round(geometry.angle(zero, zero, x, y), 6)).alias("angle"), F.round(meets["y"], 6).alias("meets"),
    )


# image kernels on 8 x 8 gray images


def _squares(spark: SparkSession, sf_dir: str, channels: tuple = (lambda x: x,)) -> DataFrame:
    """Images of the vectors' gray values, a channel for each function of them."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), _grays().alias("v"))
    pixel = lambda x: F.concat(*[F.lpad(F.hex(f(x).cast("int")), 2, "0") for f in channels])
    return rows.select("img_id", F.lit(8).alias("w"), F.lit(8).alias("h"), F.lit(len(channels)).alias("channels"), F.unhex(F.array_join(F.transform("v", pixel), "")).alias("pixels"))


def _alpha(x: Column) -> Column:
    return F.when(x < 120, 0).otherwise(x)


_K = "list_transform(range(64), lambda k: {})"
_V = "v[(k // 8) * 8 + k % 8 + 1]"
_BY = "CASE WHEN {0} < 0 THEN 0 WHEN {0} > 7 THEN 7 ELSE {0} END"


def _at(dr: int, dc: int) -> str:
    """A neighbour, edges repeated."""
    row, column = _BY.format(f"(k // 8 + {dr})"), _BY.format(f"(k % 8 + {dc})")
    return f"v[({row}) * 8 + ({column}) + 1]"


_SOBEL = "sqrt(pow({}, 2) + pow({}, 2))".format(*[" + ".join(f"{w} * ({_at(*a)} - {_at(*b)})" for w, a, b in own) for own in ([(1, (-1, 1), (-1, -1)), (2, (0, 1), (0, -1)), (1, (1, 1), (1, -1))], [(1, (1, -1), (-1, -1)), (2, (1, 0), (-1, 0)), (1, (1, 1), (-1, 1))])])
_MAX = "list_max(v)"
_MIN = "list_min(v)"
#: Kernel, options, and each pixel k of the result as SQL over the list v; a list where the result has several channels.
_KERNELS: tuple[tuple[str, dict, str], ...] = (
    ("mirror", {}, "v[(k // 8) * 8 + 8 - k % 8]"),
    ("flip", {}, "v[(7 - k // 8) * 8 + k % 8 + 1]"),
    ("rotate90", {}, "v[(7 - k % 8) * 8 + k // 8 + 1]"),
    ("rotate", {"degrees": 180.0}, "v[64 - k]"),
    ("symmetry", {}, "CASE WHEN k % 8 > 3 THEN v[(k // 8) * 8 + 8 - k % 8] ELSE " + _V + " END"),
    ("pixelate", {"block": 4}, "list_sum(list_transform(range(16), lambda j: v[(k // 32 * 4 + j // 4) * 8 + k % 8 // 4 * 4 + j % 4 + 1])) / 16.0::DOUBLE"),
    ("box_blur", {"radius": 1}, "(" + " + ".join(_at(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)) + ") / 9.0::DOUBLE"),
    ("edges", {}, _SOBEL),
    ("auto_contrast", {}, f"CASE WHEN {_MAX} = {_MIN} THEN {_V} ELSE ({_V} - {_MIN}) * 255.0::DOUBLE / ({_MAX} - {_MIN}) END"),
    ("adjust", {"invert": True}, f"255 - {_V}"),
    ("adjust", {"brightness": 0.07, "contrast": 1.3, "gamma": 0.8}, f"pow(greatest(0, least(1, ({_V} / 255.0::DOUBLE + 0.07 - 0.5) * 1.3 + 0.5)), 0.8::DOUBLE) * 255"),
    ("tone_map", {}, f"({_V} / 255.0::DOUBLE / (1 + {_V} / 255.0::DOUBLE)) * 255 / ({_MAX} / 255.0::DOUBLE / (1 + {_MAX} / 255.0::DOUBLE))"),
    ("to_polar", {}, "v[greatest(0, least(7, trunc(4 + k // 8 * 0.5 * sin(k % 8 * pi() / 4))::INT)) * 8 + greatest(0, least(7, trunc(4 + k // 8 * 0.5 * cos(k % 8 * pi() / 4))::INT)) + 1]"),
    ("fill_selection", {"points": ((0, 0), (8, 0), (0, 8)), "colour": (200,), "opacity": 0.5}, f"CASE WHEN k // 8 + k % 8 < 7 THEN {_V} * 0.5::DOUBLE + 100 ELSE {_V} END"),
    ("fill_selection", {"shape": "ellipse", "points": (0, 0, 8, 8), "colour": (7,), "inverted": True}, f"CASE WHEN pow(2 * (k // 8) - 7, 2) + pow(2 * (k % 8) - 7, 2) <= 64 THEN {_V} ELSE 7 END"),
)


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col("img_id").alias("vec_id"), F.lit(name).alias("kernel"), F.array_join(bits.bytes_of(F.col("pixels")), ",").alias("pixels"))


@query(
    f"WITH g AS (SELECT vec_id, {_GRAYS} AS v FROM embeddings) "
    + " UNION ALL ".join(f"SELECT vec_id, '{k}-{name}' AS kernel, array_to_string({_K.format(f'greatest(0, least(255, floor({sql} + 0.5::DOUBLE)))::INT')}, ',') AS pixels FROM g" for k, (name, _, sql) in enumerate(_KERNELS))
)
def image_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _squares(spark, sf_dir)
    return reduce(DataFrame.union, [_named(kernels.apply_kernel(images, name, **options), f"{k}-{name}") for k, (name, options, _) in enumerate(_KERNELS)])


_C = "greatest(0, least(255, floor(({}) + 0.5::DOUBLE)))::INT"
_ALPHA = "CASE WHEN x < 120 THEN 0 ELSE x END"


def _each(*channels: str) -> str:
    return f"array_to_string(flatten(list_transform(v, lambda x: [{', '.join(_C.format(c) for c in channels)}])), ',')"


_GRAY3 = "floor(x * 0.299701::DOUBLE + (255 - x) * 0.587130::DOUBLE + x // 2 * 0.114180::DOUBLE + 0.5)"
_SEEN = "list_filter(v, lambda y: y >= 120)"


@query(
    f"WITH g AS (SELECT vec_id, {_GRAYS} AS v FROM embeddings), h AS (SELECT *, list_avg({_SEEN}) AS m, list_avg(list_transform({_SEEN}, lambda y: 255 - y)) AS n, len({_SEEN}) AS seen FROM g) "
    f"SELECT vec_id, 'grayscale' AS kernel, {_each(_GRAY3, _GRAY3, _GRAY3)} AS pixels FROM g UNION ALL SELECT vec_id, 'colorize', {_each('10 + 190 * x / 255.0::DOUBLE', '20 + 80 * x / 255.0::DOUBLE', '30 + 20 * x / 255.0::DOUBLE')} FROM g "
    f"UNION ALL SELECT vec_id, 'set_alpha', {_each('x', '77')} FROM g UNION ALL SELECT vec_id, 'alter_alpha', {_each('x', '255 - x', 'x', f'CASE WHEN {_ALPHA} > 0 THEN least(255, x + 40) ELSE 0 END')} FROM g "
    f"UNION ALL SELECT vec_id, 'erased', {_each('x', '255 - x', 'x', f'({_ALPHA}) * 0.75::DOUBLE')} FROM g "
    f"UNION ALL SELECT vec_id, 'fill_holes', CASE WHEN seen = 0 THEN {_each('x', '255 - x', 'x', '0')} ELSE {_each('CASE WHEN x < 120 THEN m ELSE x END', 'CASE WHEN x < 120 THEN n ELSE 255 - x END', 'CASE WHEN x < 120 THEN m ELSE x END', 'CASE WHEN x < 120 THEN 255 ELSE x END')} END FROM h"
)
def image_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernels on colours and alpha."""
    one = _squares(spark, sf_dir)
    three = _squares(spark, sf_dir, (lambda x: x, lambda x: F.lit(255) - x, lambda x: F.floor(x / 2)))
    four = _squares(spark, sf_dir, (lambda x: x, lambda x: F.lit(255) - x, lambda x: x, _alpha))
    found = (
        ("grayscale", kernels.apply_kernel(three, "grayscale")), ("colorize", kernels.apply_kernel(one, "colorize", dark=(10, 20, 30), bright=(200, 100, 50))), ("set_alpha", kernels.apply_kernel(one, "set_alpha", alpha=77)),
        ("alter_alpha", kernels.apply_kernel(four, "alter_alpha", level=40)), ("erased", kernels.apply_kernel(four, "fill_selection", points=((0, 0), (8, 0), (8, 8), (0, 8)), colour=None, opacity=0.25)),
        ("fill_holes", kernels.apply_kernel(four, "fill_holes")),
    )
    return reduce(DataFrame.union, [_named(df, name) for name, df in found])


_M = "v[(k // 8) * 8 + 8 - k % 8]"
_F = "v[(7 - k // 8) * 8 + k % 8 + 1]"


@query(
    f"WITH g AS (SELECT vec_id, {_GRAYS} AS v FROM embeddings) SELECT vec_id, 'difference' AS kernel, array_to_string({_K.format(f'abs({_V} - {_M})')}, ',') AS pixels FROM g UNION ALL SELECT vec_id, 'screen', array_to_string({_K.format(_C.format(f'(1 - (1 - {_V} / 255.0::DOUBLE) * (1 - {_M} / 255.0::DOUBLE)) * 255'))}, ',') FROM g "
    f"UNION ALL SELECT vec_id, 'merged', array_to_string({_K.format(_C.format(f'{_F} * (greatest(0, {_M} - 9) / 255.0::DOUBLE) + {_V} * (1 - greatest(0, {_M} - 9) / 255.0::DOUBLE)'))}, ',') FROM g "
    f"UNION ALL SELECT vec_id, 'alpha', array_to_string(flatten({_K.format(f'[{_V}, 255 - {_M}]')}), ',') FROM g"
)
def image_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blends and masks of an image, its mirror image and its flipped one."""
    own = _squares(spark, sf_dir)
    mirrored, flipped = kernels.apply_kernel(own, "mirror"), kernels.apply_kernel(own, "flip")
    found = (
        ("difference", kernels.blend_images(own, mirrored, 18)), ("screen", kernels.blend_images(own, mirrored, 6)), ("merged", kernels.apply_masked(own, [flipped, mirrored], "merge_with_mask", shift=9)),
        ("alpha", kernels.apply_masked(own, [mirrored], "mask_as_alpha", invert=True)),
    )
    return reduce(DataFrame.union, [_named(df, name) for name, df in found])


_ODD = "list_filter(range(64), lambda k: abs(v[k + 1] - v[1]) > 90)"


@query(
    f"WITH g AS (SELECT vec_id, {_GRAYS} AS v FROM embeddings), o AS (SELECT vec_id, {_ODD} AS o FROM g), p AS (SELECT vec_id, list_transform(o, lambda k: k // 8) AS r, list_transform(o, lambda k: k % 8) AS c FROM o) "
    "SELECT vec_id, coalesce(list_min(c), 0)::BIGINT AS l, coalesce(list_min(r), 0)::BIGINT AS t, coalesce(list_max(c) + 1, 8)::BIGINT AS r, coalesce(list_max(r) + 1, 8)::BIGINT AS b FROM p"
)
def cropped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kernels.auto_crop(_squares(spark, sf_dir), 90.0)
    return found.select(F.col("img_id").alias("vec_id"), *[F.col(c).cast("long").alias(c[0]) for c in ("left", "top", "right", "bottom")])
