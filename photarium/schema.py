"""Tables of a library index, and the columns derived from others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASHES = ("dHash", "pHash", "lHash", "HdHash", "HpHash", "HlHash")
STATISTICS = ("imgavg", "imgmedian", "imghpeak", "imghlow", "imghrms", "imghrange", "imghmode", "imghminu")

IMAGES = T.StructType(
    [
        T.StructField("imgidu", T.LongType(), False), T.StructField("imgfile", T.StringType(), False), T.StructField("imgfolder", T.StringType(), False),
        T.StructField("fsize", T.LongType()), T.StructField("fmodified", T.LongType()), T.StructField("fcreated", T.LongType()),
        T.StructField("imgwidth", T.IntegerType()), T.StructField("imgheight", T.IntegerType()), T.StructField("imgframes", T.IntegerType()),
        T.StructField("imgdpi", T.IntegerType()), T.StructField("imgpixfmt", T.StringType()),
        *[T.StructField(x, T.DoubleType()) for x in STATISTICS], *[T.StructField(x, T.StringType()) for x in HASHES],
        T.StructField("isDeleted", T.IntegerType()),
    ]
)
PIXELS = T.StructType([T.StructField("imgidu", T.LongType(), False), *[T.StructField(x, T.BinaryType()) for x in ("small", "big", "smallH", "bigH")]])
SETTINGS = T.StructType([T.StructField("paramz", T.StringType(), False), T.StructField("valuez", T.StringType())])

#: Columns compared as they are; all others of a grouping key are rounded.
VERBATIM = ("fcreated", "fmodified", "fsize", "imgfile", "dHash", "lHash", "pHash", "imgwidth", "imgheight", "imgframes", "imgdpi", "imgpixfmt")
#: Text columns that compare without regard to the case of A-Z.
NOCASE = ("imgfile", "imgpixfmt", "imgfolder")
#: Key sets under which files are grouped as candidates.
PRESETS = (
    ("imgwhratio", "imgframes"),
    ("fsize", "imgmegapix", "imgwhratio", "imgframes"),
    ("kbfsize", "imgframes", "imgmegapix", "imgwhratio", "imgavg", "imghpeak", "imgmedian", "imghlow"),
    ("imgfile", "imgframes"),
    ("fsize", "imgfile", "imgframes"),
    ("imgpixfmt", "imgwidth", "imgheight"),
    ("imgmedian", "imgavg", "imghpeak"),
    ("fcreated", "fmodified"),
    ("imgdpi", "imgpixfmt"),
    ("imgmegapix",),
    ("imgavg", "imghrms", "imghmode", "imghminu", "imghrange"),
)
PRECISIONS = (0, 1, 2, 5)


def with_derived(images: DataFrame) -> DataFrame:
    """Adds fullPath, kbfsize, imgwhratio and imgmegapix; a height of zero or null gives a null ratio."""
    w, h = F.col("imgwidth").cast("double"), F.col("imgheight").cast("double")
    return images.withColumns(
        {
            "fullPath": F.concat_ws("\\", "imgfolder", "imgfile"),
            "kbfsize": F.round(F.col("fsize").cast("double") / 1024, 1),
            "imgwhratio": F.round(F.try_divide(w, h), 5),
            "imgmegapix": F.round(w * h / 1e6, 5),
        }
    )
