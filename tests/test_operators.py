import math
import random
import sqlite3
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from photarium.functions import colour, dates, geometry, text
from photarium.operators import histogram, index_ops, kernels, merge
from photarium.sources import images, lists, sqlite
from photarium.streaming import collect


def plain_statistics(values, pixels):
    """From the sorted list of all values."""
    counts = Counter(values)
    median = values[pixels // 2] if len(values) > pixels // 2 else -1
    mean = sum(v + 1 for v in values) / pixels - 1
    rms = math.sqrt(max(0.0, sum(v * v for v in values) / pixels - mean * mean))
    mode = min(counts, key=lambda v: (-counts[v], v))
    rarest = min(((n, v) for v, n in counts.items() if n < pixels), default=(0, 0))[1]
    shares = ((mean + 1) / 256, *((v + 1) / 256 for v in (median, values[-1], values[0])), rms / 256, *((v + 1) / 256 for v in (values[-1] - values[0], mode, rarest)))
    return [math.floor(x * 1e5 + 0.5) / 1e5 for x in shares]


def test_histogram_statistics(spark):
    rng = random.Random(3)
    shapes = [{k: rng.randrange(64) for k in range(256)}, {77: 4096}, {3: 2000, 200: 2096}, {k: rng.randrange(1, 900) for k in range(0, 256, rng.randrange(5, 20))}, {k: rng.randrange(300) for k in range(200, 256)}]
    rows, want = [], {}
    for key, levels in enumerate(shapes):
        pixels = 64 * ((sum(levels.values()) + 63) // 64)
        want[key] = plain_statistics(sorted(Counter(levels).elements()), pixels)
        rows += [(key, level, n, pixels) for level, n in levels.items()]
    df = spark.createDataFrame(rows, "key int, level int, n long, pixels long")
    for r in histogram.histogram_statistics(df, ["key"], "pixels").collect():
        assert [r[c] for c in ("avg", "median", "peak", "low", "rms", "range", "mode", "minu")] == pytest.approx(want[r["key"]], abs=1e-9)


def test_import_merge(spark):
    """Two libraries that share two files, one of them under another case; blobs come from the imported side where it has them."""
    schema = "imgidu long, imgfolder string, imgfile string, lHash string, fsize long"
    ours = [(4, "D:\\trips", "rome.png", "1f", 900), (9, "D:\\trips", "oslo.png", None, 0), (2, "D:\\pets", "cat.bmp", "77", 30)]
    theirs = [(5, "d:\\TRIPS", "Oslo.PNG", "ab", 0), (1, "D:\\pets", "cat.bmp", "", 31), (3, "E:\\new", "sea.gif", "0", None)]
    blob = lambda seed, n: random.Random(seed).randbytes(n)
    pixel = "imgidu long, small binary, big binary"
    our_blobs = spark.createDataFrame([(9, blob(1, 72), blob(2, 1024)), (2, blob(3, 72), None)], pixel)
    their_blobs = spark.createDataFrame([(5, blob(4, 72), None), (3, None, None)], pixel)
    merged = merge.import_merge(spark.createDataFrame(ours, schema), spark.createDataFrame(theirs, schema), merge.path_key(), "imgidu")
    rows = {r["imgidu"]: (r["old_main"], r["old_other"], r["imgfile"], r["lHash"], r["fsize"]) for r in merged.collect()}
    assert rows == {1: (2, 1, "cat.bmp", "77", 31), 2: (4, None, "rome.png", "1f", 900), 3: (9, 5, "Oslo.PNG", "ab", 0), 4: (None, 3, "sea.gif", "0", None)}
    found = {r["imgidu"]: (r["small"], r["big"]) for r in merge.merge_blobs(merged, our_blobs, their_blobs, "imgidu", ["small", "big"]).collect()}
    assert found == {1: (blob(3, 72), None), 3: (blob(4, 72), blob(2, 1024))}


def test_missing_fingerprints_by_three_routes(spark):
    files = spark.range(900).select(F.col("id").alias("imgidu"), F.expr("CASE WHEN id % 11 = 0 THEN 2 WHEN id % 7 = 0 THEN 1 ELSE 0 END").alias("isDeleted"))
    side = spark.range(900).where("id % 3 < 2").select(F.col("id").alias("imgidu"), F.expr("CASE WHEN id % 3 = 0 THEN X'01' END").alias("small"))
    files.createOrReplaceTempView("t_files"), side.createOrReplaceTempView("t_side")
    ours = merge.missing(files.where("isDeleted = 0"), side, "imgidu", F.col("small").isNotNull()).select("imgidu")
    left = spark.sql("SELECT f.imgidu FROM t_files f LEFT JOIN t_side s ON f.imgidu = s.imgidu WHERE s.small IS NULL AND f.isDeleted = 0")
    within = spark.sql("SELECT imgidu FROM t_files WHERE isDeleted = 0 AND imgidu NOT IN (SELECT imgidu FROM t_side WHERE small IS NOT NULL)")
    assert ours.exceptAll(left).count() == left.exceptAll(ours).count() == ours.exceptAll(within).count() == 0 and ours.count() == within.count()


def test_dead_marks_and_updates(spark):
    files = spark.createDataFrame([(1, 0), (2, 0), (3, 2)], "imgidu long, isDeleted int")
    outcome = spark.createDataFrame([(1, True), (2, False)], "imgidu long, decoded boolean")
    assert {r["imgidu"]: r["isDeleted"] for r in merge.mark_dead(files, outcome).collect()} == {1: 0, 2: 1, 3: 2}


def test_sqlite_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.sldb")
    rows = [(i, f"f{i}", i / 2, bytes([i % 256]) if i % 3 else None) for i in range(1, 51)]
    df = spark.createDataFrame(rows, "imgidu long, imgfile string, avg double, small binary")
    assert sqlite.write_sqlite(df, path, "images", "imgidu") == 50
    back = sqlite.read_sqlite(spark, path, "images", rows=7)
    assert back.rdd.getNumPartitions() == 8
    assert sorted((r[0], r[1], r[2], bytes(r[3]) if r[3] is not None else None) for r in back.collect()) == rows
    names = sqlite.attach(spark, path, "lib")
    assert names == ["lib_images"] and spark.sql("SELECT count(*) FROM lib_images").first()[0] == 50
    sqlite.detach(spark, "lib", names)
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE odd (n INT)"), db.execute("INSERT INTO odd VALUES ('text')")
    assert sqlite.read_sqlite(spark, path, "odd").first()[0] is None


def test_lists_and_dictionaries(spark, tmp_path):
    (tmp_path / "a.sld").write_text("[General]\nkey=1\nC:\\a\\b.jpg\n\nC:\\a\\c.PNG\r\n")
    got = lists.read_list(spark, str(tmp_path / "a.sld"))
    assert [(r["imgfolder"], r["imgfile"]) for r in got.collect()] == [("C:\\a", "b.jpg"), ("C:\\a", "c.PNG")]
    lists.write_list(got, str(tmp_path / "out"))
    assert lists.read_list(spark, str(tmp_path / "out")).count() == 2
    one = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    two = lists.copy_from(one, spark.createDataFrame([("b", "3")], "key string, value string"))
    assert {r["key"]: r["value"] for r in two.collect()} == {"a": "1", "b": "3"}
    packed = spark.createDataFrame([("a=1\nb=2",)], "t string")
    assert {r["key"]: r["value"] for r in lists.parse_dictionary(packed, "t").collect()} == {"a": "1", "b": "2"}


@pytest.mark.parametrize("kind", ["P6", "P5", "P3", "BMP"])
def test_decoding(kind):
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    if kind == "P6":
        raw = images.encode_netpbm(pixels)
    elif kind == "P5":
        pixels = np.repeat(pixels[:, :, :1], 3, axis=2)
        raw = images.encode_netpbm(pixels[:, :, 0])
    elif kind == "P3":
        raw = b"P3 # note\n7 5\n255\n" + b" ".join(str(x).encode() for x in pixels.ravel())
    else:
        import struct

        body = b"".join(row[:, ::-1].tobytes().ljust(24, b"\0") for row in pixels[::-1])
        raw = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(body), 0, 0, 54, 40, 7, 5, 1, 24, 0, len(body), 0, 0, 0, 0) + body
    assert (images.decode(raw)[0] == pixels).all()
    with pytest.raises(images.Undecodable):
        images.decode(raw[:-1] if kind != "P3" else raw[:40])


def test_collection_goes_on_where_it_stopped(spark, tmp_path):
    folder, table, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    (tmp_path / "in").mkdir()
    gray = np.tile(np.arange(64, dtype=np.uint8), (64, 1))
    (tmp_path / "in" / "a.pgm").write_bytes(images.encode_netpbm(gray))
    (tmp_path / "in" / "b.pgm").write_bytes(b"P5 broken")
    collect.collect(spark, folder, table, mark).awaitTermination()
    (tmp_path / "in" / "c.pgm").write_bytes(images.encode_netpbm(gray.T))
    collect.collect(spark, folder, table, mark).awaitTermination()
    rows = {r["path"][-5:]: r for r in collect.collected(spark, table).collect()}
    assert len(rows) == 3 and not rows["b.pgm"]["decoded"]
    a = rows["a.pgm"]
    assert (a["imgwidth"], a["imgheight"], len(a["small"]), len(a["big"]), sum(a["levels"])) == (64, 64, 72, 1024, 4096)
    assert bytes(a["smallH"]) == np.frombuffer(bytes(a["small"]), np.uint8).reshape(8, 9)[:, ::-1].tobytes()


@pytest.mark.parametrize("name", sorted(kernels.KERNELS))
def test_kernels_keep_bytes_and_sizes(spark, name):
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, (12, 16, 4)).astype(np.uint8)
    df = spark.createDataFrame([(1, 16, 12, 4, pixels.tobytes())], kernels.IMAGE)
    if name in ("colorize",):
        df = spark.createDataFrame([(1, 16, 12, 3, pixels[:, :, :3].tobytes())], kernels.IMAGE)
    r = kernels.apply_kernel(df, name).first()
    assert len(r["pixels"]) == r["w"] * r["h"] * r["channels"]
    if name == "mirror":
        assert bytes(r["pixels"]) == pixels[:, ::-1].tobytes()
    if name == "box_blur":
        assert abs(np.frombuffer(r["pixels"], np.uint8).mean() - pixels.mean()) < 12


def test_crop_and_similarity(spark):
    flat = np.zeros((10, 10, 3), np.uint8)
    flat[3:6, 2:8] = 200
    df = spark.createDataFrame([(1, 10, 10, 3, flat.tobytes())], kernels.IMAGE)
    r = kernels.auto_crop(df).first()
    assert (r["left"], r["top"], r["right"], r["bottom"]) == (2, 3, 8, 6)
    assert kernels.similarity(df, df).first()["similarity"] == 100
    assert kernels.similarity(df, df.withColumn("w", F.lit(5)).withColumn("h", F.lit(20))).first()["similarity"] == -1
    assert bytes(kernels.blend_images(df, df, 18).first()["pixels"]) == bytes(300)


def test_colour_difference_against_published_pairs(spark):
    # test pairs of the formula's publication
    pairs = [(50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425), (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669), (50.0, 2.49, -0.001, 50.0, -2.49, 0.0011, 7.2195), (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644), (2.0776, 0.0795, -1.1350, 0.9033, -0.0636, -0.5514, 0.9082)]
    df = spark.createDataFrame(pairs, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    for r in df.select(colour.delta_e2000(*[F.col(c) for c in ("l1", "a1", "b1", "l2", "a2", "b2")]).alias("d"), "want").collect():
        assert r["d"] == pytest.approx(r["want"], abs=1e-4)


def test_units_and_paths(spark):
    cases = [("12px", 12.0), ("10", 10.0), ("3pt", 4.0), ("2 in", 192.0), ("1cm", 38.0), ("", 3000.0), ("5vw", 3840.0), ("50%", 1440.0), ("odd", 3000.0)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x, _ in cases], "t string").select(text.svg_pixels(F.col("t"))).collect()]
    assert got == [w for _, w in cases]
    paths = [("C:\\a.b\\c", ""), ("C:\\a\\c.JPG", "jpg"), ("x.tar.gz", "gz")]
    assert [r[0] for r in spark.createDataFrame([(x,) for x, _ in paths], "t string").select(text.file_extension(F.col("t"))).collect()] == [w for _, w in paths]
    assert spark.createDataFrame([("*.jpg| .PNG ;gif,,jpg",)], "t string").select(text.split_extensions(F.col("t"))).first()[0] == ["jpg", "png", "gif"]
    assert spark.createDataFrame([('<svg Width="20px" x="1">',)], "t string").select(text.attribute_value(F.col("t"), "width")).first()[0] == "20px"


def test_file_times(spark):
    ticks = [(0, 0), (-5, 0), (116444736000000000, 19700101000000), (133801632000000000 + 10_000_000, 20250101000001)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t, _ in ticks], "t long").select(dates.file_time(F.col("t"))).collect()]
    assert got == [w for _, w in ticks]


def test_ranges_and_lines(spark):
    df = spark.createDataFrame([(5, 9, 1)], "v int, a int, b int")
    assert df.select(geometry.in_range(F.col("v"), F.col("a"), F.col("b"))).first()[0]
    assert df.select(geometry.clamp(F.col("v"), F.lit(6), F.lit(8), wrap=True)).first()[0] == 8
    p = df.select(geometry.intersection(*[F.lit(float(x)) for x in (0, 0, 2, 2, 0, 2, 2, 0)])).first()[0]
    assert (p["x"], p["y"]) == (1.0, 1.0)


def test_random_order_repeats(spark):
    df = spark.range(50).withColumnRenamed("id", "imgidu")
    order = lambda d: [r["imgidu"] for r in index_ops.in_random_order(d, "imgidu", 3).orderBy("rank_key").collect()]
    assert order(df) == order(df.repartition(5)) != list(range(50))
