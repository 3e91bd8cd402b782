"""More named queries with their DuckDB twins: image indexes, list services, text, colour steps, formats and image kernels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photarium import schema
from photarium.catalog import _CHANNELS, _GRAYS, _HASHED, PAIR, _channels, _grays, _hashed, long, query, table
from photarium.functions import adjust, bits, colour, dates, formats, geometry, hashes, text
from photarium.operators import candidates, cluster, index_ops, kernels, merge, paging, sweep
from photarium.plans.duplicates import Search, find_duplicates
from photarium.sources import lists
from photarium.streaming import collect

# an index of images, made of the vectors: ids, names, sizes and statistics by their numbers, hashes by their values

_STATS = ("imgavg", "imgmedian", "imghpeak", "imghlow", "imghrms", "imghrange", "imghmode", "imghminu")
_IMG = (
    f"{_HASHED}, img0 AS (SELECT vec_id AS imgidu, (CASE WHEN vec_id % 2 = 0 THEN 'F' ELSE 'f' END) || (vec_id % 97)::VARCHAR || '.jpg' AS imgfile, 'D' || (vec_id % 7)::VARCHAR AS imgfolder, vec_id % 13 * 1000 AS fsize, "
    "20200101000000 + vec_id % 5 AS fmodified, 20200101000000 + vec_id % 3 AS fcreated, (vec_id % 5 + 1) * 160 AS imgwidth, (vec_id % 3 + 1) * 120 AS imgheight, vec_id % 2 + 1 AS imgframes, 72 + vec_id % 2 * 24 AS imgdpi, "
    "CASE WHEN vec_id % 4 = 0 THEN '32-BGRA' ELSE '24-bgr' END AS imgpixfmt, "
    + ", ".join(f"(vec_id * {k + 3} % 17)::DOUBLE / 17 AS {c}" for k, c in enumerate(_STATS))
    + ", CASE WHEN vec_id % 19 = 0 THEN '' WHEN vec_id % 23 = 0 THEN 'zz' WHEN vec_id % 29 = 0 THEN NULL ELSE lower(printf('%x', h)) END AS dHash, h, CASE WHEN vec_id % 10 = 0 THEN 1 WHEN vec_id % 10 = 1 THEN NULL ELSE 0 END AS isDeleted FROM h), "
    "img AS (SELECT *, round(fsize / 1024.0::DOUBLE, 1) AS kbfsize, round(imgwidth / imgheight::DOUBLE, 5) AS imgwhratio, round(imgwidth * imgheight / 1000000.0::DOUBLE, 5) AS imgmegapix FROM img0)"
)


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, h = F.col("vec_id"), F.col("_h")
    rows = table(spark, sf_dir, "embeddings").withColumn("_h", hashes.threshold_hash(F.col("embedding")))
    stats = [((i * (k + 3) % 17).cast("double") / 17.0).alias(c) for k, c in enumerate(_STATS)]
    return schema.with_derived(
        rows.select(
            i.alias("imgidu"), F.concat(F.when(i % 2 == 0, "F").otherwise("f"), (i % 97).cast("string"), F.lit(".jpg")).alias("imgfile"), F.concat(F.lit("D"), (i % 7).cast("string")).alias("imgfolder"),
            (i % 13 * 1000).alias("fsize"), (i % 5 + 20200101000000).alias("fmodified"), (i % 3 + 20200101000000).alias("fcreated"), ((i % 5 + 1) * 160).alias("imgwidth"), ((i % 3 + 1) * 120).alias("imgheight"),
            (i % 2 + 1).alias("imgframes"), (i % 2 * 24 + 72).alias("imgdpi"), F.when(i % 4 == 0, "32-BGRA").otherwise("24-bgr").alias("imgpixfmt"), *stats,
            F.when(i % 19 == 0, "").when(i % 23 == 0, "zz").when(i % 29 == 0, F.lit(None)).otherwise(bits.to_hex(h)).alias("dHash"), F.when(i % 10 == 0, 1).when(i % 10 == 1, F.lit(None)).otherwise(0).alias("isDeleted"),
        )
    )


def _key(name: str, precision: int) -> str:
    if name in schema.NOCASE:
        return f"lower({name})"
    return name if name in schema.VERBATIM else f"round({name}, {precision})"


#: Presets and precisions tried: each precision, and sets of text, size, ratio and statistics.
_TRIED = ((0, 5), (2, 1), (4, 0), (5, 2), (10, 1))


@query(
    f"WITH {_IMG}, "
    + ", ".join(f"g{p} AS (SELECT count(*) AS m FROM img WHERE coalesce(isDeleted, 0) = 0 GROUP BY {', '.join(_key(c, d) for c in schema.PRESETS[p])} HAVING count(*) > 1)" for p, d in _TRIED)
    + " UNION ALL ".join(f" SELECT {p}::BIGINT AS preset, {d}::BIGINT AS precision, count(*)::BIGINT AS groups, coalesce(sum(m), 0)::BIGINT AS rows, coalesce(sum(m * (m - 1) // 2), 0)::BIGINT AS planned FROM g{p}" for p, d in _TRIED)
)
def preset_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live images grouped by preset key sets at several precisions."""
    images = _images(spark, sf_dir)
    each = [candidates.comparisons(candidates.image_candidates(images, schema.PRESETS[p], d)).select(F.lit(p).cast("long").alias("preset"), F.lit(d).cast("long").alias("precision"), *long("groups", "rows", "planned")) for p, d in _TRIED]
    return reduce(DataFrame.union, each)


_USABLE = "u AS (SELECT *, lower(imgpixfmt) AS k0, imgframes AS k1 FROM img WHERE coalesce(isDeleted, 0) = 0 AND regexp_full_match(coalesce(dHash, ''), '[0-9A-Fa-f]{1,16}'))"


@query(
    f"WITH {_IMG}, {_USABLE}, q AS (SELECT *, count(*) OVER (PARTITION BY k0, k1) AS n FROM u) SELECT imgidu, dense_rank() OVER (ORDER BY k0, k1)::BIGINT AS group_id, "
    "row_number() OVER (PARTITION BY k0, k1 ORDER BY imgmegapix, fsize, imgidu)::BIGINT AS cand_seq, lower(printf('%x', h)) AS hash_text FROM q WHERE n > 1"
)
def hashed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live images with a usable hash, grouped by format and frames."""
    found = candidates.image_candidates(_images(spark, sf_dir), ("imgpixfmt", "imgframes"), hash_column="dHash")
    return found.select("imgidu", *long("group_id", "cand_seq"), bits.to_hex(F.col("hash")).alias("hash_text"))


@query(
    f"WITH {_IMG}, s AS (SELECT *, lower(imgpixfmt) AS k0, NOT regexp_full_match(dHash, '[0-9A-Fa-f]{{1,16}}') AS bad FROM img WHERE coalesce(isDeleted, 0) = 0 AND coalesce(dHash, '') <> ''), "
    "i AS (SELECT *, sum(bad::INT) OVER (PARTITION BY k0 ORDER BY imgmegapix, fsize, imgidu ROWS UNBOUNDED PRECEDING) AS island FROM s), q AS (SELECT *, count(*) OVER (PARTITION BY k0, island) AS n FROM i WHERE NOT bad) "
    "SELECT imgidu, dense_rank() OVER (ORDER BY k0, island)::BIGINT AS group_id, row_number() OVER (PARTITION BY k0, island ORDER BY imgmegapix, fsize, imgidu)::BIGINT AS cand_seq FROM q WHERE n > 1"
)
def strict_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As hashed candidates, with runs that end at images of unusable hashes."""
    return candidates.strict_runs(_images(spark, sf_dir), ("imgpixfmt",), 2, "dHash").select("imgidu", *long("group_id", "cand_seq"))


@query(
    f"WITH RECURSIVE {_IMG}, {_USABLE}, q AS (SELECT *, dense_rank() OVER (ORDER BY k0, k1)::BIGINT AS g, row_number() OVER (PARTITION BY k0, k1 ORDER BY imgmegapix, fsize, imgidu) AS s FROM u), "
    "p AS (SELECT b.imgidu AS id_a, a.imgidu AS id_b, bit_count(xor(a.h, b.h)) AS d FROM q a JOIN q b ON a.g = b.g AND a.s < b.s WHERE bit_count(xor(a.h, b.h)) < 21), "
    "e AS (SELECT id_a AS x, id_b AS y, d FROM p UNION ALL SELECT id_b, id_a, d FROM p), r(x, root) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x), "
    "roots AS (SELECT x AS id, min(root) AS root FROM r GROUP BY x), near AS (SELECT x AS id, min(d) AS d FROM e GROUP BY x) SELECT id, root, d::BIGINT AS ham_dist FROM roots JOIN near USING (id)"
)
def duplicates_of_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: candidates, pairs, clusters."""
    return find_duplicates(_images(spark, sf_dir), search=Search(columns=("imgpixfmt", "imgframes"), threshold=21)).select(*long("id", "root", "ham_dist"))


@query(
    f"WITH {_HASHED}, f AS (SELECT vec_id, list_sum(list_transform(range(64), lambda k: CASE WHEN e[64 - k] > list_sum(e) / 64 THEN 1::HUGEINT << (63 - k)::INT ELSE 0::HUGEINT END))::UBIGINT AS f FROM v), "
    "x AS (SELECT c.*, f FROM c JOIN f USING (vec_id)), p AS (SELECT a.group_id, b.vec_id AS id_a, a.vec_id AS id_b, bit_count(xor(a.h, b.h)) AS d, bit_count(xor(a.f, b.h)) AS m FROM x a JOIN x b ON a.group_id = b.group_id AND a.seq < b.seq) "
    "SELECT group_id, id_a, id_b, 0::BIGINT AS variant, d::BIGINT AS ham_dist FROM p WHERE d < 20 UNION ALL SELECT group_id, id_a, id_b, 2::BIGINT, m::BIGINT FROM p WHERE m < 20"
)
def hash_pairs_flipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs, directly or mirrored: a mirrored hash is that of the values in reverse."""
    mirrored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hashes.threshold_hash(F.reverse("embedding")).alias("flip"))
    return sweep.sweep(_hashed(spark, sf_dir).join(mirrored, "id"), 20, flipped=True).select(*long(*PAIR))


_PIX = "pix AS (SELECT vec_id, k, k // 32 AS r, k % 32 AS c, (v[(k * 7 + k // 32 * 5) % 64 + 1] + k * 3) % 256 AS p FROM g, (SELECT unnest(range(1024)) AS k))"


@query(
    f"WITH g AS (SELECT vec_id, {_GRAYS} AS v FROM embeddings), {_PIX}, cs AS (SELECT a, j, cos(a * pi() * (j + 0.5::DOUBLE) / 32) * 0.25::DOUBLE / CASE WHEN a = 0 THEN sqrt(2.0::DOUBLE) ELSE 1 END AS w FROM (SELECT unnest(range(8)) AS a), (SELECT unnest(range(32)) AS j)), "
    "t AS (SELECT vec_id, a, c, sum(w * p) AS t FROM pix JOIN cs ON j = r GROUP BY ALL), f AS (SELECT vec_id, t.a AS a, cs.a AS b, sum(w * t) AS x FROM t JOIN cs ON j = c GROUP BY ALL), "
    "m AS (SELECT vec_id, median(x) AS med, sum(x) FILTER (a + b > 0) / 63 AS mean FROM f GROUP BY vec_id) "
    "SELECT vec_id, lower(printf('%x', sum(CASE WHEN x > med THEN 1::HUGEINT << (b * 8 + a)::INT ELSE 0::HUGEINT END)::UBIGINT)) AS by_median, lower(printf('%x', sum(CASE WHEN x > mean THEN 1::HUGEINT << (b * 8 + a)::INT ELSE 0::HUGEINT END)::UBIGINT)) AS by_mean FROM f JOIN m USING (vec_id) GROUP BY vec_id"
)
def cosine_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes by cosine transform of 32 x 32 values, by median and by mean."""
    one = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda k: F.lpad(F.hex((F.get("v", (k * 7 + F.shiftright(k, 5) * 5) % 64) + k * 3) % 256), 2, "0"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", _grays().alias("v")).select("vec_id", F.unhex(F.array_join(one, "")).alias("big"))
    return rows.select("vec_id", bits.to_hex(hashes.p_hash(F.col("big"), 1)).alias("by_median"), bits.to_hex(hashes.p_hash(F.col("big"), 0)).alias("by_mean"))


@query(
    f"WITH g AS (SELECT vec_id, {_GRAYS} AS v FROM embeddings) SELECT vec_id, array_to_string(list_transform(v, lambda x: (floor(x / 10.0::DOUBLE + 0.5) * 10)::INT), ',') AS by_ten, array_to_string(v, ',') AS bytes_back, "
    "CASE WHEN vec_id % 3 = 0 THEN 'abc' WHEN vec_id % 3 = 1 THEN '' END AS kept FROM g"
)
def fingerprint_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray values to a binary and back, in steps of ten, and what a hash column holds after a run."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", _grays().alias("v"))
    binary = F.unhex(F.array_join(F.transform("v", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    size = F.when(F.col("vec_id") % 3 == 1, F.lit(64)).when(F.col("vec_id") % 3 == 0, F.lit(72))
    known = F.when(F.col("vec_id") % 3 == 0, "abc")
    return rows.select(
        "vec_id", F.array_join(F.transform("v", lambda x: bits.discretize(x, 10)), ",").alias("by_ten"), F.array_join(bits.bytes_of(binary), ",").alias("bytes_back"),
        hashes.stored_hash(known, F.lit(1).cast("long"), size, 72).alias("kept"),
    )


@query("SELECT count(*) FILTER (vec_id % 5 <> 0 AND vec_id % 3 = 0)::BIGINT AS written, count(*) FILTER (vec_id % 5 <> 0 AND vec_id % 3 = 1)::BIGINT AS failed, count(*) FILTER (vec_id % 5 <> 0 AND vec_id % 3 = 2)::BIGINT AS skipped FROM embeddings")
def hash_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(F.when(i % 5 == 0, "ab").alias("dHash"), F.when(i % 3 == 0, 72).when(i % 3 == 1, 64).alias("size"))
    return paging.hash_counts(rows, "dHash", "size", 72)


@query(f"WITH g AS (SELECT vec_id, {_GRAYS} AS v FROM embeddings) SELECT vec_id, CASE WHEN vec_id % 4 > 0 THEN array_to_string(list_transform(v, lambda x: floor(x / 2.0::DOUBLE + 0.5)::INT), ',') END AS grays FROM g")
def legacy_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints in the older text form, some marked as absent."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", _grays().alias("v"))
    sign = F.transform("v", lambda x: F.decode(F.unhex(F.lpad(F.hex(x + formats.LEGACY), 4, "0")), "UTF-16BE"))
    packed = F.concat(F.when(F.col("vec_id") % 4 == 0, " ").otherwise(""), F.array_join(sign, ""))
    return rows.select("vec_id", F.array_join(formats.legacy_values(packed, 2), ",").alias("grays"))


# lists, pages and orders


def _pages_of(sort: str) -> str:
    return f"SELECT imgidu, (row_number() OVER (ORDER BY {sort}))::BIGINT AS position FROM img"


@query(f"WITH {_IMG}, a AS ({_pages_of('lower(imgfolder), lower(imgfile), imgidu')}), b AS ({_pages_of('imgmegapix DESC, imgidu DESC')}) SELECT imgidu, a.position AS by_path, b.position AS by_size FROM a JOIN b USING (imgidu)")
def sorted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir)
    by_size = paging.sorted_list(images, "resolution", down=True).select("imgidu", F.col("position").alias("by_size"))
    return paging.sorted_list(images, "path").select("imgidu", F.col("position").alias("by_path")).join(by_size, "imgidu")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1)::BIGINT AS place FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 200 OFFSET 100")
def fetched_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.fetch(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")], 100, 200).select("o_orderkey", "place")


@query("WITH d AS (SELECT DISTINCT c_nationkey::DOUBLE AS number FROM customer WHERE c_nationkey IS NOT NULL) SELECT number, row_number() OVER (ORDER BY number DESC)::BIGINT AS place FROM d")
def unique_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.unique_numbers(table(spark, sf_dir, "customer"), "c_nationkey")


@query("WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n, o_totalprice > 499000 AS stop FROM orders) SELECT o_orderkey FROM s WHERE n <= coalesce((SELECT min(n) FROM s WHERE stop), n)")
def rows_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a row callback sees that stops at the first large order."""
    return paging.until(table(spark, sf_dir, "orders"), [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_totalprice") > 499000).select("o_orderkey")


@query("SELECT (SELECT count(*) FROM nation)::BIGINT AS n, 'n_nationkey,n_regionkey' AS names, count(*)::BIGINT AS first FROM (SELECT * FROM nation LIMIT 7)")
def table_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by their number of rows and names, and the first seven of them."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    _, n, names = paging.get_table(rows, -2)
    return paging.get_table(rows, 7)[0].agg(F.lit(n).cast("long").alias("n"), F.lit(",".join(names)).alias("names"), F.count("*").alias("first"))


_DRAW = "('0x' || substr(md5('7:' || p_partkey::VARCHAR), 1, 10))::BIGINT / 1099511627776.0::DOUBLE"


@query(
    f"WITH e AS (SELECT min(p_partkey) AS lo, max(p_partkey) AS hi FROM part) SELECT p_partkey, round({_DRAW}, 12) AS plain, round({_DRAW} - CASE WHEN p_partkey - lo >= (hi - lo) / 2.0::DOUBLE THEN 0.2::DOUBLE ELSE 0 END, 12) AS second FROM part, e"
)
def random_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey")
    second = index_ops.in_random_order(part, "p_partkey", 7, bias=0.4, position="p_partkey").select("p_partkey", F.round("rank_key", 12).alias("second"))
    return index_ops.in_random_order(part, "p_partkey", 7).select("p_partkey", F.round("rank_key", 12).alias("plain")).join(second, "p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 400000)")
def removed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that are not in a list of keys."""
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return merge.missing(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")


@query(f"WITH {_IMG} SELECT imgidu, imgfolder FROM img WHERE imgfolder = 'D3'")
def one_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_ops.in_folder(_images(spark, sf_dir), "D3").select("imgidu", "imgfolder")


_DROPPED = "CASE page_id % 5 WHEN 0 THEN '.sld' WHEN 1 THEN '.SLDB' WHEN 2 THEN '/' WHEN 3 THEN '.png' ELSE '' END"


@query(f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'index' WHEN 1 THEN 'index' WHEN 3 THEN 'image' ELSE 'folder' END AS kind FROM pages")
def dropped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = pages.select("page_id", F.concat(F.lit("C:/x/"), F.col("page_id").cast("string"), F.expr(_DROPPED)).alias("path"))
    return index_ops.dropped_paths(rows, most=10**9).select("page_id", "kind")


@query(
    "SELECT 'key' AS what, count(*)::BIGINT AS n FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION ALL SELECT 'value', count(*)::BIGINT FROM customer WHERE c_nationkey IN (SELECT n_regionkey FROM nation) "
    "UNION ALL SELECT 'joined', sum(coalesce(o.n_regionkey * 10, n.n_regionkey))::BIGINT FROM nation n LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) o USING (n_nationkey)"
)
def dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership by key and by value, and one dictionary over another."""
    nation = table(spark, sf_dir, "nation")
    entries = nation.select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    people = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("c"))
    count = lambda df, name: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    both = lists.copy_from(entries, entries.where("value = '1'").withColumn("value", F.lit("10")))
    total = both.agg(F.lit("joined").alias("what"), F.sum(F.col("value").cast("long")).alias("n"))
    return count(lists.has_key(people, "c", entries.where("value = '1'")), "key").union(count(lists.has_value(people, "c", entries), "value")).union(total)


_WORDS = "list_filter(regexp_split_to_array(text, '[^a-z]+'), lambda w: contains(w, 'e'))"


@query(f"SELECT item_id, len(list_distinct({_WORDS}))::BIGINT AS n FROM benchmark WHERE len({_WORDS}) > 0")
def packed_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of an item packed as key=value text, and read back."""
    words = F.array_distinct(F.filter(F.split("text", "[^a-z]+"), lambda w: w.contains("e")))
    packed = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(words, lambda w: F.concat(F.col("item_id").cast("string"), F.lit(":"), w, F.lit("=1"))), "\n").alias("t"))
    found = lists.parse_dictionary(packed, "t").select(F.split("key", ":", 2)[0].alias("item_id")).where("item_id <> ''")
    return found.groupBy(F.col("item_id").cast(dict(packed.dtypes)["item_id"]).alias("item_id")).agg(F.count("*").alias("n"))


@query(
    "WITH o AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_name END AS a, CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS b FROM customer), m AS (SELECT c_custkey, CASE WHEN c_nationkey > 5 THEN 'main' END AS a, 'p' AS b FROM customer WHERE c_mktsegment <> 'BUILDING') "
    "SELECT c_custkey, coalesce(o.a, m.a) AS a, coalesce(o.b, m.b) AS b FROM customer c LEFT JOIN m USING (c_custkey) LEFT JOIN o USING (c_custkey) WHERE coalesce(o.a, m.a, o.b, m.b) IS NOT NULL"
)
def merged_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side tables of a merged index: the imported value, else the own one."""
    rows = table(spark, sf_dir, "customer")
    other = rows.select("c_custkey", F.expr("CASE WHEN c_acctbal > 0 THEN c_name END AS a"), F.expr("CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS b"))
    main = rows.where("c_mktsegment <> 'BUILDING'").select("c_custkey", F.expr("CASE WHEN c_nationkey > 5 THEN 'main' END AS a"), F.lit("p").alias("b"))
    merged = rows.select("c_custkey", F.col("c_custkey").alias("old_main"), F.col("c_custkey").alias("old_other"))
    return merge.merge_blobs(merged, main, other, "c_custkey", ["a", "b"])


@query("SELECT date_trunc('hour', ts) AS start, count(*)::BIGINT AS views FROM events WHERE ts IS NOT NULL GROUP BY 1")
def windowed_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's windows, over the whole table."""
    return collect.views_by_window(table(spark, sf_dir, "events"), "ts").select(F.col("start").cast("timestamp_ntz").cast("timestamp").alias("start"), "views")


@query(
    f"WITH {_HASHED}, p AS (SELECT a.group_id, b.vec_id AS id_a, a.vec_id AS id_b, bit_count(xor(a.h, b.h)) AS d FROM c a JOIN c b ON a.group_id = b.group_id AND a.seq < b.seq WHERE bit_count(xor(a.h, b.h)) < 21), "
    "l AS (SELECT p.* FROM p ANTI JOIN (SELECT vec_id AS id_a FROM embeddings WHERE embedding[1] > 0) USING (id_a)), q AS (SELECT group_id, count(*) AS n FROM l GROUP BY group_id) SELECT group_id, id_a, id_b FROM l JOIN q USING (group_id) WHERE n > 1"
)
def unlisted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose first image is not in the list yet, of groups that keep two or more."""
    listed = table(spark, sf_dir, "embeddings").where("embedding[0] > 0").select(F.col("vec_id").alias("id_a"))
    return paging.without_listed(sweep.sweep(_hashed(spark, sf_dir), 21), listed, "id_a").select(*long("group_id", "id_a", "id_b"))


@query(
    "SELECT c_mktsegment AS segment, count(*)::BIGINT AS n, sum((c_acctbal < 0)::INT)::BIGINT AS negative, (SELECT count(*) FROM nation)::BIGINT AS nations, sum(length(c_name))::BIGINT AS letters, "
    "count(*) FILTER (substr(c_name, 10, 3) = '000')::BIGINT AS zeros, sum(c_custkey % 7)::BIGINT AS rest FROM customer GROUP BY c_mktsegment"
)
def sql_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, sums of conditions, scalar subqueries and text functions in one statement."""
    return spark.sql(
        "SELECT c_mktsegment AS segment, count(*) AS n, sum(int(c_acctbal < 0)) AS negative, (SELECT count(*) FROM {nation}) AS nations, sum(length(c_name)) AS letters, "
        "count_if(substr(c_name, 10, 3) = '000') AS zeros, sum(c_custkey % 7) AS rest FROM {customer} GROUP BY c_mktsegment",
        customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation"),
    )


@query(
    f"WITH {_HASHED}, g AS (SELECT vec_id, {_GRAYS} AS v FROM embeddings), p AS (SELECT a.group_id, b.vec_id AS id_a, a.vec_id AS id_b, bit_count(xor(a.h, b.h))::BIGINT AS d FROM c a JOIN c b ON a.group_id = b.group_id AND a.seq < b.seq WHERE bit_count(xor(a.h, b.h)) < 24), "
    "s AS (SELECT p.*, floor(sqrt(list_sum(list_transform(range(64), lambda k: (x.v[k + 1] - y.v[k + 1]) ** 2)) / 32.0) + 0.5)::BIGINT AS mse FROM p JOIN g x ON x.vec_id = id_a JOIN g y ON y.vec_id = id_b) "
    "SELECT group_id, id_a, id_b, d AS ham_dist, mse FROM s WHERE mse BETWEEN 20 AND 42"
)
def score_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs within bounds of the score, ends included."""
    pixels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), _grays().alias("values"))
    scored = sweep.with_scores(sweep.sweep(_hashed(spark, sf_dir), 24), pixels)
    return cluster.within_bounds(scored, mse=(20, 42)).select(*long("group_id", "id_a", "id_b", "ham_dist", "mse"))
