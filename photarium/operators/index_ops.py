"""Services over an index of files: filters, search, sorting, statistics, selection, renaming, refresh.

The documentation of such services leaves details open; the rules chosen here are stated by each function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photarium.functions.text import file_extension, renamed
from photarium.operators.merge import renumbered


def filtered(files: DataFrame, text: str | None = None, columns: tuple[str, ...] = ("fullPath",), regex: bool = False, where: Column | None = None) -> DataFrame:
    """Files with the text in one of the columns, case aside, or a match of it as a pattern; and a condition on properties."""
    out = files if where is None else files.where(where)
    if text:
        tests = [F.coalesce(F.col(c).rlike(text) if regex else F.lower(F.col(c)).contains(text.lower()), F.lit(False)) for c in columns]
        hit = tests[0]
        for t in tests[1:]:
            hit = hit | t
        out = out.where(hit)
    return out


def in_folder(files: DataFrame, folder: str, column: str = "imgfolder") -> DataFrame:
    return files.where(F.col(column) == folder)


def search(files: DataFrame, pattern: str, column: str, position: str, after=None, before=None) -> DataFrame:
    """The first match behind `after`, the last before `before`, or all matches in order."""
    hits = files.where(F.col(column).rlike(pattern))
    if after is not None:
        return hits.where(F.col(position) > after).orderBy(position).limit(1)
    if before is not None:
        return hits.where(F.col(position) < before).orderBy(F.desc(position)).limit(1)
    return hits.orderBy(position)


def search_replace(files: DataFrame, column: str, find: str, put: str, regex: bool = False) -> DataFrame:
    """Adds `changed`: whether the replacement changed the column."""
    new = F.regexp_replace(column, find, put) if regex else F.replace(F.col(column), F.lit(find), F.lit(put))
    return files.withColumn("_new", new).withColumn("changed", F.col("_new") != F.col(column)).withColumn(column, F.col("_new")).drop("_new")


def keywords(files: DataFrame, column: str, least: int = 3) -> DataFrame:
    """(word, n): words of letters, lower-cased, at least `least` long, and the files that have them."""
    words = F.array_distinct(F.filter(F.split(F.lower(column), r"[^\p{L}]+"), lambda w: F.length(w) >= least))
    return files.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def with_keywords(files: DataFrame, column: str, words: list[str]) -> DataFrame:
    return files.where(F.arrays_overlap(F.split(F.lower(column), r"[^\p{L}]+"), F.array(*[F.lit(w.lower()) for w in words])))


def selected(files: DataFrame, text: str | None = None, column: str = "fullPath", listed: DataFrame | None = None, key: str = "imgidu") -> DataFrame:
    """Adds `selected`: by text in a column, and by membership in a list (seen files, favourites)."""
    mark = F.coalesce(F.lower(F.col(column)).contains(text.lower()), F.lit(False)) if text else F.lit(listed is not None)
    if listed is not None:
        marked = files.join(listed.select(key).distinct().withColumn("_listed", F.lit(True)), key, "left")
        return marked.withColumn("selected", mark & F.coalesce("_listed", F.lit(False))).drop("_listed")
    return files.withColumn("selected", mark)


def rest_of_group(grouped: DataFrame, order: list[Column], group: str = "group_id") -> DataFrame:
    """All members but the first of each duplicate group."""
    return grouped.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_n > 1").drop("_n")


def same_folder(files: DataFrame, picked: DataFrame, column: str = "imgfolder") -> DataFrame:
    return files.join(picked.select(column).distinct(), column, "left_semi")


def size_bin(size: Column) -> Column:
    """Classes of file sizes in bytes."""
    steps = ((0, "empty"), (1024, "under 1 KB"), (102_400, "under 100 KB"), (1_048_576, "under 1 MB"), (10_485_760, "under 10 MB"))
    out = F.when(size.isNull(), "unknown").when(size <= 0, "empty")
    for limit, name in steps[1:]:
        out = out.when(size < limit, name)
    return out.otherwise("10 MB and more")


def statistics(files: DataFrame, by: Column, size: str = "fsize") -> DataFrame:
    """(category, files, bytes)."""
    return files.groupBy(by.alias("category")).agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def histogram(files: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal classes from low to high; 0 below, bins + 1 above and at high."""
    return files.where(F.col(column).isNotNull()).groupBy(F.width_bucket(column, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def habits(seen: DataFrame, when: str, unit: str = "day") -> DataFrame:
    """(period, views)."""
    return seen.groupBy(F.date_trunc(unit, when).alias("period")).agg(F.count("*").alias("views"))


def by_extension(files: DataFrame, path: str = "fullPath") -> DataFrame:
    return statistics(files, file_extension(F.col(path)))


def in_random_order(files: DataFrame, key: str, seed: int = 0, bias: float = 0.0, position: str | None = None) -> DataFrame:
    """Adds `rank_key`, by which the list is in a random order that a rerun repeats: ten hexadecimal digits of a hash, as a share of all.
    bias in -1..1 prefers the list's first or second half by position (whole numbers without gaps)."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 10)
    draw = F.conv(digits, 16, 10).cast("double") / float(1 << 40)
    if not (bias and position):
        return files.withColumn("rank_key", draw)
    ends = F.broadcast(files.agg(F.min(position).alias("_low"), F.max(position).alias("_high")))  # one row
    first = F.col(position) - F.col("_low") < (F.col("_high") - F.col("_low")) / 2
    return files.join(ends).withColumn("rank_key", draw - F.when(first == F.lit(bias < 0), F.lit(abs(bias) / 2)).otherwise(F.lit(0.0))).drop("_low", "_high")


def reversed_list(files: DataFrame, position: str = "position") -> DataFrame:
    """New positions, the last first."""
    last = files.agg(F.max(position).alias("_m"))
    return files.join(F.broadcast(last)).withColumn(position, F.col("_m") + 1 - F.col(position)).drop("_m")


def moved(files: DataFrame, old: int, new: int, position: str = "position") -> DataFrame:
    """The entry at `old` goes to `new`; those between move up or down."""
    p = F.col(position)
    step = F.when(p == old, F.lit(new)).when((old < new) & p.between(old + 1, new), p - 1).when((old > new) & p.between(new, old - 1), p + 1).otherwise(p)
    return files.withColumn(position, step.cast("long"))


def multi_rename(files: DataFrame, file: str, order: list[Column], prefix: str = "", suffix: str = "", search_text: str | None = None, replace: str = "", counter: bool = True) -> DataFrame:
    """Adds new_name; counters run from 1 in the given order."""
    rows = renumbered(files, order, "_counter") if counter else files
    return rows.withColumn("new_name", renamed(F.col(file), F.col("_counter") if counter else None, prefix, suffix, search_text, replace)).drop("_counter")


def refreshed(index: DataFrame, listing: DataFrame, folders: DataFrame, folder: str = "imgfolder") -> DataFrame:
    """Entries of the given folders are those of the new listing; all others stay."""
    return index.join(folders, folder, "left_anti").unionByName(listing.join(folders, folder, "left_semi"), allowMissingColumns=True)


def union_lists(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Entries of both, once by key; where both have one, that of a."""
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_side"))).where("_n = 1").drop("_n", "_side")


def dropped_paths(paths: DataFrame, column: str = "path", most: int = 98_700) -> DataFrame:
    """Paths dropped onto the window, the first `most`, with their kind."""
    ext = file_extension(F.col(column))
    kind = F.when(ext.isin("sld", "sldb"), "index").when(ext == "vqpv", "vector").when(F.col(column).rlike(r"[\\/]$") | (ext == ""), "folder").otherwise("image")
    return paths.limit(most).withColumn("kind", kind)


def compare_sets(a: DataFrame, b: DataFrame, repeats: bool = False) -> DataFrame:
    """(side, n): distinct rows that only one side has, as EXCEPT counts them; with repeats, as EXCEPT ALL does."""
    only = lambda x, y: x.exceptAll(y) if repeats else x.subtract(y)
    left = only(a, b).agg(F.count("*").alias("n")).select(F.lit("a").alias("side"), "n")
    return left.union(only(b, a).agg(F.count("*").alias("n")).select(F.lit("b").alias("side"), "n"))
