"""Substring dedup by recompression.

A text is a sequence of word names. Each round names every maximal run of one symbol, then splits the alphabet in two by one bit of the
symbols' names and names every pair (left class, right class). A name is a 64-bit hash of what it stands for, so all documents, tasks and
retries agree on it without a dictionary: equal substrings get equal symbols, but for a few at their two ends, where a run or a pair may
reach outside. How many is decided inside the substring alone, so for each window we know, at every level, which symbols any other
occurrence of the same window must have too: its interior.

1. Each window is represented by one interior symbol of its highest level that has any, the longest (then the smallest name, then the
   first). Neighbouring windows share theirs, so a text yields one row for some ten words: (name, stretch, range of windows), stretch being
   a hash of all words that the range covers.
2. Names found once rule their windows out. Counts are pre-aggregated; hot names are ordinary equi-join keys.
3. Ranges equal in name and stretch (128 bits) are equal in every window. That settles the inside of a long repeat, however many copies.
4. Where one name stands for several stretches, at the ends of repeats, one range of each is read again and its windows are compared one
   by one by a 128-bit hash of their words.

No window is lost: equal windows have equal interiors, hence the same representative at the same place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photarium.llm.common import drop, release, row_ids, small_batches, store, tidied

WINDOW = 35
#: With more, too few windows of 35 words keep an interior at the top level (3: 0.10 rows a word, 5: 0.27).
ROUNDS = 3
#: Words handled at once; longer documents are handled alone.
BATCH_WORDS = 1 << 17

_U = np.uint64
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def names_of(words: list[bytes]) -> np.ndarray:
    """A 64-bit name of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words, repeat(7))), ">u8").astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def levels(names: np.ndarray, wall: np.ndarray, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each level (symbols, their starts, first, last): symbols first[i] up to, without, last[j] are those that any occurrence of
    the words i up to j must have. names: of all words; wall: marks separators between documents, which join nothing.
    """
    n = len(names)
    symbol, start = names, np.arange(n, dtype=np.int32)
    first, last = np.arange(n + 1, dtype=np.int32), np.arange(n + 1, dtype=np.int32)
    yield symbol, start, first, last
    for level in range(rounds):
        # runs: the first and the last one of a window may reach outside
        head = np.ones(len(symbol), bool)
        head[1:] = (symbol[1:] != symbol[:-1]) | wall[1:]
        at = np.flatnonzero(head)
        length = np.diff(np.append(at, len(symbol)))
        run = np.cumsum(head, dtype=np.int32) - np.int32(1)
        first = np.append(run, run[-1])[first] + np.int32(1)
        last = run[np.maximum(last - 1, 0)]
        symbol, start, wall = symbol[at], start[at], wall[at]
        long = np.flatnonzero(length > 1)
        if len(long):
            symbol = symbol.copy()
            symbol[long] = _mix(symbol[long] * _K1 + length[long].astype(np.uint64) * _K3 + _U(2 * level + 1))
        # pairs: a window's first symbol may belong to a pair if it is of the right class, its last if it is of the left
        right = (symbol >> _U(8 + level)) & _U(1) == 1
        left = ~right & ~wall
        right &= ~wall
        joins = np.zeros(len(symbol), bool)
        joins[:-1] = left[:-1] & right[1:]
        keep = np.ones(len(symbol), bool)
        keep[1:] = ~joins[:-1]
        index = np.cumsum(keep, dtype=np.int32) - np.int32(1)
        end = np.int32(index[-1] + 1)
        first = np.append(index + right, end)[first]
        last = np.where(last > 0, (index + ~left)[np.maximum(last - 1, 0)], np.int32(0))
        pair = np.flatnonzero(joins)
        named = symbol.copy()
        named[pair] = _mix((symbol[pair] * _K1 ^ (symbol[pair + 1] >> _U(17))) * _K2 + symbol[pair + 1] * _K3 + _U(2 * level + 2))
        at = np.flatnonzero(keep)
        symbol, start, wall = named[at], start[at], wall[at]
        yield symbol, start, first.astype(np.int32), last.astype(np.int32)


def representatives(docs: list[np.ndarray], window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """For documents given by their words' names: (name, stretch, document's number, first window, last window), windows by their first word."""
    sizes = np.array([len(x) for x in docs])
    names = np.concatenate([x for d in docs for x in (d, np.zeros(1, np.uint64))])
    offset = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    wall = np.zeros(len(names), bool)
    wall[offset + sizes] = True
    starts = np.repeat(offset, np.maximum(sizes - window + 1, 0)) + _ramp(np.maximum(sizes - window + 1, 0))
    owner = np.repeat(np.arange(len(docs)), np.maximum(sizes - window + 1, 0))
    name, place = np.zeros(len(starts), np.uint64), np.full(len(starts), -1, np.int64)
    open_ = np.arange(len(starts))
    for level, (symbol, start, first, last) in reversed(list(enumerate(levels(names, wall, rounds)))):
        a, b = first[starts[open_]], last[starts[open_] + window]
        has = b > a
        own, a, b = open_[has], a[has], b[has]
        open_ = open_[~has]
        if not len(own):
            continue
        # windows in a row with the same interior are settled once
        fresh = np.ones(len(own), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, group = a[fresh], b[fresh], np.cumsum(fresh) - 1
        size = np.diff(np.append(start, len(names))).astype(np.uint64)
        rank = (np.minimum(size, _U(0xFFFF)) << _U(48)) | (~symbol >> _U(16))
        best, left = a.copy(), np.flatnonzero(b - a > 1)
        step = 1
        while len(left):
            other = a[left] + step
            better = rank[other] > rank[best[left]]
            best[left[better]] = other[better]
            step += 1
            left = left[a[left] + step < b[left]]
        chosen = best[group]
        name[own] = _mix(symbol[chosen] + np.full(1, level + 1, np.uint64) * _K2)
        place[own] = (np.int64(level) << 40) + start[chosen]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    lo, hi = starts[at], starts[np.append(at[1:], len(starts)) - 1]
    stretch = span_hash(names, lo, hi + window)
    return name[at], stretch, owner[at], lo - offset[owner[at]], hi - offset[owner[at]]


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n, in a row."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _prefix(names: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of names by falling powers of an odd base, and the rising powers: (sum[e] - sum[s]) * power[s] depends on the words s to e only."""
    if base not in _powers or len(_powers[base][0]) <= len(names):
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            power = np.full(2 * len(names) + 1, x, np.uint64)
            power[0] = 1
            both.append(np.multiply.accumulate(power))
        _powers[base] = both[0], both[1]
    forth, back = _powers[base]
    total = np.zeros(len(names) + 1, np.uint64)
    np.cumsum(names * back[: len(names)], out=total[1:])
    return total, forth


def span_hash(names: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    total, forth = _prefix(_mix(names + _K1) if which else names, _BASES[which])
    return _mix((total[end] - total[start]) * forth[start] + (end - start).astype(np.uint64))


def _scan(batches: Iterator[pd.DataFrame], window: int, rounds: int) -> Iterator[pd.DataFrame]:
    held: list[np.ndarray] = []
    rids: list[tuple[int, int]] = []
    total = 0

    def flush() -> pd.DataFrame:
        name, stretch, owner, lo, hi = representatives(held, window, rounds)
        rid, rid2 = np.array(rids, np.int64)[owner].T
        return pd.DataFrame({"name": name.view(np.int64), "stretch": stretch.view(np.int64), "rid": rid, "rid2": rid2, "span": (lo << 32) | hi})

    for batch in batches:
        for rid, rid2, text in zip(batch["rid"], batch["rid2"], batch["text"]):
            words = words_of(text)
            if len(words) >= window:
                held.append(names_of(words))
                rids.append((rid, rid2))
                total += len(words)
            if total >= BATCH_WORDS:
                yield flush()
                held, rids, total = [], [], 0
    if held:
        yield flush()


def _verify(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    out: list[tuple] = []
    total = 0

    def flush() -> pd.DataFrame:
        h1, h2, rid, rid2, span, single = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"h1": h1.view(np.int64), "h2": h2.view(np.int64), "rid": rid, "rid2": rid2, "span": span, "single": single})

    for batch in batches:
        for rid, rid2, text, spans in zip(batch["rid"], batch["rid2"], batch["text"], batch["spans"]):
            names = names_of(words_of(text))
            for single in (False, True):
                own = np.unique([x["span"] for x in spans if x["single"] == single]).astype(np.int64)
                lo, hi = own >> 32, own & 0xFFFFFFFF
                starts = np.repeat(lo, hi - lo + 1) + _ramp(hi - lo + 1)
                starts = starts[starts + window <= len(names)]
                h1, h2 = span_hash(names, starts, starts + window), span_hash(names, starts, starts + window, 1)
                out.append((h1, h2, np.full(len(starts), rid, np.int64), np.full(len(starts), rid2, np.int64), (starts << 32) | starts, np.full(len(starts), single)))
                total += len(starts)
        if total >= BATCH_WORDS:
            yield flush()
            out, total = [], 0
    if out:
        yield flush()


def repeated_windows(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """docs(rid, rid2, text) to (rid, rid2, spans): ranges of windows found more than once, first << 32 | last, for the texts that have any."""
    names = store(docs.mapInPandas(lambda it: tidied(_scan(it, window, rounds)), "name long, stretch long, rid long, rid2 long, span long"), "recompression-names")
    shared = names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    # stored, so that both sides of the join are plain exchanges, which adaptive execution may split where a name is hot
    shared = store(shared, "recompression-repeated")
    ranges = store(names.join(shared, "name"), "recompression-shared")
    drop(names)
    drop(shared)
    release(docs.sparkSession)
    kinds = store(ranges.groupBy("name", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("rid", "rid2", "span")).alias("one")), "recompression-kinds")
    whole = ranges.join(kinds.where("n > 1").select("name", "stretch"), ["name", "stretch"]).select("rid", "rid2", "span")
    mixed = store(kinds.groupBy("name").agg(F.count("*").alias("kinds")).where("kinds > 1").select("name"), "recompression-mixed")
    ends = kinds.join(mixed, "name").groupBy("one.rid", "one.rid2").agg(F.collect_list(F.struct("one.span", (F.col("n") == 1).alias("single"))).alias("spans"))
    hashes = store(docs.join(ends, ["rid", "rid2"]).select("rid", "rid2", "text", "spans").mapInPandas(lambda it: tidied(_verify(it, window)), "h1 long, h2 long, rid long, rid2 long, span long, single boolean"), "recompression-ends")
    twice = store(hashes.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "recompression-twice")
    partly = hashes.where("single").join(twice, ["h1", "h2"]).select("rid", "rid2", "span")
    found = store(whole.union(partly).groupBy("rid", "rid2").agg(F.collect_set("span").alias("spans")), "recompression-found")
    for table in (ranges, kinds, mixed, hashes, twice):
        drop(table)
    release(docs.sparkSession)
    return found


def covered(n: int, spans, window: int = WINDOW) -> np.ndarray:
    """Marks the words that the windows of the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    spans = np.asarray(spans, np.int64)
    np.add.at(edge, spans >> 32, 1)
    np.add.at(edge, (spans & 0xFFFFFFFF) + window, -1)
    return np.cumsum(edge)[:n] > 0


def removals(docs: DataFrame, columns: list[Column], window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """The columns, with `text` and `spans` of each row's repeated windows (null: none)."""
    own = small_batches(docs).select(*row_ids(), "text")
    found = repeated_windows(own, window, rounds)
    return docs.select(*row_ids(), F.col("text").alias("text"), *columns).join(found, ["rid", "rid2"], "left")


def digest_of(text: Column, spans: Column, window: int = WINDOW) -> Column:
    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string")
    def of(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for own, at in zip(texts, found):
            words = words_of(own)
            n = len(words)
            if at is not None:
                words = list(compress(words, ~covered(n, at, window)))
            rows.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])

    return of(text, spans)


def cleaned_of(text: Column, spans: Column, window: int = WINDOW) -> Column:
    """The text without the covered words; what stands between kept words stays, and a blank takes the place of what went."""
    import regex

    pattern = regex.compile(r"[^\x20\x09-\x0D]+")

    @F.pandas_udf("string")
    def of(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for own, at in zip(texts, found):
            if own is not None and at is not None:
                spans = [m.span() for m in pattern.finditer(own)]
                kept = np.flatnonzero(~covered(len(spans), at, window))
                cuts = np.flatnonzero(np.diff(kept) > 1) + 1
                own = " ".join(own[spans[p[0]][0] : spans[p[-1]][1]] for p in np.split(kept, cuts) if len(p))
            out.append(own)
        return pd.Series(out, dtype=object)

    # so named, a filter on the result stays behind it; else texts would be cleaned once for the filter and again for the rest
    return of.asNondeterministic()(text, spans)


def dedup(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """The rows of docs with every word taken out of `text` that a repeated window covers; rows of which no word is left go.

    Rows without such a window stay as they are, null and empty texts included. n_chars, if there, follows the text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = removals(docs, [row], window, rounds)
    new = found.select("row", "spans", F.when(F.col("spans").isNull(), F.col("text")).otherwise(cleaned_of(F.col("text"), F.col("spans"), window)).alias("new"))
    left = new.where(F.col("spans").isNull() | (F.col("new") != ""))
    swap = {"text": F.col("new"), "n_chars": F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("new")) if "n_chars" in docs.columns else None}
    return left.select(*[(swap[c].cast(docs.schema[c].dataType) if c in swap else F.col("row").getField(c)).alias(c) for c in docs.columns])


def removal_digest(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row.

    Null and empty texts have no words and the hash of nothing; repeated rows are copies of each other like any two documents; texts
    shorter than the window lose nothing; an empty table gives no rows; other columns are not read.
    """
    found = removals(docs, [F.col("doc_id").alias("doc_id")], window, rounds)
    return found.select("doc_id", digest_of(F.col("text"), F.col("spans"), window).alias("d")).select("doc_id", "d.n_words", "d.n_removed", "d.kept_sha256")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
