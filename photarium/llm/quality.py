"""Quality rules: distances of a document's character classes and common words from those of the languages.

For each language the whole table gives a reference: its shares of character classes, and of its common words (those with at least
COMMON of all its words) with all other words as one more bin. A document is held against its nearest reference by Jensen-Shannon
distance, in [0, 1]. Short documents spread by chance, so each distance is judged from a least length on.

Common words are found exactly in two passes: a word with a share of COMMON over a language has a share of COMMON / 4 in some chunks, and
those chunks hold all of its count but COMMON / 4. The first pass sums such chunk counts, which leaves few candidates whatever the size of
the vocabulary; the second counts the candidates.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photarium.llm.common import drop, small_batches, store

COMMON = 0.002
CHUNK_WORDS = 1 << 19
#: Guards: words from which on each distance is judged.
LEAST_CLASS_WORDS = 50
LEAST_WORD_WORDS = 200
#: Distances above which a document goes.
MOST_CLASS = 0.29
MOST_WORD = 0.32
#: Fixed values of op7's base rules.
BASE_WORDS = 50
BASE_REPEATED = 50
SYMBOLS = b"#*$%&|<>"

#: Classes of bytes: a character beyond ASCII counts by its first byte, the others are in class SKIP.
CLASSES = ("lower", "upper", "digit", "blank", "point", "symbol", "other", "beyond")
SKIP = len(CLASSES)


def _class(b: int) -> int:
    c = bytes([b])
    if b >= 0x80:
        return SKIP if b < 0xC0 else 7
    if c in b" \t\n\x0b\x0c\r":
        return 3
    if c in SYMBOLS:
        return 5
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c in b".,;:!?'\"()-" else 6


_CLASS = np.array([_class(b) for b in range(256)], np.uint8)
_LETTERS = bytes(c if chr(c).isalpha() or c >= 0x80 else 0x20 for c in range(256))


def classes(raw: bytes) -> np.ndarray:
    """Counts of the classes, SKIP last."""
    return np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=SKIP + 1)


def plain_words(text: str) -> list[bytes]:
    """Lower-cased runs of letters, for the word histogram."""
    return text.lower().encode("utf-8", "replace").translate(_LETTERS).split()


def repeated_words(words: list[bytes]) -> int:
    """Words within a 3-word window whose sequence is found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(known.__getitem__, words), np.int64, n)
    pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    windows, counts = np.unique(pair[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)[1:]
    start = np.flatnonzero(counts[windows] > 1)
    mark = np.zeros(n, bool)
    for k in range(3):
        mark[start + k] = True
    return int(mark.sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances between histogram p and the rows of q, which add to 1."""
    p = p / p.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


class References:
    """For each language: shares of classes, and of its common words, the rest last. Bins of all languages stand in one array."""

    def __init__(self, rows: list[tuple[str, np.ndarray, dict[bytes, int], int]]):
        self.langs = [r[0] for r in rows]
        self.classes = np.array([r[1] / max(1, r[1].sum()) for r in rows]).reshape(len(rows), len(CLASSES))
        #: Word to (language, bin) pairs, so that a document's own words find their bins.
        self.places: dict[bytes, list[tuple[int, int]]] = {}
        shares: list[float] = []
        self.starts = np.zeros(len(rows), np.int64)
        for k, (_, _, counts, total) in enumerate(rows):
            self.starts[k] = len(shares)
            own = {w: n for w, n in counts.items() if n >= COMMON * total}
            for w in sorted(own):
                self.places.setdefault(w, []).append((k, len(shares)))
                shares.append(own[w] / max(1, total))
            shares.append((total - sum(own.values())) / max(1, total))
        self.shares = np.array(shares)
        self.ends = np.append(self.starts[1:], len(shares)) - 1

    def distances(self, class_counts: np.ndarray, words: list[bytes]) -> tuple[float, float]:
        """(class distance, word distance) to the language nearest by words, then classes; zeros without any reference."""
        if not self.langs or not class_counts.sum():
            return 0.0, 0.0
        by_class = distance(class_counts, self.classes)
        by_word = np.ones(len(self.langs))
        if words:
            own, rest = np.zeros(len(self.shares)), np.full(len(self.langs), len(words), float)
            for w, n in Counter(words).items():
                for k, at in self.places.get(w, ()):
                    own[at] = n
                    rest[k] -= n
            own[self.ends] = rest
            own /= len(words)
            mean = (own + self.shares) / 2
            with np.errstate(divide="ignore", invalid="ignore"):
                both = np.where(own > 0, own * np.log2(own / mean), 0) + np.where(self.shares > 0, self.shares * np.log2(self.shares / mean), 0)
            by_word = np.sqrt(np.clip(np.add.reduceat(both, self.starts) / 2, 0, 1))
        at = min(range(len(self.langs)), key=lambda k: (by_word[k], by_class[k]))
        return float(by_class[at]), float(by_word[at])


def _chunk_counts(batches: Iterator[pd.DataFrame], keep: dict[str, set[bytes]] | None) -> Iterator[pd.DataFrame]:
    """Rows (lang, word, n, classes): common words of chunks or, with keep, all counts of those words; a null word carries the totals."""
    counts: dict[str, Counter] = {}
    sizes: Counter = Counter()
    marks: dict[str, np.ndarray] = {}

    def flush() -> pd.DataFrame:
        rows = []
        for lang, n in sizes.items():
            rows.append((lang, None, n, marks[lang].tolist()))
            least = 0 if keep is not None else n * COMMON / 4
            rows += [(lang, w, c, None) for w, c in counts[lang].items() if c >= least]
        return pd.DataFrame(rows, columns=["lang", "word", "n", "classes"])

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            if lang is None or not text:
                continue
            words = plain_words(text)
            own = counts.setdefault(lang, Counter())
            if keep is None:
                own.update(words)
            else:
                own.update(filter(keep.get(lang, set()).__contains__, words))
            sizes[lang] += len(words)
            marks[lang] = marks.get(lang, 0) + classes(text.encode("utf-8", "replace"))[:SKIP]
            if sum(sizes.values()) >= CHUNK_WORDS:
                yield flush()
                counts, sizes, marks = {}, Counter(), {}
    if sizes:
        yield flush()


def _summed(docs: DataFrame, keep: dict[str, set[bytes]] | None) -> DataFrame:
    rows = docs.select("lang", "text").mapInPandas(lambda it: _chunk_counts(it, keep), "lang string, word binary, n long, classes array<long>")
    sums = [F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(SKIP)]
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"), *sums)


def references(docs: DataFrame) -> References:
    """From docs(lang, text), over all rows with a language. What comes to the driver: at most 4 / (3 * COMMON) words a language."""
    first = store(_summed(docs, None).where("n > 0"), "quality-words")
    totals = first.where("word is null").select("lang", F.col("n").alias("total"))
    near = first.where("word is not null").join(totals, "lang").where(F.col("n") >= F.col("total") * (COMMON * 3 / 4)).select("lang", "word")
    keep: dict[str, set[bytes]] = {}
    for r in near.collect():
        keep.setdefault(r["lang"], set()).add(bytes(r["word"]))
    drop(first)
    rows = _summed(docs, keep).where(F.col("n") > 0)
    words: dict[str, dict[bytes, int]] = {}
    total = []
    for r in rows.collect():
        if r["word"] is None:
            total.append(r)
        else:
            words.setdefault(r["lang"], {})[bytes(r["word"])] = r["n"]
    return References([(r["lang"], np.array([r[f"c{k}"] for k in range(SKIP)], float), words.get(r["lang"], {}), r["n"]) for r in sorted(total, key=lambda r: r["lang"])])


def features_of(text: Column, known: References) -> Column:
    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double"

    @F.pandas_udf(schema)
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            words, marks = raw.split(), classes(raw)
            n = len(words)
            near = known.distances(marks[:SKIP], plain_words(text)) if n >= LEAST_CLASS_WORDS else (0.0, 0.0)
            rows.append((n, int(marks[:SKIP].sum() - marks[3]), int(marks[5]), duplicate_lines(raw), repeated_words(words), *near))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return of(text)


def rules(docs: DataFrame, most_class: float = MOST_CLASS, most_word: float = MOST_WORD) -> DataFrame:
    """(doc_id, the base counts, base_failed, class_distance, word_distance, kept) for every row.

    Null and empty texts have no words and fail the base rule; a null language teaches nothing, and a document of one is held against
    the nearest reference like any other; without references only the base rule decides; equal texts get equal verdicts; an empty table
    gives no rows; other columns are not read.
    """
    own = small_batches(docs).select("doc_id", "text", "lang")
    found = own.select("doc_id", features_of(F.col("text"), references(own)).alias("f")).select("doc_id", "f.*")
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATED * F.col("n_words"))
    far = ((F.col("n_words") >= LEAST_CLASS_WORDS) & (F.col("class_distance") > most_class)) | ((F.col("n_words") >= LEAST_WORD_WORDS) & (F.col("word_distance") > most_word))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
