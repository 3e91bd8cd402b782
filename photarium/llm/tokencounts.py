"""Token counts of fields and sections by offset-mapped attribution.

A whole document is encoded once, as it would be for training: sections encoded on their own would be cut differently at their ends. Every
token has a span of the text; spans of tokens and sections are joined as intervals. A token that several sections share goes whole to
the one with most of its bytes (UTF-8), the first of equals; one that touches no section is counted apart, as section -1. So the counts of
a document's sections add to its number of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photarium.llm.byte_bpe import codec, default_vocabulary
from photarium.llm.common import small_batches

OUTSIDE = -1
COUNTS = "section array<int>, start array<int>, stop array<int>, n_tokens array<long>"


def assign(token_end: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For tokens that follow each other and end there: the number of their section, or OUTSIDE. Sections are in order and don't overlap."""
    token_start = np.concatenate([[0], token_end[:-1]]) if len(token_end) else token_end
    best, most = np.full(len(token_end), OUTSIDE), np.zeros(len(token_end), np.int64)
    own, at = np.arange(len(token_end)), np.searchsorted(stop, token_start, side="right")
    while len(own):
        inside = at < len(start)
        own, at = own[inside], at[inside]
        touches = start[at] < token_end[own]
        own, at = own[touches], at[touches]
        shared = np.minimum(stop[at], token_end[own]) - np.maximum(start[at], token_start[own])
        more = shared > most[own]
        best[own[more]], most[own[more]] = at[more], shared[more]
        at = at + 1
    return best


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines as sections, each with the line feed that ends it; by characters."""
    sizes = np.array([len(x) + 1 for x in text.split("\n")], np.int64)
    sizes[-1] -= 1
    stop = np.cumsum(sizes)
    keep = sizes > 0
    return (stop - sizes)[keep], stop[keep]


def count(ids: np.ndarray, raw: bytes, start: np.ndarray, stop: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sections, starts, stops and tokens of one text, given by its bytes; sections by characters, in order of their starts."""
    chars = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    edge = np.append(chars, len(raw))
    a, b = (edge[np.clip(x, 0, len(chars))] for x in (start, stop))
    counts = np.bincount(assign(np.cumsum(length[ids]), a, b) + 1, minlength=len(start) + 1)
    section = np.arange(len(start))
    if counts[0]:
        return np.append(section, OUTSIDE), np.append(start, -1), np.append(stop, -1), np.append(counts[1:], counts[0])
    return section, start, stop, counts[1:]


def counts_of(text: Column, sections: Column | None = None, path: str | None = None, pattern: str | None = None) -> Column:
    """struct of arrays (section, start, stop, n_tokens). sections: array of struct(start, stop) in characters that don't overlap; lines if
    not given. Null texts have no sections and no tokens."""
    path, pattern = (path, pattern) if path else default_vocabulary()
    none = np.zeros(0, np.int64)

    def counted(texts: list[str | None], every: list[np.ndarray], spans) -> pd.DataFrame:
        length = codec(path, pattern).length
        out = []
        for text, ids, span in zip(texts, every, spans):
            if text is None:
                out.append((none, none, none, none))
                continue
            if span is None:
                start, stop = line_spans(text)
            else:
                pairs = sorted((int(x["start"]), int(x["stop"])) for x in span if x is not None and x["stop"] > x["start"])
                start, stop = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), ())))
            out.append(count(ids, text.encode("utf-8", "surrogatepass"), start, stop, length))
        return pd.DataFrame(out, columns=["section", "start", "stop", "n_tokens"])

    if sections is None:

        @F.pandas_udf(COUNTS)
        def of_lines(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            return codec(path, pattern).each(batches, lambda texts, ids: counted(texts, ids, [None] * len(texts)))

        return of_lines(text)

    @F.pandas_udf(COUNTS)
    def of(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        own = texts.tolist()
        return counted(own, codec(path, pattern).encode(own), [[] if x is None else x for x in spans])

    return of(text, sections)


def token_counts(docs: DataFrame, sections: Column | None = None) -> DataFrame:
    """(doc_id, section, start, stop, n_tokens), one row a section of each document, sections counted from 0.

    Null texts have no rows, empty texts none either; a section without tokens has 0; repeated rows repeat; an empty table gives no rows;
    columns that no section is made of are not read.
    """
    found = small_batches(docs).select("doc_id", counts_of(F.col("text"), sections).alias("c"))
    each = found.select("doc_id", F.explode(F.arrays_zip("c.section", "c.start", "c.stop", "c.n_tokens")).alias("s"))
    inside = F.col("s.section") != OUTSIDE
    return each.select("doc_id", "s.section", F.when(inside, F.col("s.start")).alias("start"), F.when(inside, F.col("s.stop")).alias("stop"), "s.n_tokens")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
