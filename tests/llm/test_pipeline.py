"""Every stage of the pipeline on the small table, against a plain version of what it decides."""

import base64
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from photarium.llm import byte_bpe, simhash


@pytest.fixture(scope="module")
def outputs(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [docs.collect()]
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        found.append(docs.collect())
    return found


def test_stages_are_the_five_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "mix_sources", "byte_bpe"]


def test_language_stage_keeps_texts_with_letters(outputs):
    assert {r["doc_id"] for r in outputs[1]} == {r["doc_id"] for r in outputs[0] if r["text"] and any(c.isalpha() for c in r["text"])}


def test_near_dedup_stage_keeps_the_smallest_of_each_group(outputs):
    rows = sorted(outputs[1], key=lambda r: r["doc_id"])
    wide = np.array([simhash.wide_fingerprint(r["text"], 5) for r in rows])
    most, label = simhash.most_bits(0.8), np.arange(len(rows))
    while True:
        new = np.array([label[np.bitwise_count(wide ^ w).sum(axis=1) <= most].min() for w in wide])
        if (new == label).all():
            break
        label = new
    assert {r["doc_id"] for r in outputs[2]} == {rows[k]["doc_id"] for k in set(label)}


def test_substring_stage_takes_out_repeats_and_nothing_else(outputs):
    words = lambda r: (r["text"] or "").encode().split()
    seen = Counter(tuple(w[k : k + 35]) for w in map(words, outputs[2]) for k in range(len(w) - 34))
    want = {}
    for r in outputs[2]:
        w = words(r)
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        if kept or not gone:
            want[r["doc_id"]] = r["text"] if not gone else kept
    got = {r["doc_id"]: r for r in outputs[3]}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert r["text"] == want[i] or words(r) == want[i]


def test_mixing_stage_meets_its_budget(outputs):
    size = lambda rows: sum(len((r["text"] or "").encode().split()) for r in rows)
    sources = len({r["source"] for r in outputs[3]})
    assert abs(size(outputs[4]) - 1.5 * size(outputs[3])) <= sources
    assert max(Counter(r["doc_id"] for r in outputs[4]).values()) <= 2


def test_encoding_stage_equals_the_library(outputs):
    path, pattern = byte_bpe.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r["doc_id"], tuple(library.encode_ordinary(r["text"] or ""))) for r in outputs[4])
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in outputs[5]) == want and all(r["round_trip"] for r in outputs[5])


def test_stages_take_odd_rows_and_none(spark, tmp_path):
    """Nulls in every column, empty and long texts, equal rows, ties, columns whose names the stages use inside, and empty tables."""
    plain = "the quick brown fox jumps over the lazy dog and then it sleeps all day long in the warm sun "
    other = "der schnelle braune Fuchs springt über den faulen Hund und schläft dann den ganzen Tag "
    rows = [(k, (plain if k % 2 else other) + f"number{k} " * 20, "en" if k % 2 else "de", "s", 5) for k in range(40)]
    rows += [(None, None, None, None, None), (50, "", "en", None, 0), (51, " \n\t ", None, "s", 3), (52, "12345 678", "en", "t", 9), (53, plain * 3000, "en", "s", None), (54, plain, "en", None, 1), (54, plain, "en", None, 1), (None, other, "de", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("rid", "rid2", "row", "fp", "key", "node", "spans", "size", "taken", "words", "p", "_n"):
        docs = docs.withColumn(name, F.lit(1))
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, now, "")
            path = f"{tmp_path}/{start is docs}-{name}"
            found.write.parquet(path)
            now = spark.read.parquet(path)
            assert name == "byte_bpe" or now.columns == docs.columns
        assert (now.count() > 0) == (start is docs)
    kept = spark.read.parquet(f"{tmp_path}/True-language_id").collect()
    assert not {r["doc_id"] for r in kept} & {50, 51, 52} and {53, 54, None} <= {r["doc_id"] for r in kept}
    once = [r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/True-simhash_near_dedup").collect()]
    assert once.count(54) <= 1 and len(once) == len(set(once))
