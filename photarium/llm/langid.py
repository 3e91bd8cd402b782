"""Language identification in two steps: first the family, then one-versus-one linear SVMs among the family's languages.

Features are hashed byte trigrams of the lower-cased text with everything but letters as blanks, in relative frequencies over the whole
text. The models are linear, so a text's score under each is the mean of one table's entries over its trigrams: prediction reads every
text once, in Arrow batches, with a table of a few megabytes. Fitting uses a bounded sample: TRAIN_ROWS documents, or LEAST_EACH of each of
very many languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photarium.llm.common import small_batches, tidied

#: Families of languages by ISO 639-1 code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}

#: Documents fitted on, shared by the languages, and of each language at most and at least.
TRAIN_ROWS = 4000
TRAIN_ROWS_EACH = 600
LEAST_EACH = 10
FOLDS = 5
TABLE_BITS = 15
SCALE = 20.0
EPOCHS = 15
PENALTY = 1.0
#: Bytes of text handled at once; the table's rows at them take some hundred times the room.
CHUNK = 1 << 18
UNDECIDED = "und"

_BLANKS = bytes(c if chr(c).isalpha() or c >= 0x80 else 0x20 for c in range(256))
_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes), lang)


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Table positions of a text's byte trigrams, blanks around it included, some CHUNK at a time."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_BLANKS) + b" ", np.uint8)
    for at in range(0, len(raw) - 2, CHUNK):
        b = raw[at : at + CHUNK + 2].astype(np.uint32)
        mixed = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
        yield mixed >> np.uint32(32 - TABLE_BITS)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions that a text has, and how often: at most the table's size, however long the text."""
    total = np.zeros(1 << TABLE_BITS, np.int64)
    for part in trigrams(text):
        total += np.bincount(part, minlength=1 << TABLE_BITS)
    at = np.flatnonzero(total)
    return at, total[at]


def _fit(features: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray) -> np.ndarray:
    """Linear SVM with squared hinge loss by dual coordinate descent; the last entry is the bias."""
    w, alpha = np.zeros((1 << TABLE_BITS) + 1), np.zeros(len(sign))
    weight = np.where(sign > 0, (sign < 0).sum(), (sign > 0).sum()) / len(sign) * 2  # classes count alike
    diagonal = 1 / (2 * PENALTY * np.maximum(weight, 1e-6))
    norm = np.array([v @ v for _, v in features]) + diagonal
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for i in order.permutation(len(sign)):
            at, v = features[i]
            step = sign[i] * (w[at] @ v) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - step / norm[i])
            w[at] += (new - alpha[i]) * sign[i] * v
            alpha[i] = new
    return w


class Model:
    """Families, their languages, and one column of weights for each binary decision."""

    def __init__(self, taught: list[tuple[np.ndarray, np.ndarray]], langs: list[str]):
        """taught: counts() of the texts."""
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(x) for x in self.langs})
        self.members = {f: [x for x in self.langs if family_of(x) == f] for f in self.families}
        features = []
        for at, n in taught:
            features.append((np.append(at, 1 << TABLE_BITS), np.append(n * (SCALE / n.sum()), 1.0)))
        lang = np.array(langs)
        family = np.array([family_of(x) for x in langs])
        columns = []
        if len(self.families) > 1:
            columns += [_fit(features, np.where(family == f, 1.0, -1.0)) for f in self.families]
        self.pairs = [pair for f in self.families for pair in combinations(self.members[f], 2)]
        for a, b in self.pairs:
            own = np.flatnonzero((lang == a) | (lang == b))
            columns.append(_fit([features[i] for i in own], np.where(lang[own] == a, 1.0, -1.0)))
        table = np.stack(columns, axis=1) if columns else np.zeros(((1 << TABLE_BITS) + 1, 1))
        self.table, self.bias = (table[:-1] * SCALE).astype(np.float32), table[-1]

    def margins(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, text in enumerate(texts):
            total, n = 0.0, 0
            for part in trigrams(text):
                total, n = total + self.table[part].sum(axis=0, dtype=np.float64), n + len(part)
            out[i] = total / n + self.bias
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Languages and scores of texts that have a letter. A score is the product of the two steps' confidences in [0, 1]."""
        if not texts:
            return [], np.zeros(0)
        sure = 1 / (1 + np.exp(-4 * np.clip(self.margins(texts), -50, 50)))
        n = len(self.families) if len(self.families) > 1 else 0
        family = sure[:, :n].argmax(axis=1) if n else np.zeros(len(texts), int)
        score = sure[:, :n].max(axis=1) if n else np.ones(len(texts))
        langs = [""] * len(texts)
        for k, f in enumerate(self.families):
            own = np.flatnonzero(family == k)
            names = self.members[f]
            votes, trust = np.zeros((len(own), len(names))), np.ones((len(own), len(names)))
            for p, (a, b) in enumerate(self.pairs):
                if a in names:
                    s = sure[own, n + p]
                    for name, x in ((a, s), (b, 1 - s)):
                        j = names.index(name)
                        votes[:, j] += (x > 0.5) + 1e-3 * x
                        trust[:, j] = np.minimum(trust[:, j], x)
            best = votes.argmax(axis=1)
            score[own] *= trust[np.arange(len(own)), best]
            for i, j in zip(own, best):
                langs[i] = names[j]
        return langs, score


def sample(docs: DataFrame) -> DataFrame:
    """(lang, at, n): counts() of the rows to fit on: per language those of the smallest hashes, outside the held-out fold. TRAIN_ROWS
    are shared by the languages, of which each has LEAST_EACH at least and TRAIN_ROWS_EACH at most."""
    taught = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    labelled = taught.where(F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in taught.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    each = min(TRAIN_ROWS_EACH, max(LEAST_EACH, TRAIN_ROWS // max(1, len(sizes))))
    # 2.5 times the share, as hashes spread; the exact cut comes after, over a number of rows that the bounds hold
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, 2.5 * each / n)))]) if sizes else F.create_map().cast("map<string,double>")
    key = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = labelled.withColumn("_key", key).where(F.col("_key") < F.element_at(share, F.col("lang")))
    ranked = near.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_key", "text")))

    @F.pandas_udf("at array<int>, n array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts(x) for x in texts], columns=["at", "n"])

    return ranked.where(F.col("_n") <= each).select("lang", of("text").alias("c")).select("lang", "c.at", "c.n")


def held_out(doc_id: Column) -> Column:
    """The fold that fitting never reads: crc32 of the id as text, modulo FOLDS, is 0. A null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame) -> Model | None:
    """What comes to the driver is bounded by the rows of sample() and the size of the table, not by the texts' lengths."""
    rows = sorted((r["lang"], r["at"], r["n"]) for r in sample(docs).collect())
    return Model([(np.array(at, np.int64), np.array(n, np.float64)) for _, at, n in rows], [x for x, *_ in rows]) if rows else None


def predict_of(model: Model | None, text: Column) -> Column:
    """struct(lang, score): UNDECIDED with score 0 where the text is null or has no letter, or nothing could be learned."""

    def predicted(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"lang": [UNDECIDED] * len(texts), "score": np.zeros(len(texts))})
        if model is not None:
            own = [i for i, x in enumerate(texts) if has_letter(x)]
            langs, score = model.predict([texts.iloc[i] for i in own])
            out.loc[own, "lang"] = langs
            out.loc[own, "score"] = score
        return out

    @F.pandas_udf("lang string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return tidied(map(predicted, batches))

    # so named, a filter on the result stays behind it; else it would be predicted once for the filter and again for the rest
    return of.asNondeterministic()(text)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row.

    Null and letterless texts are `und` with score 0, an empty or unlabelled table teaches nothing and gives `und` throughout; equal
    texts get equal predictions; labels, sources and ids are never inputs of a prediction; other columns are not read.
    """
    own = small_batches(docs).select("doc_id", "text", "lang")
    found = own.select("doc_id", predict_of(fit(own), F.col("text")).alias("p"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


#: Confidence under which language_filter() rejects.
LEAST_SCORE = 0.2


def language_filter(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose language is recognised with at least that confidence, lang set to the prediction; the others go.

    Null, empty and letterless texts go; of a table that teaches nothing, and of an empty one, no row stays; texts of any length are read
    whole; repeated rows are kept or go together; all columns stay, whatever their names.
    """
    row = small_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), predict_of(fit(docs.select("doc_id", "text", "lang")), F.col("text")).alias("p"))
    kept = row.where((F.col("p.lang") != UNDECIDED) & (F.col("p.score") >= least))
    return kept.select(*[(F.col("p.lang") if c == "lang" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
