"""URL filters: explicit host and path rules first, then association rules mined from the pages those rules label.

Every URL is a set of tokens: host labels and their parts, top-level domain, path segments, query names. Labelled pages carry their
verdict as one more item; Spark's FP-growth finds the frequent token sets of four fifths of them, and rules from tokens to a verdict are
kept by support and confidence there, and by confidence again on the last fifth, which mining never saw. Pages without a label take no
part in mining. How many rules there are depends on the support, not on the number of pages; they are matched by an inverted index from
tokens to rules, and the best one that fits decides pages without an explicit rule.

Tokens that the labelled pages always have together are one item, or their subsets would all be frequent; a rule then asks for all of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photarium.llm.common import drop, store

#: (verdict, host, path) of op8's contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
SUPPORT = 0.002
#: Fewest pages a rule rests on, whatever its share.
LEAST_PAGES = 20
CONFIDENCE = 0.9
#: Labelled pages whose URL's crc32 is 0 modulo FOLDS are held out to validate rules.
FOLDS = 5
DEFAULT = "allow"

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
_PART = re.compile(r"[^\W\d_]{2,}|[a-z0-9]*[a-z][a-z0-9]*")


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, HOST, 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. A rule fits its host and all subdomains, if the path starts with its own."""
    fits = [(len(h + p), F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))) for v, h, p in rules]
    return F.coalesce(*[x for _, x in sorted(fits, key=lambda x: -x[0])], F.lit(None).cast("struct<rule:string,verdict:string>"))


def tokens_of_url(url: str | None) -> list[str]:
    """Distinct tokens of one URL, each with its kind."""
    if not url or "://" not in url:
        return []
    scheme, _, rest = url.partition("://")
    front, _, fragment = rest.partition("#")
    front, _, query = front.partition("?")
    host, _, path = front.partition("/")
    labels = [x for x in host.lower().split(".") if x]
    out = {f"scheme:{scheme.lower()}"}
    if labels:
        out.add(f"tld:{labels[-1]}")
    out.update(f"host:{x}" for x in labels[:-1])
    out.update(f"hostword:{x}" for label in labels[:-1] if "-" in label for x in label.split("-") if x)
    out.update(f"path:{x}" for segment in path.lower().split("/") for x in _PART.findall(segment))
    out.update(f"query:{x.partition('=')[0].lower()}" for x in query.split("&") if x)
    if fragment:
        out.add("fragment")
    return sorted(out)


def tokens_of(url: Column) -> Column:
    @F.pandas_udf("array<string>")
    def of(urls: pd.Series) -> pd.Series:
        return pd.Series([tokens_of_url(x) for x in urls], dtype=object)

    return of(url)


Rule = tuple[frozenset, str, float, float]


def merged_tokens(labelled: DataFrame, least: int) -> dict[str, frozenset]:
    """For tokens that at least so many rows of labelled(tokens) have, by one name each: all tokens of the same rows.

    Tokens of the same rows have the same count and the same sums of row hashes (128 bits). What comes to the driver is bounded by the
    support: tokens of an average page / support. Tokens of all rows tell nothing and are left out.
    """
    total = labelled.count()
    rows = labelled.select("tokens", F.xxhash64("tokens").alias("h"), F.xxhash64(F.lit(1), "tokens").alias("g")).select(F.explode("tokens").alias("t"), "h", "g")
    sums = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("h", "g")]
    found = rows.groupBy("t").agg(F.count("*").alias("n"), *sums).where((F.col("n") >= least) & (F.col("n") < total))
    same: dict[tuple, set] = {}
    for r in found.collect():
        same.setdefault((r["n"], r["h"], r["g"]), set()).add(r["t"])
    return {min(x): frozenset(x) for x in same.values()}


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[Rule]:
    """labelled(tokens, verdict, held): rules (tokens, verdict, confidence, support) of the rows that aren't held out, validated on those
    that are; of rules where one implies the other with no less confidence, the one that asks for less."""
    taught = labelled.where("verdict is not null and not held")
    total = taught.count()
    if not total:
        return []
    share = min(1.0, max(support, LEAST_PAGES / total))
    merged = merged_tokens(taught, math.ceil(share * total))
    if not merged:
        return []
    names = F.array(*[F.lit(x) for x in sorted(merged)])
    items = taught.select(F.array_append(F.array_intersect("tokens", names), F.concat(F.lit("verdict:"), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(items)
    found = model.associationRules.where(F.col("consequent")[0].startswith("verdict:") & ~F.exists("antecedent", lambda x: x.startswith("verdict:")))
    rules = [(frozenset().union(*(merged[x] for x in r["antecedent"])), r["consequent"][0].removeprefix("verdict:"), r["confidence"], r["support"]) for r in found.collect()]
    return minimal(validated(labelled.where("verdict is not null and held"), rules, confidence))


def validated(held: DataFrame, rules: list[Rule], confidence: float) -> list[Rule]:
    """The rules that some row of held(tokens, verdict) has, and that keep their confidence there."""
    index = RuleIndex(rules)

    @F.pandas_udf("array<int>")
    def of(tokens: pd.Series) -> pd.Series:
        return pd.Series([index.full(x) for x in tokens], dtype=object)

    hits = held.select("verdict", F.explode(of("tokens")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("allow", "block")])
    good = {r["rule"] for r in hits.collect() if r[index.rules[r["rule"]][1]] >= confidence * r["n"]}
    return [r for k, r in enumerate(index.rules) if k in good]


def minimal(rules: list[Rule]) -> list[Rule]:
    """Without rules that hold more tokens than another one of the same verdict and no less confidence: verdicts stay the same."""
    kept: list[Rule] = []
    for rule in sorted(rules, key=lambda r: (len(r[0]), -r[2], -r[3], sorted(r[0]))):
        if not any(x[1] == rule[1] and x[2] >= rule[2] and x[0] <= rule[0] for x in kept):
            kept.append(rule)
    return kept


class RuleIndex:
    """Inverted index from tokens to the rules that name them."""

    def __init__(self, rules):
        self.rules = sorted(rules, key=lambda r: (-r[2], -r[3], r[1], len(r[0]), sorted(r[0])))
        self.postings = defaultdict(list)
        for k, (tokens, *_) in enumerate(self.rules):
            for token in tokens:
                self.postings[token].append(k)

    def full(self, tokens) -> list[int]:
        """The rules all of whose tokens are there, the best first."""
        hits = Counter(k for t in set(tokens) for k in self.postings.get(t, ()))
        return sorted(k for k, n in hits.items() if n == len(self.rules[k][0]))

    def match(self, tokens: list[str]):
        """The best rule all of whose tokens are there: highest confidence, then support, then block after allow; None without one."""
        full = self.full(tokens)
        return self.rules[full[0]] if full else None


def verdict_of(url: Column, rules) -> Column:
    """struct(verdict, tokens, confidence): DEFAULT with null tokens where no mined rule matches."""
    index = RuleIndex(rules)

    @F.pandas_udf("verdict string, tokens string, confidence double")
    def of(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for url in urls:
            best = index.match(tokens_of_url(url))
            rows.append((best[1], " ".join(sorted(best[0])), best[2]) if best else (DEFAULT, None, None))
        return pd.DataFrame(rows, columns=["verdict", "tokens", "confidence"])

    return of(url)


def judge(pages: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined, confidence) for every row.

    Null URLs and those without :// have empty host and path, fit no rule and get the default verdict; equal URLs get equal verdicts;
    an empty table mines nothing and gives no rows; other columns are not read. mined: the association rule that decided, if one did.
    """
    own = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    held = F.crc32(F.col("url").cast("binary")) % FOLDS == 0
    labelled = store(own.where("r is not null").select(tokens_of(F.col("url")).alias("tokens"), F.col("r.verdict").alias("verdict"), held.alias("held")), "url-labels")
    mined = mine(labelled, support, confidence)
    drop(labelled)
    free = F.col("r").isNull()
    found = own.withColumn("m", verdict_of(F.when(free, F.col("url")), mined))
    return found.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "m.verdict").alias("verdict"),
        F.when(free, F.col("m.tokens")).alias("mined"), F.when(free, F.col("m.confidence")).alias("confidence"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
