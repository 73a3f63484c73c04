"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest.

The rows that a rule decides are the labelled ones. Trees are fitted on the
driver from at most SAMPLE_ROWS of them (lowest hashes first; a row is a dozen
numbers) and become CASE expressions, so scoring is part of the scan. Suffix
statistics are counts over all pages, joined back by the host's suffix; a labelled
row's suffix rate leaves out the labels of its own fold, so no row is told its label.

Edge cases: a null url, or one without "://", has an empty host and path, fits
no rule and is judged by the trees; rows are independent, so ties, repeats and
null ids do not matter; where no row is labelled the verdict is allow; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
SAMPLE_ROWS = 20_000
TREES = 30
DEPTH = 3
RATE = 0.2
#: Rows labelled that a suffix's rate leans on, of the overall rate.
PRIOR_ROWS = 20
FOLDS = 5
FEATURES = ("length", "depth", "digit_ratio", "entropy", "params", "labels", "hyphens", "fragment", "suffix_share", "suffix_rate")


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, lower)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and rule_verdict (null where no rule fits); the longest rule wins."""
    host, path = parsed(F.col("url"))
    rows = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)) & F.col("path").startswith(rule_path)
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _entropy(text: Column) -> Column:
    """Bits a character."""
    letters = F.split(text, "")
    letters = F.filter(letters, lambda c: c != "")
    n = F.greatest(F.size(letters), F.lit(1)).cast("double")
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def lexical(rows: DataFrame) -> DataFrame:
    """Adds FEATURES to rows with host, path and rule_verdict."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda what, c: (F.length(what) - F.length(F.replace(what, F.lit(c), F.lit("")))).cast("double")
    rows = rows.withColumns({
        "length": F.length(url).cast("double"),
        "depth": count(F.col("path"), "/"),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / n,
        "entropy": _entropy(F.col("host")),
        "params": count(query, "="),
        "labels": count(F.col("host"), "."),
        "hyphens": count(F.col("host"), "-"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "suffix": F.regexp_extract("host", r"[^.]*\.?[^.]*$", 0),
    })
    block = F.when(F.col("rule_verdict") == "block", 1).otherwise(0)
    rows = rows.withColumn("fold", F.when(F.col("rule_verdict").isNotNull(), F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")))
    in_fold = lambda c, k: F.sum(F.when(F.col("fold") == k, c).otherwise(0))
    per = rows.groupBy("suffix").agg(
        F.count("*").alias("k"), F.sum(block).alias("bad"), F.count("rule_verdict").alias("told"),
        F.array(*(in_fold(block, k) for k in range(FOLDS))).alias("bad_in"), F.array(*(in_fold(F.lit(1), k) for k in range(FOLDS))).alias("told_in"),
    )
    whole = rows.agg(F.count("*").alias("all"), (F.sum(block) / F.greatest(F.count("rule_verdict"), F.lit(1))).alias("rate"))
    stats = per.join(F.broadcast(whole)).select("suffix", (F.col("k") / F.col("all")).alias("suffix_share"), "bad", "told", "bad_in", "told_in", F.coalesce("rate", F.lit(0.0)).alias("rate"))  # one row
    own = lambda c: F.coalesce(F.element_at(c, F.col("fold") + 1), F.lit(0))
    rate = (F.col("bad") - own("bad_in") + PRIOR_ROWS * F.col("rate")) / (F.col("told") - own("told_in") + PRIOR_ROWS)
    return rows.join(stats, "suffix").withColumn("suffix_rate", rate).drop("suffix", "fold", "bad", "told", "bad_in", "told_in", "rate")


@dataclass
class Node:
    value: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.low.predict(x), self.high.predict(x))

    def column(self, names: tuple[str, ...]) -> Column:
        if self.feature < 0:
            return F.lit(float(self.value))
        return F.when(F.col(names[self.feature]) <= self.cut, self.low.column(names)).otherwise(self.high.column(names))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int) -> Node:
    """A regression tree on second-order gains; cuts lie between values at up to 32 quantiles."""
    leaf = Node(RATE * grad.sum() / (hess.sum() + 1.0))
    if depth == 0 or len(x) < 10:
        return leaf
    best, base = 1e-6, grad.sum() ** 2 / (hess.sum() + 1.0)
    for f in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33), method="lower"))
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            if 5 <= low.sum() <= len(x) - 5:
                g, h = grad[low].sum(), hess[low].sum()
                gain = g * g / (h + 1.0) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1.0) - base
                if gain > best:
                    best, leaf.feature, leaf.cut = gain, f, float(cut)
    if leaf.feature >= 0:
        low = x[:, leaf.feature] <= leaf.cut
        leaf.low, leaf.high = (_grow(x[s], grad[s], hess[s], depth - 1) for s in (low, ~low))
    return leaf


@dataclass
class BoostedTrees:
    start: float
    trees: list[Node]

    @classmethod
    def fit(cls, x: np.ndarray, blocked: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> BoostedTrees:
        if not len(x):
            return cls(-1.0, [])
        share = np.clip(blocked.mean(), 0.01, 0.99)
        model, score = cls(float(np.log(share / (1 - share))), []), np.full(len(x), np.log(share / (1 - share)))
        for _ in range(trees if 0 < blocked.sum() < len(x) else 0):
            p = 1 / (1 + np.exp(-score))
            model.trees.append(_grow(x, blocked - p, p * (1 - p), depth))
            score = score + model.trees[-1].predict(x)
        return model

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log odds of block."""
        return sum((t.predict(x) for t in self.trees), np.full(len(x), self.start))

    def column(self, names: tuple[str, ...] = FEATURES) -> Column:
        return reduce(lambda a, t: a + t.column(names), self.trees, F.lit(self.start))


def fit_urls(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> BoostedTrees:
    """rows: as lexical() gives them; those with a rule_verdict are learnt from."""
    order = F.xxhash64("url")
    told = rows.where("rule_verdict is not null").select(order.alias("o"), "url", (F.col("rule_verdict") == "block").cast("double").alias("blocked"), *FEATURES)
    got = told.orderBy("o", "url").limit(sample_rows).collect()
    x = np.array([[r[f] for f in FEATURES] for r in got], float).reshape(len(got), len(FEATURES))
    return BoostedTrees.fit(x, np.array([r["blocked"] for r in got]))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of block by the trees)."""
    rows = lexical(ruled(pages.select("page_id", "url"), rules))
    score = fit_urls(rows).column()
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return rows.withColumn("score", score).select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("score", 6).alias("score"))


def op7(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
