"""Quality rules with an isolation forest over their statistics.

``rule_statistics`` counts, per text, what the usual page rules look at. An
isolation forest is grown on those statistics of one half of a bounded sample of
labelled rows; its path lengths give each text an anomaly score, and the score
from which texts are rejected is calibrated on the other half so that at most
``max_false_rejects`` of its rows labelled good are lost.

Edge cases: a null or blank text has no words and fails the base rule; a text
of any length is read whole; equal rows get equal verdicts, row by row, so
repeated or null ids do not matter; an empty table gives an empty result; other
columns pass through, and statistics live in one struct column ``quality_rules``
that replaces a column of that name. Without labelled rows nothing is rejected
beyond the base rule.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tarnlight.llm import kernels as K
from tarnlight.llm.similarity import free_name

#: Rows with a label, lowest hashes first, from which forest and threshold are fitted.
SAMPLE_ROWS = 20_000
TREES = 100
#: Rows that grow one tree, and the share of rows labelled bad among them: anomalies are found as long as they are few.
TREE_ROWS = 256
BAD_SHARE = 0.02
#: A statistic takes part if it ranks a bad row above a good one in this share of pairs.
LEAST_AUC = 0.6
MAX_FALSE_REJECTS = 0.002

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def count_rules(texts: pa.Array) -> dict[str, np.ndarray]:
    """The columns COUNTS for each text."""
    out = {name: np.zeros(len(texts), np.int64) for name in COUNTS}
    for lo, hi, data, at in K.text_slices(texts):
        n = hi - lo
        starts, ends, rows = K.spans(data, at, K.BLANK)
        out["n_words"][lo:hi] = K.row_counts(rows, n)
        out["word_chars"][lo:hi] = K.bytes_per_row(~K.BLANK[data] & ((data & 0xC0) != 0x80), at)
        out["n_symbols"][lo:hi] = K.bytes_per_row(_SYMBOL[data], at)
        if not len(starts):
            continue
        lines, line_ends, line_rows = K.spans(data, at, _NEWLINE)
        worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, lines)
        lines, line_ends, line_rows = lines[worded], line_ends[worded], line_rows[worded]
        later, _ = K.repeated(line_rows, K.span_hashes(data, lines, line_ends))
        out["n_lines"][lo:hi] = K.row_counts(line_rows, n)
        out["n_dup_lines"][lo:hi] = K.row_counts(line_rows[later], n)
        h, first = K.windows(K.span_hashes(data, starts, ends), rows, 5)
        _, twice = K.repeated(rows[first], h)
        covered = np.zeros(len(starts) + 1, np.int64)
        np.add.at(covered, first[twice], 1)
        np.add.at(covered, first[twice] + 5, -1)
        out["n_repeat_words"][lo:hi] = K.row_counts(rows[np.cumsum(covered)[:-1] > 0], n)
    return out


_STATS = T.StructType([T.StructField(c, T.LongType(), False) for c in COUNTS])


def _struct(columns: dict[str, np.ndarray]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(v) for v in columns.values()], list(columns))


@F.arrow_udf(_STATS)
def rule_statistics(text: pa.Array) -> pa.Array:
    return _struct(count_rules(text))


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios that do not depend on a text's length; those of short texts lean to a plain text's."""
    words = np.asarray(stats["n_words"], float) + 10
    return np.column_stack([
        (np.asarray(stats["word_chars"]) + 10 * 5) / words,
        np.asarray(stats["n_symbols"]) / words,
        np.asarray(stats["n_dup_lines"]) / np.maximum(np.asarray(stats["n_lines"], float), 1),
        np.asarray(stats["n_repeat_words"]) / words,
    ])


def telling_features(x: np.ndarray, good: np.ndarray, least: float = LEAST_AUC) -> np.ndarray:
    """Columns whose distance from the good rows' median ranks bad rows above good ones; all, without both labels.

    A statistic that varies as much among good rows would only add short paths to them.
    """
    if good.all() or not good.any():
        return np.arange(x.shape[1])
    off = pd.DataFrame(np.abs(x - np.median(x[good], 0))).rank().to_numpy()
    n_bad, n_good = (~good).sum(), good.sum()
    auc = (off[~good].sum(0) - n_bad * (n_bad + 1) / 2) / (n_bad * n_good)
    return np.flatnonzero(auc >= least) if (auc >= least).any() else np.arange(x.shape[1])


def _mean_depth(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    many = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees as arrays: feature (-1 at a leaf), cut, the left child (the right one follows), depth at a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    rows: int
    limit: int

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7) -> IsolationForest:
        rng = np.random.default_rng(seed)
        usual, odd = (np.flatnonzero(good), np.flatnonzero(~good)) if good.any() else (np.arange(len(x)), np.empty(0, int))
        n_odd = min(len(odd), max(1, round(BAD_SHARE * rows)))
        n_usual = min(len(usual), rows - n_odd)
        limit = max(1, int(np.ceil(np.log2(max(n_usual + n_odd, 2)))))
        draw = lambda: np.append(rng.choice(usual, n_usual, replace=False), rng.choice(odd, n_odd, replace=False) if n_odd else odd)
        return cls([cls._grow(x[draw()], rng, limit) for _ in range(trees)], n_usual + n_odd, limit)

    @staticmethod
    def _grow(x: np.ndarray, rng: np.random.Generator, limit: int):
        nodes = [[-1, 0.0, 0, 0.0]]
        todo = [(0, x, 0)]
        while todo:
            at, own, depth = todo.pop()
            low, high = own.min(0), own.max(0)
            varies = np.flatnonzero(high > low)
            if depth >= limit or len(own) <= 1 or not len(varies):
                nodes[at][3] = depth + float(_mean_depth(len(own)))
                continue
            f = int(rng.choice(varies))
            cut = rng.uniform(low[f], high[f])
            nodes[at][:3] = [f, cut, len(nodes)]
            left = own[:, f] <= cut
            todo += [(len(nodes), own[left], depth + 1), (len(nodes) + 1, own[~left], depth + 1)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        f, cut, child, depth = zip(*nodes, strict=True)
        return np.array(f), np.array(cut), np.array(child), np.array(depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected length): near 1 for anomalies, under 0.5 for the usual."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for f, cut, child, depth in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.limit):
                split = f[at]
                inner = split >= 0
                at = np.where(inner, child[at] + (x[every, np.maximum(split, 0)] > cut[at]), at)
            total += depth[at]
        return 2.0 ** (-(total / len(self.trees)) / max(float(_mean_depth(self.rows)), 1e-9))


@dataclass
class QualityModel:
    forest: IsolationForest | None
    columns: np.ndarray
    threshold: float

    def score(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        if self.forest is None:
            return np.zeros(len(np.asarray(stats["n_words"])))
        return self.forest.score(features(stats)[:, self.columns])


def base_failed(words, repeats):
    """The fixed rule, for columns or arrays."""
    return (words < 10) | (repeats * 100 > words * 20)


def calibrate(scores: np.ndarray, good: np.ndarray, max_false_rejects: float = MAX_FALSE_REJECTS) -> float:
    """The score from which rows are rejected: best separation among cuts that lose few good rows.

    It lies halfway to the next lower score, so that unseen rows like the rejected ones are rejected too.
    """
    values = np.unique(scores)
    cuts = np.append((values[1:] + values[:-1]) / 2, values[-1] + 1e-9) if len(values) else np.array([2.0])
    good_scores, bad_scores = np.sort(scores[good]), np.sort(scores[~good])
    if not len(good_scores) or not len(bad_scores):
        return 2.0
    lost = 1 - np.searchsorted(good_scores, cuts) / len(good_scores)
    caught = 1 - np.searchsorted(bad_scores, cuts) / len(bad_scores)
    allowed = lost <= max_false_rejects
    if not allowed.any():
        return 2.0
    gain = np.where(allowed, caught - lost, -1.0)
    return float(cuts[np.flatnonzero(gain == gain.max())[-1]])


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """labels: doc_id and quality (1 good, 0 bad); at most ``sample_rows`` of them, by hash, are used."""
    sample = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most sample_rows rows of two numbers
        .select("doc_id", "good", rule_statistics("text").alias("s")).select("doc_id", "good", "s.*")
        .orderBy("doc_id", *COUNTS).limit(4 * sample_rows).toPandas()
    )
    stats = {c: rows[c].to_numpy() for c in COUNTS}
    usable = ~base_failed(stats["n_words"], stats["n_repeat_words"]) if len(rows) else np.zeros(0, bool)
    if usable.sum() < 2:
        return QualityModel(None, np.arange(0), 2.0)
    x = features({c: v[usable] for c, v in stats.items()})
    good = rows["good"].to_numpy()[usable] > 0
    grown = np.arange(len(x)) % 2 == 0  # rows are in the order of their ids, which says nothing of them
    if not (good[~grown].any() and (~good[~grown]).any()):
        grown = np.ones(len(x), bool)
    columns = telling_features(x[grown], good[grown])
    forest = IsolationForest.fit(x[grown][:, columns], good[grown])
    held = ~grown if (~grown).any() else grown
    return QualityModel(forest, columns, calibrate(forest.score(x[held][:, columns]), good[held]))


def quality_rules(docs: DataFrame, model: QualityModel) -> DataFrame:
    """All rows and columns of docs, with a struct ``quality_rules``: COUNTS, base_failed, score, kept."""

    @F.arrow_udf(T.StructType([*_STATS.fields, T.StructField("score", T.DoubleType(), False)]))
    def judged(text: pa.Array) -> pa.Array:
        """Counts and score in one function, so a task needs one Python worker."""
        counts = count_rules(text)
        return _struct(counts | {"score": model.score(counts)})

    s = free_name(docs, "__rules")
    failed = base_failed(F.col(f"{s}.n_words"), F.col(f"{s}.n_repeat_words"))
    return docs.withColumn(s, judged("text")).withColumn("quality_rules", F.struct(
        *(f"{s}.{c}" for c in COUNTS), failed.alias("base_failed"), f"{s}.score", (~failed & (F.col(f"{s}.score") < model.threshold)).alias("kept"),
    )).drop(s)


def drop_rejected(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of docs that the base rule and the forest keep, all columns as they are."""
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))
    return quality_rules(rows, model).where("quality_rules.kept").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules(docs.select("doc_id", "text"), model).select(
        "doc_id", *(f"quality_rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")),
    )
