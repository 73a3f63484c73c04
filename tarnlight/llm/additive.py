"""Quality classifier: a generalised additive model with pairwise interactions.

``text_features`` describes a text by statistics of its characters, words and lines. Each feature is cut into bins, and
boosting goes round the features: a shallow tree over one feature's bins is fitted to what is left of
the labels and added to that feature's lookup table. Then the pairs of features whose joint cells tell most of the rest
get tables of two dimensions in the same way. A text's score is the sigmoid of the intercept and one number from each table,
so scoring is a binary search a feature and vectorised additions.

The model is fitted from at most ``sample_rows`` rows with a label (those whose ids have the lowest hashes): several
models, each without one fold of the rows, which tells after how many rounds to stop. Their tables are averaged, and scaled so
that what they say of rows they have not seen is a probability. All rows are scored.

Edge cases: null and empty texts have features like any other (no words, all shares zero) and get a score; texts are read
whole; equal texts get equal scores; an id with several labels counts as the lowest; with labels of one kind the score is
their smoothed share, without any 0.5; an empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tarnlight.llm import kernels as K
from tarnlight.llm.quality import count_rules

#: Labelled rows, lowest hashes first, that the model is fitted from.
SAMPLE_ROWS = 20_000
BINS, ROUNDS, PAIR_ROUNDS, PAIRS = 32, 200, 60, 8
RATE, LEAVES, LEAST_WEIGHT, SHRINK = 0.15, 4, 2.0, 1.0
#: Models that are averaged, each without one fold of the sample; rounds without a gain on that fold after which a model stops.
FOLDS, PATIENCE = 5, 15
#: A score from here on means a text of good quality.
THRESHOLD = 0.3
#: Rows with id crc32 mod HELD_ONE_IN = 0 are held out: no label of theirs is learned.
HELD_ONE_IN = 5

FEATURES = (
    "words", "word_length", "symbols", "repeated_lines", "repeated_windows", "stutter", "capitals", "exclamations", "digits",
    "punctuation", "line_words", "distinct", "single_letters", "foreign", "ended",
)


def _set(letters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in letters]] = True
    return table


_UPPER = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ALPHA = _UPPER | _set("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _set("0123456789")
_MARK = _set(".,;:'\"()-?/")
_STOP = _set(".!?")


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    counts = count_rules(texts)
    n_words, n_lines = counts["n_words"].astype(float), counts["n_lines"].astype(float)
    stutter, distinct, single, ended, upper, alpha, bang, digit, mark, foreign = (np.zeros(len(texts)) for _ in range(10))
    for lo, hi, data, at in K.text_slices(texts):
        n = hi - lo
        for out, flags in ((upper, _UPPER[data]), (alpha, _ALPHA[data]), (bang, data == ord("!")), (digit, _DIGIT[data]), (mark, _MARK[data]), (foreign, (data & 0xC0) == 0xC0)):
            out[lo:hi] = K.bytes_per_row(flags, at)
        starts, ends, rows = K.spans(data, at, K.BLANK)
        if not len(starts):
            continue
        h = K.span_hashes(K.LOWER[data], starts, ends)
        again, _ = K.repeated(rows, h)
        distinct[lo:hi] = K.row_counts(rows[~again], n)
        stutter[lo:hi] = K.row_counts(rows[1:][(h[1:] == h[:-1]) & (rows[1:] == rows[:-1])], n)
        single[lo:hi] = K.row_counts(rows[ends - starts == 1], n)
        ended[lo:hi] = K.row_counts(rows[_STOP[data[ends - 1]]], n)
    words, chars = np.maximum(n_words, 1), np.maximum(counts["word_chars"].astype(float), 1)
    return np.column_stack([
        n_words, counts["word_chars"] / words, counts["n_symbols"] / words, counts["n_dup_lines"] / np.maximum(n_lines, 1), counts["n_repeat_words"] / words,
        stutter / words, upper / np.maximum(alpha, 1), bang / words, digit / chars, mark / chars, n_words / np.maximum(n_lines, 1), distinct / words, single / words,
        foreign / chars, ended / words,
    ])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values over the bins of one feature (sums of gradients and weights by bin): the best cuts one after another, up to LEAVES leaves."""
    sum_g, sum_h = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    cuts = [0, len(g)]

    def best(lo: int, hi: int) -> tuple[float, int]:
        at = np.arange(lo + 1, hi)
        left_g, left_h = sum_g[at] - sum_g[lo], sum_h[at] - sum_h[lo]
        all_g, all_h = sum_g[hi] - sum_g[lo], sum_h[hi] - sum_h[lo]
        fit = (left_h >= LEAST_WEIGHT) & (all_h - left_h >= LEAST_WEIGHT)
        if not fit.any():
            return 0.0, -1
        gain = np.where(fit, _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h), 0.0)
        k = int(gain.argmax())
        return float(gain[k]), int(at[k])

    while len(cuts) <= LEAVES:
        gain, cut = max(best(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        if gain <= 1e-9:
            break
        cuts = sorted([*cuts, cut])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (sum_g[b] - sum_g[a]) / (sum_h[b] - sum_h[a] + SHRINK)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of both axes of a grid into four leaves: how much it gains, and the leaf values over the grid."""
    sum_g, sum_h = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a_g, a_h = sum_g[:-1, :-1], sum_h[:-1, :-1]
    quads = [
        (a_g, a_h), (sum_g[:-1, -1:] - a_g, sum_h[:-1, -1:] - a_h), (sum_g[-1:, :-1] - a_g, sum_h[-1:, :-1] - a_h),
        (sum_g[-1, -1] - sum_g[:-1, -1:] - sum_g[-1:, :-1] + a_g, sum_h[-1, -1] - sum_h[:-1, -1:] - sum_h[-1:, :-1] + a_h),
    ]
    if not a_g.size:
        return 0.0, np.zeros_like(g)
    gain = sum(_gain(q, w) for q, w in quads) - _gain(sum_g[-1, -1], sum_h[-1, -1])
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    value = [float(q[i, j] / (w[i, j] + SHRINK)) for q, w in quads]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gain[i, j]), out


@dataclass
class AdditiveModel:
    """edges: bin edges of each feature; tables: a number for each bin; pairs: a grid of numbers for each chosen pair of features."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(self.bins(x), len(x)))

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray, bins: int = BINS) -> AdditiveModel:
        """x: rows of features; good: their labels. The mean of FOLDS models, each stopped by the rows it has not seen, and calibrated on those."""
        y = good.astype(float)
        prior = (y.sum() + 1) / (len(y) + 2)
        intercept = float(np.log(prior / (1 - prior)))
        if not len(y) or y.min() == y.max():
            return cls(intercept)
        cuts = [np.unique(np.quantile(c, np.arange(1, bins) / bins, method="inverted_cdf")) for c in x.T]
        # A feature that is mostly zero has its few other values in bins of their own as well.
        tails = [np.unique(np.quantile(c[c > 0], np.arange(0, 8) / 8, method="inverted_cdf")) if (c > 0).any() else np.empty(0) for c in x.T]
        empty = cls(intercept, [np.unique(np.append(a, b)) for a, b in zip(cuts, tails, strict=True)])
        at, fold = empty.bins(x), np.empty(len(y), int)
        for label in (0.0, 1.0):  # each fold has its share of both
            fold[y == label] = np.arange((y == label).sum()) % FOLDS
        models, unseen = [], np.full(len(y), intercept)
        for k in range(FOLDS):
            models.append(_boosted(empty, at, y, fold == k))
            unseen[fold == k] = models[-1].raw(at, len(y))[fold == k]
        scale, shift = _calibration(unseen, y)
        chosen = sorted({pair for m in models for pair in m.pairs})
        mean = lambda grids: scale * sum(grids) / FOLDS
        return cls(
            scale * intercept + shift, empty.edges, [mean(m.tables[k] for m in models) for k in range(len(empty.edges))],
            {pair: mean(m.pairs.get(pair, 0.0) for m in models) for pair in chosen},
        )

    def copy(self) -> AdditiveModel:
        return AdditiveModel(self.intercept, self.edges, [t.copy() for t in self.tables], {k: v.copy() for k, v in self.pairs.items()})

    def raw(self, at: list[np.ndarray], n: int) -> np.ndarray:
        total = np.full(n, self.intercept)
        for k, table in enumerate(self.tables):
            total += table[at[k]]
        for (a, b), grid in self.pairs.items():
            total += grid[at[a], at[b]]
        return total


def _boosted(empty: AdditiveModel, at: list[np.ndarray], y: np.ndarray, stop: np.ndarray) -> AdditiveModel:
    """A model boosted on the rows outside ``stop``, as of the round that told the rows of ``stop`` best."""
    model = AdditiveModel(empty.intercept, empty.edges, [np.zeros(len(e) + 1) for e in empty.edges])
    raw = np.full(len(y), empty.intercept)
    grow = ~stop

    def sums(index: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(raw[grow])
        return np.bincount(index[grow], y[grow] - p, size), np.bincount(index[grow], p * (1 - p), size)

    def grid_sums(pair: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        shape = tuple(len(model.tables[k]) for k in pair)
        g, h = sums(at[pair[0]] * shape[1] + at[pair[1]], shape[0] * shape[1])
        return g.reshape(shape), h.reshape(shape)

    def round_of_features() -> None:
        for k, table in enumerate(model.tables):
            step = RATE * _shallow_tree(*sums(at[k], len(table)))
            table += step
            raw[:] += step[at[k]]

    def round_of_pairs() -> None:
        for pair, grid in model.pairs.items():
            step = RATE * _cross(*grid_sums(pair))[1]
            grid += step
            raw[:] += step[at[pair[0]], at[pair[1]]]

    def loss() -> float:
        p = np.clip(_sigmoid(raw[stop]), 1e-12, 1 - 1e-12)
        return float(-(y[stop] * np.log(p) + (1 - y[stop]) * np.log(1 - p)).mean()) if stop.any() else 0.0

    def boost(one_round, rounds: int) -> None:
        kept, least, since = model.copy(), loss(), 0
        for _ in range(rounds):
            one_round()
            now = loss()
            if now < least - 1e-7:
                kept, least, since = model.copy(), now, 0
            else:
                since += 1
                if since >= PATIENCE:
                    break
        model.tables, model.pairs = kept.tables, kept.pairs
        raw[:] = model.raw(at, len(y))

    boost(round_of_features, ROUNDS)
    every = [(a, b) for a in range(len(at)) for b in range(a + 1, len(at))]
    ranked = sorted(every, key=lambda pair: -_cross(*grid_sums(pair))[0])
    model.pairs = {(a, b): np.zeros((len(model.tables[a]), len(model.tables[b]))) for a, b in ranked[:PAIRS]}
    boost(round_of_pairs, PAIR_ROUNDS)
    return model


def _calibration(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make the sigmoid of raw sums of unseen rows a probability; labels count a little less than sure."""
    good = y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    a, b = 1.0, 0.0
    cost = lambda a, b: float((np.logaddexp(0, a * raw + b) - target * (a * raw + b)).sum())
    for _ in range(100):
        p = _sigmoid(a * raw + b)
        g, w = p - target, p * (1 - p)
        slope = np.array([(g * raw).sum(), g.sum()])
        bend = np.array([[(w * raw * raw).sum(), (w * raw).sum()], [(w * raw).sum(), w.sum()]]) + 1e-9 * np.eye(2)
        step, size, now = np.linalg.solve(bend, slope), 1.0, cost(a, b)
        while size > 1e-6 and cost(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-9:
            break
        a, b = a - size * step[0], b - size * step[1]
    return max(a, 1e-3), b


def held_out(key: str = "doc_id") -> Column:
    """Whether no label of a row may be learned; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % HELD_ONE_IN == 0


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features(text: pa.Array) -> pa.Array:
    x = text_features(text)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.reshape(-1)))


def fit_additive(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """docs: doc_id, text; labels: doc_id, quality (1 good, 0 bad). At most ``sample_rows`` rows, of the lowest hashes of their ids, are learned from."""
    order = F.xxhash64("doc_id")
    sample = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good")).orderBy(order, "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most sample_rows rows of two numbers
    rows = rows.select("doc_id", "good", _features("text").alias("x")).orderBy(order, "doc_id", "x").limit(sample_rows).toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if rows.num_rows else np.empty((0, len(FEATURES)))
    return AdditiveModel.fit(x, rows.column("good").to_numpy() > 0)


def quality_scores(docs: DataFrame, model: AdditiveModel, text: str = "text", name: str = "score") -> DataFrame:
    """docs with ``name``: how likely the text is good, 0 to 1."""
    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(text_features(texts)), pa.float64())

    return docs.withColumn(name, scored(text))


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = quality_scores(docs, fit_additive(docs, labels.where(~held_out())))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
