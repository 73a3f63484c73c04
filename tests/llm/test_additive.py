import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tarnlight.llm.additive import FEATURES, AdditiveModel, fit_additive, op13, quality_scores, text_features

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    chars, n = max(sum(map(len, words)), 1), max(len(words), 1)
    low = [w.translate({k: k + 32 for k in range(65, 91)}) for w in words]
    share = lambda s, of: sum(c in s for c in text) / of
    lines = max(sum(bool(WORD.search(x)) for x in text.split("\n")), 1)
    letters = max(sum(c.isascii() and c.isalpha() for c in text), 1)
    return {
        "words": len(words), "word_length": sum(map(len, words)) / n, "symbols": share("#*$%&|<>", n), "stutter": sum(a == b for a, b in zip(low[1:], low[:-1], strict=True)) / n if low else 0,
        "capitals": sum(c.isascii() and c.isupper() for c in text) / letters, "exclamations": share("!", n), "digits": share("0123456789", chars), "punctuation": share(".,;:'\"()-?/", chars),
        "line_words": len(words) / lines, "distinct": len(set(low)) / n, "single_letters": sum(len(w.encode()) == 1 for w in words) / n,
        "foreign": sum(ord(c) > 127 for c in text) / chars, "ended": sum(w[-1] in ".!?" for w in words) / n,
    }


def test_features(spark, words):
    texts = [w[1] for w in words] + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + ["Ab ab! | 12 #\n\nwhat? é"]
    got = text_features(pa.array(texts, pa.string()))
    for row, text in zip(got, texts, strict=True):
        for name, value in brute(text).items():
            assert row[FEATURES.index(name)] == pytest.approx(value), (name, text)


def test_tables_and_pairs_learn():
    """One feature by steps, and two that only tell together."""
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    good = np.where(x[:, 0] < 0.3, True, (x[:, 1] < 0.5) == (x[:, 2] < 0.5))
    model = AdditiveModel.fit(x[:3000], good[:3000])
    assert (1, 2) in model.pairs
    assert np.mean((model.score(x[3000:]) >= 0.5) == good[3000:]) > 0.95


def test_scores_are_probabilities():
    rng = np.random.default_rng(2)
    x = rng.random((6000, 2))
    good = rng.random(6000) < x[:, 0]
    p = AdditiveModel.fit(x[:4000], good[:4000]).score(x[4000:])
    for a in (0.1, 0.3, 0.5, 0.7):
        near = (p >= a) & (p < a + 0.2)
        assert abs(good[4000:][near].mean() - p[near].mean()) < 0.07


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    rows = op13(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = (np.array([r.score for r in held if r.quality == q]) for q in (1, 0))
    assert len(bad) > 100 and (good >= 0.3).mean() >= 0.99 and (bad < 0.3).mean() >= 0.97
    assert (good[:, None] > bad[None]).mean() >= 0.999


def test_held_out_labels_are_not_learned(spark):
    """Labels of held-out rows may say what they like."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    from tarnlight.llm.additive import held_out

    lied = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = (sorted((r.doc_id, r.score) for r in quality_scores(docs, fit_additive(docs, t.where(~held_out()))).select("doc_id", "score").collect()) for t in (labels, lied))
    assert one == other


def test_edges(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    model = fit_additive(docs, empty)
    assert [r.score for r in quality_scores(docs.withColumnRenamed("lang", "words"), model).collect()] == [0.5] * docs.count()
    assert quality_scores(none, model).collect() == [] and fit_additive(none, empty).tables == []
    one_kind = spark.createDataFrame([(5, 1), (6, 1), (7, None), (None, 0)], "doc_id long, quality int")
    assert {round(r.score, 6) for r in quality_scores(docs, fit_additive(docs, one_kind)).collect()} == {0.75}
    both = spark.createDataFrame([(5, 1), (5, 0), (6, 1), (9, 0)], "doc_id long, quality int")
    scored = quality_scores(docs.union(docs), fit_additive(docs, both)).collect()
    assert len(scored) == 2 * docs.count() and len({(r.text, r.score) for r in scored}) == len({r.text for r in scored})
