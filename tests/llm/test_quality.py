import re
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import DATA

from tarnlight.llm.quality import COUNTS, count_rules, drop_rejected, fit_quality, op2, quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words, lines = WORD.findall(text), text.split("\n")
    seen, dup = set(), 0
    for line in lines:
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = Counter(windows)
    held = {j for i, w in enumerate(windows) if twice[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(bool(WORD.search(x)) for x in lines), len(held)


def test_counts(spark, words):
    texts = [w[1] for w in words] + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + ["a\na\n\n a\n#a|b\n#a|b"]
    got = count_rules(pa.array(texts, pa.string()))
    assert list(zip(*(got[c].tolist() for c in COUNTS), strict=True)) == [brute(t) for t in texts]


def test_rejects_labelled_junk(spark):
    rows = {r.doc_id: r for r in op2(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    passing = [k for k in labels if not rows[k].base_failed]
    assert np.mean([rows[k].kept for k in passing if labels[k] == 1]) >= 0.99
    assert np.mean([not rows[k].kept for k in passing if labels[k] == 0]) >= 0.9


def test_edges(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    out = quality_rules(docs.withColumnRenamed("lang", "quality_rules"), model)
    assert out.count() == docs.count() and quality_rules(none, model).count() == 0
    assert all(r.quality_rules.kept != r.quality_rules.base_failed for r in quality_rules(docs, model).collect())


def test_lines_that_a_polynomial_confuses():
    lines = ["".join("ab"[(k.bit_count() + flip) % 2] for k in range(1024)) for flip in (0, 1)]
    assert count_rules(pa.array(["\n".join(lines)]))["n_dup_lines"][0] == 0
    assert count_rules(pa.array(["\n".join([*lines, lines[0]])]))["n_dup_lines"][0] == 1


def test_held_out(spark):
    """Fitted on the labels of three quarters of the rows, told on the rest."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = fit_quality(docs, labels.where("doc_id % 4 <> 0"))
    rows = quality_rules(docs.where("doc_id % 4 = 0"), model).join(labels, "doc_id").where("not quality_rules.base_failed").select("quality", "quality_rules.kept").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert len(bad) > 50 and np.mean(good) >= 0.99 and np.mean(bad) <= 0.15


def test_repeats_and_clashing_columns(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    clash = docs.union(docs).withColumnRenamed("lang", "quality_rules").withColumnRenamed("source", "__rules")
    model = fit_quality(clash, labels)
    out = drop_rejected(clash, model)
    assert out.columns == clash.columns and {r.quality_rules for r in out.collect()} <= {"en"}
    assert sorted(map(str, out.collect())) == sorted(2 * [str(r) for r in drop_rejected(clash.limit(docs.count()), model).collect()])
    assert drop_rejected(none, model).count() == 0
