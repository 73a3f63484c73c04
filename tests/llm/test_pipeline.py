import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from conftest import DATA  # noqa: E402
from test_jaccard import brute  # noqa: E402
from test_quality import brute as rules  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tarnlight.llm.quality import COUNTS, fit_quality  # noqa: E402
from tarnlight.llm.vocabulary import tokenizer_file  # noqa: E402


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = fit_quality(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    good = {}
    for k, r in rows.items():
        stats = dict(zip(COUNTS, rules(r.text), strict=True))
        failed = stats["n_words"] < 10 or 100 * stats["n_repeat_words"] > 20 * stats["n_words"]
        if not failed and model.score({c: np.array([v]) for c, v in stats.items()})[0] < model.threshold:
            good[k] = r
    one = pipeline.quality(spark, docs, DATA)
    assert {r.doc_id for r in one.collect()} == set(good) and one.columns == docs.columns

    two = pipeline.near_duplicates(spark, one, DATA)
    parts = brute([(k, r.text) for k, r in good.items()])
    firsts = {k for k, (_, c) in parts.items() if c == k}
    assert {r.doc_id for r in two.collect()} == firsts and two.columns == docs.columns

    three = pipeline.decontaminate(spark, two, DATA)
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    held = {k for k in firsts if any(i in " ".join(rows[k].text.lower().split()) for i in items)}
    kept = {r.doc_id for r in three.collect()}
    assert not kept & held and len(firsts - held - kept) <= 2

    four = pipeline.mix(spark, three, DATA)
    mixed = four.collect()
    assert four.columns == docs.columns and {r.doc_id for r in mixed} <= kept
    assert max(sum(r.doc_id == k for r in mixed) for k in kept) <= 2
    whole = Tokenizer.from_file(tokenizer_file())
    five = pipeline.tokens(spark, spark.createDataFrame(mixed, docs.schema), DATA)
    ends = {r.start + r.n_tokens for r in five.collect()}
    assert max(ends) == sum(len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)


def test_run(spark):
    assert [n for n, _ in pipeline.STAGES] and pipeline.run(spark, DATA).count() > 0


def test_repeated_rows(docs, spark):
    twice = docs.union(docs)
    kept = pipeline.near_duplicates(spark, twice, DATA).where("doc_id in (5, 8)").collect()
    assert sorted(r.doc_id for r in kept) == [5, 8]
