import time
from collections import Counter, defaultdict

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tarnlight.llm import mixing as M
from tarnlight.llm.mixing import Mix, mixed_documents, permuted

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes):
    """By hand: excess over twice a source's size is shared again until none is left."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_targets_and_takes(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    mix = Mix(docs)
    rows = mix.taken().join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert len(rows) == docs.count() and target == pytest.approx(targets(sizes))
    assert all(abs(taken[s] - target[s]) <= 64 + 0.02 * target[s] for s in taken)
    again = Mix(docs).taken()
    assert again.exceptAll(mix.taken()).count() == 0
    places = mix.slots.select("shard", "place")
    assert places.distinct().count() == places.count() == mix.sources.agg(F.sum("draws")).first()[0]


def test_taken_by_hand(spark):
    """What every document gives, recounted word by word from the slots of the shards."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    mix = Mix(docs, 8)
    times = Counter((r.s, r.block) for r in mix.slots.collect())
    want = Counter()
    for r in mix.rows.collect():
        want[r.doc_id] += sum(times[r.s, w // 8] for w in range(r.start, r.start + r.size))
    assert {r.doc_id: r.taken for r in mix.taken().collect()} == dict(want)


def test_shards(spark, monkeypatch):
    """Shards are full, sources get their number, and the counts of a shard scatter as a multinomial's do."""
    monkeypatch.setattr(M, "SHARD_SLOTS", 64)
    mix = Mix(spark.read.parquet(f"{DATA}/documents.parquet"), 16)
    counts = mix.counts.collect()
    per_shard, per_source = Counter(), Counter()
    for r in counts:
        per_shard[r.shard] += r.n
        per_source[r.s] += r.n
    full = {k: n for k, n in per_shard.items() if k != max(per_shard)}
    assert set(full.values()) == {64} and 0 < per_shard[max(per_shard)] <= 64
    draws = {r.s: r.draws for r in mix.sources.collect()}
    assert dict(per_source) == {s: n for s, n in draws.items() if n}
    got = Counter({(r.shard, r.s): r.n for r in counts})
    total, chi, cells = sum(draws.values()), 0.0, 0
    for s, n in draws.items():
        mean = 64 * n / total
        if mean >= 3:
            chi += sum((got[k, s] - mean) ** 2 / (mean * (1 - n / total)) for k in full)
            cells += len(full)
    assert cells and 0.8 < chi / cells < 1.2
    assert "shard" in mix.slots.columns and mix.slots.groupBy("shard").count().where("count > 64").isEmpty()


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3))).collect()]
        assert sorted(got) == list(range(n))


def test_mixed_documents(docs, none):
    out = mixed_documents(docs, 8)
    assert out.columns == docs.columns and mixed_documents(none, 8).count() == 0
    whole = Mix(docs.dropDuplicates(["doc_id", "source", "text"]), 8).taken().agg(F.sum("taken")).first()[0]
    assert out.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] == whole


def test_repeated_rows_and_clashing_columns(docs):
    twice = docs.union(docs).withColumn("__key", F.lit(1)).withColumn("__runs", F.lit("x")).withColumn("s", F.lit(2)).withColumn("shard", F.lit(3))
    out = mixed_documents(twice, 8)
    assert out.columns == twice.columns
    once = mixed_documents(docs.dropDuplicates(["doc_id", "source", "text"]), 8)
    assert sorted(map(str, out.select(docs.columns).collect())) == sorted(map(str, once.collect()))
    assert Mix(twice).taken().count() == 2 * docs.count()


def test_edges(docs, none):
    got = Mix(docs).taken()
    assert got.count() == docs.count() and {r.taken for r in got.where("size = 0").collect()} == {0}
    assert Mix(none).taken().count() == 0


def test_places_follow_the_draws(spark, monkeypatch):
    """places are the slots of the shards, hash by hash; another draw moves them and leaves what is taken of each source."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    monkeypatch.setattr(M, "SHARD_SLOTS", 64, raising=False)
    mix = Mix(docs, 8)
    at = defaultdict(int)
    for r in mix.slots.select("s", "block", F.xxhash64("shard", "place").alias("h")).collect():
        at[r.s, r.block] ^= r.h
    want = {r.doc_id: 0 for r in mix.rows.collect()}
    for r in mix.rows.collect():
        for block in range(r.start // 8, -(-(r.start + r.size) // 8) if r.size else 0):
            want[r.doc_id] ^= at.get((r.s, block), 0)
    first = {r.doc_id: r for r in mix.taken().collect()}
    assert {k: r.places for k, r in first.items()} == want
    monkeypatch.setattr(M, "SEED", M.SEED + 1)
    other = {r.doc_id: r for r in Mix(docs, 8).taken().collect()}
    assert sum(other[k].places != r.places for k, r in first.items()) > len(first) / 2
    assert sum(r.taken for r in other.values()) == pytest.approx(sum(r.taken for r in first.values()), rel=0.02)


def test_many_runs_of_a_long_text(spark):
    """A text is cut into words once, not for each of its thousands of runs."""
    words = [f"w{k}" for k in range(24_000)]
    docs = spark.createDataFrame([(1, " ".join(words), "a"), (2, "x " * 24_000, "b")], "doc_id long, text string, source string")
    began = time.monotonic()
    rows = mixed_documents(docs, 4).where("doc_id = 1").collect()
    assert time.monotonic() - began < 60
    assert rows and all(set(r.text.split(" ")) <= set(words) for r in rows)
