import time
import random

import numpy as np
import pytest

from tarnlight.llm import decontamination as D
from tarnlight.llm.decontamination import best_alignment, drop_leaks, find_leaks


def least_edits(pattern, region):
    row = [0] * (len(region) + 1)
    for i, a in enumerate(pattern):
        now = [i + 1]
        for j, b in enumerate(region):
            now.append(min(row[j] + (a != b), row[j + 1] + 1, now[-1] + 1))
        row = now
    return min(row)


def test_alignment():
    r = random.Random(1)
    for _ in range(200):
        pattern = [r.choice(b"abc") for _ in range(r.randint(5, 40))]
        other = [*pattern]
        for _ in range(r.randint(0, 6)):
            i, kind = r.randrange(len(other)), r.random()
            other[i : i + 1] = [] if kind < 0.3 and len(other) > 2 else [r.choice(b"abc")] if kind < 0.6 else [other[i], r.choice(b"abc")]
        region = [100] * 4 + other + [100] * 4
        got, wanted = best_alignment(np.array(pattern, np.uint8), np.array(region, np.uint8), 4), least_edits(pattern, region)
        assert (got[0] if got else None) == (wanted if wanted <= 4 else None)


@pytest.fixture
def bench(spark):
    r = random.Random(9)
    texts = [" ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n)) for n in (15, 40, 120)]
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(9, None), (8, "short")], "item_id long, text string"), texts


def test_leaks(spark, bench, docs, none):
    benchmark, texts = bench
    edited = texts[1][:60] + "Q" + texts[1][61:120] + texts[1][122:]
    rows = [(1, "before " + texts[0] + " after"), (2, texts[1].upper().replace(" ", "\n  ")), (3, "x " + edited), (4, texts[2][200:420]), (5, texts[2][:60]), (6, texts[0][::-1]), (7, None)]
    held = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in find_leaks(held, benchmark).collect()}
    assert set(got) >= {(1, 0), (2, 1), (3, 1)} and not {5, 6, 7} & {k for k, _ in got}
    one = got[1, 0]
    assert rows[0][1].encode()[one.start : one.end].decode() == texts[0] and one.edits == 0
    kept = {r.doc_id for r in drop_leaks(held, benchmark).collect()}
    assert kept == {k for k, _ in rows} - {k for k, _ in got}
    assert find_leaks(docs, benchmark).count() == 0 and drop_leaks(docs, benchmark).count() == docs.count() and find_leaks(none, benchmark).count() == 0
    assert find_leaks(docs, benchmark.limit(0)).count() == 0


def test_partial_passages(spark, bench):
    benchmark, texts = bench
    item, n = texts[2], D.PART + D.PART_STEP - 1
    passages = [item[a : a + n] for a in range(0, len(item) - n, 7)] + [item[30:280], item[-n:], texts[1][50 : 50 + n]]
    held = spark.createDataFrame([(k, f"qq {p} zz") for k, p in enumerate(passages)], "doc_id long, text string")
    assert {r.doc_id for r in find_leaks(held, benchmark).collect()} == set(range(len(passages)))
    assert drop_leaks(held, benchmark).count() == 0


def test_short_items(spark):
    """Under MIN_BYTES bytes an item counts without an edit and as whole words only."""
    item = "a short question of 35 bytes, no more"
    benchmark = spark.createDataFrame([(1, item), (2, "tiny item")], "item_id long, text string")
    rows = [(1, f"so {item.upper()}!"), (2, item), (3, f"so {item}over"), (4, f"x{item}"), (5, item.replace("35", "36")), (6, "a tiny item"), (7, f"{item}over {item}")]
    got = {r.doc_id for r in find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got == {1, 2, 7}


def test_against_brute_force(spark):
    """Every window against every place of every text, by plain dynamic programming."""
    r = random.Random(21)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    items = [(1, words(18)), (2, words(50))]
    rows = []
    for k in range(24):
        body = [*items[k % 2][1]]
        lo = r.randrange(max(1, len(body) - 150))
        body = body[lo : lo + r.randint(60, 240)]
        for _ in range(r.randint(0, 14)):
            i, kind = r.randrange(len(body)), r.random()
            body[i : i + 1] = [] if kind < 0.3 else [r.choice("xyz")] if kind < 0.6 else [body[i], r.choice("xyz")]
        rows.append((k, f"{words(3)} {''.join(body)} {words(3)}"))
    index = D.LeakIndex(items)
    clean = lambda text: [*" ".join(text.lower().split()).encode()]
    want = {
        (k, item) for k, text in rows for w, p in enumerate(index.patterns) for item in index.owners[w]
        if least_edits([*p.tobytes()], clean(text)) <= index.budget[w]
    }
    held = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.item_id) for x in find_leaks(held, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and 4 < len({k for k, _ in want}) < len(rows)


def test_many_blocks_repeats_and_clashes(spark, bench, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_GRAMS", 500)
    benchmark, texts = bench
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[2]), (3, "clean words"), (3, "clean words"), (None, None)]
    held = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, __key string")
    kept = drop_leaks(held, benchmark)
    assert kept.columns == held.columns and sorted(str(x.doc_id) for x in kept.collect()) == ["3", "3", "None"]
    assert sorted((x.doc_id, x.item_id) for x in find_leaks(held, benchmark).collect()) == [(1, 0), (1, 0), (2, 2)]


def test_shared_preamble(monkeypatch):
    """Items that share a preamble against a text that repeats it: windows once, regions put together, hits some at a time."""
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))
    preamble = words(30)[:105]
    items = [(k, f"{preamble} {words(20)}") for k in range(200)]
    index = D.LeakIndex(items)
    assert max(len(o) for o in index.owners) == 200
    parts = [preamble] * 20 + [f"{preamble} {words(6)}" for _ in range(20)]
    raw = np.frombuffer((" ".join(parts) + " " + items[7][1]).encode(), np.uint8)
    began = time.monotonic()
    found = list(index.scan(raw, np.array([0, len(raw)])))
    assert time.monotonic() - began < 20
    assert {index.owners[w][0] for _, w, *_ in found if not index.part[w]} == {7}
    monkeypatch.setattr(D, "POSTINGS", 1000)
    monkeypatch.setattr(D, "ALIGNED", 50)
    assert sorted(index.scan(raw, np.array([0, len(raw)]))) == sorted(found)
