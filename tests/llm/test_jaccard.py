import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import DATA

from tarnlight.llm import jaccard as J
from tarnlight.llm import similarity as S
from tarnlight.llm.jaccard import jaccard_components

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sets_of(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """rows: (id, text) with distinct ids."""
    sets, up = [(k, sets_of(t)) for k, t in rows], {k: k for k, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    lists = defaultdict(list)
    for i, (k, s) in enumerate(sets):
        for j, n in Counter(j for g in s for j in lists[g]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = root(k), root(sets[j][0])
                up[max(a, b)] = min(a, b)
        for g in s:
            lists[g].append(i)
    return {k: (len(s), root(k)) for k, s in sets}


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("small, hot", [(24, 512), (2, 512), (2, 3)])
def test_chains_and_small_sets(spark, monkeypatch, small, hot):
    """Near copies in chains, tiny sets on both sides of the light boundary, and lists verified by blocks."""
    monkeypatch.setattr(S, "SMALL_LIST", small)
    monkeypatch.setattr(S, "BLOCK_MEMBERS", 2)
    monkeypatch.setattr(S, "HOT", hot)
    r = random.Random(4)
    rows, base = [], [f"w{k}" for k in range(60)]
    for k in range(60):
        if k % 20 == 0:
            base = [f"b{k}w{i}" for i in range(r.choice([8, 30, 60]))]
        else:
            base = [*base]
            base[r.randrange(len(base))] = f"n{k}"
        rows.append((k, " ".join(base)))
    rows += [(100 + k, " ".join("abcdefghijk"[: 4 + k % 7])) for k in range(14)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_edges(docs, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()), key=str)
    by = {k: (n, c) for k, n, c in got if k is not None}
    assert by[0] == (0, 0) and by[1] == (0, 1) and by[2] == (0, 2)
    assert by[5][1] == by[6][1] == by[7][1] == 5 and by[4] == (1, 4) and by[10] == (1, 10)
    assert (None, 1, 4) in got and jaccard_components(none).count() == 0


def thue_morse(n, a, b):
    return "".join((a, b)[k.bit_count() % 2] for k in range(n))


def test_words_that_a_polynomial_confuses(spark):
    words = [thue_morse(2048, *p) for p in (("a", "b"), ("b", "a"), ("xy", "yx"), ("yx", "xy"))]
    got = jaccard_components(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k for k in range(4)}


def test_equal_numbers(spark):
    """Items that agree in their number by chance are told apart."""
    join = J.JaccardJoin(spark.createDataFrame([], "doc_id long, text string"))
    items = join.numbered(spark.createDataFrame([(7, b"x"), (7, b"y"), (8, b"z")], "id long, name binary")).collect()
    assert len({r.node for r in items}) == 3 and {r.node for r in items} > {7, 8}
    entries = spark.createDataFrame([r for b in entries_of(S.Packer(2, 512)) for r in b.to_pylist()], "part int, hot boolean, blob binary")
    lists = defaultdict(set)
    for r in join._lists(entries, 2).collect():
        lists[r.sig] |= {r.node, r.pivot}
    assert [len(x) for x in lists.values()] == [3] and set.union(*lists.values()) == {r.node for r in items}


def entries_of(packer):
    import numpy as np

    yield from packer.add(np.array([5, 5, 6], np.uint64), np.array([7, 8, 8], np.int64))
    yield from packer.flush()


def test_near_copies_go(spark):
    """Rows are told apart by id and text; repeated rows stay once."""
    a, b = ("one two three four five six seven " * 3 + f"{x} {x} {x}" for x in "ab")
    other = " ".join(f"w{k}" for k in range(20))
    rows = [(3, a), (5, a), (5, other), (6, b), (6, other), (None, a), (7, None), (7, " "), (3, a)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __key string")
    got = sorted((r.doc_id, r.text or "") for r in J.drop_near_copies(docs).collect())
    assert got in ([(3, a), (5, other), (7, ""), (7, " ")], [(3, a), (5, other), (6, b), (7, ""), (7, " ")])


def test_boundary():
    assert J.light_boundary([(5, 100), (40, 100)], 0.0) <= 5
    assert J.light_boundary([(5, 100), (10, 100), (40, 100)], 5.0) >= 10
    assert [J.at_least(n) for n in (1, 2, 3, 4, 8)] == [1, 2, 3, 3, 6]
