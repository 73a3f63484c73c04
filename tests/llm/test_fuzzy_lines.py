"""Fuzzy lines against plain edit distance: no filter that could lose a pair."""

import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tarnlight.llm import similarity as S
from tarnlight.llm.edits import Letters, within
from tarnlight.llm.fuzzy_lines import dropped_lines, drop_repeated_lines, edit_distance, op3, similar_lines
from tarnlight.llm.store import Workspace

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(row[j] + (x != y), row[j + 1] + 1, now[-1] + 1))
        row = now
    return row[-1]


def test_edit_distance():
    r = random.Random(3)
    for _ in range(800):
        a, b = ("".join(r.choice("abé") for _ in range(r.randint(0, 14))) for _ in range(2))
        d = slow_distance(a, b)
        assert edit_distance(a, b) == d and (edit_distance(a, b, 3) == d or min(d, edit_distance(a, b, 3)) > 3)


def test_many_distances():
    """Pairs at once, with bands of one word and of several, against one at a time."""
    r, texts = random.Random(5), []
    for n in (0, 1, 3, 40, 63, 64, 65, 200, 640, 1500):
        for _ in range(4):
            base = [r.choice("abcdé中 ") for _ in range(n)]
            texts.append("".join(base))
            for _ in range(3):
                other = [*base]
                for _ in range(r.randint(0, n // 7 + 1)):
                    i = r.randrange(len(other) + 1)
                    other[i : i + r.randrange(2)] = r.choice([[], [r.choice("abcd")]])
                texts.append("".join(other))
    x, y = (np.array(k) for k in zip(*((i - i % 4 + a, i - i % 4 + b) for i in range(0, len(texts), 4) for a in range(4) for b in range(4)), strict=True))
    most = np.array([max(len(texts[a]), len(texts[b])) // 10 + r.randrange(3) for a, b in zip(x, y, strict=True)])
    slow = [abs(len(texts[a]) - len(texts[b])) <= m and edit_distance(texts[a], texts[b]) <= m for a, b, m in zip(x, y, most, strict=True)]
    assert within(Letters(texts), x, y, most).tolist() == slow and 0 < sum(slow) < len(slow)


def brute(rows):
    """rows: (id, text) with distinct ids. The lines of each that go."""
    items = defaultdict(list)
    for k, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            if w := ALNUM.findall(line.translate(LOW)):
                items[" ".join(w)].append((k, i))
    up = {f: f for f in items}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    forms = sorted((f for f in items if f.count(" ") >= 4), key=len)
    sizes = np.array([len(f) for f in forms])
    bags = np.array([[f.count(c) for c in "abcdefghijklmnopqrstuvwxyz "] for f in forms])
    for i, f in enumerate(forms):
        hi = np.searchsorted(sizes, len(f) / 0.9 + 1)
        apart = np.abs(bags[i + 1 : hi] - bags[i]).sum(1) / 2  # an edit changes two counts at most
        for j in np.flatnonzero(apart <= 0.1 * sizes[i + 1 : hi]) + i + 1:
            if edit_distance(f, forms[j]) <= 0.1 * len(forms[j]):
                up[root(f)] = root(forms[j])
    groups, gone = defaultdict(list), {k: [] for k, _ in rows}
    for f, places in items.items():
        groups[root(f)] += places
    for places in groups.values():
        for k, i in sorted(places)[1:]:
            gone[k].append(i)
    return {k: sorted(v) for k, v in gone.items()}


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r.doc_id: [int(x) for x in r.dropped.split(",") if x] for r in op3(spark, DATA).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("small, hot", [(24, 512), (1, 512), (1, 3)])
def test_edited_copies(spark, monkeypatch, small, hot):
    """Groups of lightly edited lines, also with lists in blocks and with hot signatures."""
    monkeypatch.setattr(S, "SMALL_LIST", small)
    monkeypatch.setattr(S, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(S, "HOT", hot)
    r, rows = random.Random(8), []
    for g in range(6):
        base = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(14)]
        for k in range(8):
            if k % 3 == 2:
                base = [*base]
                base[r.randrange(14)] = "".join(r.choice("qrstuv") for _ in range(4))
            w = [*base]
            w[r.randrange(14)] += r.choice("xyz")
            rows.append((10 * g + k, f"{g} {k}\n{' '.join(w)}"))
    rows += [(900, "ha ha ha ha ha ha ha ha"), (901, "Ha ha, ha ha ha ha ha HA!"), (902, None), (903, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: list(r.dropped) for r in dropped_lines(docs).collect()} == brute(rows)


@pytest.mark.parametrize("block", [4096, 50])
def test_family_names_no_pairs(spark, monkeypatch, block):
    """Lines further from each other than the limit, that share words: what is written grows with them, not with their pairs."""
    monkeypatch.setattr(S, "BLOCK_MEMBERS", block)
    wrote, save = {}, Workspace.save

    def counted(self, df, label):
        out = save(self, df, label)
        wrote[label] = out.count()
        return out

    monkeypatch.setattr(Workspace, "save", counted)
    r, base, n = random.Random(4), [f"{c}{k}stays" for k, c in enumerate("abcdefghij")], 240
    rows = []
    for k in range(n):
        line = [*base]
        for i in (2, 7):
            line[i] = "".join(r.choice("klmn") for _ in range(6))
        rows.append((k, " ".join(line)))
    got = {row.doc_id: list(row.dropped) for row in dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert max(rows for label, rows in wrote.items() if label not in ("dealt", "lists", "mixed")) <= 20 * n


def edited(r, line, n):
    out = [*line]
    for _ in range(n):
        i, kind = r.randrange(len(out)), r.random()
        out[i : i + 1] = [] if kind < 0.25 else [r.choice("abcdefgh")] if kind < 0.75 else [out[i], r.choice("abcdefgh")]
    return " ".join("".join(out).split())


def test_lists_are_gone_before_their_texts_are_dealt(spark, monkeypatch):
    """Disk: what is read no more does not stand beside the texts of lists, and only items of these lists are dealt out with them."""
    r, held, save = random.Random(5), {}, Workspace.save
    words = [f"word{k:03d}" for k in range(400)]
    base = [r.choice(words) for _ in range(30)]
    family = [" ".join(w if k not in (i, i + 9) else words[(i * 7 + k) % 400] for k, w in enumerate(base)) for i in range(20)]
    rest = [" ".join(r.choice(words) for _ in range(12)) for _ in range(300)]

    def watched(self, df, label):
        out = save(self, df, label)
        if label == "within-0":
            held["tables"] = [x for x in ("dealt", "lists", "texts-wanted", "within-items", "per-document") if os.path.exists(self.path(x).removeprefix("file:"))]
            held["texts"] = self.spark.read.parquet(self.path("texts")).count()
        return out

    monkeypatch.setattr(Workspace, "save", watched)
    docs = spark.createDataFrame([(k, line) for k, line in enumerate(family + rest)], "doc_id long, text string")
    got = {x.doc_id for x in dropped_lines(docs).where(F.size("dropped") > 0).collect()}
    assert held["tables"] == [] and 0 < held["texts"] <= len(family)
    assert got <= set(range(len(family)))


def test_recall(spark):
    r = random.Random(2)
    pairs = []
    while len(pairs) < 240:
        line = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range((8, 16, 40)[len(pairs) % 3]))
        other = edited(r, line, max(1, int((0, 0.03, 0.06)[len(pairs) // 3 % 3] * len(line))))
        if other != line and similar_lines(line, other):
            pairs.append((line, other))
    docs = spark.createDataFrame([(2 * k + i, line) for k, p in enumerate(pairs) for i, line in enumerate(p)], "doc_id long, text string")
    gone = {row.doc_id for row in dropped_lines(docs).where(F.size("dropped") > 0).collect()}
    assert not any(k % 2 == 0 for k in gone)
    assert len(gone) >= 0.95 * len(pairs)


def test_edges(spark, docs, none):
    out = {r.doc_id: r.text for r in drop_repeated_lines(docs).collect()}
    assert out[0] is None and out[1] == "" and out[5] is not None and out[6] == ""
    assert drop_repeated_lines(none).count() == 0 and dropped_lines(none).count() == 0
    assert dropped_lines(docs).count() == docs.count()
    twice = spark.createDataFrame([(1, "a line of five words here"), (1, "a line of five words here"), (2, "A line of five words here!")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, list(r.dropped)) for r in dropped_lines(twice).collect())
    assert got == [(1, 1, []), (1, 1, []), (2, 1, [0])]
    named = twice.toDF("doc_id", "text").withColumn("key", F.lit("k")).withColumn("line", F.lit(3)).withColumn("__dropped", F.lit(1))
    assert drop_repeated_lines(named.drop("__dropped")).columns == ["doc_id", "text", "key", "line"]
