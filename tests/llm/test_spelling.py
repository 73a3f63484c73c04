import random
import re
from collections import Counter
from zlib import crc32

from conftest import DATA

from tarnlight.llm.spelling import Automaton, near_words, op12, roots, variant_groups, word_counts
from tarnlight.llm.store import Workspace

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows):
    total = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    same = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[same:] == b[same + 1 :] or (len(a) == len(b) and a[same + 1 :] == b[same + 1 :])


def brute_near(counts):
    out = {}
    for w in counts:
        near = [v for v in counts if one_apart(w, v)]
        if near:
            best = min(near, key=lambda v: (-counts[v], v))
            out[w] = (len(near), best, counts[best])
    return out


def test_counts(spark, docs, words):
    more = [(k, "Bußgeld STRASSE straße naïve Ärger Ärger abcde, abcde×fghij ÷÷÷÷÷÷ 한국어단어들 wordthatoccurs " * 3 + "y" * 70 + " " + "y" * 70) for k in range(40)]
    got = {r.word: r.n for r in word_counts(docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")), least_count=1).collect()}
    total = Counter()
    for key, text in [(r[0], r[1]) for r in words] + more:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    assert got == {w: n for w, n in total.items() if len(w) >= 5}


def test_numbers_and_errors():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(2, 7))) for _ in range(400)})
    automaton = Automaton(words)
    assert len(automaton.edges) < sum(map(len, words)) / 2
    for word in words:
        assert words[automaton._rest(automaton.root, 0, word, 0)] == word
        for exact in (0, len(word) // 2, len(word)):
            found = automaton.one_error(word, exact)
            assert sorted(words[k] for k in found) == [v for v in words if v.startswith(word[:exact]) and one_apart(word, v)]
    assert Automaton([]).one_error("abc", 1) == set()


def test_near_words_in_split_groups(spark):
    """Many words share a half, so groups are split; the result is that of all pairs."""
    rng = random.Random(5)
    words = {"wxyz" + "".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(60)} | {"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) + "wxyz" for _ in range(60)}
    counts = {w: rng.randint(3, 9) for w in sorted(words)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    for group_words, crowd in ((20_000, 20_000), (40, 7)):
        got = {r.word: (r.n_near, r.form, r.form_n) for r in near_words(table, Workspace(spark, "t"), group_words, crowd).collect()}
        assert got == brute_near(counts)


def test_roots(spark):
    links = [(f"w{k:02}", f"w{k + 1:02}") for k in range(17)] + [("a", "w05"), ("b", "c")]
    got = {r.word: r.root for r in roots(spark.createDataFrame(links, "word string, form string"), Workspace(spark, "t")).collect()}
    assert got == {w: "c" if w == "b" else "w17" for w, _ in links}


def test_query_against_all_pairs(spark):
    counts = brute_counts([(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()])
    by_rest = {}
    for w in counts:
        for k in range(len(w)):
            by_rest.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    near = {w: {v for k in range(len(w)) for v in by_rest.get(w[:k] + w[k + 1 :], ()) if one_apart(w, v)} | {v for v in by_rest.get(w, ()) if one_apart(w, v)} | {w[:k] + w[k + 1 :] for k in range(len(w)) if w[:k] + w[k + 1 :] in counts} for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    got = op12(spark, DATA).collect()
    assert len(got) == len(counts)
    for r in got:
        root = r.word
        while form[root]:
            root = form[root]
        assert (r.form, r.root, r.n, r.n_near, r.form_n) == (form[r.word], root, counts[r.word], len(near[r.word]), counts.get(form[r.word])), r


def test_edges(spark, docs, none):
    assert variant_groups(word_counts(none), Workspace(spark, "t")).collect() == []
    twice = docs.union(docs).withColumnRenamed("lang", "word").withColumnRenamed("source", "n")
    single = {r.word: r.n for r in word_counts(docs, least_count=1).collect()}
    assert {r.word: r.n for r in word_counts(twice, least_count=1).collect()} == {w: 2 * n for w, n in single.items()}
    assert single["x" * 100000] == 1
