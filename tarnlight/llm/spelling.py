"""Spelling variants: words that differ by one code point, found with automata in both directions.

``word_counts`` counts the words of all texts. ``near_words`` finds, for each word of a list, the words
exactly one inserted, deleted or replaced code point away: of a word's two halves one must
then stand unchanged in its near word, the first half at the start or the second one at the end. Words are dealt by these
halves; each group makes a minimal acyclic automaton, of its words (for first halves) or of its
reversed words (for second ones), in which a word's half is matched exactly and
completed with one error. The automaton numbers its words by a perfect hash, so a match is an index
into the group's counts. A word that both directions find is counted in the first only. ``variant_groups`` names
for each word the form that it is a variant of, and the root to which forms lead.

A half that more than CROWD words share is split: its words are dealt to several groups, and the words that ask
are asked in each, so no task's memory grows with a half. Roots are found by pointer doubling over written tables;
as a form is at least twice as frequent as its variant, chains are short.

Edge cases: null texts have no words, nor do texts without letters; a null id counts as an empty one; texts are read
whole, and a run of any length is one word. Rows of one id are counted each. Among near words as frequent
the first in code-point order is the form. An empty table, or one with too few equal words, gives no rows.
Columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnlight.llm import kernels as K
from tarnlight.llm.store import Workspace

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form is so many times as frequent as its variant, at least.
RATIO = 2
#: One run in DELETE_ONE_IN (by a hash of document and run) loses a code point before it is counted.
DELETE_ONE_IN = 97
#: Words of an automaton, and words with one half from which they are split.
GROUP_WORDS, CROWD = 20_000, 20_000
#: Bytes of text that are counted at once, and distinct words that a task holds.
SLICE_BYTES, HELD_WORDS = 1 << 22, 400_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LEAD = 0xC3  # the first byte of U+00C0 to U+00FF


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each span of data, going on from the crc32 ``before`` it; long spans one by one."""
    crc = before ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    long = size >= K.LONG_SPAN
    at = np.flatnonzero(~long)
    at = at[np.argsort(-size[at], kind="stable")]
    left = -size[at]  # ascending, so spans that go on are a prefix
    for k in range(K.LONG_SPAN):
        at = at[: np.searchsorted(left, -k)]
        if not len(at):
            break
        c = crc[at]
        crc[at] = _CRC[(c ^ data[starts[at] + k]) & 255] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(long).tolist():
        crc[i] = crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    return crc


def _count(ids: pa.Array, texts: pa.Array, least: int) -> Iterator[tuple[list[bytes], list[int]]]:
    """Words (UTF-8) of at least ``least`` code points and their counts, slice by slice."""
    prefix = np.array([crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()], np.uint32)
    for lo, _, data, at in K.text_slices(texts, SLICE_BYTES):
        letter = _LETTER[data] | (data == _LEAD)
        letter[1:] |= data[:-1] == _LEAD
        starts, ends, rows = K.spans(np.where(letter, np.uint8(97), np.uint8(32)), at, K.BLANK)
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        length = points[ends] - points[starts]
        fit = length >= least  # a shorter run gives a shorter word
        starts, ends, rows, length = starts[fit], ends[fit], rows[fit], length[fit]
        if not len(starts):
            continue
        data = K.LOWER[data]
        crc = span_crcs(data, starts, ends, prefix[lo + rows])
        cut = crc % DELETE_ONE_IN == 0
        raw = data.tobytes()
        words, counts = [], []
        for k in np.flatnonzero(cut & (length > least)).tolist():
            run = raw[starts[k] : ends[k]].decode()
            drop = int(crc[k]) % len(run)
            words.append((run[:drop] + run[drop + 1 :]).encode())
            counts.append(1)
        starts, ends = starts[~cut], ends[~cut]
        _, first, times = np.unique(K.span_hashes(data, starts, ends), return_index=True, return_counts=True)
        words += [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        yield words, counts + times.tolist()


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of at least ``least_length`` code points that occur ``least_count`` times or more."""
    def told(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for words, counts in _count(batch.column(0), batch.column(1), least_length):
                for w, n in zip(words, counts, strict=True):
                    held[w] = held.get(w, 0) + n
                if len(held) >= HELD_WORDS:
                    yield told(held)
                    held = {}
        yield told(held)

    each = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """Minimal acyclic automaton of sorted words. ``edges[s]`` has, by letter, the next state and how many words come before its."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._sizes: list[int] = []
        self._known: dict[tuple, int] = {}
        path: list[tuple[list[bool], list[tuple[str, int]]]] = [([False], [])]
        last = ""
        for word in words:
            same = 0
            for a, b in zip(last, word):  # noqa: B905
                if a != b:
                    break
                same += 1
            while len(path) > same + 1:
                state = self._freeze(*path.pop())
                path[-1][1].append((last[len(path) - 1], state))
            path.extend(([False], []) for _ in range(len(word) - same))
            path[-1][0][0] = True
            last = word
        while len(path) > 1:
            state = self._freeze(*path.pop())
            path[-1][1].append((last[len(path) - 1], state))
        self.root = self._freeze(*path.pop())
        del self._known

    def _freeze(self, final: list[bool], edges: list[tuple[str, int]]) -> int:
        name = (final[0], *edges)
        state = self._known.get(name)
        if state is None:
            state = self._known[name] = len(self.edges)
            before, out = int(final[0]), {}
            for letter, after in edges:
                out[letter] = (after, before)
                before += self._sizes[after]
            self.edges.append(out)
            self.final.append(final[0])
            self._sizes.append(before)
        return state

    def _rest(self, state: int, number: int, word: str, at: int) -> int:
        """The number of the word that goes on with word[at:], or -1."""
        edges = self.edges
        for k in range(at, len(word)):
            step = edges[state].get(word[k])
            if step is None:
                return -1
            state, number = step[0], number + step[1]
        return number if self.final[state] else -1

    def one_error(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that start with word[:exact] and are one error away from word."""
        state, number, edges, rest = self.root, 0, self.edges, self._rest
        for k in range(exact):
            step = edges[state].get(word[k])
            if step is None:
                return set()
            state, number = step[0], number + step[1]
        found, size = set(), len(word)
        for k in range(exact, size + 1):
            letter = word[k] if k < size else ""
            for other, (after, before) in edges[state].items():
                found.add(rest(after, number + before, word, k))
                if letter and other != letter:
                    found.add(rest(after, number + before, word, k + 1))
            if not letter:
                break
            found.add(rest(state, number, word, k + 1))
            step = edges[state].get(letter)
            if step is None:
                break
            state, number = step[0], number + step[1]
        found.discard(-1)
        return found


_FOUND = "word string, n_near long, form_n long, form string"


def _group_near(group: pd.DataFrame) -> pd.DataFrame:
    """Near words within a group of one direction, for those of its words that ask: their number and the most frequent."""
    back = bool(group["back"].iloc[0])
    held = group[group["held"]].drop_duplicates("word")
    words, counts = held["word"].tolist(), held["n"].tolist()
    spelled = [w[::-1] for w in words] if back else words
    order = sorted(range(len(words)), key=spelled.__getitem__)
    words, counts, spelled = ([x[k] for k in order] for x in (words, counts, spelled))
    automaton = Automaton(spelled)
    out = []
    for word in dict.fromkeys(group.loc[group["asks"], "word"]):
        half = len(word) // 2
        near = automaton.one_error(word[::-1], len(word) - half) if back else automaton.one_error(word, half)
        if back:  # those that keep the first half are found forward
            near = {k for k in near if not words[k].startswith(word[:half])}
        if near:
            best = min(near, key=lambda k: (-counts[k], words[k]))
            out.append((word, len(near), counts[best], words[best]))
    return pd.DataFrame(out, columns=["word", "n_near", "form_n", "form"])


def near_words(words: DataFrame, work: Workspace, group_words: int = GROUP_WORDS, crowd: int = CROWD) -> DataFrame:
    """words: word (each once, two code points or more), n. Returns word, n_near, form, form_n (the near word of largest n) of words with a near word.

    A word stands under the halves that words of its length, one less and one more have, and asks under its own.
    """
    size = F.length("word")
    half = lambda k: F.floor((size + k) / 2).cast("int")
    rows = []
    for back in (False, True):
        own = half(0) if not back else size - half(0)
        for k in (-1, 0, 1):
            part = half(k) if not back else size + k - half(k)
            key = F.right("word", part) if back else F.left("word", part)
            # A neighbour length that leads to the same half as the own length adds nothing; of the two others at most one differs.
            rows.append(F.when(F.lit(k == 0) | (part != own), F.struct(F.lit(back).alias("back"), key.alias("key"), F.lit(k == 0).alias("asks"))))
    each = words.select("word", "n", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("word", "n", "r.*")
    each = work.save(each, "halves")
    total = each.count()
    groups = max(1, -(-total // group_words))
    hot = work.save(each.groupBy("back", "key").count().where(F.col("count") > crowd).select("back", "key", F.ceil(F.col("count") / crowd).cast("int").alias("splits")), "crowds")
    each = each.join(hot, ["back", "key"], "left")
    plain = F.concat(F.when(F.col("back"), "b").otherwise("f"), F.pmod(F.xxhash64("key"), F.lit(groups)).cast("string"))
    place = F.pmod(F.xxhash64("word"), F.col("splits")).cast("int")
    calm = each.where("splits is null").select("word", "n", "back", "asks", F.lit(True).alias("held"), plain.alias("group"))
    asked = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("splits") - 1)).otherwise(F.array(place))
    split = each.where("splits is not null").select("*", F.explode(asked).alias("split"))
    named = F.concat(F.when(F.col("back"), "b").otherwise("f"), F.col("split").cast("string"), F.lit(":"), F.col("key"))
    split = split.select("word", "n", "back", "asks", (F.col("split") == place).alias("held"), named.alias("group"))
    found = calm.union(split).groupBy("group").applyInPandas(_group_near, _FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.m")).alias("form_n"))


def roots(links: DataFrame, work: Workspace) -> DataFrame:
    """links: word, form (acyclic). Returns word, root: the last form that forms lead to. Each step doubles how far a word sees."""
    now, step = work.save(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots-0"), 0
    while not now.where("moved").isEmpty():
        after = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step += 1
        now = work.save(now.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots-{step}")
    return now.select("word", "root")


def variant_groups(words: DataFrame, work: Workspace, ratio: int = RATIO) -> DataFrame:
    """words: word, n. Returns word, form, root, n, n_near, form_n: form is the near word of largest n if it is ``ratio`` times as frequent, root where forms end."""
    words = work.save(words, "words")
    near = near_words(words, work)
    form = F.col("form_n") >= ratio * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("form")).alias("form"), F.when(form, F.col("form_n")).alias("form_n"),
    )
    rows = work.save(rows, "forms")
    last = roots(rows.where("form is not null").select("word", "form"), work)
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return variant_groups(word_counts(docs), Workspace(spark, "spelling"))
