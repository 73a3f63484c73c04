"""License scan with a positional rare-token index.

Templates are passages of public licences. Their content words are the index's
vocabulary; a template's posting of a word is its position. A first pass keeps,
per text, the positions of vocabulary words and the base phrases. Document
frequencies of the vocabulary over all texts give each word its IDF. Of each
template the highest-IDF words that hold more than 1 - COVERAGE of its IDF are
looked up, so no place that reaches COVERAGE is without one of them; their
postings tell relative positions (text position less template position). At
each of these the template words found in place are summed by IDF, and the
template's mandatory key phrases must stand there word for word. A template's
label is given at COVERAGE of its IDF and up, with the best place's coverage.

Edge cases: null and empty texts have no words and no labels; a text of any
length is read whole; rows are independent, so ties, repeats and null ids do
not matter; an empty table gives an empty result; other columns pass through
``scan_licenses``, whose struct replaces a column ``licenses``.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnlight.llm import kernels as K
from tarnlight.llm.similarity import free_name
from tarnlight.llm.store import Workspace

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Fixed values: (label, passage of the public licence text, mandatory key phrases).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted", "without restriction including without limitation")),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache license version", "except in compliance with the license")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("free software", "gnu general public license")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistribution and use in source and binary forms", "above copyright notice")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("all-rights-reserved", "all rights reserved", ("rights reserved",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("unencumbered software released into the public domain",)),
)
#: Words too common to index.
COMMON = frozenset("a all and any are as at by can for form if in is it may must not of on one or that the this to use was were with you your".split())

#: Words by which a place may differ from the one looked up.
DRIFT = 3
COVERAGE = 0.6


class Templates:
    """Vocabulary and postings of the templates."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.base = [(phrase.split(), label) for phrase, label in base]
        words = {w for _, text, keys in templates for w in (*text.split(), *" ".join(keys).split())} | {w for phrase, _ in self.base for w in phrase}
        self.words = sorted(w for w in words if w not in COMMON or any(w in p for p, _ in self.base))
        self.index = {w: i for i, w in enumerate(self.words)}
        self.labels = [label for label, _, _ in templates]
        known = lambda text: [(i, self.index[w]) for i, w in enumerate(text.split()) if w in self.index]
        self.posts = [known(text) for _, text, _ in templates]
        self.keys = [[known(k) for k in keys] for _, _, keys in templates]
        self.key_starts = [[self._find(text.split(), k.split()) for k in keys] for _, text, keys in templates]
        self.of_word: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, posts in enumerate(self.posts):
            for at, w in posts:
                self.of_word[w].append((t, at))
        data = np.frombuffer(" ".join(self.words).encode(), np.uint8)
        starts, ends, _ = K.spans(data, np.array([0, len(data)]), K.NOT_ALNUM)
        h = K.span_hashes(data, starts, ends)
        self.order = np.argsort(h)
        self.hashes = h[self.order]

    @staticmethod
    def _find(text: list[str], phrase: list[str]) -> int:
        return next(i for i in range(len(text)) if text[i : i + len(phrase)] == phrase)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary number of each hash, or -1."""
        i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[i] == h, self.order[i], -1)

    def judge(self, positions: np.ndarray, words: np.ndarray, idf: np.ndarray) -> dict[str, float]:
        """Label -> coverage for templates that stand in a text."""
        found: dict[str, float] = {}
        if not len(words):
            return found
        at_word: dict[int, list[int]] = defaultdict(list)
        for p, w in zip(positions.tolist(), words.tolist(), strict=True):
            at_word[w].append(p)
        placed = set(zip(positions.tolist(), words.tolist(), strict=True))
        for t, (posts, label) in enumerate(zip(self.posts, self.labels, strict=True)):
            mass = sum(idf[w] for _, w in posts)
            if sum(idf[w] for _, w in posts if w in at_word) < COVERAGE * mass or any(w not in at_word for key in self.keys[t] for _, w in key):
                continue
            shifts, left = set(), mass
            for at, w in sorted(posts, key=lambda post: (-idf[post[1]], post)):
                if left < (COVERAGE - 1e-9) * mass:  # the words left cannot reach it alone
                    break
                left -= idf[w]
                shifts.update(p - at + d for p in at_word.get(w, ()) for d in range(-DRIFT, DRIFT + 1))
            for key, start in zip(self.keys[t], self.key_starts[t], strict=True):
                at, w = min(key, key=lambda post: len(at_word[post[1]]))
                stands = [p - at for p in at_word[w] if all((p - at + i, x) in placed for i, x in key)]
                shifts &= {p - start + d for p in stands for d in range(-DRIFT, DRIFT + 1)}
            for s in shifts:
                near = lambda at, w, s=s: any((at + s + d, w) in placed for d in range(-DRIFT, DRIFT + 1))
                cover = sum(idf[w] for at, w in posts if near(at, w)) / mass if mass else 0.0
                if cover >= COVERAGE:
                    found[label] = max(found.get(label, 0.0), min(1.0, float(cover)))
        return found


_FIRST = "n_words long, n_base long, first_word long, last_word long, base_labels string, positions array<int>, words array<int>"


def first_pass(texts: pa.Array, templates: Templates) -> pd.DataFrame:
    out = {c: np.zeros(len(texts), np.int64) for c in ("n_words", "n_base")}
    first: list = [None] * len(texts)
    last, labels = list(first), [""] * len(texts)
    positions: list = [()] * len(texts)
    words = list(positions)
    phrases = [([templates.index[w] for w in phrase], label) for phrase, label in templates.base]
    for lo, hi, data, at in K.text_slices(texts):
        low = K.LOWER[data]
        starts, ends, rows = K.spans(low, at, K.NOT_ALNUM)
        if not len(starts):
            continue
        n = K.row_counts(rows, hi - lo)
        out["n_words"][lo:hi] = n
        before = np.cumsum(n) - n
        word = templates.look_up(K.span_hashes(low, starts, ends))
        hit = np.flatnonzero(word >= 0)
        if not len(hit):
            continue
        place = hit - before[rows[hit]]
        cuts = np.flatnonzero(np.diff(rows[hit])) + 1
        for p, w in zip(np.split(place, cuts), np.split(hit, cuts), strict=True):
            row = lo + int(rows[w[0]])
            positions[row], words[row] = p.astype(np.int32), word[w].astype(np.int32)
        base: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for phrase, label in phrases:
            starts_at = hit[word[hit] == phrase[0]]
            starts_at = starts_at[starts_at + len(phrase) <= len(word)]
            for k, w in enumerate(phrase):
                starts_at = starts_at[(word[starts_at + k] == w) & (rows[starts_at + k] == rows[starts_at])]
            for i in starts_at.tolist():
                base[int(rows[i])].append((i - int(before[rows[i]]), label))
        for r, found in base.items():
            out["n_base"][lo + r] = len(found)
            first[lo + r], last[lo + r] = min(found)[0], max(found)[0]
            labels[lo + r] = ",".join(sorted({label for _, label in found}))
    return pd.DataFrame(out | {"first_word": pd.array(first, "Int64"), "last_word": pd.array(last, "Int64"), "base_labels": labels, "positions": positions, "words": words})


def scan_licenses(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, with a struct ``licenses``: n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the best template's share of IDF found in place; at least 0.5 where a base phrase stands.
    """
    templates, work = Templates(), Workspace(docs.sparkSession, "licenses")

    @F.pandas_udf(_FIRST)
    def find(text: pd.Series) -> pd.DataFrame:
        return first_pass(pa.array(text, pa.string(), from_pandas=True), templates)

    held = docs.withColumn("licenses", find("text"))
    if "text" in docs.columns and len(docs.columns) <= 2:  # a narrow table is written once with its findings, without texts
        held = work.save(held.drop("text"), "found")
    counted = held.select(F.explode(F.array_distinct("licenses.words")).alias("w")).groupBy("w").count().collect()  # a row for each vocabulary word
    total = held.count()
    idf = np.full(len(templates.words), np.log(1 + total))
    for w, n in counted:
        idf[w] = np.log(1 + total / n)

    @F.pandas_udf("labels string, score double")
    def judge(found: pd.DataFrame) -> pd.DataFrame:
        labels, scores = [], []
        for base, p, w in zip(found["base_labels"], found["positions"], found["words"], strict=True):
            got = templates.judge(np.asarray(p, np.int64), np.asarray(w, np.int64), idf)
            labels.append(",".join(sorted({*got, *filter(None, base.split(","))})))
            scores.append(max([0.5 if base else 0.0, *got.values()]))
        return pd.DataFrame({"labels": labels, "score": scores})

    name = free_name(held, "__judged")
    judged = held.withColumn(name, judge("licenses"))
    return judged.withColumn("licenses", F.struct(*(f"licenses.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")), f"{name}.labels", f"{name}.score")).drop(name)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "licenses.*")
