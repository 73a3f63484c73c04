"""Greedy word-piece lengths by a linear longest-match automaton.

A word is its UTF-8 bytes (A-Z lower-cased) and an end mark. Longest match
first cuts it into vocabulary strings. The automaton is the vocabulary's trie
with failure links: where no edge fits, the link leads to the node that greedy
matching would be in after it has cut off some pieces, and the number of pieces
popped on the way is precomputed. One pass over the symbols so gives the number
of pieces, and no piece is built.

Edge cases: null and blank texts count 0 words and 0 pieces; texts of any length
are read whole; rows are independent, so repeats and null ids do not matter; an
empty table gives an empty result; other columns pass through and the struct
``token_counts`` replaces a column of that name. A symbol at which no
vocabulary string begins is a piece of its own.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnlight.llm import kernels as K
from tarnlight.llm.vocabulary import byte_letters, tokenizer_file

END = 256
#: Bytes from which a word is read by itself, symbol by symbol.
LONG_WORD = 256
_NONE = -1


def vocabulary_symbols(path: str, word_end: str = "</w>") -> list[tuple[int, ...]]:
    """Vocabulary strings as symbols: bytes, and END for the mark of a word's end."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    letters = byte_letters()
    out = []
    for token in vocab:
        body, ends = (token[: -len(word_end)], True) if token.endswith(word_end) else (token, False)
        if all(c in letters for c in body):
            out.append((*(letters[c] for c in body), *([END] if ends else [])))
    return [x for x in out if x]


class LongestMatch:
    """The automaton as arrays: sorted edges, failure links and popped counts."""

    def __init__(self, tokens: list[tuple[int, ...]]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for token in [*((x,) for x in range(END + 1)), *tokens]:  # a symbol that no string begins with is a piece
            at = 0
            for x in token:
                if x not in children[at]:
                    children[at][x] = len(children)
                    children.append({})
                    final.append(False)
                at = children[at][x]
            final[at] = True
        n = len(children)
        link, popped = [_NONE] * n, [0] * n
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for x, v in children[u].items():
                queue.append(v)
                if final[v]:  # cut the whole string of v off
                    link[v], popped[v] = 0, 1
                    continue
                at, count = link[u], popped[u]  # what u's pieces leave, then x
                while x not in children[at]:
                    at, count = link[at], count + popped[at]
                link[v], popped[v] = children[at][x], count
        edges = sorted((u * 512 + x, v) for u, own in enumerate(children) for x, v in own.items())
        self.keys, self.to = np.array([k for k, _ in edges], np.int64), np.array([v for _, v in edges], np.int64)
        self.link, self.popped = np.array(link), np.array(popped)
        self._edges: dict[int, int] | None = None

    def _child(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        key = at * 512 + x
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.to[i], _NONE)

    def _feed(self, at: np.ndarray, count: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Nodes after one more symbol of each word; adds the pieces cut off to count."""
        todo = np.arange(len(at))
        at = at.copy()
        while len(todo):
            nxt = self._child(at[todo], x[todo])
            went = nxt != _NONE
            at[todo[went]] = nxt[went]
            todo = todo[~went]
            count[todo] += self.popped[at[todo]]
            at[todo] = self.link[at[todo]]
        return at

    def count_one(self, word: bytes) -> int:
        """Pieces of one word, in time that grows with its length only."""
        if self._edges is None:
            self._edges = dict(zip(self.keys.tolist(), self.to.tolist(), strict=True))
            self._link, self._popped = self.link.tolist(), self.popped.tolist()
        edges, link, popped, at, count = self._edges, self._link, self._popped, 0, 0
        for x in (*word, END):
            to = edges.get(at * 512 + x)
            while to is None:
                count += popped[at]
                at = link[at]
                to = edges.get(at * 512 + x)
            at = to
        while at:
            count += popped[at]
            at = link[at]
        return count

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word data[start:end]: long ones one by one, the rest in lock step."""
        out = np.empty(len(starts), np.int64)
        long = ends - starts >= LONG_WORD
        out[long] = [self.count_one(data[a:b].tobytes()) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        out[~long] = self._lock_step(data, starts[~long], ends[~long])
        return out

    def _lock_step(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        order = np.argsort(starts - ends, kind="stable")  # longest first: the words still being read are a prefix
        first, size = starts[order], (ends - starts)[order]
        at, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for k in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -k))
            at[:n] = self._feed(at[:n], count[:n], data[first[:n] + k].astype(np.int64))
        at = self._feed(at, count, np.full(len(at), END))
        todo = np.flatnonzero(at)  # what is held at the end is cut up too
        while len(todo):
            count[todo] += self.popped[at[todo]]
            at[todo] = self.link[at[todo]]
            todo = todo[at[todo] > 0]
        out = np.empty(len(order), np.int64)
        out[order] = count
        return out


_automata: dict[str, LongestMatch] = {}


def automaton(path: str) -> LongestMatch:
    if path not in _automata:
        _automata[path] = LongestMatch(vocabulary_symbols(path))
    return _automata[path]


def count_pieces(texts: pa.Array, machine: LongestMatch) -> tuple[np.ndarray, np.ndarray]:
    """Words and pieces of each text; each distinct word of a slice is read once."""
    words, pieces = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for lo, hi, data, at in K.text_slices(texts):
        data = K.LOWER[data]
        starts, ends, rows = K.spans(data, at, K.BLANK)
        if len(starts):
            _, one, which = np.unique(K.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            each = machine.count(data, starts[one], ends[one])[which]
            words[lo:hi] = K.row_counts(rows, hi - lo)
            pieces[lo:hi] = K.row_counts(rows, hi - lo, each)
    return words, pieces


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """All rows and columns of docs, with the struct ``token_counts``: n_words, n_pieces."""

    @F.pandas_udf("n_words long, n_pieces long")
    def counts(text: pd.Series) -> pd.DataFrame:
        words, pieces = count_pieces(pa.array(text, pa.string(), from_pandas=True), automaton(vocabulary_path))
        return pd.DataFrame({"n_words": words, "n_pieces": pieces})

    return docs.withColumn("token_counts", counts("text"))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, tokenizer_file()).select("doc_id", "token_counts.n_words", "token_counts.n_pieces")
