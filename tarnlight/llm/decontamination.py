"""Benchmark decontamination by the q-gram lemma.

Text and benchmark are compared as bytes with A-Z lower-cased and runs of white
space made one space. A benchmark item is taken whole up to WINDOW bytes, and
else as overlapping windows of that length. Besides, items longer than PART
bytes are cut to windows of PART bytes at every PART_STEP-th byte, so a verbatim
passage of PART + PART_STEP - 1 bytes holds one whole wherever it starts; these
tell a leak only of an item that no window of the first kind finds in the text.
Shorter passages of a longer item may be missed. A window of m bytes within k edits
of some region of a text shares at least m - q + 1 - k q of its q-grams with it,
all on diagonals that lie within k of each other. So the q-grams that text and
window share are counted in overlapping diagonal bands, bands that meet the
bound are kept, and each is verified by banded alignment. Items of Q to MIN_BYTES
bytes are short enough to stand in a text by chance: they count only without an
edit and between word ends.

The benchmark is read in blocks of at most BLOCK_GRAMS q-grams; each block is one
pass over the documents, and its index is what the workers are sent, one at a time.

Edge cases: null and empty texts, and items under Q bytes, match nothing; texts
of any length are read whole; rows are independent, so repeats and null ids do
not matter; edits are counted in bytes, so one letter of another script may
cost up to four, of a window whose length is in bytes too; empty tables give
empty results; other columns pass through ``drop_leaks``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnlight.llm import kernels as K
from tarnlight.llm.similarity import few, free_name, row_key
from tarnlight.llm.store import Workspace

Q = 12
WINDOW = 200
STEP = 100
PART, PART_STEP = 72, 18
MIN_BYTES = 40
#: Edits allowed, as a share of a window's bytes.
EDITS = 0.06
BLOCK_GRAMS = 1 << 20
#: Postings that are laid out, and regions that are aligned, at once.
POSTINGS, ALIGNED = 1 << 20, 4096
_FILTER_BITS = 23
_SPACE = np.uint8(32)


def normalised(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets of the rows in them, and the place in ``data`` of each byte."""
    data = np.where(K.BLANK[data], _SPACE, K.LOWER[data])
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != _SPACE) | (data[:-1] != _SPACE)
    inner = at[:-1]
    keep[inner[inner < len(data)]] = True
    place = np.flatnonzero(keep)
    return data[place], np.searchsorted(place, at), place


def grams(data: np.ndarray, q: int) -> np.ndarray:
    starts = np.arange(max(0, len(data) - q + 1))
    return K.span_hashes(data, starts, starts + q)


def best_alignments(patterns: np.ndarray, regions: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Edits (budget + 1: more than it) and end in the region of each pattern's best match in its region; rows of equal length.

    A band: a pattern's byte i is compared with region bytes i .. i + width, the region's slack. All rows take a step at once.
    """
    n, size = patterns.shape
    width = max(0, regions.shape[1] - size) + 1
    big = budget + 1
    tail = size + width + 1
    padded = np.concatenate([regions, np.zeros((n, tail), np.uint8)], axis=1)
    valid = np.arange(padded.shape[1]) < regions.shape[1]
    offsets = np.arange(width + 1, dtype=np.int32)
    row = np.zeros((n, width + 1), np.int32)  # row[:, d]: edits of pattern[:i] ending before region byte i + d
    got = np.empty_like(row)
    alive = np.arange(n)
    for i in range(size):
        step = row + ((padded[alive, i : i + width + 1] != patterns[alive, i : i + 1]) | ~valid[i : i + width + 1])
        got = np.minimum(step[:, :-1], row[:, 1:] + 1)  # a pattern byte without a region byte
        got = np.concatenate([got, np.minimum(step[:, -1:], big)], axis=1)
        row = np.minimum(np.minimum.accumulate(got - offsets, axis=1) + offsets, big)
        if i % 8 == 7:
            going = row.min(1) < big
            if not going.all():
                alive, row = alive[going], row[going]
            if not len(alive):
                break
    edits, ends = np.full(n, big, np.int64), np.zeros(n, np.int64)
    if len(alive):
        at = row.argmin(1)
        edits[alive] = row[np.arange(len(alive)), at]
        ends[alive] = np.minimum(size + at, regions.shape[1])
    return edits, ends


def best_alignment(pattern: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int] | None:
    """(edits, end in region) of the pattern's best match in the region, if within budget."""
    edits, end = best_alignments(pattern[None], region[None], budget)
    return (int(edits[0]), int(end[0])) if edits[0] <= budget else None


def _whole_words(pattern: np.ndarray, body: np.ndarray, first: int, last: int, lo: int, hi: int) -> tuple[int, int] | None:
    """As best_alignment in body[lo:hi], without an edit and where no letter or digit of the row, body[first:last], goes on at either end."""
    needle, text = pattern.tobytes(), body[lo:hi].tobytes()
    at = text.find(needle)
    while at >= 0:
        a, b = lo + at, lo + at + len(needle)
        if (a == first or K.NOT_ALNUM[body[a - 1]] or K.NOT_ALNUM[body[a]]) and (b == last or K.NOT_ALNUM[body[b]] or K.NOT_ALNUM[body[b - 1]]):
            return 0, at + len(needle)
        at = text.find(needle, at + 1)
    return None


class LeakIndex:
    """Windows of a block of benchmark items, and where each q-gram stands in them."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, edits: float = EDITS):
        self.q = q
        #: Distinct windows, the items that have each, and whether it is a part.
        self.owners, self.patterns, self.part = [], [], []
        known: dict[tuple[bytes, bool], int] = {}

        def add(window: np.ndarray, item: int, part: bool) -> None:
            at = known.setdefault((window.tobytes(), part), len(self.patterns))
            if at == len(self.patterns):
                self.owners.append([])
                self.patterns.append(window)
                self.part.append(part)
            if item not in self.owners[at][-1:]:
                self.owners[at].append(item)

        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            body, _, _ = normalised(raw, np.array([0, len(raw)]))
            body = np.frombuffer(body.tobytes().strip(b" "), np.uint8)
            if len(body) < q:
                continue
            last = max(0, len(body) - WINDOW)
            for a in sorted({*range(0, last, STEP), last}):
                add(body[a : a + WINDOW], item, False)
            last = len(body) - PART
            for a in sorted({*range(0, last, PART_STEP), last}) if last > 0 else ():
                add(body[a : a + PART], item, True)
        self.length = np.array([len(p) for p in self.patterns], np.int64)
        self.budget = np.where(self.length < MIN_BYTES, 0, self.length * edits).astype(np.int64)
        self.least = np.maximum(1, self.length - q + 1 - self.budget * q)
        found = [grams(p, q) for p in self.patterns]
        h = np.concatenate(found) if found else np.empty(0, np.uint64)
        window = np.repeat(np.arange(len(found)), [len(x) for x in found])
        offset = np.concatenate([np.arange(len(x)) for x in found]) if found else np.empty(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.window, self.offset = window[order].astype(np.int32), offset[order].astype(np.int32)
        self.gram, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.gram >> np.uint64(64 - _FILTER_BITS)] = True

    def scan(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, window, start, end, edits) of each verified region; start and end in ``data``."""
        if not len(self.gram):
            return
        body, bounds, place = normalised(data, at)
        h = grams(body, self.q)
        hit = np.flatnonzero(self.filter[h >> np.uint64(64 - _FILTER_BITS)])
        i = np.minimum(np.searchsorted(self.gram, h[hit]), len(self.gram) - 1)
        same = self.gram[i] == h[hit]
        hit, i = hit[same], i[same]
        row = np.searchsorted(bounds, hit, "right") - 1
        inside = hit + self.q <= bounds[row + 1]
        hit, i, row = hit[inside], i[inside], row[inside]
        row, window, band = self._bands(hit, i, row)
        lo = np.maximum(bounds[row], band * (self.budget[window] + 1) - self.budget[window])
        hi = np.minimum(bounds[row + 1], (band + 2) * (self.budget[window] + 1) + self.length[window] + self.budget[window])
        # Regions of one shape are aligned together; of equal windows and regions one is enough.
        length, size = self.length[window], hi - lo
        order = np.lexsort((size, length))
        cuts = np.flatnonzero((length[order][1:] != length[order][:-1]) | (size[order][1:] != size[order][:-1])) + 1
        for same in np.split(order, cuts) if len(order) else ():
            for first in range(0, len(same), ALIGNED):
                yield from self._verified(same[first : first + ALIGNED], row, window, lo, hi, body, bounds, place)

    def _bands(self, hit: np.ndarray, gram: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, window and band of the diagonal bands that share enough q-grams. A hit has a posting for each window with its q-gram, so
        hits are taken some at a time, and what is kept of them is a count for each band."""
        n = self.first[gram + 1] - self.first[gram]
        ends = np.cumsum(n)
        held, lo = [np.empty((4, 0), np.int64)], 0
        while lo < len(hit):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + POSTINGS, "right")))
            m, start = n[lo:hi], self.first[gram[lo:hi]]
            k = np.repeat(start - np.cumsum(m) + m, m) + np.arange(m.sum())
            window, diagonal, rows = self.window[k].astype(np.int64), np.repeat(hit[lo:hi], m) - self.offset[k], np.repeat(row[lo:hi], m)
            band = diagonal // (self.budget[window] + 1)
            held.append(_counted(np.tile(rows, 2), np.tile(window, 2), np.concatenate([band, band - 1]), np.ones(2 * len(band), np.int64)))
            if len(held) > 8:
                held = [_counted(*np.concatenate(held, axis=1))]
            lo = hi
        rows, window, band, count = _counted(*np.concatenate(held, axis=1))
        enough = count >= self.least[window]
        return rows[enough], window[enough], band[enough]

    def _verified(self, some: np.ndarray, row: np.ndarray, window: np.ndarray, lo: np.ndarray, hi: np.ndarray, body: np.ndarray, bounds: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """The regions of one shape (window length and region size) that hold their windows."""
        size, region = int(self.length[window[some[0]]]), int(hi[some[0]] - lo[some[0]])
        regions = body[lo[some][:, None] + np.arange(region)]
        pairs = np.concatenate([np.ascontiguousarray(window[some].astype(">u8")).view(np.uint8).reshape(-1, 8), regions], axis=1)
        _, one, which = np.unique(np.ascontiguousarray(pairs).view(np.dtype((np.void, pairs.shape[1]))).ravel(), return_index=True, return_inverse=True)
        patterns = np.stack([self.patterns[w] for w in window[some[one]].tolist()])
        budget = int(self.budget[window[some[0]]])
        edits, ends = (x[which] for x in best_alignments(patterns, regions[one], budget))
        for j in np.flatnonzero(edits <= budget).tolist():
            f = int(some[j])
            w, r, match = int(window[f]), int(row[f]), (int(edits[j]), int(ends[j]))
            if size < MIN_BYTES:
                match = _whole_words(self.patterns[w], body, int(bounds[r]), int(bounds[r + 1]), int(lo[f]), int(hi[f]))
            if match:
                end = int(lo[f]) + match[1]
                start = max(int(lo[f]), end - size)
                yield r, w, int(place[start]), int(place[end - 1]) + 1, match[0]


def _counted(rows: np.ndarray, window: np.ndarray, band: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Equal (row, window, band) put together, their counts added up."""
    if not len(rows):
        return np.empty((4, 0), np.int64)
    order = np.lexsort((band, window, rows))
    rows, window, band, count = rows[order], window[order], band[order], count[order]
    new = np.flatnonzero(np.append(True, (window[1:] != window[:-1]) | (rows[1:] != rows[:-1]) | (band[1:] != band[:-1])))
    return np.stack([rows[new], window[new], band[new], np.add.reduceat(count, new)])


def benchmark_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size; a byte is in WINDOW / STEP + PART / PART_STEP windows."""
    block, n = [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        size = (WINDOW // STEP + PART // PART_STEP) * len((text or "").encode())
        if block and n + size > BLOCK_GRAMS:
            yield block
            block, n = [], 0
        block.append((item, text))
        n += size
    if block:
        yield block


_LEAKS = "doc_id long, item_id long, start long, end long, edits long"


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (bytes of the text, of the item's first region), edits (the least of its regions)."""
    out = None
    for items in benchmark_blocks(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(LeakIndex(items))  # BLOCK_GRAMS at most

        def scan(batches, index=index):
            for batch in batches:
                ids = batch.column(0)
                for lo, _, data, at in K.text_slices(batch.column(1)):
                    best: dict = {}
                    for r, w, start, end, edits in index.value.scan(data, at):
                        found = (index.value.part[w], start - int(at[r]), end - int(at[r]), edits)
                        for item in index.value.owners[w]:
                            key = (lo + r, item)
                            old = best.get(key, found)
                            if old[0] != found[0]:
                                best[key] = min(old, found)  # windows of the first kind go before parts
                            else:
                                best[key] = (*min(old[:3], found[:3]), min(old[3], edits))
                    yield pa.RecordBatch.from_pylist(
                        [{"doc_id": ids[r].as_py(), "item_id": item, "start": a, "end": b, "edits": e} for (r, item), (_, a, b, e) in best.items()],
                        schema=pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "start", "end", "edits")]),
                    )

        rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(K.tidy(scan), _LEAKS)
        out = rows if out is None else out.union(rows)
    return docs.sparkSession.createDataFrame([], _LEAKS) if out is None else out


def _leaks(index) -> Callable:
    """A column function: whether a text holds a window of the (broadcast) index."""
    @F.arrow_udf("boolean")
    def leaks(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text), bool)
        for lo, _, data, at in K.text_slices(text):
            for r, *_ in index.value.scan(data, at):
                out[lo + r] = True
        return pa.array(out)

    return leaks


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark window is found."""
    context = docs.sparkSession.sparkContext
    blocks = benchmark_blocks(benchmark)
    one, more = next(blocks, None), next(blocks, None)
    if one is None:
        return docs
    if more is None:
        return docs.where(~_leaks(context.broadcast(LeakIndex(one)))("text"))
    # Several blocks: a pass for each tells the rows that go, so that a worker holds one index at a time.
    work, key = Workspace(docs.sparkSession, "leaks"), free_name(docs, "__key")
    keyed = docs.withColumn(key, row_key())
    found = None
    for items in chain((one, more), blocks):
        rows = keyed.where(_leaks(context.broadcast(LeakIndex(items)))("text")).select(key)
        found = rows if found is None else found.union(rows)
    return keyed.join(few(work.save(found.distinct(), "found")), key, "left_anti").select(docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
