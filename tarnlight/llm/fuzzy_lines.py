"""Fuzzy line dedup: pairs of a line's rare words, edit similarity, one occurrence kept.

A line is normalised to its words (runs of letters and digits, A-Z
lower-cased) with one space between. Lines of equal normal form are one class.
Classes of MIN_WORDS words or more link when their edit distance is at most a
tenth of the longer one. Candidates share two of their SKETCH words, in the same
order: the words of least hash over weight, where the weight grows with a word's
length, so edits elsewhere do not change which words are chosen, and they stand
within the allowed edits of the same place. That is a sampling, not a bound: a
pair whose edits touch most of its words can be missed (the README has the
measured recall, and why blocks of SimHash bits found less). Counts of letters
refute most candidates and no similar pair. Of each connected group only the
first occurrence (smallest id, then line) stays.

Equal lines of a task are put together before they are dealt out: one goes to
its class, the others only tell where they stand. So a line that stands in a
third of all documents loads no task.

Edge cases: null and empty texts have no lines; lines without a word are never
dropped; a line of any length is one line; null ids sort last; rows of equal
id and text are one document, whose result each of them gets; an empty table
gives an empty result; other columns pass through ``drop_repeated_lines``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnlight.llm import kernels as K, similarity as S
from tarnlight.llm.components import connected_components
from tarnlight.llm.edits import BAND, Letters, within
from tarnlight.llm.similarity import BROADCAST_ROWS, LIST_ENTRIES, Packer, SimilarityJoin, few, free_name, numbers, ranked, row_key

MIN_WORDS = 5
#: Words of a line of which candidates share two.
SKETCH = 6
#: Edits allowed, as a share of the longer line.
EDITS = 0.1
#: Counts of letters in a sketch, each 255 at most.
BUCKETS = 32
#: Bytes of a word as they are, but A-Z lower-cased, and a space for each other.
_LETTERS = np.where(K.NOT_ALNUM[K.LOWER], 32, K.LOWER).astype(np.uint8).tobytes()
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A line's characters, counts of letters, and of SKETCH words as they follow each other hashes (0 where there are fewer) and places (65,535 at most).
SKETCHES = np.dtype([("chars", "<u4"), ("letters", "u1", BUCKETS), ("word", "<u4", SKETCH), ("place", "<u2", SKETCH)])
#: A line as it is dealt to its class, and one that its task has told of already.
_FIRST = np.dtype([("one", "<u8"), ("two", "<u8"), ("unnamed", "?"), ("doc", "<i8"), ("key", "<i8"), ("line", "<i4"), ("k", "<i8"), ("long", "?"), ("sketch", SKETCHES)])
_COPY = np.dtype([("one", "<u8"), ("two", "<u8"), ("chars", "<u4"), ("key", "<i8"), ("line", "<i4")])
#: Lines of a task that are put together at once.
_HELD = 1 << 17
#: Members of lists that are verified together, pairs whose sketches are compared at once, and pairs between two looks at what is joined.
_TOGETHER, _SEEN, _PAIRS = 1 << 13, 1 << 16, 1 << 12
#: Turns in which lists are dealt out with their texts, and members that are dealt in one.
_TURNS, _ONE_TURN = 4, 1 << 16


def normal_form(line: str) -> str:
    return b" ".join(line.encode("utf-8", "surrogatepass").translate(_LETTERS).split()).decode("utf-8", "surrogatepass")


def line_table(texts: pa.Array):
    """(row, line, words, name (16 bytes), characters, sketch) of each line with a word; lines from 0.

    A sketch: see SKETCHES.
    """
    for lo, hi, data, at in K.text_slices(texts):
        low = K.LOWER[data]
        starts, ends, rows = K.spans(low, at, K.NOT_ALNUM)
        if not len(starts):
            continue
        h = K.span_hashes(low, starts, ends)
        breaks = np.concatenate([[0], np.cumsum(low == 10, dtype=np.int64)])
        line = breaks[starts]
        new = np.append(True, (line[1:] != line[:-1]) | (rows[1:] != rows[:-1]))
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(starts)))
        of = np.cumsum(new) - 1
        place = (np.arange(len(h)) - first[of]).astype(np.uint64)
        one, two = (np.add.reduceat(K.mix(h * np.uint64(odd) + place * _ODD), first) for odd in (1, 5))
        name = np.concatenate([K.mix(x ^ n.astype(np.uint64)).view(np.uint8).reshape(-1, 8) for x in (one, two)], axis=1)

        mark = np.zeros(len(low), np.int32)
        mark[starts[first]] = 1
        letter = np.flatnonzero(~K.NOT_ALNUM[low] & ((low & 0xC0) != 0x80))
        bucket = (np.cumsum(mark, dtype=np.int32)[letter] - 1) * BUCKETS + (low[letter] & (BUCKETS - 1))
        counts = np.bincount(bucket, minlength=len(first) * BUCKETS).reshape(-1, BUCKETS)
        chars = counts.sum(1) + n - 1
        counts[:, 0] += n - 1
        sketch = np.zeros(len(first), SKETCHES)
        sketch["chars"], sketch["letters"] = chars, np.minimum(counts, 255)
        # Where a word begins in the normal form: the letters before it, and a space for each word before.
        letters = np.zeros(len(low) + 1, np.int64)
        letters[letter + 1] = 1
        np.cumsum(letters, out=letters)
        begins = letters[starts] - letters[starts[first]][of] + place.astype(np.int64)
        sketch_words(h, of, ends - starts, begins, sketch)
        row = rows[first]
        yield lo + row, line[first] - breaks[at[row]], n, name, chars, sketch


def sketch_words(h: np.ndarray, of: np.ndarray, size: np.ndarray, begins: np.ndarray, sketch: np.ndarray) -> None:
    """Sets word and place of each line's sketch: SKETCH distinct words, in the order in which they first stand there.

    Words have hash h, line ``of`` (ascending), size bytes, and begin at a character of the normal form.
    """
    n = len(sketch)
    h = K.mix(h)
    rank = (-np.log(((h >> np.uint64(11)) + np.uint64(1)) / 2.0**53) / np.maximum(size - 2, 0.15) ** 2).astype(np.float32)
    bits = max(len(h) - 1, 1).bit_length()
    if bits + max(n - 1, 1).bit_length() <= 34:  # line, rank and place in one number
        key = (of.astype(np.uint64) << np.uint64(30) | (rank.view(np.uint32) >> np.uint32(2)).astype(np.uint64)) << np.uint64(bits) | np.arange(len(h), dtype=np.uint64)
        key.sort()
        order = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    else:
        order = np.lexsort((rank, of))
    own, words = of[order], h[order]
    order = order[np.append(True, (words[1:] != words[:-1]) | (own[1:] != own[:-1]))]
    count = np.bincount(of[order], minlength=n)
    order = order[np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count) < SKETCH]
    order.sort()
    own = of[order]
    count = np.bincount(own, minlength=n)
    nth = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
    sketch["word"][own, nth] = h[order].astype(np.uint32) | np.uint32(1)
    sketch["place"][own, nth] = np.minimum(begins[order], 65535)


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Myers' bit-parallel Levenshtein distance; equal ends are cut off first. Beyond ``most`` any number over it."""
    n = min(len(a), len(b))
    k = next((i for i in range(n) if a[i] != b[i]), n)
    a, b, n = a[k:], b[k:], n - k
    k = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score, left = full, 0, len(a), len(b)
    for c in b:
        eq = at.get(c, 0)
        xv = eq | minus
        xh = ((eq & plus) + plus ^ plus) | eq
        up, down = minus | ~(xh | plus) & full, plus & xh
        score += bool(up & top) - bool(down & top)
        left -= 1
        if most is not None and score - left > most:
            return score - left
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | ~(xv | up) & full, up & xv
    return score


def similar_lines(a: str, b: str) -> bool:
    """Whether two normal forms are within EDITS of each other."""
    most = int(EDITS * max(len(a), len(b)))
    return abs(len(a) - len(b)) <= most and edit_distance(a, b, most) <= most


def _unpacked(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), SKETCHES)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Edits between lines at least, by their letters and lengths, over the edits allowed; NaN beyond, or without two words (one of a line of one word) in common within them.

    x: one sketch for each of y, or one for all.
    """
    n, k = x["chars"].astype(np.int64), y["chars"].astype(np.int64)
    most = (EDITS * np.maximum(n, k)).astype(np.int64)
    edits = np.maximum((np.abs(x["letters"].astype(np.int16) - y["letters"].astype(np.int16)).sum(-1, dtype=np.int64) + 1) // 2, np.abs(n - k))
    out = np.where(edits <= most, edits / np.maximum(most, 1), np.nan)
    left = np.flatnonzero(edits <= most)
    if len(left):
        x = x[left] if x.shape else x
        y, most = y[left], most[left]
        place = np.abs(x["place"].astype(np.int64)[..., :, None] - y["place"].astype(np.int64)[:, None, :]) <= most[:, None, None]
        both = ((x["word"][..., :, None] == y["word"][:, None, :]) & (y["word"] > 0)[:, None, :] & place).sum((1, 2))
        few_words = (y["word"] > 0).sum(1) < 2
        out[left[(both < 2) & ~(few_words & (both > 0))]] = np.nan
    return out


class _Classes:
    """Puts the equal lines of a task together and deals them out: rows part, copies, blob."""

    def __init__(self, parts: int):
        self.parts, self.held, self.n = parts, [], 0

    def add(self, lines: np.ndarray):
        self.held.append(lines)
        self.n += len(lines)
        if self.n >= _HELD:
            yield from self.flush()

    def flush(self):
        if not self.n:
            return
        rows = np.concatenate(self.held)
        self.held, self.n = [], 0
        rows, first = in_classes(rows)
        rest = rows[~first]
        copies = np.zeros(len(rest), _COPY)
        for name in ("one", "two", "key", "line"):
            copies[name] = rest[name]
        copies["chars"] = rest["sketch"]["chars"]
        heads = rows[first]
        heads["k"] = np.add.reduceat(rows["k"], np.flatnonzero(first))
        yield from self._dealt(heads["one"] >> np.uint64(18), heads, False)
        yield from self._dealt(copies["key"].view(np.uint64) + copies["line"].astype(np.uint64), copies, True)

    def _dealt(self, by: np.ndarray, rows: np.ndarray, copies: bool):
        if not len(rows):
            return
        part = (K.mix(by) % np.uint64(self.parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, rows = part[order], rows[order]
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        blobs = [rows[a:b].tobytes() for a, b in zip(starts, np.append(starts[1:], len(rows)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(np.full(len(starts), copies)), pa.array(blobs, pa.binary())], ["part", "copies", "blob"])


def _numbers(one: np.ndarray, chars: np.ndarray) -> np.ndarray:
    return numbers(chars.astype(np.int64), one)


def in_classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by name, the first occurrence (smallest id, nulls last, then key and line) before the others, and which rows are first."""
    rows = rows[np.lexsort((rows["line"], rows["key"], rows["doc"], rows["unnamed"], rows["two"], rows["one"]))]
    return rows, np.append(True, (rows["one"][1:] != rows["one"][:-1]) | (rows["two"][1:] != rows["two"][:-1]))


_MEMBERS = "node long, doc_id long, key long, line int, k long, long boolean, sketch binary, number long, name binary, ranked long"


def _read_classes(batches):
    """Whole partitions of _Classes' rows to _MEMBERS: a row for each class, with its first occurrence, its size and sketch; and one for each other occurrence, without.

    node: the class's number, or another where two classes have the same; then number and name tell which.
    ranked: another number, by which the join knows the class. Classes that could agree in either are in one partition.
    """
    names = [x.split()[0] for x in _MEMBERS.split(", ")]
    heads, copies = [], []
    for batch in batches:
        for copy, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            (copies if copy else heads).append(np.frombuffer(blob, _COPY if copy else _FIRST))
    if copies:
        rows = np.concatenate(copies)
        number = _numbers(rows["one"], rows["chars"])
        yield _members(names, number, None, rows["key"], rows["line"], None, None, None, number, rows, None)
    if not heads:
        return
    rows, first = in_classes(np.concatenate(heads))
    starts = np.flatnonzero(first)
    size = np.add.reduceat(rows["k"], starts)
    number = _numbers(rows["one"], rows["sketch"]["chars"])
    own = _unlike(number[starts], rows[starts])
    by_copies = _unlike(ranked(rows["sketch"]["chars"][starts].astype(np.int64), size, rows["one"][starts]), rows[starts])
    node = own[np.cumsum(first) - 1]
    doc = pa.array(rows["doc"][first], mask=rows["unnamed"][first])
    yield _members(names, node[first], doc, rows["key"][first], rows["line"][first], size, rows["long"][first], rows["sketch"][first], number[first], rows[first], by_copies)
    yield _members(names, node[~first], None, rows["key"][~first], rows["line"][~first], None, None, None, None, None, None)


def _unlike(number: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The numbers, of equal ones but the first replaced by negative hashes of the names."""
    order = np.argsort(number, kind="stable")
    again = order[np.append(False, number[order][1:] == number[order][:-1])]
    out = number.copy()
    out[again] = (K.mix(heads["one"][again] ^ K.mix(heads["two"][again])) | np.uint64(1 << 63)).view(np.int64)
    return out


def _members(names, node, doc, key, line, k, long, sketch, number, named, ranks):
    n = len(node)
    name = pa.nulls(n, pa.binary()) if named is None else pa.array([a.tobytes() + b.tobytes() for a, b in zip(named["one"], named["two"], strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([
        pa.array(node), pa.nulls(n, pa.int64()) if doc is None else doc, pa.array(key), pa.array(line), pa.nulls(n, pa.int64()) if k is None else pa.array(k),
        pa.nulls(n, pa.bool_()) if long is None else pa.array(long), pa.nulls(n, pa.binary()) if sketch is None else pa.array([x.tobytes() for x in sketch], pa.binary()),
        pa.nulls(n, pa.int64()) if number is None else pa.array(number), name, pa.nulls(n, pa.int64()) if ranks is None else pa.array(ranks),
    ], names)


def _verified_pairs(batches):
    """As SimilarityJoin.verifier, many pairs at once."""
    now, texts, u, v, x, y = None, [], [], [], [], []
    at = -1  # the pivot's text

    def tested():
        some, letters = np.arange(len(x)), Letters(texts)
        fit = _similar(texts, letters, np.array(x, np.int64), np.array(y, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)[some[fit]]) for c in (u, v)], ["u", "v"])

    for batch in batches:
        for t, salt, a, body in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if a is None:
                now, at = (t, salt), len(texts)
                texts.append(normal_form(body))
            elif (t, salt) == now:
                x.append(len(texts))
                y.append(at)
                u.append(a)
                v.append(t)
                texts.append(normal_form(body))
        if len(x) >= _PAIRS:
            yield tested()
            texts, u, v, x, y = [texts[at]], [], [], [], []
            at = 0
    if x:
        yield tested()


def _verified_lists(batches):
    """sig, cell, block, node, component, odd, sketch, body, sorted by cells of lists, to u, v: links that join the components of a cell, by a few."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, cell = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        new = np.flatnonzero((sig[1:] != sig[:-1]) | (cell[1:] != cell[:-1])) + 1
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            if (last.column(0)[0].as_py(), last.column(1)[0].as_py()) != (sig[0], cell[0]):
                new = np.append(0, new)
        if n + batch.num_rows >= _TOGETHER and len(new):
            cut = int(new[-1])
            held.append(batch.slice(0, cut))
            yield _joined(pa.Table.from_batches(held))
            held, n = [], 0
            batch = batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
    if n:
        yield _joined(pa.Table.from_batches(held))


def _joined(rows: pa.Table) -> pa.RecordBatch:
    """The links of whole cells, those within what links before them joined left out."""
    sig, cell, block, node, component, odd = (rows.column(k).to_numpy() for k in range(6))
    texts = [normal_form(x) for x in rows.column(7).to_pylist()]
    sketch = _unpacked(rows.column(6).to_pylist())
    of = np.cumsum(np.append(False, (sig[1:] != sig[:-1]) | (cell[1:] != cell[:-1])))
    chars = sketch["chars"].astype(np.int64)
    order = np.lexsort((chars, of))
    of, chars, block, node, odd, sketch = (x[order] for x in (of, chars, block, node, odd, sketch))
    letters, texts = Letters([texts[i] for i in order]), [texts[i] for i in order]
    crossed = np.zeros(int(of[-1]) + 1, bool)  # cells of two blocks
    crossed[of[block != block[np.searchsorted(of, of)]]] = True
    _, group = np.unique(component[order], return_inverse=True)
    up = list(range(int(group.max()) + 1))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    wide = np.int64(int(chars.max()) * 2 + 4)
    key = of * wide + chars
    ones = np.flatnonzero(odd)
    lo = np.searchsorted(key, of[ones] * wide + (chars[ones] * (1 - EDITS)).astype(np.int64), "left")
    hi = np.searchsorted(key, of[ones] * wide + (chars[ones] / (1 - EDITS)).astype(np.int64) + 1, "right")
    ends = np.cumsum(hi - lo)
    u, v, first = [], [], 0
    while first < len(ones):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + _SEEN, "right")))
        k = (hi - lo)[first:last]
        x = np.repeat(ones[first:last], k)
        y = np.arange(len(x)) + np.repeat(lo[first:last] - (np.cumsum(k) - k), k)
        first = last
        now = np.fromiter(map(root, range(len(up))), np.int64, len(up))[group]
        apart = (now[x] != now[y]) & (~odd[y] | (y > x)) & (~crossed[of[x]] | (block[x] != block[y]))
        x, y = x[apart], y[apart]
        far = _far(sketch[x], sketch[y])
        near = np.flatnonzero(~np.isnan(far))
        near = near[np.argsort(far[near], kind="stable")]
        at = 0
        while at < len(near):
            some = near[at : at + _PAIRS]
            at += len(some)
            now = np.fromiter(map(root, range(len(up))), np.int64, len(up))[group]
            some = some[now[x[some]] != now[y[some]]]
            some = some[_similar(texts, letters, x[some], y[some])]
            for a, b in zip(x[some].tolist(), y[some].tolist(), strict=True):
                p, q = root(int(group[a])), root(int(group[b]))
                if p != q:
                    up[q] = p
                    u.append(node[a])
                    v.append(node[b])
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _similar(texts: list[str], letters: Letters, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the texts of each pair x, y are similar."""
    most = (EDITS * np.maximum(letters.size[x], letters.size[y])).astype(np.int64)
    same = np.zeros(len(x), bool)
    banded = np.flatnonzero(most <= BAND)
    same[banded] = within(letters, x[banded], y[banded], most[banded])
    for k in np.flatnonzero(most > BAND).tolist():
        same[k] = similar_lines(texts[x[k]], texts[y[k]])
    return same


class LineJoin(SimilarityJoin):
    """One run over docs; ``lines()`` is its result."""

    ratio = 1 - EDITS
    by_copies = True

    def __init__(self, docs: DataFrame):
        super().__init__(docs, "lines")

    def bodies(self, docs, wanted):
        per = wanted.groupBy("key").agg(F.collect_list(F.struct("line", "t", "salt", "a")).alias("wanted"))

        def pick(batches):
            for batch in batches:
                out = []
                for text, own in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    lines = text.as_py().split("\n")
                    out += [{"t": w["t"], "salt": w["salt"], "a": w["a"], "body": lines[w["line"]]} for w in own]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("t", pa.int64()), ("salt", pa.int32()), ("a", pa.int64()), ("body", pa.string())]))

        per = self.work.save(per, "per-document")
        return docs.join(F.broadcast(per) if wanted.count() <= BROADCAST_ROWS // 8 else per, "key").select("text", "wanted").mapInArrow(pick, "t long, salt int, a long, body string")

    def prepared(self):
        return normal_form

    def similar(self):
        return similar_lines

    def verifier(self):
        return _verified_pairs

    def sketched(self):
        def block(sketches):
            rows = _unpacked(sketches)
            order = np.argsort(rows["chars"], kind="stable")
            rows = rows[order]

            def find(others):
                for other in _unpacked(others):
                    n = int(other["chars"])
                    lo, hi = np.searchsorted(rows["chars"], [int(n * (1 - EDITS)), int(n / (1 - EDITS)) + 1])
                    far = _far(other, rows[lo : hi + 1])
                    at = np.flatnonzero(~np.isnan(far))
                    yield order[lo + at], far[at]

            return find

        return block

    def refuted(self):
        return lambda xs, ys: _far(_unpacked(xs), _unpacked(ys)) if xs else np.zeros(0)

    def _entries(self, parts: int) -> DataFrame:
        hot = self.hot

        def emit(batches):
            packer, i, j = Packer(parts, hot), *np.triu_indices(SKETCH, 1)
            for batch in batches:
                if not batch.num_rows:
                    continue
                node = batch.column(0).to_numpy(zero_copy_only=False)
                words = _unpacked(batch.column(1).to_pylist())["word"].astype(np.uint64)
                words[:, 1] = np.where(words[:, 1] == 0, words[:, 0], words[:, 1])  # a line of one word, over and over
                sig = K.mix(K.mix(words[:, i]) * np.uint64(3) + words[:, j])
                has = (words[:, i] > 0) & (words[:, j] > 0)
                yield from packer.add(sig[has], np.broadcast_to(node[:, None], has.shape)[has])
            yield from packer.flush()

        return self.items.select("node", "sketch").mapInArrow(emit, "part int, hot boolean, blob binary")

    def groups(self, entries: DataFrame, parts: int) -> DataFrame:
        """As SimilarityJoin's; lists that still hold several components are verified where they stand, so that no pair is named."""
        work = self.work
        found, components, mixed = self._by_pivots(entries, parts)
        if mixed.isEmpty():
            return components
        for label in ("dealt", "lists"):  # what is dropped here does not stand beside the texts
            work.drop(label)
        # Only items of these lists are dealt out with their sketches, not all.
        at = work.save(self.items.join(few(mixed.select("node").distinct()), "node", "left_semi"), "within-items")
        wanted = work.save(at.select("key", "line", F.col("node").alias("t"), F.lit(0).alias("salt"), F.lit(None).cast("long").alias("a")), "texts-wanted")
        docs = self.docs.select("key", "text")
        if self.rows_repeat:
            docs = docs.join(few(wanted.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"])
        texts = work.save(self.bodies(docs, wanted).select(F.col("t").alias("node"), "body").join(at.select("node", "sketch"), "node"), "texts")
        for label in ("texts-wanted", "per-document", "within-items"):
            work.drop(label)
        work.settle()
        # Of a list, those outside its largest component meet all others; a long list is dealt to blocks, and each two of them meet in a cell.
        share = mixed.groupBy("sig", "component").agg(F.count("*").alias("k"))
        most = share.groupBy("sig").agg(F.max_by("component", F.struct("k", "component")).alias("most"))
        blocks = F.ceil(F.col("members") / S.BLOCK_MEMBERS).cast("int")
        rows = mixed.join(most, "sig").select("sig", "node", "component", (F.col("component") != F.col("most")).alias("odd"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), blocks.alias("blocks"))
        rows = rows.join(texts, "node")
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cell = (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).alias("cell")
        rows = rows.select("sig", cell, "block", "node", "component", "odd", "sketch", "body")
        # Lists are dealt out in turns, for a text stands in each of its lists; so a share of that is on disk at once.
        turns = _TURNS if mixed.count() > _ONE_TURN else 1
        links = []
        for turn in range(turns):
            own = rows.where(F.pmod(F.xxhash64("sig"), F.lit(turns)) == turn).repartition(parts, "sig", "cell").sortWithinPartitions("sig", "cell")
            links.append(work.save(own.mapInArrow(K.tidy(_verified_lists), "u long, v long"), f"within-{turn}"))
            work.settle()
        for label in ("mixed", "texts"):
            work.drop(label)
        whole = connected_components(reduce(DataFrame.union, links, found), work, "whole")
        work.settle()
        return whole

    def lines(self) -> tuple[DataFrame, DataFrame]:
        """Two tables, by key: n_lines (with a word) of each document that has any, and the lines that go: line, class_doc, class_line (the occurrence that stays)."""
        self.rows_repeat = not self.docs.groupBy("key").count().where("count > 1").isEmpty()
        docs = self.docs.dropDuplicates(["key"]) if self.rows_repeat else self.docs
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.docs.rdd.getNumPartitions())

        def emit(batches):
            classes = _Classes(parts)
            for batch in batches:
                ids, keys = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
                unnamed, doc = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
                for row, line, n, name, _, sketch in line_table(batch.column(2)):
                    rows = np.zeros(len(row), _FIRST)
                    rows["one"], rows["two"] = (np.ascontiguousarray(name[:, 8 * k : 8 * k + 8]).view(np.uint64).ravel() for k in range(2))
                    rows["unnamed"], rows["doc"], rows["key"], rows["line"] = unnamed[row], doc[row], keys[row], line
                    rows["k"], rows["long"], rows["sketch"] = 1, n >= MIN_WORDS, sketch
                    yield from classes.add(rows)
            yield from classes.flush()

        dealt = docs.mapInArrow(emit, "part int, copies boolean, blob binary").repartitionById(parts, F.col("part"))
        members = self.work.save(dealt.mapInArrow(_read_classes, _MEMBERS), "members")
        self.work.settle()
        classes = members.where("k is not null")
        other = classes.where("node <> number").select("number", "name", F.col("node").alias("other"))
        if not other.isEmpty():  # copies of a class that has not the number of its name
            members = members.join(other, ["number", "name"], "left").withColumn("node", F.coalesce("other", "node"))
        members = members.select("node", "doc_id", "key", "line", "k")
        self.items, self.renumbered = classes.where("long").select(F.col("ranked").alias("node"), "key", "line", "sketch"), None
        total = self.items.count()
        linked = self.groups(self._entries(parts_of := max(parts, -(-total * SKETCH * (SKETCH - 1) // 2 // LIST_ENTRIES))), parts_of)
        # The first occurrence of each component of several classes, and of each class of several lines.
        place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key", "line")
        several = linked.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node")).union(linked.select("node", "component"))
        named = classes.select("node", "ranked", place.alias("first")).join(several.withColumnRenamed("node", "ranked"), "ranked")
        least = named.groupBy("component").agg(F.min("first").alias("stays"))
        stays = named.select("node", "component").join(least, "component").select("node", "stays")
        own = classes.where("k > 1").select("node", place.alias("own"))
        stays = own.join(stays, "node", "full").select("node", F.coalesce("stays", "own").alias("stays"))
        gone = members.join(stays, "node").where((F.col("key") != F.col("stays.key")) | (F.col("line") != F.col("stays.line")))
        gone = gone.select("key", F.col("line").cast("long").alias("line"), F.col("stays.doc_id").alias("class_doc"), F.col("stays.line").cast("long").alias("class_line"))
        return members.groupBy("key").agg(F.count("*").alias("n_lines")), gone


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_lines (with a word), dropped (numbers of the lines that go, ascending) of every row of docs."""
    join = LineJoin(docs)
    counts, gone = join.lines()
    per = gone.groupBy("key").agg(F.sort_array(F.collect_set("line")).alias("dropped"))
    return (
        join.docs.select("doc_id", "key").join(counts.join(per, "key", "left"), "key", "left")
        .select("doc_id", "key", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("dropped", F.array().cast("array<bigint>")).alias("dropped"))
    )


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with their texts cut to the lines that stay; all other columns as they are."""
    key, dropped = free_name(docs, "__key"), free_name(docs, "__dropped")
    gone = LineJoin(docs).lines()[1].groupBy(F.col("key").alias(key)).agg(F.collect_set("line").alias(dropped))
    rows = docs.withColumn(key, row_key()).join(gone, key, "left")
    stays = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(dropped, i.cast("long")))
    return rows.withColumn("text", F.when(F.col(dropped).isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))).select(docs.columns)


def op3(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (with a word), n_dropped, dropped (line numbers from 0, comma-joined) of every document."""
    return dropped_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped"),
    )
