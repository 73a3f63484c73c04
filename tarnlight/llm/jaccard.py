"""N-gram Jaccard self-join of documents: size-aware, heavy and light.

A document's set holds its distinct shingles of five words. Two sets of Jaccard
similarity t or more share c shingles within the first |s| - ceil(t |s|) + c of
any one order of all shingles. Small ("light") sets enumerate all subsets of
fixed size c = 2 of that prefix, so light pairs meet at whole subsets. Large
("heavy") sets put the prefix for c = 1 on inverted lists, single shingles, and
so do light sets that a heavy one can reach. The boundary is the size at which
the cost of enumerating, summed over the sizes at hand, is least. Frequent
shingles come last in the order, so few lists are long.

Lists are not expanded into pairs (see ``similarity``). A set's sketch holds, in
four bits a shingle or more, the parities of how many of its shingles fall in
each bit. Two sets differ in at least as many shingles as their parities differ
in bits, so a sketch refutes a pair only if it is not similar; what is left is
verified on the shingles of the texts themselves.

What is bounded: the shingles that are ordered by frequency, at most
``ORDERED`` (counted over all documents, within batches of BATCH shingles;
any order gives the same result).

Edge cases: null and blank texts have an empty set and link with nothing; a
text of under five words has one shingle, all its words; equal sets are one
class, so copies cost one set; a component's id is the smallest id in it that is
not null, and of a component whose rows all have null ids null; repeated ids are
rows of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnlight.llm import kernels as K
from tarnlight.llm.similarity import LIST_ENTRIES, Packer, SimilarityJoin, binary_rows, few, free_name, numbers, row_key

WIDTH = 5
#: Similarity in hundredths.
PERCENT = 75
#: Shingles at most that are ordered by their frequency: 4 MB in each worker.
ORDERED = 1 << 18
BATCH = 1 << 21
#: Cost of verifying a chance candidate, in emitted signatures.
VERIFY_COST = 20
LARGEST_LIGHT = 200
_COUNT = struct.Struct("<Q")


def at_least(n, percent: int = PERCENT):
    """ceil(percent / 100 * n): shared shingles that a set of n needs with any partner."""
    return -(-percent * n // 100)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row of each shingle, shingle), sorted by row and shingle, distinct in a row."""
    for lo, hi, data, at in K.text_slices(texts):
        data = K.LOWER[data]
        starts, ends, rows = K.spans(data, at, K.BLANK)
        h = K.span_hashes(data, starts, ends)
        found, first = K.windows(h, rows, width)
        of, got = [rows[first]], [found]
        short = K.row_counts(rows, hi - lo)
        for k in range(1, width):
            if (short == k).any():
                found, first = K.windows(h, rows, k)
                own = short[rows[first]] == k
                of.append(rows[first][own])
                got.append(found[own])
        of, got = np.concatenate(of), np.concatenate(got)
        if len(short) and short.min() < width:
            order = np.argsort(of, kind="stable")
            of, got = of[order], got[order]
        K.sort_rows(got, np.concatenate([[0], np.cumsum(K.row_counts(of, hi - lo))]))
        new = np.ones(len(got), bool)
        new[1:] = (got[1:] != got[:-1]) | (of[1:] != of[:-1])
        yield lo, hi, of[new], got[new]


def node_names(n: np.ndarray, of: np.ndarray, h: np.ndarray) -> np.ndarray:
    """16 bytes for each set: its size (4, big-endian) and a 96-bit hash of it."""
    out = np.zeros((len(n), 16), np.uint8)
    out[:, :4] = n.astype(">u4").view(np.uint8).reshape(-1, 4)
    full = np.flatnonzero(n)
    if len(full):
        first = np.searchsorted(of, full)
        one, two = np.add.reduceat(K.mix(h), first), np.add.reduceat(K.mix(h ^ np.uint64(0x5851F42D4C957F2D)), first)
        out[full, 4:12] = one.view(np.uint8).reshape(-1, 8)
        out[full, 12:] = two.view(np.uint8).reshape(-1, 8)[:, :4]
    return out


def set_ids(n: np.ndarray, names: np.ndarray) -> np.ndarray:
    return numbers(n, np.ascontiguousarray(names[:, 4:12]).view(np.uint64).ravel())


def parities(n: np.ndarray, of: np.ndarray, h: np.ndarray) -> pa.Array:
    """A sketch for each set: its size (8 bytes), and parity bits, a power of two of at least four a shingle."""
    bits = np.where(n > 0, 1 << np.ceil(np.log2(np.maximum(4 * n, 64))).astype(np.int64), 0)
    ends = np.cumsum(bits)
    odd = np.bincount((ends - bits)[of] + (h & (bits[of] - 1).astype(np.uint64)).astype(np.int64), minlength=int(ends[-1]) if len(ends) else 0) & 1
    body = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return pa.array([_COUNT.pack(k) + body[(e - b) // 8 : e // 8] for k, b, e in zip(n.tolist(), bits.tolist(), ends.tolist(), strict=True)], pa.binary())


def _parity(sketch: bytes) -> tuple[int, int, int]:
    """Size, bits as an integer, and how many they are."""
    return _COUNT.unpack_from(sketch)[0], int.from_bytes(sketch[8:], "little"), 8 * (len(sketch) - 8)


def parity_distance(x: bytes, y: bytes, percent: int) -> float:
    """Shingles in which two sets differ at least, over their sizes; NaN if they cannot be similar."""
    (n, p, a), (k, q, b) = _parity(x), _parity(y)
    while a > b:
        a //= 2
        p = (p ^ p >> a) & ((1 << a) - 1)
    while b > a:
        b //= 2
        q = (q ^ q >> b) & ((1 << b) - 1)
    differ = max((p ^ q).bit_count(), abs(n - k))
    return differ / (n + k) if differ * (100 + percent) <= (n + k) * (100 - percent) else np.nan


class ParityBlock:
    """Sketches of a block by their number of bits, to be compared with one sketch at a time."""

    def __init__(self, sketches: list[bytes], percent: int):
        self.percent = percent
        self.size = np.array([_COUNT.unpack_from(x)[0] for x in sketches], np.int64)
        width = np.array([len(x) - 8 for x in sketches])
        self.by = {}
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            words = np.frombuffer(b"".join(sketches[i][8:] for i in rows), "<u8").reshape(len(rows), -1)
            self.by[w] = rows, words

    def near(self, sketch: bytes) -> tuple[np.ndarray, np.ndarray]:
        n, width = _COUNT.unpack_from(sketch)[0], len(sketch) - 8
        at, far = [], []
        for w, (rows, words) in self.by.items():
            fits = (self.size[rows] * 100 >= n * self.percent) & (n * 100 >= self.size[rows] * self.percent)
            if not fits.any():
                continue
            rows, words, own = rows[fits], words[fits], np.frombuffer(sketch, "<u8", offset=8)
            while words.shape[1] > len(own):
                words = words[:, : words.shape[1] // 2] ^ words[:, words.shape[1] // 2 :]
            while len(own) > words.shape[1]:
                own = own[: len(own) // 2] ^ own[len(own) // 2 :]
            differ = np.maximum(np.bitwise_count(words ^ own).sum(1, dtype=np.int64), np.abs(self.size[rows] - n))
            both = self.size[rows] + n
            close = differ * (100 + self.percent) <= both * (100 - self.percent)
            at.append(rows[close])
            far.append(differ[close] / both[close])
        return (np.concatenate(at), np.concatenate(far)) if at else (np.empty(0, np.int64), np.empty(0))


_SETS = "doc_id long, key long, n long, name binary, id long, sketch binary, shingle long, df long"


def _describe(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """doc_id, key, n, name, id and sketch of each row; besides, shingle and df for shingles found in several documents of a batch."""
    names = ["doc_id", "key", "n", "name", "id", "sketch", "shingle", "df"]
    held: list[np.ndarray] = []

    def frequent():
        every = np.concatenate(held)
        every.sort()
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        count = np.diff(np.append(first, len(every)))
        value, count = every[first[count > 1]], count[count > 1]
        none = pa.nulls(len(value), pa.int64())
        blank = pa.nulls(len(value), pa.binary())
        return pa.RecordBatch.from_arrays([none, none, none, blank, none, blank, pa.array(value.view(np.int64)), pa.array(count.astype(np.int64))], names)

    for batch in batches:
        for lo, hi, of, h in shingle_sets(batch.column(2), width):
            n = K.row_counts(of, hi - lo)
            name = node_names(n, of, h)
            none = pa.nulls(hi - lo, pa.int64())
            ids = [batch.column(k).slice(lo, hi - lo) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(n), binary_rows(name), pa.array(set_ids(n, name)), parities(n, of, h), none, none], names)
            held.append(h)
            if sum(map(len, held)) >= BATCH:
                yield frequent()
                held.clear()
    if held:
        yield frequent()


class Signatures:
    """Signatures of sets: subsets of two for light ones, single shingles for heavy ones and those next to them."""

    def __init__(self, shingles: np.ndarray, df: np.ndarray, boundary: int, percent: int):
        order = np.argsort(shingles)
        self.shingles, self.df = shingles[order], df[order].astype(np.int32)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.shingles >> np.uint64(42)] = True
        self.boundary, self.percent = boundary, percent

    def _weight(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int32)
        hit = np.flatnonzero(self.filter[h >> np.uint64(42)])
        if len(hit):
            i = np.minimum(np.searchsorted(self.shingles, h[hit]), len(self.shingles) - 1)
            out[hit] = np.where(self.shingles[i] == h[hit], self.df[i], 0)
        return out

    def of(self, rows: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and signature. h: sorted in each row; n: size of each row's set."""
        weight = self._weight(h)
        start = np.cumsum(n) - n
        some = np.zeros(len(n), bool)
        some[rows[weight > 0]] = True
        moved = np.flatnonzero(some[rows])
        if len(moved):
            order = moved[np.lexsort((h[moved], weight[moved], rows[moved]))]
            h = h.copy()
            h[moved] = h[order]
        prefix = np.where(n > 0, n - at_least(n, self.percent) + 1, 0)
        light = n <= self.boundary
        singles = ~light | (100 * n // self.percent > self.boundary)
        rank = np.arange(len(h)) - start[rows]
        own = (rank < prefix[rows]) & singles[rows] & (n[rows] > 1)
        of, sig = [rows[own]], [K.mix(h[own])]
        wide = np.where(light & (n > 1), np.minimum(n, prefix + 1), 0)
        for j in range(1, int(wide.max(initial=0))):
            has = np.flatnonzero(wide > j)
            second = h[start[has] + j]
            for i in range(j):
                of.append(has)
                sig.append(K.mix(K.mix(h[start[has] + i]) * np.uint64(3) + second))
        return np.concatenate(of), np.concatenate(sig)


def light_boundary(sizes: list[tuple[int, int]], chance: float, percent: int = PERCENT) -> int:
    """The largest light size. sizes: (size, sets of it); chance: other sets expected on a shingle's list."""
    def light(n):
        q = min(n, n - at_least(n, percent) + 2)
        return q * (q - 1) / 2

    def heavy(n):
        return (n - at_least(n, percent) + 1) * (1 + VERIFY_COST * chance)

    held = dict(sizes)
    cost = sum(k * heavy(n) for n, k in held.items())
    best, at = cost, 1
    for n in range(2, LARGEST_LIGHT + 1):
        cost += held.get(n, 0) * (light(n) - heavy(n))
        if cost < best:
            best, at = cost, n
    return at


class JaccardJoin(SimilarityJoin):
    """One run of the join; ``components()`` is its result."""

    def __init__(self, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT):
        super().__init__(docs, "jaccard")
        self.width, self.percent, self.ratio = width, percent, percent / 100

    def bodies(self, docs, wanted):
        return docs.join(few(wanted), "key").select("t", "salt", "a", F.col("text").alias("body"))

    def prepared(self):
        width = self.width
        return lambda body: next(shingle_sets(pa.array([body], pa.string()), width))[3]

    def similar(self):
        percent = self.percent

        def similar(x, y):
            shared = len(x) + len(y) - len(np.union1d(x, y))
            return 100 * shared >= percent * (len(x) + len(y) - shared)

        return similar

    def sketched(self):
        percent = self.percent

        def block(sketches):
            held = ParityBlock(sketches, percent)
            return lambda others: (held.near(x) for x in others)

        return block

    def refuted(self):
        percent = self.percent
        return lambda xs, ys: np.array([parity_distance(x, y, percent) for x, y in zip(xs, ys, strict=True)], float)

    def _order(self, seen: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray, float]:
        """The most frequent shingles with their counts, and the others' chance of meeting. total: shingles of all rows."""
        counts = self.work.save(seen.where("shingle is not null").groupBy("shingle").agg(F.sum("df").alias("df")), "counts")
        sizes = counts.groupBy(F.least("df", F.lit(1 << 16)).alias("df")).agg(F.count("*").alias("k")).orderBy(F.desc("df")).collect()  # 65,536 rows at most
        kept, least = 0, None
        for df, k in sizes:
            if kept + k > ORDERED:
                break
            kept, least = kept + k, df
        rows = counts.where(F.col("df") >= least).toPandas() if least else pd.DataFrame({"shingle": [], "df": []})  # ORDERED rows at most
        rest = sum(df * k for df, k in sizes if least is None or df < least)
        self.work.drop("counts")
        return rows["shingle"].to_numpy().astype(np.int64).view(np.uint64), rows["df"].to_numpy(), rest / max(total, 1)

    def _signatures(self, maker: Signatures, parts: int) -> DataFrame:
        """Copies within a slice of texts emit once."""
        held = self.spark.sparkContext.broadcast(maker)  # ORDERED numbers
        width, hot = self.width, self.hot

        def emit(batches):
            packer = Packer(parts, hot)
            for batch in batches:
                for lo, hi, of, h in shingle_sets(batch.column(0), width):
                    n = K.row_counts(of, hi - lo)
                    ids = set_ids(n, node_names(n, of, h))
                    _, first = np.unique(ids, return_index=True)
                    new = np.zeros(hi - lo, bool)
                    new[first] = True
                    keep = new[of]
                    rows, sig = held.value.of(of[keep], h[keep], np.where(new, n, 0))
                    yield from packer.add(sig, ids[rows])
            yield from packer.flush()

        return self.docs.select("text").mapInArrow(K.tidy(emit), "part int, hot boolean, blob binary")

    def components(self) -> DataFrame:
        """doc_id, key, n_shingles, component_id and first (key of its group's first row: smallest id, nulls last) of every row."""
        work, width = self.work, self.width
        seen = work.save(self.docs.mapInArrow(K.tidy(lambda batches: _describe(batches, width)), _SETS), "seen")
        rows = seen.where("n is not null").select("doc_id", "key", "n", "name")
        classes = seen.where("n > 0").groupBy("name").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("rep"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("id").alias("id"), F.first("sketch").alias("sketch"),
        )
        classes = work.save(classes, "classes")
        self.items = work.save(self.numbered(classes).withColumn("line", F.lit(0)), "items")
        self.rows_repeat = not rows.groupBy("key").count().where("count > 1").isEmpty()
        total, emitted = rows.agg(F.sum("n"), F.sum(F.col("n") * (100 - self.percent) / 100 + 1)).first()
        sizes = classes.where(F.col("n") <= LARGEST_LIGHT).groupBy("n").count().collect()  # LARGEST_LIGHT rows at most
        shingles, df, chance = self._order(seen, total or 0)
        boundary = light_boundary([tuple(x) for x in sizes], chance, self.percent)
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-int(emitted or 0) // LIST_ENTRIES))
        whole = self.groups(self._signatures(Signatures(shingles, df, boundary, self.percent), parts), parts)

        named = self.items.join(whole, "node", "left").select("name", "rep", F.coalesce("component", "node").alias("component"))
        least = named.groupBy("component").agg(F.min("rep").alias("first"))
        named = named.join(least, "component").select("name", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("first"))
        some = rows.where("n > 0").join(named, "name").select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id", "first")
        return some.union(rows.where("n = 0").select("doc_id", "key", "n", F.col("doc_id").alias("component_id"), "key"))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return JaccardJoin(docs, width, percent).components().select("doc_id", "n_shingles", "component_id")


def drop_near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Of each group of linked rows the first (smallest id, nulls last) stays, once; rows without words stay. All columns."""
    join = JaccardJoin(docs, width, percent)
    groups = join.work.save(join.components().where("n_shingles > 0").select("key", "first"), "groups")
    key = free_name(docs, "__key")
    gone = groups.where("key <> first").select(F.col("key").alias(key)).distinct()
    kept = docs.withColumn(key, row_key()).join(few(gone), key, "left_anti")
    if join.rows_repeat:
        again = groups.groupBy(F.col("key").alias(key)).count().where("count > 1").select(key)
        kept = kept.join(again, key, "left_anti").union(kept.join(again, key, "left_semi").dropDuplicates([key]))
    return kept.select(docs.columns)


def op9(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
