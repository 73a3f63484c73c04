"""Vectors as short codes: product quantisation with integer codebooks and annular norm pruning.

A vector's components become integers ``floor(scale * x)`` and are cut into equal consecutive
parts. Each part position has a codebook; a part is told by the index of its nearest entry.
Entries are kept in the order of their norms: since an entry whose norm differs from the
part's by more than the best distance so far cannot be nearer, a binary search over norms gives the
interval of entries that may be, ends included, and only that annulus is evaluated. All
distances are whole numbers, so codes do not depend on partitions or order.

``fit_codebooks`` runs the rounds of assignment and update, ``encode`` adds codes and errors, ``decode`` gives
back the entries' values. A round is one pass over the vectors; what reaches the driver is a sum per codebook
entry and task (added up by Spark first), never a row.

Edge cases: null vectors and vectors with null or non-finite components are dropped, and so are those
whose length is not that of the most rows (the shorter of two as common) or not a positive multiple of the number of
parts; scaled components beyond LARGEST count as LARGEST. Rows of one id
are all coded, and the codebooks start from the rows of smallest id, equal ids in the order of their components, null
ids last. With fewer rows than entries a codebook has one for each row; an empty table has empty codebooks and no codes.
Equal distances go to the lower index. Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tarnlight.llm.similarity import free_name
from tarnlight.llm.store import Workspace

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Scaled components end here, so that squared distances of parts up to 256 long are exact in 64 bits.
LARGEST = 1 << 26
#: Rows that are looked at together, and the entries nearest in norm that give the first bound.
GROUP, FIRST = 64, 8
#: Copies of an error sum that a hot label's rows are dealt to.
SALTS = 32


class Annuli:
    """A codebook in the order of its entries' norms."""

    def __init__(self, entries: np.ndarray):
        squares = (entries * entries).sum(1)
        self.order = np.lexsort((np.arange(len(entries)), squares))
        self.entries, self.squares = entries[self.order], squares[self.order]
        self.norms = np.sqrt(self.squares.astype(float))
        self.evaluated = 0

    def _distances(self, x: np.ndarray, square: np.ndarray, lo: int, hi: int) -> np.ndarray:
        e = self.entries[lo:hi]
        most = int(np.abs(x).max(initial=0)) * int(np.abs(e).max(initial=0)) * x.shape[1]
        dot = (x.astype(float) @ e.T.astype(float)).astype(np.int64) if most < 1 << 52 else x @ e.T  # floats are exact up to there
        return square[:, None] - 2 * dot + self.squares[lo:hi]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row (the lower of two), and the squared distance."""
        squares = (x * x).sum(1)
        norms = np.sqrt(squares.astype(float))
        code, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        rows = np.argsort(norms, kind="stable")  # neighbours in norm share most of their annuli
        for start in range(0, len(x), GROUP):
            own = rows[start : start + GROUP]
            part, square, norm = x[own], squares[own], norms[own]
            mid = int(np.searchsorted(self.norms, norm[len(own) // 2]))
            lo, hi = max(0, mid - FIRST), min(len(self.norms), mid + FIRST)
            bound = self._distances(part, square, lo, hi).min(1)
            # The interval of norms that the best distance so far allows, a little wider than rounding can narrow it.
            reach = np.sqrt(bound.astype(float)) * (1 + 1e-9) + norm * 1e-9 + 1e-9
            first = np.searchsorted(self.norms, norm - reach, "left")
            after = np.searchsorted(self.norms, norm + reach, "right")
            lo, hi = int(first.min()), int(after.max())
            far = self._distances(part, square, lo, hi)
            at = np.arange(lo, hi)
            far[(at < first[:, None]) | (at >= after[:, None])] = np.iinfo(np.int64).max
            self.evaluated += int((after - first).sum())
            best = far.min(1)
            code[own] = np.where(far == best[:, None], self.order[lo:hi], len(self.norms)).min(1)
            error[own] = best
        return code, error


@dataclass
class Codebooks:
    """entries: an array of integers (part, entry, position in part)."""

    entries: np.ndarray
    length: int
    scale: int = SCALE

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _whole(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def usable(rows: DataFrame, vector: str, parts: int = PARTS) -> tuple[DataFrame, int]:
    """The rows that can be coded, and their length (0: none)."""
    rows = rows.where(_whole(F.col(vector)))
    common = rows.groupBy(F.size(vector).alias("n")).count().where((F.col("n") > 0) & (F.col("n") % parts == 0)).orderBy(F.desc("count"), "n").first()
    length = common["n"] if common else 0
    return rows.where((F.size(vector) == length) & (F.size(vector) > 0)), length


def _integers(vectors: pa.Array, length: int, scale: int) -> np.ndarray:
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.clip(np.floor(flat * scale), -LARGEST, LARGEST).astype(np.int64).reshape(-1, length)


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    return x.reshape(len(x), parts, -1)


_SUMS = T.StructType([T.StructField(c, k, False) for c, k in (("part", T.IntegerType()), ("entry", T.IntegerType()), ("at", T.IntegerType()), ("total", T.LongType()))])


def _sums(rows: DataFrame, vector: str, books: Codebooks) -> DataFrame:
    """part, entry, at, total: the sum over the assigned parts of each component; at -1 has their number."""
    parts, entries, size = books.entries.shape
    own = books  # a few thousand numbers, in the closure

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(e) for e in own.entries]
        total = np.zeros((parts, entries, size + 1), np.int64)
        for batch in batches:
            x = _parts(_integers(batch.column(0), own.length, own.scale), parts)
            for p in range(parts):
                code, _ = annuli[p].nearest(x[:, p])
                order = np.argsort(code, kind="stable")
                used, start = np.unique(code[order], return_index=True)
                if len(used):
                    total[p, used, :size] += np.add.reduceat(x[order, p], start, axis=0)
                    total[p, :, size] += np.bincount(code, minlength=entries)
        p, e, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (p.astype(np.int32), e.astype(np.int32), np.where(at == size, -1, at).astype(np.int32), total[p, e, at])], ["part", "entry", "at", "total"])

    return rows.select(vector).mapInArrow(add, _SUMS).groupBy("part", "entry", "at").agg(F.sum("total").alias("total"))


def fit_codebooks(rows: DataFrame, vector: str, key: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """rows: as usable() gives them. Each round assigns all parts and moves every used entry to the floor of their mean."""
    first = rows.select(key, vector).orderBy(F.col(key).asc_nulls_last(), vector).limit(entries).toArrow()  # entries rows
    if not first.num_rows:
        return Codebooks(np.empty((parts, 0, 0), np.int64), 0, scale)
    vectors = first.column(1).combine_chunks()
    length = len(vectors[0])
    start = _parts(_integers(vectors, length, scale), parts)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)), length, scale)
    size = length // parts
    for _ in range(rounds):
        found = _sums(rows, vector, books).toArrow()  # parts x entries x (size + 1) numbers at most
        total = np.zeros((*books.entries.shape[:2], size + 1), np.int64)
        total[tuple(found.column(c).to_numpy() for c in ("part", "entry", "at"))] = found.column("total").to_numpy()
        n = total[:, :, -1:]
        books = Codebooks(np.where(n > 0, total[:, :, :size] // np.maximum(n, 1), books.entries), length, scale)
    return books


def encode(rows: DataFrame, vector: str, books: Codebooks) -> DataFrame:
    """rows with code (two hex digits or more a part, in part order) and error (the squared distances' sum). rows: as usable() gives them."""
    parts, entries = books.entries.shape[:2]
    digits = max(2, len(f"{max(entries - 1, 0):x}"))

    @F.arrow_udf(T.StructType([T.StructField("code", T.StringType(), False), T.StructField("error", T.LongType(), False)]))
    def told(vectors: pa.Array) -> pa.Array:
        n = len(vectors)
        error, codes = np.zeros(n, np.int64), []
        if n:
            names = pa.array([f"{k:0{digits}x}" for k in range(entries)])
            x = _parts(_integers(vectors, books.length, books.scale), parts)
            for p in range(parts):
                code, far = Annuli(books.entries[p]).nearest(x[:, p])
                codes.append(names.take(pa.array(code)))
                error += far
        text = pc.binary_join_element_wise(*codes, "") if codes else pa.array([], pa.string())
        return pa.StructArray.from_arrays([text, pa.array(error)], ["code", "error"])

    s = free_name(rows, "__code")
    return rows.withColumn(s, told(vector)).withColumns({"code": F.col(f"{s}.code"), "error": F.col(f"{s}.error")}).drop(s)


def decode(rows: DataFrame, code: str, books: Codebooks) -> DataFrame:
    """rows with vector: the middle of the cell of each component of the code's entries, in the scale of the input."""
    parts, entries, _ = books.entries.shape
    digits = max(2, len(f"{max(entries - 1, 0):x}"))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def values(codes: pa.Array) -> pa.Array:
        out = [None if c is None else np.concatenate([(books.entries[p, int(c[p * digits : (p + 1) * digits], 16)] + 0.5) / books.scale for p in range(parts)]) for c in codes.to_pylist()]
        return pa.array(out, pa.list_(pa.float64()))

    return rows.withColumn("vector", values(code))


def with_group_error(rows: DataFrame, group: str, name: str = "label_error") -> DataFrame:
    """rows with the sum of error over the rows of an equal group, nulls together; a hot group's rows are dealt to SALTS places."""
    salt, sums = free_name(rows, "__salt"), free_name(rows, "__group")
    total = rows.groupBy(F.col(group).alias(sums)).agg(F.sum("error").alias(name)).withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn(salt, F.pmod(F.xxhash64("code", "error"), F.lit(SALTS)).cast("int"))
    return salted.join(total, (salted[salt] == total[salt]) & salted[group].eqNullSafe(total[sums])).drop(salt, sums)


def op11(spark, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "vector-codes")
    rows, _ = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"), "embedding")
    books = fit_codebooks(rows, "embedding", "vec_id")
    coded = work.save(encode(rows, "embedding", books).select("vec_id", "label", "code", "error"), "coded")
    return with_group_error(coded, "label").select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
