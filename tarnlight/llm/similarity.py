"""Connected groups of a similarity self-join, from signatures, without expanding lists into pairs.

Items are distinct, and known by numbers: a code of their size, then hash bits (a few
that agree by chance are numbered anew). Items that can be similar share a signature. The
joins move numbers only:

1. Signatures are dealt to partitions as packed blobs and become lists. Each member is
   paired with its list's pivot: the member of most copies, where numbers tell them, and of
   those the one of middle size, for variants are nearer to what they were made from than to each
   other. Very frequent signatures are not put
   together in one task: their pivots come from an aggregation and a join.
2. Pairs of all lists are deduplicated. A sketch of each item refutes most that are not
   similar and none that is; the rest are verified on the items themselves, which are
   fetched once for a pair and once for a pivot.
3. The components of those links are found. Only lists whose members are still in several
   are looked at again, one of each set of equal lists, and there only pairs across
   components: in some turns the CLOSEST of each item, then all that are left.

So every link that could join two components is tested, while a group of copies,
however large, costs each member a few verifications.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnlight.llm import kernels as K
from tarnlight.llm.components import connected_components
from tarnlight.llm.store import Workspace

#: Longest list whose pairs across components are made by a join.
SMALL_LIST = 24
#: Members of a block of a longer list.
BLOCK_MEMBERS = 4096
#: Entries of a pack from which a signature's list is not put together in one task.
HOT = 256
#: Others of other components against which an item is verified in a turn.
CLOSEST = 2
#: Pairs verified against one copy of a pivot.
PIVOT_PAIRS = 256
#: Rows that are broadcast at most: some 50 bytes each. Beyond, they are joined by shuffle.
BROADCAST_ROWS = 1 << 19
#: Entries packed at once, and entries of a partition of lists.
PACKED, LIST_ENTRIES = 1 << 19, 1 << 20
_HASH_BITS, _RANK_AT = 52, 46
_STEP = np.log(1.02)
_MARK = np.int64(-1)


def binary_rows(rows: np.ndarray) -> pa.Array:
    """A binary column of equally long rows."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def few(rows: DataFrame) -> DataFrame:
    """rows with a broadcast hint if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def numbers(sizes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Numbers of items, not negative: a code of the size in steps of 2 per cent, then hash bits."""
    code = np.minimum(np.log(np.maximum(sizes, 1)) / _STEP, 2047).astype(np.uint64)
    return (code << np.uint64(_HASH_BITS) | h >> np.uint64(64 - _HASH_BITS)).view(np.int64)


def ranked(sizes: np.ndarray, copies: np.ndarray, h: np.ndarray) -> np.ndarray:
    """As numbers, with six bits of the logarithm of an item's copies before the hash bits."""
    code = np.minimum(np.log(np.maximum(sizes, 1)) / _STEP, 2047).astype(np.uint64)
    rank = np.minimum(np.log2(np.maximum(copies, 1)), 63).astype(np.uint64)
    return (code << np.uint64(_HASH_BITS) | rank << np.uint64(_RANK_AT) | h >> np.uint64(64 - _RANK_AT)).view(np.int64)


def size_reach(ratio: float) -> int:
    """Steps by which the codes of sizes within ratio of each other may differ."""
    return int(np.ceil(-np.log(ratio) / _STEP))


def sizes_near(a: str, b: str, ratio: float) -> Column:
    """Whether the sizes in the numbers a and b can be within ratio of each other; always where a number is not of the usual kind."""
    reach = size_reach(ratio)
    return (F.abs(F.shiftright(a, _HASH_BITS) - F.shiftright(b, _HASH_BITS)) <= reach) | (F.col(a) < 0) | (F.col(b) < 0)


def row_key() -> Column:
    """What rows of equal id and text have in common."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


class Packer:
    """Gathers (signature, item) and yields rows part, blob: the entries of one partition.

    A signature's home is its partition and 32 bits. One that has ``hot`` entries in a pack is hot: its entries
    are dealt to all partitions, and only a mark goes home, so that those of other packs join them.
    """

    def __init__(self, parts: int, hot: int):
        self.parts, self.hot, self.held, self.n = parts, hot, [], 0

    def add(self, sig: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((sig, node))
        self.n += len(sig)
        if self.n >= PACKED:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        sig, node = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        parts = np.uint64(self.parts)
        order = np.argsort(sig)
        sig, node = sig[order], node[order]
        starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        counts = np.diff(np.append(starts, len(sig)))
        hot = np.repeat(counts >= self.hot, counts)
        home = np.append(sig[~hot], sig[starts[counts >= self.hot]])
        kept = np.append(node[~hot], np.full(len(home) - (~hot).sum(), _MARK))
        yield from self._blobs((home % parts).astype(np.int32), (home // parts).astype("<u4"), kept, False)
        if hot.any():
            sig, node = sig[hot], node[hot]
            name = (sig % parts) << np.uint64(32) | (sig // parts).astype(np.uint32).astype(np.uint64)
            yield from self._blobs((K.mix(sig ^ node.view(np.uint64)) % parts).astype(np.int32), name.astype("<u8"), node, True)

    @staticmethod
    def _blobs(part: np.ndarray, name: np.ndarray, node: np.ndarray, hot: bool) -> Iterator[pa.RecordBatch]:
        order = np.argsort(part, kind="stable")
        part, name, node = part[order], name[order], node[order]
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = np.append(starts[1:], len(part))
        blobs = [name[a:b].tobytes() + node[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(np.full(len(starts), hot)), pa.array(blobs, pa.binary())], ["part", "hot", "blob"])


def _distinct(name: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (name, item), sorted."""
    order = np.lexsort((node, name))
    name, node = name[order], node[order]
    new = np.append(True, (name[1:] != name[:-1]) | (node[1:] != node[:-1])) if len(name) else np.zeros(0, bool)
    return name[new], node[new]


def _repeated(name: np.ndarray) -> np.ndarray:
    """Indexes of names that occur twice."""
    order = np.argsort(name, kind="stable")
    s = name[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    return order[same[:-1] | same[1:]]


def read_lists(batches: Iterator[pa.RecordBatch], reach: int, by_copies: bool = False) -> Iterator[pa.RecordBatch]:
    """part, hot, blob of whole partitions to home, sig, node, pivot: the members, but the pivot, of lists with two items or more.

    A list is cut where the sizes of its items, which their numbers begin with, leave a gap that no two
    similar items can leave. Hot entries have no list and no pivot yet.
    """
    held: dict[tuple[int, bool], list[bytes]] = {}
    for batch in batches:
        for part, hot, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            held.setdefault((part, hot), []).append(blob)
    names = ["home", "sig", "node", "pivot"]
    while held:
        (part, hot), blobs = held.popitem()
        wide = 8 if hot else 4
        name = np.concatenate([np.frombuffer(x, f"<u{wide}", len(x) // (wide + 8)) for x in blobs])
        node = np.concatenate([np.frombuffer(x, "<i8", offset=len(x) // (wide + 8) * wide) for x in blobs])
        del blobs
        if hot:
            name, node = _distinct(name, node)
            none = pa.nulls(len(name), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(name.astype(np.int64)), none, pa.array(node), none], names)
            continue
        several = _repeated(name)
        name, node = _distinct(name[several], node[several])
        if not len(name):
            continue
        home = name.astype(np.int64) | np.int64(part) << np.int64(32)
        marked = np.isin(home, home[node == _MARK])
        own = marked & (node != _MARK)
        if own.any():
            none = pa.nulls(int(own.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(home[own]), none, pa.array(node[own]), none], names)
        home, node = home[~marked], node[~marked]
        if not len(home):
            continue
        first = np.append(True, (home[1:] != home[:-1]) | ((node[1:] >> _HASH_BITS) - (node[:-1] >> _HASH_BITS) > reach))
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(home)))
        rank = np.zeros(len(home), np.int64)
        rank[starts + sizes // 2] = 1
        if by_copies:
            rank += (node >> _RANK_AT & 63) << 1
        best = np.flatnonzero(rank == np.repeat(np.maximum.reduceat(rank, starts), sizes))
        of = np.repeat(np.arange(len(starts)), sizes)
        best = best[np.append(True, of[best][1:] != of[best][:-1])]
        pivot = node[best][of]
        member = np.ones(len(home), bool)
        member[best] = False
        sig = K.mix(home.view(np.uint64) ^ K.mix(pivot.view(np.uint64))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x[member]) for x in (home, sig, node, pivot)], names)


class SimilarityJoin(ABC):
    """docs are read as doc_id (long), key (a hash of id and text) and text. ``items`` is set before groups() is called."""

    def __init__(self, docs: DataFrame, name: str):
        self.spark = docs.sparkSession
        self.work = Workspace(self.spark, name)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
        self.rows_repeat = True
        self.hot = HOT

    #: Least ratio of the sizes of similar items.
    ratio: float
    #: Turns in which each item of a list with several components is verified against its closest only.
    turns = 1
    #: Whether items are numbered by ``ranked``.
    by_copies = False

    @abstractmethod
    def bodies(self, docs: DataFrame, wanted: DataFrame) -> DataFrame:
        """wanted: key, line, t, salt, a. The same rows as t, salt, a and body (string)."""

    @abstractmethod
    def prepared(self) -> Callable:
        """A function of a body that gives what ``similar`` compares. It is sent to the workers."""

    @abstractmethod
    def similar(self) -> Callable:
        """A function of two prepared bodies. It is sent to the workers."""

    @abstractmethod
    def sketched(self) -> Callable:
        """A function of a list of sketches that returns a function of another list's: for each, the indexes in the
        first that are not refuted and a measure of how far they are. It is sent to the workers."""

    @abstractmethod
    def refuted(self) -> Callable:
        """A function of two lists of sketches: for each pair how far they are, NaN where they cannot be similar."""

    def verifier(self) -> Callable:
        """A function of batches t, salt, a, body, sorted, the pivot (a null) before its members, to u, v: members and pivots that are similar."""
        prepared, similar = self.prepared(), self.similar()

        def verify(batches):
            now = pivot = None
            for batch in batches:
                u, v = [], []
                for t, salt, a, body in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                    if a is None:
                        now, pivot = (t, salt), prepared(body.as_py())
                    elif (t, salt) == now and similar(prepared(body.as_py()), pivot):
                        u.append(a)
                        v.append(t)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        return verify

    def near(self, a: str, b: str) -> Column:
        return sizes_near(a, b, self.ratio)

    def numbered(self, classes: DataFrame) -> DataFrame:
        """classes (id, name and others) with node: the id, or another number where several names have it."""
        several = classes.groupBy("id").count().where("count > 1").select("id")
        if several.isEmpty():
            self.renumbered = None
            return classes.withColumn("node", F.col("id"))
        place = F.row_number().over(Window.partitionBy("id").orderBy("name"))
        again = classes.join(several, "id", "left_semi").select("id", "name", place.alias("place"))
        again = again.select("id", "name", F.when(F.col("place") == 1, F.col("id")).otherwise(F.xxhash64("name").bitwiseOR(F.lit(-(1 << 63)))).alias("other"))
        self.renumbered = again.select(F.col("id").alias("node"), "other")
        return classes.join(again.drop("id"), "name", "left").withColumn("node", F.coalesce("other", "id")).drop("other")

    def _lists(self, entries: DataFrame, parts: int) -> DataFrame:
        """sig, node, pivot: the members, but the pivot, of each list."""
        reach, by_copies = size_reach(self.ratio), self.by_copies
        dealt = entries.repartitionById(parts, F.col("part")).mapInArrow(K.tidy(lambda batches: read_lists(batches, reach, by_copies)), "home long, sig long, node long, pivot long")
        rows = self.work.save(dealt, "dealt")
        hot = rows.where("pivot is null").select("home", "node")
        if self.renumbered is not None:  # all items of a number, with a pivot of its own for each list
            hot = rows.select("home", "node").union(rows.where("pivot is not null").select("home", "pivot"))
            hot = hot.join(self.renumbered, "node", "left").select("home", F.coalesce("other", "node").alias("node"))
            rows = rows.limit(0)
        elif hot.isEmpty():
            return rows.select("sig", "node", "pivot")
        hot = hot.distinct()
        copies = F.shiftright("node", _RANK_AT).bitwiseAND(F.lit(63)) if self.by_copies else F.lit(0)
        pivots = hot.groupBy("home").agg(F.max_by("node", F.struct(copies, F.xxhash64("node"), "node")).alias("pivot"))
        hot = hot.join(pivots, "home").where("node <> pivot")
        lists = self.work.save(rows.where("pivot is not null").select("sig", "node", "pivot").union(hot.select("home", "node", "pivot")), "lists")
        self.work.drop("dealt")
        return lists

    def _close(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b and others) that their sketches do not refute, with far."""
        refuted = self.refuted()
        names = pairs.columns
        sketches = self.items.select("node", "sketch")

        def test(batches):
            for batch in batches:
                *own, x, y = batch.columns
                far = refuted(x.to_pylist(), y.to_pylist())
                yield pa.RecordBatch.from_arrays([*own, pa.array(far)], [*names, "far"]).filter(pa.array(~np.isnan(far)))

        both = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
        return both.select(*names, "x", "y").mapInArrow(K.tidy(test), ", ".join(f"{c} long" for c in names) + ", far double")

    def _linked(self, pairs: DataFrame, label: str, keep_pairs: bool = False) -> DataFrame:
        """Those of the pairs a, b that are similar, as u, v."""
        pairs = self.work.save(pairs.select("a", "b"), f"{label}-pairs")
        salts = F.ceil(F.col("count") / PIVOT_PAIRS).cast("int")
        pivots = pairs.groupBy("b").count().select("b", salts.alias("salts"))
        at = self.items.select("node", "key", "line")
        own = pairs.join(pivots, "b").join(at.withColumnRenamed("node", "a"), "a")
        own = own.select("key", "line", F.col("b").alias("t"), F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), "a")
        other = pivots.join(at.withColumnRenamed("node", "b"), "b")
        other = other.select("key", "line", F.col("b").alias("t"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("a"))
        wanted = self.work.save(own.union(other), f"{label}-wanted")
        docs = self.docs.select("key", "text")
        if self.rows_repeat:
            docs = docs.join(few(wanted.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"])
        rows = self.bodies(docs, wanted).repartition("t", "salt").sortWithinPartitions("t", "salt", F.col("a").asc_nulls_first())
        out = self.work.save(rows.mapInArrow(K.tidy(self.verifier()), "u long, v long"), label)
        for name in ("wanted",) if keep_pairs else ("wanted", "pairs"):
            self.work.drop(f"{label}-{name}")
        self.work.settle()
        return out

    def _mixed(self, lists: DataFrame, components: DataFrame, label: str) -> DataFrame:
        """sig, node, component, members: the members, but the pivot, of lists that still hold several components; one of equal lists."""
        named = lists.select("sig", "node").join(components, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
        per = named.groupBy("sig").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"),
            F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("two"),
        )
        once = per.where("lo <> hi").groupBy("one", "two", "members").agg(F.min("sig").alias("sig")).select("sig", "members")
        return self.work.save(named.join(once, "sig"), label)

    def _small(self, mixed: DataFrame) -> DataFrame:
        """a, b, p, q, far: pairs across components (p, q) of short lists that are not refuted."""
        small = mixed.where(F.col("members") <= SMALL_LIST).select("sig", F.col("node").alias("a"), F.col("component").alias("p"))
        other = small.select("sig", F.col("a").alias("b"), F.col("p").alias("q"))
        pairs = small.join(other, "sig").where((F.col("a") < F.col("b")) & (F.col("p") != F.col("q")) & self.near("a", "b"))
        return self._close(pairs.select("a", "b", "p", "q").distinct())

    def _large(self, mixed: DataFrame, every: bool) -> DataFrame:
        """a, b of long lists: blocks of their members against blocks of those outside the largest component.

        Of each item the closest, or all, that are not refuted.
        """
        sketched = self.sketched()
        large = mixed.where(F.col("members") > SMALL_LIST)
        share = large.groupBy("sig", "component").agg(F.count("*").alias("k"))
        most = share.groupBy("sig").agg(F.max_by("component", F.struct("k", "component")).alias("most"), (F.sum("k") - F.max("k")).alias("odd"))
        held = large.join(most, "sig").join(self.items.select("node", "sketch"), "node")
        blocks = lambda n: F.ceil(F.col(n) / BLOCK_MEMBERS).cast("int")
        dealt = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
        every_of = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
        left = held.select("sig", dealt("members").alias("i"), every_of("odd").alias("j"), F.lit(False).alias("right"), "node", "component", "sketch")
        right = held.where("component <> most").select("sig", every_of("members").alias("i"), dealt("odd").alias("j"), F.lit(True).alias("right"), "node", "component", "sketch")

        def scan(rows: pd.DataFrame) -> pd.DataFrame:
            block, odd = rows[~rows["right"]], rows[rows["right"]]
            out = []
            if len(block) and len(odd):
                node, component = block["node"].to_numpy(), block["component"].to_numpy()
                find = sketched(block["sketch"].to_list())
                for a, p, (at, far) in zip(odd["node"], odd["component"], find(odd["sketch"].to_list()), strict=True):
                    other = component[at] != p
                    at, far = at[other], far[other]
                    if not every:
                        best = np.argsort(far, kind="stable")[:CLOSEST]
                        at, far = at[best], far[best]
                    out += [(a, b, x) for b, x in zip(node[at], far, strict=True)]
            return pd.DataFrame(out, columns=["a", "b", "far"]).astype({"a": "int64", "b": "int64", "far": "float64"})

        found = left.union(right).groupBy("sig", "i", "j").applyInPandas(scan, "a long, b long, far double")
        return found.select("a", "b").distinct() if every else self._nearest(found)

    @staticmethod
    def _nearest(pairs: DataFrame) -> DataFrame:
        """a, b: of each item in a the closest by far."""
        by = Window.partitionBy("a").orderBy("far", "b")
        once = pairs.select("a", "b", "far").distinct()
        return once.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= CLOSEST).select("a", "b")

    def _by_pivots(self, entries: DataFrame, parts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Links u, v of members with their lists' pivots, the components of these, and the lists that still hold several (see _mixed)."""
        lists = self._lists(entries, parts)
        self.work.settle()
        pairs = lists.select(F.col("node").alias("a"), F.col("pivot").alias("b")).where(self.near("a", "b")).distinct()
        found = self._linked(self._close(pairs), "found")
        components = connected_components(found, self.work, "stars")
        mixed = self._mixed(lists, components, "mixed")
        self.work.settle()
        return found, components, mixed

    def groups(self, entries: DataFrame, parts: int) -> DataFrame:
        """node, component of every item that is linked, but the smallest of each group. entries: rows of Packers with ``parts``."""
        work = self.work
        found, components, mixed = self._by_pivots(entries, parts)
        if mixed.isEmpty():
            return components
        small = work.save(self._small(mixed), "small")
        large = mixed.where(F.col("members") > SMALL_LIST)
        tried = None
        for turn in range(self.turns):
            pairs = self._nearest(self._apart(small, components, tried)).union(self._large(large, every=False)).distinct()
            found = found.union(self._linked(pairs, f"more-{turn}", keep_pairs=True))
            own = self.spark.read.schema("a long, b long").parquet(work.path(f"more-{turn}-pairs"))
            tried = own if tried is None else tried.union(own)
            components = connected_components(found, work, f"again-{turn}")
            large = self._mixed(large, components, f"large-{turn}")
        left = self._apart(small, components, tried).select("a", "b")
        last = self._linked(left.union(self._large(large, every=True)).distinct().join(tried, ["a", "b"], "left_anti"), "last")
        whole = connected_components(found.union(last), work, "whole")
        for label in ("dealt", "lists", "mixed", "small", *(f"large-{k}" for k in range(self.turns)), *(f"more-{k}-pairs" for k in range(self.turns))):
            work.drop(label)
        return whole

    def _apart(self, pairs: DataFrame, components: DataFrame, tried: DataFrame | None) -> DataFrame:
        """a, b, far of the pairs whose items are in several components and that have not been tried."""
        named = lambda c, o: components.select(F.col("node").alias(c), F.col("component").alias(o))
        rows = pairs.select("a", "b", "far").join(named("a", "p"), "a", "left").join(named("b", "q"), "b", "left")
        rows = rows.where(F.coalesce("p", "a") != F.coalesce("q", "b")).select("a", "b", "far")
        return rows if tried is None else rows.join(tried, ["a", "b"], "left_anti")
