"""Mixing sources to target weights, with DataFrame functions only.

Targets: sources in code-point order (null last) weigh 5, 2, 1 and so on in
turn, and share a percentage of all words; no source gets more than MOST_TIMES its
words, and what that leaves over is shared again by weight.

The words of a source, document after document, are packed into blocks of fixed
length, and a source's target buys a number of output slots. Each output shard
draws its source counts from the multinomial of the targets: every one of its
slots draws a source by a seeded hash. Over all shards a source so misses its
number of slots by chance; what is too much is taken from its shards in
proportion, and the places that become free go to the sources that have too
few, so shards keep their size and sources get their number exactly.

A source's slots are numbered from shard to shard, and the k-th takes block
p(k mod blocks), where p is the source's own pseudorandom permutation of its block
numbers for pass k div blocks: every block is taken in one pass before any is
taken in the next. Slots and blocks are joined by source and block number.

A permutation is a swap-or-not shuffle: it needs no table, works on any length
and depends on nothing but the seed, so reruns agree. Offsets of documents come
from sums over hash chunks and windows within a chunk, so a source with a third
of all rows is not sorted in one task.

Edge cases: a null or blank text has size 0 and is never taken; a null source
is one source; rows with null or repeated ids are documents of their own; an
empty table gives an empty result; other columns are not read. Sizes are whole
words, so a source's taken words are within a block or so of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnlight.llm.similarity import free_name
from tarnlight.llm.store import Workspace

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_TIMES = 2
BLOCK_WORDS = 64
#: Slots of a shard, unless that made more than MOST_SHARDS.
SHARD_SLOTS = 4096
MOST_SHARDS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a chunk of the offsets' sums, on average, unless that made more than MOST_CHUNKS.
CHUNK_DOCS = 1024
MOST_CHUNKS = 1 << 16
#: Equal parts of 0 to 1 by which draws find their source, and sources and parts that are broadcast at most.
BUCKETS = 4096
BROADCAST_ROWS = 1 << 16
ROUNDS = 16
SEED = 11


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1, its own for each key, at ``index`` (long)."""
    def swap(x, r):
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *key), n) - x, n)
        return F.when(F.xxhash64(r, F.greatest(x, other), *key).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    # A lambda names its argument once; rounds written out as columns would double the expression each.
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, swap)


class Mix:
    """One mix of docs; ``rows`` are its documents with offsets, ``counts`` the slots of each shard and source, ``slots`` its output."""

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, share_percent: int = SHARE_PERCENT, weights: tuple[int, ...] = WEIGHTS):
        self.block_words = block_words
        self.spark = docs.sparkSession
        self.work = Workspace(self.spark, "mix")
        size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
        self.sizes = self.work.save(docs.select("doc_id", "source", F.xxhash64("text").alias("tie"), size.alias("size")), "sizes")
        self.sources = self.work.save(self._targets(share_percent, weights), "sources")
        self.n_sources, self.n_slots = self.sources.agg(F.count("*"), F.coalesce(F.sum("draws"), F.lit(0))).first()
        self.shard_slots = max(SHARD_SLOTS, -(-self.n_slots // MOST_SHARDS))
        self.rows = self._offsets()
        self.counts = self._counts()
        self.slots = self._slots()

    def _targets(self, share_percent: int, weights: tuple[int, ...]) -> DataFrame:
        """A row for each source: s (its number), source_size, target, blocks, draws, before (draws of the sources before)."""
        every = Window.partitionBy()
        by_name = Window.orderBy(F.col("source").asc_nulls_last())
        known = self.sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        known = known.withColumn("s", F.row_number().over(by_name).cast("long"))
        turn = F.pmod(F.col("s") - 1, F.lit(len(weights))).cast("int")
        known = known.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn + 1))
        known = known.withColumn("most", (F.col("source_size") * MOST_TIMES).cast("double"))
        # Sources reach their limit in order of limit / weight; the level of the rest is highest where the limited ones end.
        by_limit = Window.orderBy(F.col("most") / F.col("weight"), "s")
        ahead = by_limit.rowsBetween(Window.unboundedPreceding, -1)
        goal = F.sum("source_size").over(every) * (share_percent / 100)
        level = (goal - F.coalesce(F.sum("most").over(ahead), F.lit(0.0))) / F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
        known = known.withColumn("level", level)
        known = known.withColumn("target", F.least("most", F.max("level").over(every) * F.col("weight")))
        known = known.withColumn("blocks", F.ceil(F.col("source_size") / self.block_words).cast("long"))
        draws = F.least(F.col("blocks") * MOST_TIMES, F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))
        known = known.withColumn("draws", F.when(F.col("source_size") > 0, draws).otherwise(F.lit(0).cast("long")))
        known = known.withColumn("before", F.coalesce(F.sum("draws").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
        return known.select("source", "s", "source_size", "target", "blocks", "draws", "before")

    def _offsets(self) -> DataFrame:
        """The documents with s, source_size, target and start: the words of their source before them."""
        chunks = min(MOST_CHUNKS, max(1, -(-self.sizes.count() // CHUNK_DOCS)))
        held = self.sizes.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(chunks)))
        named = held.join(self.sources.select(F.col("source").alias("name"), "s", "source_size", "target"), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
        sums = named.groupBy("s", "chunk").agg(F.sum("size").alias("words"))
        starts = sums.select("s", "chunk", (F.sum("words").over(Window.partitionBy("s").orderBy("chunk")) - F.col("words")).alias("chunk_start"))
        within = Window.partitionBy("s", "chunk").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, 0)
        own = named.withColumn("own", F.sum("size").over(within) - F.col("size"))
        return own.join(starts.hint("merge"), ["s", "chunk"]).withColumn("start", F.col("chunk_start") + F.col("own")).drop("chunk", "own", "chunk_start")

    def _drawn(self) -> DataFrame:
        """shard, s, drawn: the multinomial source counts of each shard."""
        all_slots = F.lit(max(self.n_slots, 1)).cast("double")
        lo, hi = F.col("before") / all_slots, (F.col("before") + F.col("draws")) / all_slots
        shares = self.sources.where("draws > 0").select("s", lo.alias("lo"), hi.alias("hi"))
        last = F.lit(BUCKETS - 1).cast("long")
        in_bucket = F.sequence(F.least(F.floor(F.col("lo") * BUCKETS), last), F.least(F.floor(F.col("hi") * BUCKETS), last))
        shares = shares.withColumn("bucket", F.explode(in_bucket))  # a source has a row for each bucket that its share touches
        shares = F.broadcast(shares) if self.n_sources + BUCKETS <= BROADCAST_ROWS else shares.hint("merge")
        slots = self.spark.range(0, self.n_slots, 1, self._parts())
        u = F.xxhash64(F.lit(SEED), "id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
        slots = slots.select(F.floor(F.col("id") / self.shard_slots).cast("long").alias("shard"), u.alias("u"))
        slots = slots.withColumn("bucket", F.floor(F.col("u") * BUCKETS).cast("long"))
        return slots.join(shares, "bucket").where("u >= lo and u < hi").groupBy("shard", "s").agg(F.count("*").alias("drawn"))

    def _parts(self) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.n_slots // (1 << 20)))

    def _counts(self) -> DataFrame:
        """shard, s, n, first: slots of each shard and source, and the source's slots in the shards before."""
        drawn = self.work.save(self._drawn(), "drawn")
        goals = self.sources.select("s", "draws")
        told = drawn.groupBy("s").agg(F.sum("drawn").alias("told"))
        goals = goals.join(told, "s", "left").withColumn("told", F.coalesce("told", F.lit(0)))
        by_shard = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)  # MOST_SHARDS rows
        rows = drawn.join(goals, "s").withColumn("upto", F.sum("drawn").over(by_shard))
        stays = lambda upto: F.when(upto == F.col("told"), F.col("draws")).otherwise(F.floor(upto * (F.col("draws") / F.col("told"))))
        kept = F.when(F.col("told") > F.col("draws"), stays(F.col("upto")) - stays(F.col("upto") - F.col("drawn"))).otherwise(F.col("drawn"))
        rows = self.work.save(rows.select("shard", "s", "drawn", kept.cast("long").alias("kept")), "kept")
        # Free places and missing slots are as many; both are some square roots of all slots, so each is a row.
        free = rows.groupBy("shard").agg(F.sum(F.col("drawn") - F.col("kept")).alias("k")).where("k > 0")
        missing = goals.where("draws > told").select("s", (F.col("draws") - F.col("told")).alias("k"))
        units = lambda rows, c: (
            rows.withColumn("upto", F.sum("k").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, 0)))
            .select(c, F.explode(F.sequence(F.col("upto") - F.col("k"), F.col("upto") - 1)).alias("unit"))
        )
        more = units(free, "shard").join(units(missing, "s").hint("merge"), "unit").select("shard", "s", F.lit(1).cast("long").alias("n"))
        counts = rows.select("shard", "s", F.col("kept").alias("n")).union(more).groupBy("shard", "s").agg(F.sum("n").alias("n")).where("n > 0")
        return self.work.save(counts.withColumn("first", F.sum("n").over(by_shard) - F.col("n")), "counts")

    def _slots(self) -> DataFrame:
        """The output: shard, place (within it), s, block, pass of every slot."""
        within = Window.partitionBy("shard").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
        rows = self.counts.withColumn("base", F.sum("n").over(within) - F.col("n")).join(self.sources.select("s", "blocks"), "s")
        rows = rows.repartition(self._parts(), "shard", "s")
        rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        rows = rows.withColumn("k", F.col("first") + F.col("i"))
        rows = rows.withColumn("pass", F.floor(F.col("k") / F.col("blocks")).cast("long"))
        block = permuted(F.pmod("k", "blocks"), F.col("blocks"), F.col("s"), F.col("pass"))
        return rows.select("shard", (F.col("base") + F.col("i")).alias("place"), "s", "pass", block.alias("block"))

    def pieces(self) -> DataFrame:
        """A row for each document and block that share words: first (word of the document) and words."""
        b = self.block_words
        end = F.col("start") + F.col("size")
        cut = self.rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b).cast("long"), F.floor((end - 1) / b).cast("long"))))
        lo, hi = F.greatest("start", F.col("block") * b), F.least(end, (F.col("block") + 1) * b)
        return cut.withColumn("first", lo - F.col("start")).withColumn("words", hi - lo)

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken and places of every row of docs.

        places: which slots (shard and place) take words of the document, as the exclusive or of their hashes; 0 for none. It
        changes with the shards' draws, though what is taken of a source does not.
        """
        # Generated rows escape the optimizer's estimates, so joins of them say that they are shuffled.
        times = self.slots.groupBy("s", "block").agg(F.count("*").alias("times"), F.bit_xor(F.xxhash64("shard", "place")).alias("at"))
        got = self.pieces().join(times.hint("merge"), ["s", "block"], "left").withColumn("got", F.col("words") * F.coalesce("times", F.lit(0)))
        key = ["doc_id", "size", "source_size", "target"]
        nothing = F.lit(0).cast("long")
        some = got.groupBy("s", "start", *key).agg(F.sum("got").alias("taken"), F.coalesce(F.bit_xor("at"), nothing).alias("places")).select(*key, "taken", "places")
        return some.union(self.rows.where("size = 0").select(*key, nothing.alias("taken"), nothing.alias("places")))


def mixed_documents(docs: DataFrame, block_words: int) -> DataFrame:
    """The mix as rows of docs: a row for each document and pass that takes words of it, its text cut to those words.

    A document that a pass takes whole keeps its text as it is. Of others the words
    taken stay, with one space between. n_chars, where docs has it, is the new length.
    Rows of equal id, source and text are one document.
    """
    held, key, other, runs_, whole = docs, *(free_name(docs, c) for c in ("__key", "__other", "__runs", "__whole"))
    row = F.xxhash64("doc_id", "source", "text")
    if not docs.groupBy(row.alias("k")).count().where("count > 1").isEmpty():
        held = docs.dropDuplicates(["doc_id", "source", "text"])
    mix = Mix(held, block_words)
    runs = F.sort_array(F.collect_list(F.struct("first", "words")))  # a document's blocks
    got = mix.pieces().join(mix.slots.select("s", "block", "pass").hint("merge"), ["s", "block"])
    got = got.groupBy("doc_id", "tie", "s", "start", "size", "pass").agg(runs.alias("runs"), F.sum("words").alias("words"))
    got = got.join(mix.sources.select("s", "source"), "s")
    got = got.select(F.xxhash64("doc_id", "tie", "source").alias(other), F.col("runs").alias(runs_), (F.col("words") == F.col("size")).alias(whole))
    own = held.withColumn(key, F.xxhash64("doc_id", F.xxhash64("text"), "source"))
    rows = own.join(got.hint("merge"), F.col(key) == F.col(other))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    # A text is cut into words once, however many runs are taken of it: a word list named inside the runs' lambda would be made for each of them.
    joined = lambda w: F.array_join(F.transform(runs_, lambda r: F.array_join(F.slice(w, (r["first"] + 1).cast("int"), r["words"].cast("int")), " ")), " ")
    cut = F.element_at(F.transform(F.array(words), joined), 1)
    rows = rows.withColumn("text", F.when(F.col(whole), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(docs.columns)


def op4(spark, sf_dir: str) -> DataFrame:
    return Mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).taken()
