"""Token-id output: one concatenated id array whose document boundaries are Elias-Fano coded.

A token table is a folder of Parquet files (so Spark's committer makes writes
whole, whatever executor is lost). A row is a block of consecutive documents:
``part, seq`` (its place: blocks ordered by them hold the documents by
ascending id), ``n_docs, n_tokens``, and ``payload``, a binary in this format:

    "TKEF", version (1 byte), bytes per id (1 byte: 2 where the vocabulary fits, else 4),
    documents without an id (8 bytes, they come first), smallest id (8 bytes),
    the ids less the smallest, Elias-Fano; the n_docs + 1 boundaries, Elias-Fano;
    the token ids, little-endian.

Edge cases: a null or empty text is a document of the end id alone; a null
document id sorts first; repeated ids stand next to each other, ordered by a
hash of their text; an empty table writes no blocks. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tarnlight.llm.elias_fano import EliasFano
from tarnlight.llm.kernels import CACHES, tidy
from tarnlight.llm.store import Workspace, small_batches
from tarnlight.llm.vocabulary import byte_letters, tokenizer_file

END_ID = 2
BLOCK_TOKENS = 1 << 18
_HEAD = struct.Struct("<4sBBQq")
_BLOCKS = "part int, seq int, n_docs long, n_tokens long, payload binary"
_DIGEST = "doc_id long, part int, seq int, start_in_block long, n_tokens long, ids_crc32 long"
#: Distinct pieces between spaces, and distinct words, whose ids a worker keeps, of each so many. Fewer take less memory and more time.
_MEMO = 300_000
#: Boundaries that are selected at once.
_SELECTED = 4096
#: The normalizer for which a plain piece can be cut into words before it is looked up.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}


#: Pieces that are their own normal form but for case; within them the tokenizer's pattern finds these words.
_PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class _WordIds(dict):
    """Ids of the words that the tokenizer's pattern finds, from its model."""

    def __init__(self, model, memo: int):
        super().__init__()
        self.model, self.memo = model, memo
        self.letter = {byte: letter for letter, byte in byte_letters().items()}

    def __missing__(self, word: str) -> bytes:
        ids = np.array([t.id for t in self.model.tokenize("".join([self.letter[b] for b in word.encode()]))], "<u4").tobytes()
        if len(self) >= self.memo:
            self.clear()
        self[word] = ids
        return ids


class PieceIds(dict):
    """Ids, as little-endian uint32 bytes, of a text's pieces between spaces and newlines.

    The tokenizer drops white space and no token, normalisation or special
    string crosses it, so a text's ids are those of its pieces joined. A plain
    piece is cut into words here and each word is looked up once; any other
    piece goes through the whole tokenizer.
    """

    def __init__(self, path: str, memo: int = _MEMO):
        from tokenizers import Tokenizer

        super().__init__()
        self.memo = memo
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.words = _WordIds(self.tokenizer.model, memo)
        self.split = self.tokenizer.normalizer is not None and json.loads(self.tokenizer.normalizer.__getstate__()) == _NORMALIZER

    def __missing__(self, piece: str) -> bytes:
        if self.split and len(piece) <= 64 and "<|" not in piece and _PLAIN.fullmatch(piece):
            ids = b"".join(map(self.words.__getitem__, _WORDS.findall(piece.lower())))
        else:
            ids = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.memo:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        return np.frombuffer(b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))), "<u4")


_loaded: dict[tuple[str, int], PieceIds] = {}
CACHES.append(_loaded)


def piece_ids(path: str, memo: int = _MEMO) -> PieceIds:
    """One for each worker process, the last that was asked for."""
    if (path, memo) not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded.clear()
        _loaded[path, memo] = PieceIds(path, memo)
    return _loaded[path, memo]


def pack_block(doc_ids: list[int | None], docs: list[np.ndarray], width: int) -> bytes:
    """doc_ids ascending, nulls first; docs: the ids of each."""
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in docs], dtype=np.int64)])
    return b"".join([
        _HEAD.pack(b"TKEF", 2, width, len(doc_ids) - len(known), first),
        EliasFano.encode(known.astype(np.uint64) - np.array(first, np.int64).astype(np.uint64)).to_bytes(),
        EliasFano.encode(bounds).to_bytes(),
        np.concatenate(docs).astype(f"<u{width}").tobytes(),
    ])


class Block:
    """A payload, read back."""

    def __init__(self, payload: bytes):
        magic, version, width, self.unnamed, first = _HEAD.unpack_from(payload)
        if (magic, version) != (b"TKEF", 2):
            raise ValueError("not a token block")
        known, at = EliasFano.from_bytes(payload, _HEAD.size)
        self.bounds, at = EliasFano.from_bytes(payload, at)
        self.ids = np.frombuffer(payload, f"<u{width}", offset=at)
        self.doc_ids = [None] * self.unnamed + (known.values() + np.array(first, np.int64).astype(np.uint64)).astype(np.int64).tolist()

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by two selects."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, memo: int = _MEMO) -> None:
    """Encodes each whole text, appends end_id and writes blocks in ascending doc_id order. memo: pieces and words whose ids a worker keeps."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part, seq = piece_ids(tokenizer_path, memo), TaskContext.get().partitionId(), 0
        doc_ids, held, n = [], [], 0

        def block():
            row = [part], [seq], [len(doc_ids)], [n], [pack_block(doc_ids, held, pieces.width)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(pieces.encode(text.as_py()), np.uint32(end_id))
                if held and n + len(ids) > block_tokens:
                    yield block()
                    doc_ids, held, n, seq = [], [], 0, seq + 1
                doc_ids.append(doc_id)
                held.append(ids)
                n += len(ids)
        if held:
            yield block()

    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.select("text").rdd.getNumPartitions())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    with small_batches(spark):
        rows.select("doc_id", "text").mapInArrow(tidy(encode), _BLOCKS).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The blocks, with ``start``: the ids of all blocks before."""
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each range partition
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    starts = blocks.select("part", "seq", own.alias("own")).join(before, "part").select("part", "seq", (F.col("part_start") + F.col("own")).alias("start"))
    return blocks.join(starts, ["part", "seq"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(*(batch.column(k) for k in range(3)), strict=True):
                block = Block(payload.as_py())
                for lo in range(0, len(block.doc_ids), _SELECTED):
                    own = block.doc_ids[lo : lo + _SELECTED]
                    n, bounds = len(own), block.bounds.select_many(np.arange(lo, lo + len(own) + 1)).astype(np.int64)
                    crc = [zlib.crc32(block.ids[a:b].astype("<u4")) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, seq.as_py(), np.int32)), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["doc_id", "part", "seq", "start_in_block", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(_BLOCKS).parquet(path)
    starts = read_tokens(spark, path).select("part", "seq", "start")
    return (
        blocks.select("part", "seq", "payload").mapInArrow(tidy(decode), _DIGEST).join(starts, ["part", "seq"])
        .select("doc_id", (F.col("start") + F.col("start_in_block")).alias("start"), "n_tokens", "ids_crc32")
    )


def write_and_digest(docs: DataFrame, memo: int = _MEMO) -> DataFrame:
    work = Workspace(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_file(), work.path("blocks"), memo=memo)
    return token_digest(docs.sparkSession, work.path("blocks"))


def op1(spark, sf_dir: str) -> DataFrame:
    return write_and_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
