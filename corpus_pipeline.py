"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, token output.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns
the next stage's docs. All but the last return the columns of ``documents``,
whatever their names are. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlight.llm.decontamination import drop_leaks
from tarnlight.llm.jaccard import drop_near_copies
from tarnlight.llm.mixing import mixed_documents
from tarnlight.llm.quality import drop_rejected, fit_quality
from tarnlight.llm.store import Workspace
from tarnlight.llm.token_output import write_and_digest

#: Words of a block of the mix: long, so most documents are taken whole.
MIX_BLOCK_WORDS = 2048
#: Pieces and words whose ids a worker keeps: few, for the stages before leave their executor little memory.
TOKEN_MEMO = 1 << 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules or the forest reject go, null and empty texts among them; each row's verdict is its own, so repeats and ties fare alike."""
    return drop_rejected(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, once; rows without words stay, a null id comes last."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of the benchmark go; a null or empty text holds none, equal rows fare alike, an empty benchmark removes nothing."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a text that a pass takes in part is cut to that part.

    A null or blank text is never taken, a null source is one source, rows of equal id, source and text are one document.
    """
    return mixed_documents(docs, MIX_BLOCK_WORDS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read back from the token files.

    A null or empty text is the end id alone; null ids come first, rows of one id are ordered by a hash of their text.
    """
    return write_and_digest(docs, TOKEN_MEMO)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
    ("token output", tokens),
]

#: SQL cannot express a trained forest or a tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work.save(docs, f"stage-{k}")
            if k:
                work.drop(f"stage-{k - 1}")
    return docs
