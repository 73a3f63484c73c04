import re

import numpy as np
from pyspark.sql import functions as F

from tarnlight.llm import kernels as K, token_output
from tarnlight.llm.vocabulary import tokenizer_file


def resident() -> int:
    return int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) >> 10


def test_a_task_leaves_its_worker_small():
    """Arrays of 96 KB each are freed below one that stays, so without the return the process would keep their memory."""
    kept = []

    def task(batches):
        held = [np.ones(12_000) for _ in range(3000)]
        kept.append(np.ones(10))
        yield len(held)

    before = resident()
    assert list(K.tidy(task)(iter([]))) == [3000]
    assert resident() - before < 100


def test_texts_reach_the_tokenizer_in_small_batches(spark, tmp_path, monkeypatch):
    """Rows of a batch in a worker, told by the blocks that it writes."""
    def counting(task):
        def run(batches):
            for batch in batches:
                yield from task(iter([batch]))

        return run

    monkeypatch.setattr(token_output, "tidy", counting)
    docs = spark.range(5000).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        token_output.write_tokens(docs, tokenizer_file(), str(tmp_path / "blocks"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sizes = [r.n_docs for r in spark.read.parquet(str(tmp_path / "blocks")).collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 2000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_memo_of_token_ids_is_bounded():
    """However many pieces and words there are, and with the same ids as without a bound."""
    text = " ".join(f"abc{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{k}" for k in range(3000))
    few, many = token_output.PieceIds(tokenizer_file(), 100), token_output.PieceIds(tokenizer_file())
    assert few.encode(text).tolist() == many.encode(text).tolist()
    assert len(few) <= 100 and len(few.words) <= 100 < len(many.words)
