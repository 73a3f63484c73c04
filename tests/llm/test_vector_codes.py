import hashlib

import numpy as np
import pytest
from conftest import DATA

from tarnlight.llm.vector_codes import LARGEST, Annuli, decode, encode, fit_codebooks, op11, usable, with_group_error


def plain(x, parts, entries, rounds):
    """All distances, entry by entry. x: rows of integers in the order of their ids."""
    x = x.reshape(len(x), parts, -1).transpose(1, 0, 2)
    books = x[:, :entries].copy()
    for k in range(rounds + 1):
        far = ((x[:, :, None] - books[:, None]) ** 2).sum(-1)
        code, error = far.argmin(-1), far.min(-1)
        if k < rounds:
            for p in range(parts):
                for e in np.unique(code[p]):
                    books[p, e] = x[p, code[p] == e].sum(0) // (code[p] == e).sum()
    return books, code.T, error.sum(0)


@pytest.mark.parametrize("spread", [1, 50, 1 << 25])
def test_annulus_holds_the_nearest(spread):
    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread + 1, (200, 5))
    entries[50:60] = entries[:10]  # ties go to the lower index
    x = np.concatenate([rng.integers(-spread, spread + 1, (500, 5)), entries, np.zeros((3, 5), np.int64), np.full((2, 5), LARGEST)])
    far = np.array([[int(((a - b).astype(object) ** 2).sum()) for b in entries] for a in x])
    annuli = Annuli(entries)
    code, error = annuli.nearest(x)
    assert (code == far.argmin(1)).all() and (error == far.min(1)).all()
    assert spread == 1 or annuli.evaluated < far.size


def test_query_against_all_distances(spark):
    rows = sorted((r for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()), key=lambda r: r.vec_id)
    x = np.floor(np.array([r.embedding for r in rows], float) * 1024).astype(np.int64)
    books, code, error = plain(x, 4, 256, 4)
    got = {r.vec_id: r for r in op11(spark, DATA).collect()}
    assert len(got) == len(rows)
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    for r, c, e in zip(rows, code, error, strict=True):
        own = got[r.vec_id]
        assert (own.code, own.error, own.codebooks_sha256) == ("".join(f"{k:02x}" for k in c), e, sha)
        assert own.label_error == sum(f for q, f in zip(rows, error, strict=True) if q.label == r.label)


ODD = [
    (None, 1, [0.5, 0.25, 0.0, -0.5]), (1, None, [0.5, 0.25, 0.0, -0.5]), (1, None, [0.5, 0.25, 0.0, -0.5]), (2, 7, None), (3, 7, [0.1, None, 0.1, 0.1]),
    (4, 7, [0.1, float("nan"), 0.1, 0.1]), (5, 7, [float("inf"), 0.1, 0.1, 0.1]), (6, 7, []), (7, 7, [1.0]), (8, 7, [-0.001, 1e30, -1e30, 0.0]), (9, None, [-0.001, 0.0, 0.0, 0.0]),
]
SCHEMA = "vec_id long, label int, embedding array<float>"


def test_odd_rows(spark):
    rows, length = usable(spark.createDataFrame(ODD, SCHEMA), "embedding")
    assert length == 4 and sorted(map(str, (r.vec_id for r in rows.collect()))) == ["1", "1", "8", "9", "None"]
    books = fit_codebooks(rows, "embedding", "vec_id", entries=3)
    assert books.entries.shape == (4, 3, 1) and books.entries.min() >= -LARGEST
    coded = encode(rows.withColumnRenamed("label", "__code"), "embedding", books)
    assert coded.columns == ["vec_id", "__code", "embedding", "code", "error"]
    one, other = (r.code for r in coded.where("vec_id = 1").collect())
    assert one == other and all(len(r.code) == 8 for r in coded.collect())
    total = {(r.vec_id, r.code): r.label_error for r in with_group_error(encode(rows, "embedding", books), "label").collect()}
    nulls = [r.error for r in encode(rows, "embedding", books).where("label is null").collect()]
    assert len(nulls) == 3 and total[(9, coded.where("vec_id = 9").first().code)] == sum(nulls)


def test_tables_without_vectors(spark, tmp_path):
    none = spark.createDataFrame([r for r in ODD if r[0] in (2, 3, 4, 5, 6)], SCHEMA)
    none.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op11(spark, str(tmp_path)).collect() == []


def test_decoded_vectors_are_near(spark):
    rows, _ = usable(spark.read.parquet(f"{DATA}/embeddings.parquet"), "embedding")
    books = fit_codebooks(rows, "embedding", "vec_id")
    back = decode(encode(rows, "embedding", books), "code", books).collect()
    off = [np.square(np.array(r.embedding) - np.array(r.vector)).sum() for r in back]
    assert all(abs(o - r.error / 1024**2) < 0.05 for o, r in zip(off, back, strict=True)) and np.mean(off) < 0.5
