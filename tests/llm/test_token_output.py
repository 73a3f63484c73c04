import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tarnlight.llm.elias_fano import EliasFano
from tarnlight.llm.token_output import Block, pack_block, piece_ids, write_and_digest
from tarnlight.llm.vocabulary import tokenizer_file


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1)))
def test_elias_fano_round_trip(values):
    values.sort()
    code, end = EliasFano.from_bytes(EliasFano.encode(np.array(values, np.uint64)).to_bytes())
    assert code.values().tolist() == values and code.select_many(np.arange(len(values))).tolist() == values
    assert all(code.select(i) == values[i] for i in range(0, len(values), 7))


def test_elias_fano_space():
    """About 2 bits and the low bits a value, and less than 64."""
    values = np.cumsum(np.random.default_rng(1).integers(1, 900, 50_000)).astype(np.uint64)
    assert 8 * len(EliasFano.encode(values).to_bytes()) / len(values) < 2.2 + np.log2(900)


def test_blocks_round_trip():
    docs = [np.array(x, "<u4") for x in ([2], [5, 6, 2], [], [49407, 2])]
    block = Block(pack_block([None, -5, 7, 7], docs, 2))
    assert block.doc_ids == [None, -5, 7, 7]
    assert [block.document(i).tolist() for i in range(4)] == [d.tolist() for d in docs]


def test_pieces_equal_the_tokenizer():
    pieces, whole, r = piece_ids(tokenizer_file()), Tokenizer.from_file(tokenizer_file()), random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice("aZé'sStT1<|>! \nßÀ÷²µ.́Σς-dDmvel") for _ in range(r.randint(0, 14)))
        assert whole.encode(text, add_special_tokens=False).ids == pieces.encode(text).tolist(), text


def test_digest(docs, none, words):
    whole = Tokenizer.from_file(tokenizer_file())
    at, wanted = 0, []
    for doc_id, text, *_ in sorted(words, key=lambda w: (w[0] is not None, w[0] or 0)):
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        wanted.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, write_and_digest(docs).collect()), key=lambda r: r[1]) == wanted
    assert write_and_digest(none).count() == 0
    twice = sorted(map(tuple, write_and_digest(docs.union(docs).withColumn("part", docs.n_chars)).collect()), key=lambda r: r[1])
    assert len(twice) == 2 * len(wanted) and [r[1] for r in twice] == np.cumsum([0, *(r[2] for r in twice)])[:-1].tolist()
