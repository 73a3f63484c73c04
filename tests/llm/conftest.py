import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def words():
    """Texts of odd kinds: null, empty, blank, short, repeated, very long, with other scripts."""
    base = "the quick brown fox jumps over the lazy dog and then some more words follow here for good measure indeed".split()
    texts = [None, "", " \n\t ", "one two", "One TWO", " ".join(base), " ".join(base), " ".join(base[:-1] + ["surely"]), "é ß 한국 " + " ".join(base[::-1]), "a b c d e " * 20000, "x" * 100000]
    return [(k if k != 3 else None, t, "en", f"src{k % 3}" if k % 5 else None, len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, words):
    return spark.createDataFrame(words, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
