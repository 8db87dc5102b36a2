import random

import pytest

ODD = [None, "", "   ", "word", "a b", "é ñ ß 中文 字", "x" * 5000, "a b c d e " * 2000, "tab\tand\nline\r\nend"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null columns, empty and very long texts, repeated rows and keys, and extra columns with clashing names."""
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", i, "e", 1) for i, t in enumerate(ODD)]
    rows += [(3, "word", "en", "s", 4, "e", 1), (None, "word", None, None, None, None, None), (100, "a b c d e " * 2000, "fr", "t", 1, "e", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def prose(rnd: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rnd.randint(0, words)}" for _ in range(n))
