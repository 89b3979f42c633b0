import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

KIND = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept string, score string, piece string, fingerprint string, n_words string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, equal texts, repeated rows, columns named like outputs."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
    texts = [None, "", "   \n\t ", "one", "a b c d e f g h i j k l", "a b c d e f g h i j k l", "line one\nline two\nline three\nend", "line one\nline two\nline three\nother", long, "Ünï çødé ▁ 日本 🎉"]
    rows = [(i, t, ["en", None, "de"][i % 3], [None, "x", "y"][i % 3], None, "s", "k", "?", "p", "f", "w") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], rows[0], (None, "no key at all here", None, None, 3, None, None, None, None, None, None), (None,) * 11]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], KIND)
