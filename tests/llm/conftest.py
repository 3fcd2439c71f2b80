from __future__ import annotations

import pytest

LONG = " ".join(f"word{i} the and" for i in range(4000))
COPY = "the quick brown fox jumps over the lazy dog and runs away from all the other animals in the wood " * 4


def edge_rows():
    """Null, blank, short, long, repeated and equal texts; null and repeated ids; odd characters."""
    near = COPY.replace("quick", "slow", 1)
    rows = [(1, COPY, "en", "a"), (1, COPY, "en", "a"), (2, COPY, "en", "b"), (3, near, "en", None), (4, None, None, "a"), (5, "", "en", "a"), (6, " \t\n ", "de", "b"), (7, "one two", "en", "b"),
            (8, "One TWO", "en", "b"), (9, LONG, "en", "a"), (None, "no id here at all my friend", "en", "a"), (10, "12 34 !?", "fr", "a"), (11, "Ärger über größe <|endoftext|> 中文 ½", "de", "a")]
    return [(*r, len(r[1] or ""), "x", 7, "extra") for r in rows]


#: Extra columns clash with names that operators use for their own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n long, mix_key string"


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
