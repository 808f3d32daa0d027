import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: extra columns that clash with names used inside
EXTRA = ", _key string, key long, size string, _events int, `_none` boolean, start int, shard string, `a.b` int"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty and long texts, repeated rows and ids, and clashing columns."""
    rng = random.Random(7)
    long_text = words(rng, 60_000)
    plain = [(i, words(rng, 80), "en", f"s{i % 3}") for i in range(40)]
    rows = plain + [
        (100, None, "en", "s0"), (101, "", "en", "s1"), (102, " \n\t ", None, None), (None, words(rng, 70), "en", "s0"), (None, None, None, None),
        (103, long_text, "en", "s2"), (104, long_text + " x", "en", "s2"), (105, "one", "de", ""), (106, "ein zwei drei", "de", None),
        (0, plain[0][1], "en", "s0"), (1, plain[1][1], "en", "s1"), (1, "another text under the same id", "en", "s1"), (107, plain[5][1], "fr", "s9"),
    ]
    full = [(i, t, lang, src, None if t is None else len(t), "k", 1, None, 3, None, 0, "x", 9) for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA + EXTRA)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
