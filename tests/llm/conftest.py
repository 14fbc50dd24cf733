from __future__ import annotations

import random

import pytest

WORDS = "the and with token stone river light paper under over music garden winter summer house road".split()


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + (r.choice("xyz") if r.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and very long texts, repeated rows and ids, and columns whose names clash."""
    r = random.Random(3)
    long = prose(r, 40000)
    rows = [(1, None, "en"), (2, "", None), (None, "no id here at all", "en"), (3, prose(r, 60), "en"), (3, prose(r, 60), "en"), (4, "x", "fr"), (5, " \n\t ", "fr"), (6, long, "de"), (7, "é漢字😀 " * 50, None), (8, "a" * 5000, "en")]
    same = (9, prose(r, 80), "en")
    rows += [same, same, (10, same[1], "en")]
    df = spark.createDataFrame([(i, t, lang, None, None, 1, 2.0, "z", b"q") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, th string, ids binary")
    return df.withColumnRenamed("fp", "key")


@pytest.fixture(scope="session")
def none_at_all(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (6, 0, 1), (9, 1, 0), (9, 0, 0), (None, 1, 1), (4, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (None, "some item without any id at all, but long"), (4, "tiny")], "item_id long, text string")
