import os

import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def texts(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


ODD_TEXTS = [(1, None), (2, ""), (3, "  \n "), (4, "a"), (5, "plain words that say a thing or two about nothing much"), (5, "plain words that say a thing or two about nothing much"), (None, "no id here"), (None, None), (7, "é" * 200), (8, "word " * 60_000), (9, "\x00\x1f|||###")]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names clash with those inside."""
    rows = [(i, t, None if i == 4 else "en", None if i == 5 else "src1", 0, "x", 1.5, "y") for i, t in ODD_TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, node string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
