import pytest

from varispan.operators import conserve as C

ROWS = [("f", "en", "ACGTNacgtRYGGCA"), ("f", "en", "acgtacgtacgtnnACGGT"), ("g", "de", "ACGTACGTAAAA"), ("g", "de", None), ("g", "de", "AC"), ("h", "de", "TTTTACGTACGT")]


def rows(df):
    return sorted(tuple(r) for r in df.select("l", "r", "d", "label", "file", "n").collect())


@pytest.mark.parametrize("sizes", [(2, 1, 2), (5, 4, 5)])
@pytest.mark.parametrize("omit_soft", [False, True])
def test_counting_before_splitting_counts_the_same(spark, sizes, omit_soft):
    df = spark.createDataFrame(ROWS, "file string, label string, seq string")
    got = rows(C.amplicon_counts(df, *sizes, omit_soft))
    assert got == rows(C.count_amplicons(C.split_kmers(df, *sizes, omit_soft)))


def test_kmers_are_cut_once(spark):
    """The masks of files and the rows of the keys that are left share one shuffle of counted k-mers."""
    df = spark.createDataFrame(ROWS, "file string, label string, seq string")
    found = C.conserved(C.amplicon_counts(df, 2, 1, 2), ["f", "g", "h"])
    assert found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a05_unique_cols", "a07_consensus"])
def test_registered_queries_complement_different_kmers_alone(spark, name):
    """Complements are made above the first count, not of each k-mer of each document."""
    from varispan.plans import queries as Q

    plan = Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = [i for i, line in enumerate(plan) if "Generate explode(array(" in line]
    assert made and all(any("Aggregate [kmer" in line for line in plan[i + 1 : i + 5]) for i in made)
