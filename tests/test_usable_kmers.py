import random

import pytest

from varispan.operators import primers as P


@pytest.mark.parametrize("stretch", [1 << 18, 50])
def test_usable_kmers_equal_one_by_one(spark, monkeypatch, stretch):
    """Also across stretches and with keys that occur twice, other letters, and sequences that are short, empty or null."""
    rng = random.Random(3)
    o = P.PrimerOptions(tm=(40, 70), max_end_gc=5)
    data = [(i % 7, "".join(rng.choice("ACGGTC" + "N" * (i % 2)) for _ in range(rng.choice([11, 12, 13, 200])))) for i in range(40)] + [(90, ""), (91, None), (None, "GATTACAGATTACAGGC" * 3)]
    want = {}
    for key, seq in data:
        for i in range(len(seq or "") - 11):
            if (p := P.acceptable(seq[i : i + 12], o)) is not None:
                n, least = want.get(key, (0, p))
                want[key] = n + 1, min(least, p)
    monkeypatch.setattr(P, "STRETCH", stretch)
    df = spark.createDataFrame(data, "id long, seq string")
    # as the workers have their own copy of STRETCH, the stretches are tried in this process
    run = {}
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: run.update(f=f) or self)
    P.usable_kmers(df, 12, o)
    got = {}
    for batch in run["f"](iter(df.toArrow().to_batches())):
        for r in batch.to_pylist():
            n, least = got.get(r["id"], (0, r["least_penalty"]))
            got[r["id"]] = n + r["n"], min(least, r["least_penalty"])
    assert got == want and len(want) > 5


def test_no_row_is_made_of_a_kmer(spark):
    """Sequences go to the judge whole: nothing in the plan multiplies rows."""
    from varispan.plans import queries as Q

    plan = Q.p01_pair(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
