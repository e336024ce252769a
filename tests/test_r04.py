import random
from pathlib import Path

import numpy as np
import pytest

from varispan.operators import primers as P
from varispan.operators import regions as R
from varispan.plans import queries as Q

DATA = "/root/testdata/sf0.001"


def test_primers_at_once_equal_one_by_one():
    """Same primers, same penalties to the last bit."""
    rng = random.Random(7)
    o = P.PrimerOptions(tm=(40, 75), primer_size=(8, 35), gc=(30, 80))
    for letters in ("ACGT", "ACGTacgtN", "AACCGT", "GC"):
        seq = "".join(rng.choice(letters) for _ in range(160)) + "GAATTCGAATTC"
        at = [(i, n) for i in range(len(seq)) for n in range(8, 36) if i + n <= len(seq)]
        kept, penalty = P.acceptable_all(seq, *(np.array(x) for x in zip(*at)), o)
        want = {x: p for x in at if (p := P.acceptable(seq[x[0] : sum(x)], o)) is not None}
        assert {at[k]: p for k, p in zip(kept.tolist(), penalty.tolist())} == want


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")
def test_calls_are_read_once(spark):
    plan = Q.grouped(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_quantity") and plan.count("Relation [") == 2  # lineitem and part


def test_no_stretch_takes_the_chromosome_with_it(spark):
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(1000))
    tiles = R.reference_tiles(spark.createDataFrame([("c", seq), ("e", "")], "chrom string, seq string"), R.RegionOptions(tile=300, halo=50))
    assert {(r.chrom, r.tile, r.origin, r.seq) for r in tiles.collect()} == {("e", 0, 0, "")} | {("c", t, max(0, t * 300 - 50), seq[max(0, t * 300 - 50) : t * 300 + 350]) for t in range(4)}
