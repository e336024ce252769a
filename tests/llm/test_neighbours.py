import math

import numpy as np
import pytest

from varispan.llm import neighbours


def plain(rows, k):
    """{query: [(vec_id, score)]} over all rows, in double precision."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % 20 == 0:
            out[q] = sorted(((i, float(x @ y)) for i, y in good if i != q), key=lambda r: (-r[1], r[0]))[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        own = out.setdefault(r.query_id, [])
        assert r["rank"] == len(own) + 1
        own.append((r.vec_id, r.score))
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) for q, near in want.items())
    return hits / sum(map(len, want.values()))


def test_query_recall_and_scores(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = plain(rows, 20), found(neighbours.op1_neighbours(spark, sf))
    assert recall(got, want) >= 0.9
    exact = {q: dict(plain([(i, v) for i, v in rows if i == q] + [(i, v) for i, v in rows if i != q], len(rows))[q]) for q in list(want)[:3]}
    for q, scores in exact.items():
        assert all(abs(scores[i] - s) < 1e-9 for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda r: (-r[1], r[0]))


def test_odd_vectors_ties_and_clashing_names(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 60)]
    rows += [(100, [1.0] * 8), *((200 + i, [1.0] * 8) for i in range(1, 40)), (None, [1.0] * 8), (301, None), (302, []), (303, [0.0] * 8), (320, [None] + [1.0] * 7), (340, [float("nan")] + [1.0] * 7), (360, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in rows], "vec_id long, embedding array<double>, key int, id string, score double")
    got = found(neighbours.search(df, k=20, recall=1.0, sample=1000))
    want = plain(rows, 20)
    assert set(got) == set(want) == {20, 40, 100, 220}
    # equal vectors: the smaller ids, whole and in order
    assert [i for i, _ in got[100]] == [i for i, _ in want[100]]
    assert recall(got, want) >= 0.9


def test_copies_do_not_swell_the_index(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(500)], "vec_id long, embedding array<double>")
    assert neighbours.distinct_candidates(neighbours.usable(df), 20).count() == 21
    got = found(neighbours.search(df))
    assert [i for i, _ in got[0]] == list(range(1, 21)) and [i for i, _ in got[480]] == list(range(20))


def test_repeated_rows_take_no_places(spark):
    """Ids stored many times, with one vector or with several, hide no other id."""
    rng = np.random.default_rng(9)
    rows = [(3, [1.0, 2.0])] * 21 + [(i, [1.0, 2.0]) for i in range(20, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(r.vec_id for r in neighbours.distinct_candidates(neighbours.usable(df), 20).collect()) == [3, *range(20, 40)]
    got = found(neighbours.search(df))
    assert [i for i, _ in got[20]] == [3, *range(21, 40)]
    ids = np.array([7] * 25 + list(range(100, 140)))
    score = np.concatenate([5 + rng.random(25), rng.random(40)])[None, :]
    q, c = neighbours.best(np.array([20]), ids, score, 20)
    want = sorted(range(25, 65), key=lambda j: -score[0, j])[:19]
    assert c.tolist() == [int(score[0, :25].argmax()), *want]


def test_few_candidates_are_all_returned(spark, monkeypatch):
    """Also where the probes alone would find some of them only."""
    monkeypatch.setattr(neighbours, "calibrate", lambda *a: 1)
    monkeypatch.setattr(neighbours, "CANDIDATES", 7)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(20, 41)]
    got = found(neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=30))
    want = plain(rows, 30)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


@pytest.mark.parametrize("rows", [[], [(20, [1.0, 0.0])], [(20, [0.0, 0.0]), (21, None)]])
def test_too_few(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = neighbours.search(df)
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.count() == 0


def test_transform_is_a_rotation():
    x = np.random.default_rng(1).normal(size=(4, 16))
    y = neighbours.hadamard(x)
    assert np.allclose(x @ x.T, y @ y.T)
    h = neighbours.Hash(10, 2.0, 30 * 200, 3)
    b = h.buckets(np.random.default_rng(2).normal(size=(50, 10)) / 10)
    assert b.shape == (3, 50) and b.min() >= 0 and b.max() < h.keys == 32


@pytest.mark.parametrize("rows", [10, 10_000, 1_000_000, 10**10])
def test_buckets_keep_their_size_as_the_table_grows(rows):
    h = neighbours.Hash(100, 1.0, rows, 1)
    assert 0.5 <= rows / h.keys / neighbours.BUCKET_ROWS <= 2 or h.keys == 2
    x = np.random.default_rng(3).normal(size=(4, 100)) / 20
    # a query's first probe is the bucket of its own direction, and no key comes twice
    near = h.probes(x, 0, 300)
    own = h.buckets(x / np.linalg.norm(x, axis=1, keepdims=True))[0]
    assert (near[:, 0] == own).all()
    assert all(len(set(r)) == min(300, h.keys) for r in near.tolist())


def test_several_axes_find_what_one_would(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", 4)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 12))
    rows = [(i, (centres[i % 40] + 0.2 * rng.normal(size=12)).tolist()) for i in range(1200)]
    want = plain(rows, 20)
    assert len(neighbours.Hash(12, 1.0, 1200).sizes) == 2
    assert recall(found(neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))), want) >= 0.9


def test_equal_vectors_have_equal_scores_wherever_they_lie(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATES", 5)
    rng = np.random.default_rng(13)
    x, y = rng.normal(size=37).tolist(), rng.normal(size=37).tolist()
    rows = [(20, x)] + [(i, y) for i in range(100, 118)] + [(i, rng.normal(size=37).tolist()) for i in range(200, 219)]
    got = found(neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10))[20]
    scores = {i: s for i, s in got if i < 200}
    assert len(set(scores.values())) <= 1 and sorted(scores) == list(range(100, 100 + len(scores)))


def test_buckets_are_dealt_whole(spark, monkeypatch):
    """With blocks of a few rows the same neighbours are found."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    whole = found(neighbours.search(df))
    monkeypatch.setattr(neighbours, "CANDIDATES", 7)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    assert {q: [i for i, _ in v] for q, v in found(neighbours.search(df)).items()} == {q: [i for i, _ in v] for q, v in whole.items()}
