import random
import zlib

import numpy as np

from varispan.llm import quality


def test_held_out_accuracy(spark, sf):
    """Ranks held-out rows well, and keeps what is clean."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.op4_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    test = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = [s for s, y, _ in test if y == 1], [s for s, y, _ in test if y == 0]
    assert len(good) > 20 and len(bad) > 3
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9
    assert np.mean([p == y for _, y, p in test]) > 0.9
    assert np.mean([p for _, y, p in test if y == 1]) > 0.97


def test_score_is_the_log_density_difference():
    rng = np.random.default_rng(0)
    d = quality.D
    mean = rng.normal(size=(2, d))
    cov = np.stack([np.cov(rng.normal(size=(d, 80)) * (k + 1)) for k in (0, 1)])
    low = np.linalg.cholesky(cov)
    m = quality.Model(0.6, mean, np.linalg.inv(low), 2 * np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1), np.zeros(d), np.ones(d), 1.0)
    x = rng.normal(size=(5, d))
    dens = [-0.5 * (np.einsum("ij,jk,ik->i", x - mean[k], np.linalg.inv(cov[k]), x - mean[k]) + np.linalg.slogdet(cov[k])[1]) for k in (0, 1)]
    want = 1 / (1 + np.exp(-(np.log(0.6 / 0.4) + dens[1] - dens[0])))
    assert np.allclose(m.score(x), want)


def test_statistics_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab C1!|#é.\n") for _ in range(rng.randint(0, 300))).encode() for _ in range(50)]
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = quality.statistics(raw, off)
    for i, t in enumerate(texts):
        assert np.allclose(quality.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0], whole[i])


def test_odd_rows_and_no_labels(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, None), (None, 1), (8, 7)], "doc_id long, quality int")
    for table in (labels, labels.where("false")):
        rows = quality.classify(odd, table).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out for r in rows if r.doc_id is None)
    assert quality.classify(nothing, labels).count() == 0


def test_fit_equals_brute_force(spark):
    """Means, shrunk covariances and prior against numpy over all labelled rows at once, however they are dealt to tasks."""
    rng = np.random.default_rng(4)
    d = quality.D
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, d)) * (1 + y[:, None]) + y[:, None]
    rows = [(int(k), [float(v) for v in z]) for k, z in zip(y, x)] + [(None, [0.0] * d), (7, [1.0] * d)]
    m = quality.fit(spark.createDataFrame(rows, "quality int, f array<double>").repartition(5), 0.1, 1e-3)
    own = [x[y == k] for k in (0, 1)]
    cov = [np.cov(z.T, bias=True) for z in own]
    pooled = sum(len(z) * c for z, c in zip(own, cov)) / len(x)
    sd = np.sqrt(np.diag(pooled))
    assert np.isclose(m.prior, (len(own[1]) + 1) / (len(x) + 2))
    for k in (0, 1):
        assert np.allclose(m.mean[k], (own[k].mean(0) - own[1].mean(0)) / sd)
        c = (0.9 * cov[k] + 0.1 * pooled) / np.outer(sd, sd)
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-3 * np.eye(d)
        assert np.allclose(m.inv[k].T @ m.inv[k], np.linalg.inv(c))
        assert np.isclose(m.log_det[k], np.linalg.slogdet(c)[1])
