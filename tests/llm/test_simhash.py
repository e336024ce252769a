import random

import pytest
import xxhash

from varispan.llm import common, simhash
from varispan.llm.common import Scratch, connected_components, forest_components


def plain_fingerprint(text, words):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    w = low.split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if len(w) >= words else [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, tau):
    """fps: (id, fingerprint); smallest id reachable of each."""
    ids = [i for i, _ in fps]
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x, (i, f) in enumerate(fps):
        for j, g in fps[x + 1 :]:
            if (f ^ g).bit_count() <= tau:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in ids}


def test_query_equals_brute_force(spark, sf, texts):
    want = [(i, plain_fingerprint(t, 3)) for i, t in texts]
    roots = plain_components(want, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_simhash(spark, sf).collect()}
    assert got == {i: (f"{f:016x}", roots[i]) for i, f in want}


@pytest.mark.parametrize("bucket", [1, 4, 10_000])
def test_links_equal_brute_force_at_any_bucket_size(spark, bucket):
    """Hot buckets go by midpoints: chains, a dense ball and far apart fingerprints come out alike."""
    rng = random.Random(bucket)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for b in base[:3]:
        for _ in range(40):
            f = b
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    rows = sorted(enumerate(sorted(fps)))
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in rows]
    df = spark.createDataFrame(signed, "fp long, rep long")
    scratch = Scratch(spark, "t")
    got = {r.node: r.root for r in connected_components(simhash.links(df, 2, scratch, bucket), scratch).collect()}
    want = plain_components(rows, 2)
    assert {i: got.get(i, i) for i, _ in rows} == want


def plain_similar(rows, words, least):
    """{id: smallest id reachable} over Jaccard similarities of all pairs."""
    sets = {i: set(simhash.shingle_hashes((t or "").encode(), words).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b):
                p, q = sorted((top(i), top(j)))
                parent[q] = p
    return {i: top(i) for i in ids}


def test_similar_documents_equal_brute_force(spark, sf, texts):
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    want = plain_similar(texts, 5, 0.8)
    assert got == want and len(set(want.values())) < len(want)


@pytest.mark.parametrize("outsiders", [64, 2])
def test_similarity_is_settled_on_whole_texts(spark, monkeypatch, outsiders):
    """Near copies of a long and a short text at growing distance; large bands go by their hubs, mixed ones are split."""
    monkeypatch.setattr(simhash, "OUTSIDERS", outsiders)
    rng = random.Random(6)
    rows = []
    for base, n in ((0, 60), (1000, 900)):
        text = [f"t{rng.randrange(5000)}" for _ in range(n)]
        rows.append((base, " ".join(text)))
        for k in range(1, 40):
            own = list(text)
            for j in rng.sample(range(n), max(1, n * k // 400)):
                own[j] = f"x{rng.random()}"
            rows.append((base + k, " ".join(own)))
    rows += [(2000 + k, " ".join(f"y{rng.random()}" for _ in range(50))) for k in range(20)] + [(3000, "Same Words"), (3001, "same  words"), (3002, "same words more")]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_similar([(i, t.lower()) for i, t in rows], 5, 0.8)


@pytest.mark.parametrize("outsiders", [2, 128])
def test_links_in_a_crowd_just_below_the_threshold(spark, monkeypatch, outsiders):
    """Texts of one template at a mutual similarity of 0.78, some pairs of them at 0.815 or 0.85: all share bands, few link."""
    monkeypatch.setattr(simhash, "OUTSIDERS", outsiders)
    rng = random.Random(8)
    template = [f"t{i}" for i in range(400)]
    rows = []
    for k in range(200):
        rows.append((k, template + [f"x{rng.random()}" for _ in range(56)]))
        if k % 5 == 0:
            same = 10 if k % 2 else 20
            rows.append((1000 + k, rows[-1][1][: 400 + same] + [f"x{rng.random()}" for _ in range(56 - same)]))
    rows = [(i, " ".join(w)) for i, w in rows]
    want = plain_similar(rows, 5, 0.8)
    assert sum(i != r for i, r in want.items()) == 40
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_overlaps(monkeypatch):
    import numpy as np

    monkeypatch.setattr(simhash, "COLUMNS", 7)
    rng = np.random.default_rng(2)
    xs, ys = ([np.unique(rng.integers(0, 90, n).astype(np.uint64)) for n in sizes] for sizes in ((0, 5, 40, 80), (30, 0, 60)))
    assert simhash.overlaps(xs, ys).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in ys] for x in xs]


def test_allocation_covers_the_distance():
    """Thresholds sum to tau + 1 with one added to each: the generalised pigeonhole bound."""
    import numpy as np

    rng = np.random.default_rng(1)
    sample = rng.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64)
    for m in (1, 2, 3, 4):
        parts = simhash.correlated_parts(300, np.full((64, 64), 75.0) + np.eye(64) * 75, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        _, ts = simhash.allocate(parts, sample, 10_000, 2)
        assert sum(t + 1 for t in ts) == 3


@pytest.mark.parametrize("components", [connected_components, forest_components])
def test_components_of_chains_and_hubs(spark, components):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 200)] + [(500, 500), (None, 7), (300, 301), (301, 300)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 200)}, 300: 300, 301: 300}


@pytest.mark.parametrize("most", [1, 3, 1 << 19])
def test_forest_components_of_random_graphs(spark, monkeypatch, most):
    """However few edges a task joins at once, and with a long chain of shuffled names dealt over many tasks."""
    monkeypatch.setattr(common, "FOREST_EDGES", most)
    rng = random.Random(most)
    names = rng.sample(range(10_000), 400)
    edges = list(zip(names[:150], names[1:151])) + [(rng.choice(names[150:]), rng.choice(names[150:])) for _ in range(160)]
    parent = {n: n for e in edges for n in e}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        p, q = sorted((top(a), top(b)))
        parent[q] = p
    want = {n: top(n) for e in edges if e[0] != e[1] for n in e}
    df = spark.createDataFrame(edges, "a long, b long").repartition(8)
    rows = forest_components(df, Scratch(spark, "t")).collect()
    assert len(rows) == len(want) and {r.node: r.root for r in rows} == want


def test_odd_rows(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[1].component_id == by[3].component_id == 1
    assert sum(r.doc_id == 5 for r in rows) == 2
    assert simhash.near_duplicates(nothing).count() == 0


def test_stage_keeps_one_of_each_group(spark, odd, nothing):
    kept = simhash.stage(spark, odd, "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 4, 5, 7, 8, 9]
    assert sum(r.doc_id is None for r in kept) == 2
    assert kept[0].asDict().keys() == odd.first().asDict().keys()
    assert simhash.stage(spark, nothing, "").count() == 0
