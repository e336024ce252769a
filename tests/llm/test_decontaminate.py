import random
import re

import numpy as np
import pytest

from varispan.llm import decontaminate as D


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def holds(text, passage):
    t, p = b" ".join(words(text)), b" ".join(words(passage))
    return len(words(passage)) >= D.MIN_WORDS and b" " + p + b" " in b" " + t + b" "


def test_whole_passages_are_found(spark, sf, texts):
    """Every document with an item word for word is found, and what is found shares most of the item's words in order."""
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r for r in D.op8_decontaminate(spark, sf).collect()}
    want = {(i, k) for i, t in texts for k, p in bench if holds(t, p)}
    assert want and want <= set(got)
    for (i, k), r in got.items():
        assert 0.6 <= r.lcs <= 1 and (r.lcs >= 0.8 or r.answered)


FILLER = [f"w{i}" for i in range(3000)]


def passage(rng, n):
    return [rng.choice(FILLER) for _ in range(n)]


@pytest.fixture(scope="module")
def planted(spark):
    """Items of several lengths put whole, paraphrased and cut into documents at odd places; and clean documents."""
    rng = random.Random(4)
    items = {k: passage(rng, n) for k, n in enumerate((8, 20, 29, 30, 49, 50, 60, 61, 130), 1)}
    docs, want = {0: "clean " + " ".join(passage(rng, 400))}, set()
    for k, w in items.items():
        for how in range(4):
            i = 10 * k + how
            part = list(w)
            if how == 1:  # a tenth of the words replaced
                for j in rng.sample(range(len(part)), len(part) // 10):
                    part[j] = rng.choice(FILLER)
            if how == 2:  # a word let into every tenth place
                part = [x for j, y in enumerate(part) for x in ([y, rng.choice(FILLER)] if j % 10 == 9 else [y])]
            if how == 3:
                part = [x.upper() + "," for x in part]
            docs[i] = " ".join(passage(rng, rng.randint(0, 95)) + part + passage(rng, rng.randint(0, 95)))
            want.add((i, k))
    for i in range(900, 960):
        docs[i] = " ".join(passage(rng, rng.randint(5, 300)))
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string"), want


def test_paraphrases_are_found_and_clean_texts_are_not(planted):
    docs, bench, want = planted
    got = {(r.doc_id, r.item_id) for r in D.find(docs, bench).collect()}
    assert want <= got
    assert got == want


def test_short_items_of_common_words_are_found(spark):
    """Whole copies of items of 5 to 7 words that most documents hold, in long documents of rare words, at any place."""
    rng = random.Random(12)
    common = [f"c{i}" for i in range(40)]
    items = {n: rng.sample(common, n) for n in (5, 6, 7)} | {n: rng.sample(common, 8) + passage(rng, n - 8) for n in (12, 29)}
    docs, want = {}, set()
    for k, w in items.items():
        for place in range(10):
            text = passage(rng, 60)
            docs[100 * k + place] = " ".join(text[:place] + w + text[place:])
            want.add((100 * k + place, k))
        docs[100 * k + 10], docs[100 * k + 11] = " ".join(w), " ".join(passage(rng, 50) + w)
        want |= {(100 * k + 10, k), (100 * k + 11, k)}
    for i in range(200):
        docs[10_000 + i] = " ".join(x for c in rng.sample(common, 40) for x in (c, *passage(rng, 5)))
    docs = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.find(docs, bench).collect()} == want


def settled(text, passages):
    """Brute force: the best share of a passage's words in order over all runs of whole blocks of the text, by the table; answers at 0.6."""
    t, out = words(text), {}
    for item, p in passages:
        size = 2 if len(p) < 30 else 4 if len(p) < 50 else 6
        tail = p[-max(3, min(6, len(p) // 4)) :]
        for at in range(0, len(t), D.BLOCK):
            span = t[max(0, at - D.BLOCK) : at + (size + 1) * D.BLOCK]
            share = lcs(p, span) / len(p)
            if share >= 0.8 or share >= 0.6 and any(span[i : i + len(tail)] == tail for i in range(len(span))):
                out[item] = max(out.get(item, 0), share)
    return out


@pytest.fixture(scope="module")
def partly(spark):
    """Documents that hold from half of an item to all of it, in order, with other words in place of the rest; every third one keeps the item's last words."""
    rng = random.Random(21)
    items = {k: passage(rng, n) for k, n in enumerate((24, 36, 60), 1)}
    docs = {}
    for k, w in items.items():
        for i in range(24):
            lost = rng.sample(range(len(w) - (6 if i % 3 == 0 else 0)), int(len(w) * rng.uniform(0, 0.5)))
            part = [rng.choice(FILLER) if j in lost else x for j, x in enumerate(w)]
            docs[100 * k + i] = " ".join(passage(rng, rng.randint(0, 25)) + part + passage(rng, rng.randint(0, 25)))
    return docs, items


def test_search_equals_brute_force(spark, partly):
    docs, items = partly
    got = {(r.doc_id, r.item_id): r.lcs for r in D.find(*tables(spark, docs, items)).collect()}
    want = {(i, k): share for i, t in docs.items() for k, share in settled(t, [(k, words(" ".join(w))) for k, w in items.items()]).items()}
    assert 20 < len(want) < len(docs) and set(got) == set(want)
    assert all(got[key] <= want[key] + 1e-9 for key in got)


def tables(spark, docs, items):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")


def test_parts_of_a_large_benchmark_give_the_same(spark, planted, odd):
    """Several indexes find what one does, an item's passages in different ones, rows given twice, null ids and repeated items included."""
    docs, bench, want = planted
    twice = docs.union(docs.where("doc_id in (10, 90)")).union(docs.where("doc_id = 90").selectExpr("cast(null as long)", "text"))
    again = bench.union(bench)
    one, several = (sorted((r.doc_id or -1, r.item_id, r.lcs, r.answered) for r in D.find(twice, again, most=m).collect()) for m in (D.PASSAGES, 3))
    assert one == several and len(one) == len(want) + 3
    assert D.find(odd, bench, most=1).count() == 0


def test_products_in_blocks_give_the_same(spark, planted, monkeypatch):
    docs, bench, want = planted
    df, n = D.document_frequencies(docs)
    index = D.build_index(bench, np.log((1 + n) / (1 + df)) + 0.05)
    texts = [r.text.encode() for r in docs.orderBy("doc_id").collect()]
    _, _, row, h = D.words_of(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), D._KEEP)
    kind = [np.flatnonzero(index.size < 30), np.flatnonzero((index.size >= 30) & (index.size < 50)), np.flatnonzero(index.size >= 50)]
    found = lambda: sorted((d, p) for d, p, _ in D._candidates(row, h, len(texts), index, index.idf.astype(float) ** 2, kind, 0.5))
    whole = found()
    monkeypatch.setattr(D, "CELLS", 7)
    assert whole and found() == whole


def test_stage(spark, planted, monkeypatch, tmp_path):
    docs, bench, want = planted
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r.doc_id for r in D.stage(spark, docs, str(tmp_path)).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {i for i, _ in want}


def test_common_subsequence_equals_table():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 70))] for _ in range(2))
        masks = {}
        for i, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << i
        assert D.common_subsequence(masks, len(a), b) == lcs(a, b)


def test_basis_explains_the_benchmark(spark, planted):
    """With a rank of the benchmark's own, the randomised factors hold the passages' products exactly."""
    docs, bench, _ = planted
    df, n = D.document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 0.05
    index = D.build_index(bench, idf, items_per_task=2)
    dense = np.zeros((len(index.words), D.FEATURES), np.float32)
    for row, (f, w) in zip(dense, D._rows(index.words, idf)):
        row[f] = w
    own = dense[:, index.slot >= 0] @ index.basis
    assert np.allclose(own @ own.T, dense @ dense.T, rtol=1e-3, atol=1e-2)


def test_tasks_hand_on_rows_of_their_own_features(spark, planted, monkeypatch):
    """What is added up follows the passages' features, in however many tasks they are."""
    _, bench, _ = planted
    idf, sent, plain = np.ones(D.FEATURES), [], D.arrow_map
    scratch = D.Scratch(spark, "t")

    def kept(df, run, schema):
        sent.append(scratch.save(plain(df, run, schema)))
        return sent[-1]

    monkeypatch.setattr(D, "arrow_map", kept)
    index = D.build_index(bench, idf, items_per_task=1)
    k = min(len(index.words), D.RANK + 16)
    sketch, gram = (sum(len(r.m) for r in t.select("m").collect()) for t in sent if "piece" in t.columns)
    assert 0 < sketch <= 8 * k * sum(len(f) for f, _ in D._rows(index.words, idf))
    assert 0 < gram <= 8 * k * k * len(index.words)


def test_frequencies_count_passages(spark):
    text = " ".join(["same"] * 130)
    df, n = D.document_frequencies(spark.createDataFrame([(1, text), (2, "same other"), (3, None), (4, "")], "doc_id long, text string"))
    assert n == 4 and sorted(df[df > 0].tolist()) == [1, 4]


def test_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "plain words that say a thing or two about nothing much"), (2, None), (None, "no id here at all now"), (3, "too short"), (4, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in D.find(odd, bench).collect())
    assert got == [(5, 1), (5, 1)]
    assert D.find(nothing, bench).count() == 0
    assert D.find(odd, bench.where("false")).count() == 0
