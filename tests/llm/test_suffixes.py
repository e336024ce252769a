import hashlib
import random

import numpy as np
import pytest

from varispan.llm import suffixes


def plain(rows):
    """(doc_id, bytes) in order: removed masks by a table of first starts."""
    first, out = {}, []
    for i, t in rows:
        gone = bytearray(len(t))
        for s in range(len(t) - 99):
            w = t[s : s + 100]
            if first.setdefault(w, (i, s)) != (i, s):
                gone[s : s + 100] = b"\x01" * 100
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_query_equals_brute_force(spark, sf, texts):
    want = plain([(i, (t or "").encode()) for i, t in texts])
    assert any(r[2] for r in want)
    assert rows_of(suffixes.op5_suffixes(spark, sf)) == sorted(want)


def tangle(seed):
    """Copies, shared stretches with differing edges, repeats inside a document, periodic text and multi-byte letters."""
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared = [line(n) for n in (99, 100, 101, 150, 400)]
    docs = []
    for i in range(60):
        parts = [line(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(shared)
            a = rng.randint(0, 30)
            parts += [s[a:] if rng.random() < 0.5 else s, line(rng.randint(0, 60))]
        docs.append("".join(parts))
    docs += [docs[3], docs[3], "ab" * 300, "b" + "ab" * 120, "x" * 500, shared[4] * 3, ""]
    return [(i * 2 + 1, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed, hot", [(1, suffixes.HOT), (2, 3)])
def test_tangled_texts_equal_brute_force(spark, seed, hot):
    """Also with a hot limit so low that the hashed path settles most of them."""
    docs = tangle(seed)
    got = rows_of(suffixes.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), hot=hot))
    assert got == sorted(plain([(i, t.encode()) for i, t in docs]))


def test_merged_transforms_sort_all_suffixes():
    """The interleave of the shards' transforms is the order of all suffixes, with their common prefixes."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 3, n).astype(np.uint8) for n in (0, 5, 130, 130, 260, 7, 400)]
    texts.append(texts[4][20:180])
    shards, suffix = [], []
    for i in range(0, len(texts), 3):
        part = texts[i : i + 3]
        off = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
        flat = np.zeros(off[-1], np.uint16)
        for t, a in zip(part, off):
            flat[a : a + len(t)] = t.astype(np.uint16) + 1
        start, symbol, back = suffixes.shard_bwt(flat, off)
        shards.append((symbol, back))
        own = np.searchsorted(off, start, side="right") - 1
        suffix += [bytes(part[o][s - off[o] :].astype(np.uint8) + 1) + b"\0" for o, s in zip(own, start)]
    order, lcp = suffixes.merge_bwts(shards)
    sorted_ = [suffix[i] for i in order]
    depth = suffixes.WINDOW
    assert [s[:depth] for s in sorted_] == sorted(s[:depth] for s in suffix)
    for k in range(1, len(sorted_)):
        a, b = sorted_[k - 1], sorted_[k]
        n = 0
        while n < min(depth, len(a), len(b)) and a[n] == b[n]:
            n += 1
        # past an end, where strings count as equal, no prefix is defined
        assert lcp[k] >= n if b"\0" in a[:n] else lcp[k] == n


def test_kept_text(spark):
    rng = random.Random(4)
    t = "".join(rng.choice("abcdef") for _ in range(300))
    df = spark.createDataFrame([(1, t), (2, "pre " + t + " post")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffixes.dedup(df, keep_text=True).collect()}
    assert got == {1: t.encode(), 2: b"pre  post"}


def test_odd_rows(odd, nothing):
    rows = suffixes.dedup(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].n_bytes == 0 and by[8].n_removed == 300_000 - 5 and by[7].n_removed == 400 - 2
    assert [r.n_removed for r in rows if r.doc_id == 5] == [0, 0]
    assert suffixes.dedup(nothing).count() == 0
