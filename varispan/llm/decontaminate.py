"""Benchmark decontamination: latent semantic candidates, then longest common subsequences and answers.

Benchmark passages are TF-IDF rows over hashed words (document frequencies from all passages of the corpus).
A distributed randomised SVD gives their latent basis; every window of every document is projected into it
and compared by cosine; candidates are settled on the words themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, chunks, text_buffers, words_of

FEATURES = 1 << 17
#: Words in a block; windows are 2, 4 or 6 blocks, one block apart.
BLOCK = 10
WINDOWS = (2, 4, 6)
PART = BLOCK * max(WINDOWS)
MIN_WORDS = 5
RANK = 256
FOUND = "doc_id long, item_id long, cosine double, lcs double, answered boolean"
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_CHUNK = 1 << 19
#: Passages in one index, which every task gets whole; a larger benchmark is searched in several.
PASSAGES = 8192
#: Features in one piece of a sum; rows in one of the small square sum.
SUM_ROWS, GRAM_ROWS = 1024, 32
#: Cells of a product of windows and passages that are held at once.
CELLS = 1 << 22
#: Everything that is not an ASCII letter or digit, or a byte of a longer UTF-8 character, parts words here.
_KEEP = np.zeros(256, bool)
_KEEP[48:58] = _KEEP[65:91] = _KEEP[97:123] = _KEEP[128:] = True


def feature(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (FEATURES - 1)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Passages (windows of PART words, end to end) that hold each feature, and their number, over all documents. One row per feature and task is shuffled."""

    def run(batches):
        total, n = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            raw, off = text_buffers(b.column(0))
            for i, j in chunks(off):
                _, _, row, h = words_of(raw, off[i : j + 1], _KEEP)
                if not len(h):
                    continue
                first = np.searchsorted(row, np.arange(j - i))
                place = (np.arange(len(h)) - first[row]) // PART
                step = np.ones(len(h), np.int64)
                step[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
                passage = np.cumsum(step) - 1
                n += int(passage[-1]) + 1
                key = np.sort(passage * FEATURES + feature(h))
                key = key[np.concatenate([[True], key[1:] != key[:-1]])]
                total += np.bincount(key & (FEATURES - 1), minlength=FEATURES)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"f": np.append(used, -1).astype(np.int32), "n": np.append(total[used], n)})

    rows = arrow_map(docs.select(F.col("text").cast("string").alias("text")), run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n"))
    got = rows.toPandas()  # at most FEATURES + 1 rows
    df = np.zeros(FEATURES + 1, np.int64)
    df[got.f.to_numpy()] = got.n.to_numpy()
    return df[:-1], int(df[-1])


@dataclass(frozen=True)
class Index:
    """Latent basis and the benchmark passages in it."""

    idf: np.ndarray  # FEATURES
    slot: np.ndarray  # FEATURES -> row of basis, -1 if no benchmark passage has the feature
    basis: np.ndarray  # slots x rank, float32
    item: np.ndarray  # per passage
    size: np.ndarray  # words per passage
    latent: np.ndarray  # passages x rank, scaled so that a product with a window over its norm is the score
    words: list  # per passage, word hashes in order
    answer: list  # per passage, its last words


def passages(text: bytes) -> list[np.ndarray]:
    """Word hashes of an item's passages: runs of PART words, the last one taken from the end so as to be whole."""
    raw = np.frombuffer(text, np.uint8)
    h = words_of(raw, np.array([0, len(raw)]), _KEEP)[3]
    if len(h) < MIN_WORDS:
        return []
    cuts = [h[i : i + PART] for i in range(0, len(h), PART)]
    if len(cuts) > 1 and len(cuts[-1]) < PART:
        cuts[-1] = h[-PART:]
    return cuts


def _rows(words: list[np.ndarray], idf: np.ndarray):
    """Sparse TF-IDF rows: (features, weights) each."""
    for h in words:
        f, tf = np.unique(feature(h), return_counts=True)
        yield f, tf * idf[f]


def passage_rows(benchmark: DataFrame) -> DataFrame:
    """(item_id, words) of every different passage; words are hashes, little-endian."""

    def run(batches):
        for b in batches:
            made = [(i, h.astype("<u8").tobytes()) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for h in passages(t.encode())]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in made], pa.int64()), pa.array([h for _, h in made], pa.binary())], names=["item_id", "words"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    return arrow_map(rows, run, "item_id long, words binary").distinct()


def build_index(benchmark: DataFrame, idf: np.ndarray, rank: int = RANK, oversample: int = 16, seed: int = 5, items_per_task: int = 512) -> Index | None:
    """The index of all passages of ``benchmark``; None if it has none."""
    return index_of(passage_rows(benchmark), idf, rank, oversample, seed, items_per_task)


def index_of(rows: DataFrame, idf: np.ndarray, rank: int = RANK, oversample: int = 16, seed: int = 5, per_task: int = 512) -> Index | None:
    """Randomised SVD (Halko et al. 2011, one power step) of the TF-IDF rows of ``passage_rows``.

    Two passes: A'(A G) for a Gaussian G, whose QR gives Q, and (AQ)'(AQ), whose eigenvectors turn Q into the basis.
    A task holds the features of its own ``per_task`` passages alone and hands on their rows, no others, in pieces of SUM_ROWS features,
    which are added up by piece before any reach the driver. So what meets in a piece follows the passages, in however many tasks they are. There, and in the index that tasks get, are at most PASSAGES passages
    and FEATURES x (rank + oversample) numbers: ``find`` splits a larger benchmark.
    """
    got = rows.orderBy("item_id", "words").collect()
    if not got:
        return None
    item, words = [r.item_id for r in got], [np.frombuffer(r.words, "<u8") for r in got]
    used = np.unique(np.concatenate([feature(h) for h in words]))
    slot = np.full(FEATURES, -1, np.int32)
    slot[used] = np.arange(len(used))
    k = min(rank + oversample, len(words), len(used))
    tasks = -(-len(words) // per_task)
    spread = rows.repartition(tasks, "item_id", "words")

    def own(batches):
        return [(slot[f], w) for b in batches for f, w in _rows([np.frombuffer(x, "<u8") for x in b.column(1).to_pylist()], idf)]

    def pieces(at, m, many):
        for p in np.unique(at // many):
            here = at // many == p
            yield pa.RecordBatch.from_pydict({"piece": pa.array([p], pa.int32()), "at": [at[here].astype("<i4").tobytes()], "m": [m[here].astype("<f8").tobytes()]})

    def sketch(batches):
        mine = own(batches)
        if mine:
            g = np.random.default_rng(seed).standard_normal((len(used), k)).astype(np.float32)
            at = np.unique(np.concatenate([f for f, _ in mine]))
            total = np.zeros((len(at), k))
            for f, w in mine:
                total[np.searchsorted(at, f)] += np.outer(w, w @ g[f])
            yield from pieces(at, total, SUM_ROWS)

    def gram(batches):
        mine = own(batches)
        if mine:
            z = np.array([w @ q[f] for f, w in mine], np.float64)
            yield from pieces(np.arange(k), z.T @ z, GRAM_ROWS)

    def add(table: pa.Table) -> pa.Table:
        # views of the table's own bytes: a sum holds no copy of what it adds up
        parts = [(np.frombuffer(a.as_buffer(), "<i4"), np.frombuffer(m.as_buffer(), "<f8").reshape(-1, k)) for a, m in zip(table.column("at"), table.column("m"))]
        at = np.unique(np.concatenate([a for a, _ in parts]))
        total = np.zeros((len(at), k))
        for a, m in parts:
            total[np.searchsorted(at, a)] += m
        return pa.table({"piece": table.column("piece")[:1], "at": [at.astype("<i4").tobytes()], "m": [total.astype("<f8").tobytes()]})

    def sums(run, out):
        form = "piece int, at binary, m binary"
        for r in arrow_map(spread, run, form).groupBy("piece").applyInArrow(add, form).toLocalIterator():
            out[np.frombuffer(r.at, "<i4")] = np.frombuffer(r.m, "<f8").reshape(-1, k)
        return out

    q = np.linalg.qr(sums(sketch, np.zeros((len(used), k), np.float32)))[0]
    value, vector = np.linalg.eigh(sums(gram, np.zeros((k, k))))
    top = np.argsort(-value)[: min(rank, k)]
    basis = q @ vector[:, top].astype(np.float32)
    latent = np.stack([w @ basis[slot[f]] for f, w in _rows(words, idf)]).astype(np.float64)
    norm = np.array([np.sqrt((w**2).sum()) for _, w in _rows(words, idf)])
    # A window x that holds passage q has <x, q> of about |q|^2 and keeps only |latent q|^2 of it in the basis: the score is scaled back by that share.
    energy = np.maximum((latent**2).sum(1), 1e-12)
    scaled = latent * (norm / energy)[:, None]
    answer = [h[-max(3, min(6, len(h) // 4)) :] for h in words]
    return Index(idf.astype(np.float32), slot, basis, np.array(item, np.int64), np.array([len(h) for h in words]), scaled.astype(np.float32), words, answer)


def common_subsequence(masks: dict[int, int], n: int, other) -> int:
    """Length of the longest common subsequence of an n-word passage (bit masks by word) and ``other``, bit-parallel."""
    full = (1 << n) - 1
    v = full
    for w in other:
        m = masks.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


def holds_run(run: list, other: list) -> bool:
    n = len(run)
    return any(other[i : i + n] == run for i in range(len(other) - n + 1) if other[i] == run[0])


def run_hashes(h: np.ndarray) -> np.ndarray:
    """A hash of each MIN_WORDS words in a row."""
    n = max(0, len(h) - MIN_WORDS + 1)
    out = np.zeros(n, np.uint64)
    for i, c in enumerate(_STEP[:MIN_WORDS]):
        out += h[i : i + n] * c
    return out ^ out >> np.uint64(31)


class Runs:
    """The runs of MIN_WORDS words of the passages: what many documents share weighs too little for the cosine of a window."""

    def __init__(self, index: Index):
        at = [(p, run_hashes(h)) for p, h in enumerate(index.words)]
        key = np.concatenate([g for _, g in at]) if at else np.zeros(0, np.uint64)
        passage = np.repeat([p for p, _ in at], [len(g) for _, g in at]).astype(np.int64)
        place = np.concatenate([np.arange(len(g)) for _, g in at]) if at else passage
        order = np.argsort(key, kind="stable")
        self.key, self.passage, self.place = key[order], passage[order], place[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(key >> np.uint64(44)).astype(np.int64)] = True
        self.size = index.size

    def places(self, row: np.ndarray, h: np.ndarray):
        """(document, from word, to word, passage) of the spans that share a run with a passage, widened by a fifth of it on both sides."""
        if not len(self.key) or len(h) < MIN_WORDS:
            return
        g = run_hashes(h)
        x = np.flatnonzero(self.seen[(g >> np.uint64(44)).astype(np.int64)] & (row[: len(g)] == row[MIN_WORDS - 1 :]))
        lo, hi = (np.searchsorted(self.key, g[x], side=s) for s in ("left", "right"))
        x, lo, n = x[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        if not len(x):
            return
        k = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        x = np.repeat(x, n)
        p, wide = self.passage[k], self.size[self.passage[k]] // 5
        begin = x - self.place[k]
        first, last = np.searchsorted(row, row[x]), np.searchsorted(row, row[x], side="right")
        spans = np.stack([row[x], np.maximum(first, begin - wide), np.minimum(last, begin + self.size[p] + wide), p])
        yield from np.unique(spans, axis=1).T.tolist()


def search(docs: DataFrame, index: Index, least_cosine: float = 0.5, most_alike: float = 0.8, alike: float = 0.6, keyed: bool = False) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answered) of every document and item found together; ``keyed`` adds the text's digest."""
    kind = np.where(index.size < 30, 0, np.where(index.size < 50, 1, 2))
    by_kind = [np.flatnonzero(kind == c) for c in range(3)]
    weight = index.idf.astype(np.float64) ** 2

    def run(batches):
        masks = []
        for h in index.words:
            m: dict[int, int] = {}
            for i, w in enumerate(h.tolist()):
                m[w] = m.get(w, 0) | 1 << i
            masks.append(m)
        answers = [a.tolist() for a in index.answer]
        runs = Runs(index)
        for b in batches:
            raw, off = text_buffers(b.column(1))
            best: dict[tuple[int, int], tuple[float, float, bool]] = {}
            for i, j in chunks(off, _CHUNK):
                _, _, row, h = words_of(raw, off[i : j + 1], _KEEP)
                if len(h):
                    for d, p, cos in _candidates(row, h, j - i, index, weight, by_kind, least_cosine):
                        settle(best, i + d[0], p, cos, h[d[1] : d[2]].tolist(), masks, answers)
                    near = set(best)
                    for d, lo, hi, p in runs.places(row, h):
                        if (i + d, int(index.item[p])) not in near:
                            settle(best, i + d, p, cosine(h[lo:hi], index.words[p]), h[lo:hi].tolist(), masks, answers)
            keys = list(best)
            at = pa.array([k[0] for k in keys], pa.int64())
            out = pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([k[1] for k in keys], pa.int64()), pa.array([best[k][0] for k in keys], pa.float64()), pa.array([best[k][1] for k in keys], pa.float64()), pa.array([best[k][2] for k in keys], pa.bool_())], names=["doc_id", "item_id", "cosine", "lcs", "answered"])
            yield out.append_column("digest", b.column(2).take(at)) if keyed else out

    def cosine(x, y):
        (f, v), (g, w) = _rows([x, y], index.idf.astype(np.float64))
        _, i, j = np.intersect1d(f, g, assume_unique=True, return_indices=True)
        return float(v[i] @ w[j] / np.sqrt((v @ v) * (w @ w)))

    def settle(best, d, p, cos, around, masks, answers):
        n = int(index.size[p])
        lcs = common_subsequence(masks[p], n, around) / n
        if lcs < alike:
            return
        answered = holds_run(answers[p], around)
        if lcs >= most_alike or answered:
            key = (d, int(index.item[p]))
            new = (lcs, cos, answered)
            old = best.get(key)
            if old is None or new > (old[1], old[0], old[2]):
                best[key] = (cos, lcs, answered)

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *([F.md5(text).alias("digest")] if keyed else []))
    return arrow_map(rows, run, FOUND + (", digest string" if keyed else ""))


def _candidates(row, h, n_docs, index, weight, by_kind, least):
    """((document, from word, to word), passage, cosine) of windows close to a passage.

    A window's cosine is at most the share of its norm that lies on benchmark features, so windows below ``least`` there
    are not projected.
    """
    first = np.searchsorted(row, np.arange(n_docs + 1))
    place = np.arange(len(h)) - first[row]
    begin = np.flatnonzero(place % BLOCK == 0)
    owner = row[begin]
    f = feature(h)
    slot = index.slot[f]
    w = weight[f]
    block = np.cumsum(place % BLOCK == 0) - 1
    n = len(begin)
    whole = np.concatenate([[0], np.cumsum(np.bincount(block, w, n))])
    known = np.concatenate([[0], np.cumsum(np.bincount(block, w * (slot >= 0), n))])
    stop = np.searchsorted(owner, owner, side="right")
    at = np.arange(n)
    windows = []
    need = np.zeros(n, bool)
    for m, own in zip(WINDOWS, by_kind):
        end = np.minimum(at + m, stop)
        total = whole[end] - whole[at]
        good = np.flatnonzero((known[end] - known[at] >= least * least * total * 0.999) & (total > 0)) if len(own) else at[:0]
        windows.append((good, end[good], np.sqrt(total[good])))
        mark = np.zeros(n + 1, np.int64)
        np.add.at(mark, good, 1)
        np.add.at(mark, end[good], -1)
        need |= np.cumsum(mark[:-1]) > 0
    if not need.any():
        return
    word = np.flatnonzero(need[block] & (slot >= 0))
    vec = np.zeros((n + 1, index.basis.shape[1]), np.float32)
    part = index.basis[slot[word]] * index.idf[f[word]][:, None]
    edge = np.flatnonzero(np.concatenate([[True], block[word][1:] != block[word][:-1]])) if len(word) else word
    if len(word):
        vec[block[word][edge] + 1] = np.add.reduceat(part, edge, axis=0)
    np.cumsum(vec, axis=0, out=vec)
    for (good, end, norm), own in zip(windows, by_kind):
        if not len(good):
            continue
        latent = index.latent[own].T
        step = max(1, CELLS // len(own))
        for s in range(0, len(good), step):
            from_, to = good[s : s + step], end[s : s + step]
            cos = (vec[to] - vec[from_]) @ latent / norm[s : s + step, None]
            for x, y in zip(*np.nonzero(cos >= least)):
                d = int(owner[from_[x]])
                lo = max(int(first[d]), int(begin[from_[x]]) - BLOCK)
                last = int(begin[to[x]]) if to[x] < n else len(h)
                hi = min(int(first[d + 1]), last + BLOCK)
                yield (d, lo, hi), int(own[y]), float(cos[x, y])


def find(docs: DataFrame, benchmark: DataFrame, most: int = PASSAGES) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, cosine, lcs, answered.

    lcs is the longest common subsequence over the item's (passage's) words; found means 0.8 or more, or 0.6 or
    more with the item's last words in one run. Candidates are windows by cosine, and spans with a run of five of the item's
    words: no whole copy is missed, nor, from items of 20 words on, an altered one that keeps the last words, even where so
    many documents hold an item that its words weigh little. An altered copy that keeps no such run goes by the cosine alone. Items of under five words can't be told from chance and are not searched; null items and ids neither. Null and empty texts hold nothing. Repeated rows are each reported;
    other columns are ignored; an empty table on either side gives an empty result. A benchmark of over ``most`` passages is
    searched in parts, one scan of the documents each, so that what tasks and driver hold does not grow with it.
    """
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 0.05
    scratch = Scratch(docs.sparkSession, "passages")
    rows = scratch.save(passage_rows(benchmark))
    parts = -(-rows.count() // most)
    if parts <= 1:
        index = index_of(rows, idf)
        return search(docs, index) if index is not None else docs.sparkSession.createDataFrame([], FOUND)
    # Passages are dealt by hash, so a part has about half of ``most`` or more, never much above it; each part's result is written before the next index is made.
    place = F.pmod(F.xxhash64("item_id", "words"), F.lit(parts))
    found = [scratch.save(_keyed(search(docs, index_of(rows.where(place == p), idf), keyed=True)), "found") for p in range(parts) if not rows.where(place == p).isEmpty()]
    every = reduce(DataFrame.unionByName, found).groupBy("doc_id", "digest", "item_id").agg(F.max("best").alias("best"), F.max("n").alias("n"))
    return every.select("doc_id", "item_id", "best.cosine", "best.lcs", "best.answered", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")


def _keyed(found: DataFrame) -> DataFrame:
    """A part's best per text and item, with the number of equal rows that gave it."""
    return found.groupBy("doc_id", "digest", "item_id").agg(F.max(F.struct("lcs", "cosine", "answered")).alias("best"), F.count("*").alias("n"))


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark passage go; all other rows stay, null ids too."""
    found = Scratch(spark, "leaks").save(find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
