"""SimHash near-duplicates linked through a generalised pigeonhole index.

Two fingerprints within ``tau`` bits must, for any partition of the bits and any thresholds t_i >= -1 with
sum(t_i + 1) = tau + 1, be within t_i bits on some part i. Correlated bits share a part, thresholds come
from a dynamic programme over estimated candidate counts, and every candidate is verified on all 64 bits.
"""

from __future__ import annotations

from contextlib import contextmanager
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..deploy import ship
from .common import Scratch, arrow_map, forest_components, text_buffers

BITS = 64
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Bit counts of every byte value, most significant first.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_FP_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``words`` words, repeats included."""
    w = text.translate(LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    flat = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(w) - words + 1)
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        return np.array([digest(flat, 42)], np.uint64)
    return np.fromiter((digest(flat[s:e], 42) for s, e in zip(start[:n].tolist(), end[words - 1 :].tolist())), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """Unsigned fingerprint of shingle hashes: a bit is one if it is set in over half of them; none: 0."""
    if not len(h):
        return 0
    by = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    value = 0
    for i in range(7, -1, -1):
        ones = np.bincount(by[:, i], minlength=256) @ _BYTE_BITS
        value = value << 8 | int(np.packbits(ones * 2 > len(h))[0])
    return value


def fingerprint(text: bytes, words: int) -> int:
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp as signed long) of each row; null text counts as empty."""

    def run(batches):
        for b in batches:
            raw, off = text_buffers(b.column(1))
            fps = np.fromiter((fingerprint(raw[s:e].tobytes(), words) for s, e in zip(off[:-1], off[1:])), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, _FP_SCHEMA)


def _bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all of them."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            for i in range(0, len(x), 1 << 16):
                total += x[i : i + (1 << 16)].T @ x[i : i + (1 << 16)]
            n += len(x)
        yield pa.RecordBatch.from_pydict({"i": np.arange(BITS * BITS + 1, dtype=np.int32), "v": np.append(total.ravel(), n)})

    rows = arrow_map(fps.select("fp"), run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r.i] = r.v
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Split the bits (0 = most significant) into m parts of even width, each greedily filled with the bits most correlated to it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    left, parts = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        rest = sorted(left)
        part = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        left.discard(part[0])
        while len(part) < width:
            best = max(sorted(left), key=lambda b: corr[b, part].mean())
            part.append(best)
            left.discard(best)
        parts.append(sorted(part))
    return parts


def allocate(parts: list[list[int]], sample: np.ndarray, n: int, tau: int) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost. Cost of t_i: probes sent plus candidate pairs, the latter from pair distances in the sample."""
    x = np.unpackbits(sample.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
    pairs = max(1.0, len(x) * (len(x) - 1) / 2)
    cost = []
    for part in parts:
        y = x[:, part]
        on = y.sum(1)
        dist = (on[:, None] + on[None, :] - 2 * (y @ y.T)).astype(np.int32)
        near = np.bincount(dist[np.triu_indices(len(x), 1)], minlength=len(part) + 1)
        row = [0.0]
        for t in range(tau + 1):
            share = near[: t + 1].sum() / pairs
            floor = sum(comb(len(part), j) for j in range(t + 1)) / 2.0 ** len(part)
            probes = float(sum(comb(len(part), j) for j in range(t + 1)))
            row.append(n * probes + max(share, floor) * n * n / 2)
        cost.append(row)
    best = {0: (0.0, [])}
    for row in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for k, extra in enumerate(row):
                if used + k <= tau + 1 and (used + k not in new or c + extra < new[used + k][0]):
                    new[used + k] = (c + extra, [*ts, k - 1])
        best = new
    return best[tau + 1]


def plan_parts(fps: DataFrame, tau: int, sample_rows: int = 1500) -> list[tuple[list[int], int]]:
    """Parts with their thresholds; parts of threshold -1 are not probed. ``sample_rows`` bounds the estimate's sample only: it moves cost, never results."""
    n, both = _bit_moments(fps)
    sample = np.array([r.fp for r in fps.orderBy(F.xxhash64("fp", F.lit(7))).limit(sample_rows).collect()], np.int64)
    options = []
    for m in range(1, tau + 3):
        if BITS // m < 1:
            break
        parts = correlated_parts(n, both, m)
        cost, ts = allocate(parts, sample, n, tau)
        options.append((cost, m, list(zip(parts, ts))))
    _, _, chosen = min(options, key=lambda o: o[:2])
    return [(p, t) for p, t in chosen if t >= 0]


def _as_long(bits) -> int:
    v = sum(1 << (BITS - 1 - b) for b in bits)
    return v - (1 << BITS) if v >= 1 << (BITS - 1) else v


def _xors(bits: list[int], radius: int):
    return F.array(*[F.lit(_as_long(c)).cast("long") for r in range(radius + 1) for c in combinations(bits, r)])


def links(fps: DataFrame, tau: int, scratch: Scratch, bucket: int = 256) -> DataFrame:
    """Edges (a, b) between ids of distinct fingerprints within ``tau`` bits, enough to connect all such pairs.

    ``fps`` has one row per fingerprint: fp, rep. Buckets of up to ``bucket`` fingerprints are joined and
    verified pair by pair. Fingerprints that lie in a larger bucket, or probe one, instead meet at shared
    midpoints: within tau bits of each other means that one's ball of radius tau // 2 meets the other's of
    radius tau - tau // 2, and each midpoint links its visitors to one of them. That path is exact too and
    sends rows in proportion to the fingerprints, so no bucket is ever expanded into all its pairs.
    """
    parts = plan_parts(fps, tau)
    index = fps.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_as_long(p)).cast("long")).alias("key")) for i, (p, _) in enumerate(parts)])).alias("k")).select("fp", "rep", "k.part", "k.key")
    sizes = index.groupBy("part", "key").count()
    hot = scratch.save(sizes.where(F.col("count") > bucket).select("part", "key"), "hot")
    probe = None
    for i, (p, t) in enumerate(parts):
        own = F.col("fp").bitwiseAND(F.lit(_as_long(p)).cast("long"))
        one = fps.select("fp", "rep", F.lit(i).alias("part"), F.explode(F.transform(_xors(p, t), lambda x: own.bitwiseXOR(x))).alias("key"))
        probe = one if probe is None else probe.union(one)
    cold = index.join(hot, ["part", "key"], "left_anti")
    # The anti join keeps hot probes out; their fingerprints take the midpoint path below.
    pairs = probe.join(hot, ["part", "key"], "left_anti").alias("p").join(cold.alias("i"), ["part", "key"])
    near = pairs.where((F.col("p.fp") != F.col("i.fp")) & (F.bit_count(F.col("p.fp").bitwiseXOR(F.col("i.fp"))) <= tau)).select(F.col("p.rep").alias("a"), F.col("i.rep").alias("b"))
    warm = probe.join(hot, ["part", "key"], "left_semi").select("fp", "rep").distinct()
    lo, hi = tau // 2, tau - tau // 2
    every = list(range(BITS))
    at = warm.select("fp", "rep", F.explode(F.transform(_xors(every, hi), lambda x: F.col("fp").bitwiseXOR(x))).alias("mid"))
    at = at.withColumn("inner", F.bit_count(F.col("fp").bitwiseXOR(F.col("mid"))) <= lo)
    hub = at.groupBy("mid").agg(F.min(F.when(F.col("inner"), F.col("rep"))).alias("hub"), F.count("*").alias("n")).where("n > 1 and hub is not null").select("mid", "hub")
    met = at.join(hub, "mid").where(F.col("rep") != F.col("hub")).select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    return near.union(met)


def near_duplicates(docs: DataFrame, words: int = 3, tau: int = 2, bucket: int = 256) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id (smallest doc_id reachable over links).

    Fingerprints link at ``tau`` or fewer differing bits. Null and empty texts have fingerprint 0 and link
    like any other. Repeated rows come out as often as they came in. A null doc_id is carried; it never
    names a component, and a component of null ids alone has a null component_id. Other columns of the
    input are ignored, so clashing names do no harm. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    by_doc = scratch.save(fingerprints(docs, words), "fp")
    fps = scratch.save(by_doc.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "reps")
    roots = forest_components(links(fps, tau, scratch, bucket), scratch)
    named = fps.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return by_doc.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- documents by their similarity ---

#: Min-hash bands beside the fingerprint: pairs of similarity 0.8 share one of BANDS with a chance of 0.9999.
BANDS, ROWS = 24, 5
#: Each text is compared to the first of its largest band; then all that this leaves outside a band's largest group to all of
#: the band, in blocks of OUTSIDERS by MEMBERS texts.
OUTSIDERS, MEMBERS = 128, 512
#: Bytes of either side of a block, and columns of its table of shingles held at once.
BLOCK_BYTES, COLUMNS = 4 << 20, 1 << 13
#: Bytes of a batch of text pairs.
PAIR_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_FACTORS = (np.random.default_rng(17).integers(0, 1 << 31, BANDS * ROWS, dtype=np.int64) * 2 + 1).astype(np.uint32)
_SKETCH = "doc_id long, th long, fp long, node long, bands array<long>"


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key per band of the least products of the (distinct) hashes."""
    u = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for i in range(0, len(u), 2048):
        np.minimum(least, (u[i : i + 2048, None] * _FACTORS).min(0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key


def _text_key():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """Per row: doc_id, th (hash of the text), fp, node (hash of the set of shingles) and band keys."""

    def run(batches):
        for b in batches:
            raw, off = text_buffers(b.column(2))
            fps, nodes, keys = np.zeros(len(b), np.uint64), np.zeros(len(b), np.uint64), np.zeros((len(b), BANDS), np.uint64)
            for i, (s, e) in enumerate(zip(off[:-1], off[1:])):
                h = shingle_hashes(raw[s:e].tobytes(), words)
                own = np.unique(h)
                fps[i], nodes[i], keys[i] = majority(h), xxhash.xxh64_intdigest(own.tobytes(), 1), band_keys(own)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * BANDS, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64)), pa.array(nodes.view(np.int64)), bands], names=["doc_id", "th", "fp", "node", "bands"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("th"), F.col("text").cast("string").alias("text")), run, _SKETCH)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_prints(nodes: DataFrame, tau: int, scratch: Scratch) -> DataFrame:
    """(a, b) of nodes (node, fp) whose fingerprints are within ``tau`` bits, enough to connect them."""
    reps = scratch.save(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "reps")
    return links(reps, tau, scratch).unionByName(nodes.join(reps, "fp").select(F.col("node").alias("a"), F.col("rep").alias("b")))


def hub_pairs(met: DataFrame) -> DataFrame:
    """(a, b): each node of the bands ``met`` (key, node) and the first of the largest band it is in. One row a node, however many bands are shared."""
    sizes = met.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    return met.join(sizes, "key").groupBy(F.col("node").alias("a")).agg(F.max(F.struct("n", "key", "first")).alias("best")).select("a", F.col("best.first").alias("b"))


def open_bands(met: DataFrame, roots: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, root, main, outer, inner) of the bands that still hold several groups: a member's group, the band's largest
    group, and the numbers of blocks for those outside it and for all."""
    size = texts.select("node", F.octet_length("text").cast("long").alias("bytes"))
    named = met.join(size, "node").join(roots, "node", "left").select("key", "node", "bytes", F.coalesce("root", "node").alias("root"))
    named = scratch.save(named, "named")
    groups = named.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    rank = F.struct("n", "root")
    bands = groups.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("bytes").alias("bytes"), F.max_by("bytes", rank).alias("own"), F.max_by("root", rank).alias("main"))
    bands = bands.where(F.col("n") > F.col("most"))
    blocks = lambda n, most, size: F.greatest(F.ceil(n / F.lit(most)), F.ceil(size / F.lit(BLOCK_BYTES))).cast("int")
    bands = bands.select("key", "main", blocks(F.col("n") - F.col("most"), OUTSIDERS, F.col("bytes") - F.col("own")).alias("outer"), blocks(F.col("n"), MEMBERS, F.col("bytes")).alias("inner"))
    return scratch.save(named.join(bands, "key").select("key", "node", "root", "main", "outer", "inner"), "open")


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of ``xs`` with each of ``ys``, sets of hashes."""
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (xs, ys)]
    shared = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    total = np.zeros((len(xs), len(ys)))
    if not len(shared):
        return total
    placed = []
    for h, owner in sides:
        at = np.searchsorted(shared, h)
        good = shared[np.minimum(at, len(shared) - 1)] == h
        order = np.argsort(at[good], kind="stable")
        placed.append((at[good][order], owner[good][order]))
    for c in range(0, len(shared), COLUMNS):
        tables = []
        for (at, owner), s in zip(placed, (xs, ys)):
            i, j = np.searchsorted(at, (c, c + COLUMNS))
            t = np.zeros((len(s), min(COLUMNS, len(shared) - c)), np.float32)
            t[owner[i:j], at[i:j] - c] = 1
            tables.append(t)
        total += tables[0] @ tables[1].T
    return total


def block_links(member: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b) of ``similarity`` or more between different groups of a band of ``open_bands``, one for two groups of a block. All outside a
    band's largest group meet all of the band; only links leave a block, so no pair is ever a row."""

    def run(key, left, right):
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        root_a, root_b = (t.column("root").to_numpy() for t in (left, right))
        if not len(root_a) or not (root_a[:, None] != root_b[None, :]).any():
            return none
        sets: dict[int, np.ndarray] = {}
        sides = []
        for t in (left, right):
            ids = t.column("node").to_numpy()
            raw, off = text_buffers(t.column("text"))
            for i, n in enumerate(ids.tolist()):
                if n not in sets:
                    sets[n] = np.unique(shingle_hashes(raw[off[i] : off[i + 1]].tobytes(), words))
            sides.append((ids, [sets[n] for n in ids.tolist()]))
        (a, xs), (b, ys) = sides
        nx, ny = (np.array([len(x) for x in s])[:, None] for s in (xs, ys))
        ny = ny.T
        # sizes alone can rule a pair out
        open_ = (root_a[:, None] != root_b[None, :]) & (np.minimum(nx, ny) >= similarity * np.maximum(nx, ny))
        i, j = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if not len(i):
            return none
        both = overlaps([xs[k] for k in i], [ys[k] for k in j])
        at = np.ix_(i, j)
        p, q = np.nonzero(open_[at] & (both >= similarity * (nx[i] + ny[:, j] - both)))
        p, q = i[p], j[q]
        _, one = np.unique(np.stack([root_a[p], root_b[q]]), axis=1, return_index=True)
        return pa.table({"a": a[p[one]], "b": b[q[one]]})

    full = member.join(texts, "node")
    deal = F.xxhash64("node")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = full.where("root <> main").withColumn("i", F.pmod(deal, "outer").cast("int")).withColumn("j", every("inner"))
    right = full.withColumn("j", F.pmod(deal, "inner").cast("int")).withColumn("i", every("outer"))
    keys = ["key", "i", "j"]
    # named anew, as both sides stem from one table
    left, right = (t.select(*(F.col(c).alias(c) for c in (*keys, "node", "root", "text"))).groupBy(*keys) for t in (left, right))
    ship(member.sparkSession)
    return left.cogroup(right).applyInArrow(run, "a long, b long")


def similar_pairs(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The (a, b) whose sets of shingles have a Jaccard similarity of ``similarity`` or more. ``texts``: node, text, one row each."""

    def run(batches):
        known: tuple = (None, None)
        for b in batches:
            a, z = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            bodies = [text_buffers(b.column(i)) for i in (2, 3)]
            good = np.zeros(len(b), bool)
            for i in range(len(b)):
                x, y = (np.unique(shingle_hashes(raw[off[i] : off[i + 1]].tobytes(), words)) if k or known[0] != z[i] else known[1] for k, (raw, off) in ((1, bodies[0]), (0, bodies[1])))
                known = (z[i], y)
                # sizes alone can rule a pair out
                if min(len(x), len(y)) >= similarity * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[i] = both >= similarity * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(z[good])], names=["a", "b"])

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return arrow_map(two.select("a", "b", "text_a", "text_b"), run, "a long, b long")


@contextmanager
def _small_batches(spark):
    """Arrow batches cut by bytes in the plans run within, as a row holds two whole texts; a longer row stands alone."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(PAIR_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def _group(docs: DataFrame, nodes: DataFrame, words: int, similarity: float, tau: int, scratch: Scratch) -> DataFrame:
    """(node, root) of the nodes with a link."""
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), _text_key().alias("_th"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = nodes.select("node", F.col("first.doc_id").alias("_id"), F.col("first.th").alias("_th"))
    shared = nodes.select("node", F.explode("bands").alias("key"))
    many = shared.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = scratch.save(shared.join(many, "key", "left_semi"), "bands")
    # texts that meet another one; pairs of all rounds are among them or among near fingerprints
    prints = scratch.save(_ordered(near_prints(nodes, tau, scratch)), "prints")
    ids = met.select("node").unionByName(prints.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    texts = scratch.save(rows.join(ids.join(place, "node"), ["_id", "_th"]).dropDuplicates(["node"]).select("node", "text"), "texts")
    # at most two pairs a text: by its fingerprint and by its largest band
    first = prints.groupBy("a").agg(F.min("b").alias("b")).unionByName(hub_pairs(met))
    with _small_batches(scratch.spark):
        edges = scratch.save(similar_pairs(_ordered(first), texts, words, similarity), "links")
    roots = scratch.save(forest_components(edges, scratch), "roots")
    # what is near by fingerprint and not in one group yet; most of it is
    named = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    apart = prints.join(named("a"), "a", "left").join(named("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    blocks = block_links(open_bands(met, roots, texts, scratch), texts, words, similarity)
    with _small_batches(scratch.spark):
        more = scratch.save(similar_pairs(apart, texts, words, similarity).unionByName(blocks), "links")
    if not more.isEmpty():
        roots = scratch.save(forest_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), scratch), "roots")
    for table in (texts, met, prints, edges, more):
        scratch.drop(table)
    return roots


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, tau: int = 2) -> DataFrame:
    """One row per input row: doc_id, th (xxhash64 of its text, null as empty), component_id (smallest doc_id reachable).

    Documents link if their sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more. Candidates
    are fingerprints within ``tau`` bits and, as a pair at 0.8 is some ten bits apart, texts that share a
    min-hash band; every candidate is settled on the whole texts, so nothing links that is less alike. Texts without words are alike.
    Bands of any size are worked through: each text meets the first of its largest band, and what this leaves outside a band's
    largest group meets all of the band, however much it is. So every pair that shares a band is compared or in one group already. Copies count once, so a large group of them costs one comparison. Null ids and repeated rows are as in ``near_duplicates``.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    by_doc = scratch.save(sketches(docs, words), "sketches")
    first = F.min(F.struct("doc_id", "th")).alias("first")
    nodes = scratch.save(by_doc.where("doc_id is not null").groupBy("node").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), first), "nodes")
    roots = _group(docs, nodes, words, similarity, tau, scratch)
    named = nodes.select("node", F.col("first.doc_id").alias("doc_id")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = named.select("node", "root").join(ids, "root").select("node", "component_id")
    return by_doc.select("doc_id", "th", "node").join(of_node, "node", "left").select("doc_id", "th", "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of similar documents the one of smallest doc_id stays, once; rows with a null doc_id stay."""
    groups = similar_documents(docs)
    gone = Scratch(spark, "dropped").save(groups.where("doc_id <> component_id").select("doc_id", F.col("th").alias("_th")).distinct())
    known = docs.where("doc_id is not null").withColumn("_th", _text_key())
    kept = known.join(gone, ["doc_id", "_th"], "left_anti")
    # of a document given twice one row stays
    kept = kept.dropDuplicates(["doc_id", "_th"]).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))
