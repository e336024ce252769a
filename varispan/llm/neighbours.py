"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

Three rounds of sign flips and a fast Hadamard transform stand for a random rotation; a unit vector's bucket is its
nearest signed axis. Inner products become angles by one more component that brings every candidate to the
same length. Queries probe the axes in the order of their rotated components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map

TABLES = 10
#: Rows that a bucket of the index holds on average: keys grow with the table, so what a probe meets does not.
BUCKET_ROWS = 200
#: Most probes a table, and the share of a score by which sums of other order may differ.
PROBES, NOISE = 512, 1e-12
#: Most candidates and queries that one task holds of a bucket; larger buckets are dealt to more tasks.
CANDIDATES, QUERIES = 4096, 1024


def dense(col: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, with zeros up to ``width``."""
    size = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(size), width))
    if len(size) and (size == size[0]).all():
        out[:, : size[0]] = flat.reshape(len(size), size[0])
    else:
        row = np.repeat(np.arange(len(size)), size)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
        x = x.reshape(n, d)
    return x / np.sqrt(d)


def axis_sizes(rows: int, dim: int) -> list[int]:
    """Dimensions of the rotations that make up a key, so that a bucket holds BUCKET_ROWS of ``rows`` or so: all but the last are whole."""
    left, out = max(2.0, rows / BUCKET_ROWS), []
    while left > 1:
        out.append(min(dim, 1 << max(0, int(np.ceil(np.log2(left / 2))))))
        left /= 2 * out[-1]
    return out


class Hash:
    """Cross-polytope hashes in the next power of two over ``width`` + 1. A key of each of the ``tables`` is the nearest signed axes of one pseudo-rotation for each of ``sizes``, in that many of its dimensions."""

    def __init__(self, width: int, longest: float, rows: int, tables: int = TABLES, seed: int = 11):
        self.width, self.longest, self.tables = width, longest, tables
        self.dim = 1 << int(width).bit_length()
        self.sizes = axis_sizes(rows, self.dim)
        self.keys = int(np.prod([2 * d for d in self.sizes]))
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, len(self.sizes), 3, self.dim))

    def rotate(self, x: np.ndarray, table: int, axis: int) -> np.ndarray:
        for s in self.signs[table, axis]:
            x = hadamard(x * s)
        return x[:, : self.sizes[axis]]

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.dim))
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        if query:
            out[:, : self.width] = x / norm
        else:
            out[:, : self.width] = x / self.longest
            out[:, self.width] = np.sqrt(np.maximum(0, 1 - (norm[:, 0] / self.longest) ** 2))
        return out

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """tables x rows of keys; an axis counts as i or, if negative, its rotation's dimension + i."""
        up = self.lift(x, False)
        out = np.zeros((self.tables, len(x)), np.int64)
        for t in range(self.tables):
            for a, d in enumerate(self.sizes):
                y = self.rotate(up, t, a)
                top = np.abs(y).argmax(1)
                out[t] = out[t] * (2 * d) + top + d * (y[np.arange(len(y)), top] < 0)
        return out

    def probes(self, x: np.ndarray, table: int, most: int) -> np.ndarray:
        """rows x up to ``most`` keys, by what their axes fall short of the nearest ones, squared and summed."""
        up = self.lift(x, True)
        keys, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for a, d in enumerate(self.sizes):
            y = self.rotate(up, table, a)
            y = np.concatenate([y, -y], axis=1)
            order = np.argsort(-y, axis=1, kind="stable")[:, :most]
            short = np.take_along_axis(y, order, 1)
            short = (short[:, :1] - short) ** 2
            # a pair of places (i, j) has (i + 1) (j + 1) - 1 others before it
            i = np.arange(keys.shape[1])
            many = np.minimum(order.shape[1], most // (i + 1))
            i, j = np.repeat(i, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            total = cost[:, i] + short[:, j]
            best = np.argsort(total, axis=1, kind="stable")[:, :most]
            cost = np.take_along_axis(total, best, 1)
            keys = np.take_along_axis(keys[:, i] * (2 * d) + order[:, j], best, 1)
        return keys


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (floats as given, else doubles) of the rows that take part: no null, empty, zero or non-finite vectors, no null ids."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return v.where("vec_id is not null and embedding is not null").where(good)


def distinct_candidates(v: DataFrame, k: int) -> DataFrame:
    """Of rows with equal vectors the k + 1 smallest distinct ids, each once: a query needs no others, as ties go to smaller ids and only its own id is barred. Each task drops repeats before the shuffle."""
    same = Window.partitionBy("embedding").orderBy("vec_id")
    return v.dropDuplicates(["vec_id", "embedding"]).withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).drop("r")


def best(ids_q, ids_c, score, k):
    """Top k distinct ids per query of a score block, and those that equal the last but for NOISE, each with its best row, ties to smaller ids, the query's own id barred: (query row, candidate row)."""
    score = np.where(ids_c[None, :] == ids_q[:, None], -np.inf, score)
    # a row meets at most ``most`` rows of each id, so the k first ids lie within the k * most first rows
    most = int(np.unique(ids_c, return_counts=True)[1].max()) if len(ids_c) else 1
    m = min(k * most, score.shape[1])
    if score.shape[1] > 4 * m:
        edge = -np.partition(-score, m - 1, axis=1)[:, m - 1 : m]
        q, c = np.nonzero(score >= edge - NOISE * np.abs(edge))
    else:
        q, c = np.nonzero(score > -np.inf)
    keep = score[q, c] > -np.inf
    q, c = q[keep], c[keep]
    if most > 1:  # the best row of each id
        order = np.lexsort((-score[q, c], ids_c[c], q))
        q, c = q[order], c[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (ids_c[c[1:]] != ids_c[c[:-1]])
        q, c = q[new], c[new]
    order = np.lexsort((ids_c[c], -score[q, c], q))
    q, c = q[order], c[order]
    first = np.searchsorted(q, q)
    place = np.arange(len(q)) - first
    last = score[q, c][np.minimum(first + k - 1, len(q) - 1)] if len(q) else score[q, c]
    top = (place < k) | (score[q, c] >= last - NOISE * np.abs(last))
    return q[top], c[top]


def calibrate(cands: DataFrame, queries: DataFrame, h: Hash, k: int, recall: float, sample: int) -> int:
    """Probes per table that find ``recall`` of the true neighbours of a sample of queries.

    The ``sample`` queries of smallest hash meet every candidate, in blocks where the candidates lie; for each true
    neighbour the least place of its bucket in the query's probe order, over tables, is what it takes to find it.
    """
    rows = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not rows:
        return 1
    ids = np.array([r.vec_id for r in rows])
    x = np.zeros((len(rows), h.width))
    for i, r in enumerate(rows):
        x[i, : len(r.embedding)] = r.embedding
    orders = [h.probes(x, t, PROBES) for t in range(h.tables)]

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            own = b.column(0).to_numpy(zero_copy_only=False)
            y = dense(b.column(1), h.width)
            score = x @ y.T
            q, c = best(ids, own, score, k)
            at = h.buckets(y[c])
            same = [o[q] == a[:, None] for o, a in zip(orders, at)]
            need = np.min([np.where(e.any(1), e.argmax(1), PROBES - 1) for e in same], axis=0) if len(q) else q
            yield pa.RecordBatch.from_pydict({"q": q.astype(np.int32), "vec_id": own[c], "score": score[q, c], "need": need.astype(np.int32)})

    near = arrow_map(cands, run, "q int, vec_id long, score double, need int")
    near = near.groupBy("q", "vec_id").agg(F.max("score").alias("score"), F.min_by("need", F.struct(-F.col("score"), "need")).alias("need"))
    top = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    need = sorted(r.need for r in near.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("need").collect())
    return need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)] + 1 if need else 1


def search(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, recall: float = 0.97, sample: int = 64, tables: int = TABLES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest inner product found for each query.

    ``queries`` (vec_id, embedding) defaults to the rows whose id is divisible by 20. Every row is indexed; probes
    per table are set so that a sample of ``sample`` queries finds ``recall`` of its true neighbours. Scores are exact
    products in double precision of the original vectors, summed in order of the components, ties go to the smaller id, and a query never finds its own id.
    Null, empty, zero and non-finite vectors and null ids take no part. Vectors of different lengths count
    as if filled up with zeros. Repeated ids with different vectors are rows of their own; a candidate id is
    reported once, with its best score. Other columns are ignored; a query with fewer than k found meets all
    candidates, so with fewer than k all are returned, and an empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "neighbours")
    v = scratch.save(usable(vectors), "vectors")
    q = v.where("vec_id % 20 = 0") if queries is None else scratch.save(usable(queries), "queries")
    cands = scratch.save(distinct_candidates(v, k), "candidates")
    both = v if queries is None else v.union(q)
    shape = both.agg(F.max(F.size("embedding")).alias("d"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, y: a + y * y)).alias("n")).first()
    out = "query_id long, vec_id long, score double"
    if shape.d is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    h = Hash(shape.d, float(np.sqrt(shape.n)) * (1 + 1e-12), cands.count(), tables)
    probes = calibrate(cands, q, h, k, recall, sample)

    def index(batches):
        for b in batches:
            at = h.buckets(dense(b.column(1), h.width))
            for t in range(h.tables):
                yield pa.RecordBatch.from_arrays([pa.array(at[t] + h.keys * t), *b.columns], names=["key", "id", "vec"])

    def probe(batches):
        for b in batches:
            x = dense(b.column(1), h.width)
            for i in range(0, len(x), 1024):
                for t in range(h.tables):
                    near = h.probes(x[i : i + 1024], t, probes)
                    rows = pa.array(i + np.repeat(np.arange(len(near)), near.shape[1]))
                    place = np.tile(np.arange(near.shape[1], dtype=np.int32), len(near))
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel() + h.keys * t), pa.array(place), *[c.take(rows) for c in b.columns]], names=["key", "place", "id", "vec"])

    def rerank(key, left, right):
        ids_c, ids_q = left.column("id").to_numpy(), right.column("id").to_numpy()
        if not len(ids_c) or not len(ids_q):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        y, x = (dense(t.column("vec").combine_chunks(), h.width) for t in (left, right))
        score = x @ y.T
        floor = right.column("floor").to_numpy()[:, None]
        qi, ci = best(ids_q, ids_c, np.where(score >= floor - NOISE * np.abs(floor), score, -np.inf) if np.isfinite(floor).any() else score, k)
        return pa.table({"query_id": ids_q[qi], "vec_id": ids_c[ci], "score": score[qi, ci]})

    kinds = [t.schema["embedding"].dataType.simpleString() for t in (cands, q)]
    idx = scratch.save(arrow_map(cands, index, f"key long, id long, vec {kinds[0]}"), "index")
    prb = scratch.save(arrow_map(q, probe, f"key long, place int, id long, vec {kinds[1]}"), "probes")
    deal = F.xxhash64("id")
    keys = ["key", "cb", "qb"]
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    def ranked(asked: DataFrame) -> DataFrame:
        """The best of each block of a key (one block in most) for each of its probes; ``asked``: key, id, vec, floor."""
        parts = idx.groupBy("key").agg(F.ceil(F.count("*") / CANDIDATES).cast("int").alias("nc")).join(asked.groupBy("key").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("nq")), "key")
        parts = scratch.save(parts, "blocks")
        left = idx.join(parts, "key").withColumn("cb", F.pmod(deal, "nc").cast("int")).withColumn("qb", every(F.col("nq")))
        right = asked.join(parts, "key").withColumn("qb", F.pmod(deal, "nq").cast("int")).withColumn("cb", every(F.col("nc")))
        met = left.select(*keys, "id", "vec").groupBy(*keys).cogroup(right.select(*keys, "id", "vec", "floor").groupBy(*keys)).applyInArrow(rerank, out)
        return scratch.save(met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")

    # the nearest bucket of each table first: what scores under its k-th best can't be among the k
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    nothing = F.lit(float("-inf")).alias("floor")
    found = ranked(prb.where("place = 0").select("key", "id", "vec", nothing))
    if probes > 1:
        floors = found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        rest = prb.where("place > 0").join(floors, "id", "left").select("key", "id", "vec", F.coalesce("least", F.lit(float("-inf"))).alias("floor"))
        found = scratch.save(found.unionByName(ranked(rest)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")
    scratch.drop(idx)
    scratch.drop(prb)
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = scratch.save(q.join(full, F.col("vec_id") == F.col("query_id"), "left_anti").select(F.lit(0).alias("key"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), "short")
    wanting = short.count()
    if wanting:  # all candidates, in blocks
        nc, nq = -(-cands.count() // CANDIDATES), -(-wanting // QUERIES)
        block = lambda n: F.pmod(deal, F.lit(n)).cast("int")
        left = cands.select(F.lit(0).alias("key"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec")).withColumn("cb", block(nc)).withColumn("qb", every(F.lit(nq)))
        right = short.withColumn("qb", block(nq)).withColumn("cb", every(F.lit(nc)))
        more = left.select(*keys, "id", "vec").groupBy(*keys).cogroup(right.select(*keys, "id", "vec", nothing).groupBy(*keys)).applyInArrow(rerank, out)
        found = found.unionByName(more).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    kth = F.max(F.when(F.col("rank") == k, F.col("score"))).over(Window.partitionBy("query_id"))
    near = found.withColumn("rank", F.row_number().over(top)).withColumn("kth", kth).where((F.col("rank") <= k) | (F.col("score") >= F.col("kth") - F.lit(NOISE) * F.abs("kth")))
    # block products differ in their last bits by where a vector lay; one sum in one order gives equal vectors equal scores
    ends = [t.dropDuplicates(["vec_id", "embedding"]).select(F.col("vec_id").alias(i), F.col("embedding").alias(e)) for t, i, e in ((q, "query_id", "x"), (v, "vec_id", "y"))]
    pairs = near.select("query_id", "vec_id").join(ends[0], "query_id").join(ends[1], "vec_id")
    product = F.aggregate(F.zip_with("x", "y", lambda a, b: F.coalesce(a.cast("double") * b.cast("double"), F.lit(0.0))), F.lit(0.0), lambda a, z: a + z)
    exact = pairs.groupBy("query_id", "vec_id").agg(F.max(product).alias("score"))
    return exact.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
