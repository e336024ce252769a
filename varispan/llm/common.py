"""Shared plumbing: scratch tables on shared storage, Arrow text access, graph components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship

#: Bytes of text that a numpy pass holds at once; whole batches would need many times their size.
CHUNK_BYTES = 2 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one of our own only where it is unset on a local master (tests)."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="varispan-")
    return _own_dir


class Scratch:
    """Parquet tables under the shared folder that cut lineage and survive lost executors.

    ``save`` writes and rereads; ``drop`` removes a table that no later plan reads.
    What is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.paths: dict[int, str] = {}
        atexit.register(self.clear)

    def path(self, label: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{label}{self.n}"

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = self.path(label)
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")  # what was shuffled for this table is of no further use
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch = self
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            self._delete(path)

    def clear(self) -> None:
        try:
            if self.spark._jsc is not None and not self.spark._jsc.sc().isStopped():
                self._delete(self.root)
        except Exception:  # the JVM may be gone at exit
            pass


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with this package on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes (uint8) and n + 1 offsets of a string column; null counts as empty.

    A null slot can span bytes in Arrow, so nulls are filled first.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges [i, j) of at most ``most`` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) until nothing changes. Each round
    is two grouped minima and two joins, so a hub costs one row per task before the shuffle and its join
    is one that the skew-join rule can split; no adjacency list is ever gathered. Null ends and self-loops
    are ignored. Raises if it has not converged within ``max_rounds`` (rounds grow with log of the size).
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        # e has a > b. Neighbours of u: both ways for the large star, smaller ones only for the small star.
        pairs = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            pairs = pairs.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        if large:
            out = pairs.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = pairs.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        return out.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(df: DataFrame) -> tuple:
        h = F.xxhash64("a", "b")
        return tuple(df.agg(F.count("*"), F.sum(h % 1_000_003), F.bit_xor(h)).first())

    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.save(e, "edges")
    before = mark(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        new = scratch.save(star(star(e, True), False), "edges")
        scratch.drop(e)
        e, now = new, mark(new)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components have not converged")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


#: Edges that a task joins at once before it lets them go.
FOREST_EDGES = 1 << 19


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node of the edges that is not the smallest of its component among them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        p, q = root[x], root[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def forest_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """The same as ``connected_components`` with Python workers, in fewer and cheaper rounds.

    In each round edges meet at their larger end, where a task joins all it holds, and each node then takes over its
    root's root. After a task has joined its edges a node has one row from it, so a hub brings no more rows to
    its own task than there are tasks; the join on roots is one that the skew-join rule can split.
    """

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            size += len(batch)
            if size >= FOREST_EDGES:
                # rows of one node stay together: what may go on in the next batch is kept back
                rows = np.concatenate(held, axis=1)
                cut = int(np.searchsorted(rows[0], rows[0, -1])) if (np.diff(rows[0]) >= 0).all() else size
                held, size = [rows[:, cut:]], size - cut
                if cut:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in local_roots(*rows[:, :cut])], names=["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in local_roots(*np.concatenate(held, axis=1))], names=["a", "b"])

    def joined(e: DataFrame) -> DataFrame:
        return arrow_map(e.select("a", "b"), run, "a long, b long")

    def home(e: DataFrame) -> DataFrame:
        return e.repartition("a").sortWithinPartitions("a")

    def done(e: DataFrame) -> bool:
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")).select("x.*")
        odd = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))
        return odd.agg(F.count("*").alias("n")).first().n == 0

    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    e = scratch.save(joined(home(joined(e))), "edges")
    for _ in range(max_rounds):
        if done(e):
            break
        up = e.groupBy(F.col("a").alias("r")).agg(F.min("b").alias("top"))
        jumped = e.join(up, F.col("b") == F.col("r"), "left").select("a", F.coalesce("top", "b").alias("b"))
        new = scratch.save(joined(home(joined(jumped))), "edges")
        scratch.drop(e)
        e = new
    else:
        raise RuntimeError("components have not converged")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """P ** i (or its inverse) mod 2 ** 64 for i < n; kept for ordinary chunk sizes."""
    key = "inv" if inverse else "pow"
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), _P_INV if inverse else _P, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * CHUNK_BYTES:
            _powers[key] = have
    return have[:n]


#: ASCII white space as bytes.split() takes it: space, tab, line feed, vertical tab, form feed, return.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def words_of(raw: np.ndarray, off: np.ndarray, keep: np.ndarray | None = None):
    """(start, end, row, hash) of the words in consecutive rows of bytes.

    Words are runs of bytes that are not white space, or of the bytes marked in ``keep``; they never cross
    rows. The hash is a polynomial in the A-Z-folded bytes mod 2 ** 64, so equal words have equal hashes.
    """
    base = off[0]
    own = raw[base : off[-1]]
    n = len(own)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    inside = keep[own] if keep is not None else ~SPACE[own]
    first = np.empty(n, bool)
    first[0] = inside[0]
    np.logical_and(inside[1:], ~inside[:-1], out=first[1:])
    edge = (off[:-1] - base)[off[:-1] < off[-1]]
    first[edge] = inside[edge]
    last = np.empty(n, bool)
    last[-1] = inside[-1]
    np.logical_and(inside[:-1], ~inside[1:], out=last[:-1])
    tail = off[1:-1] - base - 1
    tail = tail[tail >= 0]
    last[tail] = inside[tail]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(off - base, start, side="right") - 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(FOLD[own].astype(np.uint64) * powers(n), out=total[1:])
    h = (total[end] - total[start]) * powers(n, True)[start]
    h ^= h >> np.uint64(29)
    return start + base, end + base, row, h
