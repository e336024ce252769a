"""Exact substring dedup: repeated 100-byte strings found by merging shard Burrows-Wheeler transforms.

Every string of WINDOW bytes owns one anchor, the least hash among its K-grams, so equal strings share the
anchor's gram and their offset from it. Anchors whose gram is unique settle most of the text. Anchors with
equal contexts (all bytes of any string they can own) settle whole copies by hash. What is left, contexts
that agree in part, goes as text to shards whose transforms are merged by interleave refinement.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, text_buffers

WINDOW = 100
K = 32
SPAN = WINDOW - K  # a string starts at most this far before its anchor
#: Anchors of longer texts are found piece by piece.
PIECE = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i mod 2 ** 64."""
    have = _tables.get(int(base))
    if have is None or len(have[0]) < n:
        n = max(n, PIECE + 8 * WINDOW)
        up, down = np.full(n, base, np.uint64), np.full(n, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        have = _tables[int(base)] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have[0][:n], have[1][:n]


def _prefix(data: np.ndarray, base: np.uint64) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def anchors(data: np.ndarray, off: np.ndarray, lo: int = 0, hi: int | None = None):
    """(row, place, back, width, gram hash, context hash) of the anchors in [lo, hi) of ``data``.

    ``off`` bounds the rows within data. ``place`` is from the start of data; the strings that an anchor owns start
    at place - back .. place - back + width.
    """
    n = len(data)
    hi = n if hi is None else hi
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none, none, none
    pa_ = _prefix(data, _A)
    up = _powers(_A, n + 1)[1]
    grams = n - K + 1
    h = _mix((pa_[K:] - pa_[:-K]) * up[:grams])
    low = np.uint64((1 << 22) - 1)
    key = (h & ~low) | np.arange(grams, dtype=np.uint64)
    w = SPAN + 1
    pad = -grams % w
    big = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(big, axis=1).ravel()
    behind = np.minimum.accumulate(big[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - WINDOW + 1
    least = np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts])
    at = (least & low).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:starts]
    inside = np.arange(starts) + WINDOW <= off[1:][row]
    s = np.flatnonzero(inside & (at >= lo) & (at < hi))
    if not len(s):
        return none, none, none, none, none, none
    p = at[s]
    edge = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)]))
    first, last = s[edge], s[np.append(edge[1:], len(s)) - 1]
    p, row = p[edge], row[s[edge]]
    a, b = np.maximum(off[:-1][row], p - SPAN), np.minimum(off[1:][row], p + WINDOW)
    pb = _prefix(data, _B)
    c = _mix((pb[b] - pb[a]) * _powers(_B, n + 1)[1][a] + (p - a).astype(np.uint64))
    return row, p, p - first, last - first, h[p].view(np.int64), c.view(np.int64)


# --- shard transforms and their merge ---


def shard_bwt(text: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix starts in order, preceding symbols, last-to-first map) of a small collection of strings.

    ``text`` has symbols 1..256 and a 0 that ends each string; string i is text[off[i] : off[i + 1]]. Suffixes
    are ordered by their first WINDOW symbols (prefix doubling), ties by place; zeros of different strings
    count as equal, so only order within the shard matters here. The map leads from a suffix to the one that starts
    a symbol earlier; from a whole string it leads to that string's final 0.
    """
    n = len(text)
    rank = text.astype(np.int64)
    step = 1
    top = np.int64(n + 300)
    while step < WINDOW:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:]
        # nothing is read past a string's end: its 0 ranks below all, and what follows it is made 0
        both = rank * top + np.where(rank > 0, ahead, 0)
        both[text == 0] = 0
        order = np.argsort(both, kind="stable")
        new = np.zeros(n, np.int64)
        fresh = both[order]
        new[order] = np.cumsum(np.concatenate([[0], (fresh[1:] != fresh[:-1]).astype(np.int64)]))
        rank = new
        rank[text == 0] = 0
        step *= 2
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = order - 1
    first = np.zeros(n, bool)
    first[off[:-1]] = True
    symbol = np.where(first[order], 0, text[before]).astype(np.uint16)
    final = np.zeros(n, np.int64)
    final[off[:-1]] = off[1:] - 1
    back = np.where(first[order], final[order], before)
    return order, symbol, place[back]


def merge_bwts(shards: list[tuple[np.ndarray, np.ndarray]], depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes of all shards by their first ``depth`` symbols.

    ``shards`` holds (symbols, last-to-first map) each; a suffix is named by its rank in its shard plus the
    sizes of the shards before. Starting from any interleave, each round deals all suffixes stably by the symbol
    before them (Holt and McMillan 2014, for any number of shards at once), which refines the order by one
    more symbol; no text is read and no suffixes are compared. A place that first begins a block in round
    k has common prefix k - 1 with the place before it; what has not parted after ``depth`` rounds has ``depth``.
    """
    base = np.cumsum([0, *(len(s) for s, _ in shards)])
    symbol = np.concatenate([s for s, _ in shards])
    back = np.concatenate([b + o for (_, b), o in zip(shards, base)]).astype(np.int32)
    n = len(symbol)
    order = np.arange(n, dtype=np.int32)
    block = np.zeros(n, np.int32)
    lcp = np.full(n, depth, np.int32)
    if n:
        lcp[0] = 0
    for k in range(1, depth + 1):
        c = symbol[order]
        deal = np.argsort(c, kind="stable")
        c, old = c[deal], block[deal]
        fresh = np.empty(n, bool)
        fresh[:1] = True
        np.not_equal(c[1:], c[:-1], out=fresh[1:])
        fresh[1:] |= old[1:] != old[:-1]
        lcp[fresh & (lcp == depth)] = k - 1
        np.cumsum(fresh, out=block)
        order = back[order[deal]]
        if int(block[-1]) == n:
            break
    return order, lcp


def repeated(texts: list[np.ndarray], shard_symbols: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, class) of every position from which WINDOW symbols occur more than once in the collection. Strings are cut into shards; each is transformed alone and the transforms are merged."""
    shards, where, i = [], [], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < shard_symbols):
            size += len(texts[j]) + 1
            j += 1
        off = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[i:j]])])
        flat = np.zeros(off[-1], np.uint16)
        for t, a in zip(texts[i:j], off):
            flat[a : a + len(t)] = t.astype(np.uint16) + 1
        start, symbol, back = shard_bwt(flat, off)
        shards.append((symbol, back))
        own = np.searchsorted(off, start, side="right") - 1
        where.append((own + i, start - off[own]))
        i = j
    if not shards:
        z = np.zeros(0, np.int64)
        return z, z, z
    order, lcp = merge_bwts(shards)
    string, at = (np.concatenate([w[x] for w in where])[order] for x in (0, 1))
    size = np.array([len(t) for t in texts])
    whole = at + WINDOW <= size[string]
    group = np.cumsum(lcp < WINDOW)
    many = np.bincount(group)[group] > 1
    pick = whole & many
    return string[pick], at[pick], group[pick]


# --- the distributed operator ---

#: Contexts of one gram beyond which its strings are settled by 128-bit hashes instead of as text.
HOT = 30_000
BUCKET_CONTEXTS = 12_000
RANGES, STEP = 4, 18
_ANCHOR = "gram long, ctx long, doc long, th long, pk long"
_ARROW_ANCHOR = ["gram", "ctx", "doc", "th", "pk"]


def _pieces(off: np.ndarray):
    """(rows i..j, from, to, lo, hi): what to read of the text and which anchor places in it to keep."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + PIECE, side="right")) - 1))
        if off[j] - off[i] <= 2 * PIECE:
            yield i, j, off[i], off[j], 0, off[j] - off[i]
        else:
            for p in range(off[i], off[j], PIECE):
                a, b = max(off[i], p - 2 * WINDOW), min(off[j], p + PIECE + 2 * WINDOW)
                yield i, j, a, b, p - a, min(p + PIECE, off[j]) - a
        i = j


def _all_anchors(raw, off):
    """Columns row, place in row, back, width, gram, ctx for whole texts of any length."""
    out = []
    for i, j, a, b, lo, hi in _pieces(off):
        bound = np.clip(off[i : j + 1], a, b) - a
        row, p, back, width, gram, ctx = anchors(raw[a:b], bound, lo, hi)
        out.append((row + i, p + a - off[i + row], back, width, gram, ctx))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 6


def _table(*cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=_ARROW_ANCHOR)


def _find_anchors(docs: DataFrame) -> DataFrame:
    """kind 0: anchors for the shuffle; kind 1: strings already known to repeat an earlier row of the same batch, so copies in bulk leave each batch once."""

    def run(batches):
        for b in batches:
            raw, off = text_buffers(b.column(2))
            row, place, back, width, gram, ctx = _all_anchors(raw, off)
            doc = b.column(0).to_numpy(zero_copy_only=False)[row]
            th = b.column(1).to_numpy(zero_copy_only=False)[row]
            pk = place << 16 | back << 8 | width
            order = np.lexsort((pk, th, doc, ctx, gram))
            gram, ctx, doc, th, pk = (x[order] for x in (gram, ctx, doc, th, pk))
            same = np.zeros(len(gram), bool)
            np.logical_and(gram[1:] == gram[:-1], ctx[1:] == ctx[:-1], out=same[1:])
            yield _with_kind(0, gram[~same], ctx[~same], doc[~same], th[~same], pk[~same])
            # rows alike in doc, th and place are one document's, given twice
            lead = np.maximum.accumulate(np.where(~same, np.arange(len(same)), 0))
            other = same & ((doc != doc[lead]) | (th != th[lead]) | (pk != pk[lead]))
            yield _with_kind(1, gram[other], ctx[other], doc[other], th[other], pk[other])

    return arrow_map(docs.select("doc", "th", "text"), run, "kind int, " + _ANCHOR)


def _with_kind(kind: int, *cols) -> pa.RecordBatch:
    t = _table(*cols)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(t), kind, np.int32)), *t.columns], names=["kind", *_ARROW_ANCHOR])


def _settle(found: DataFrame) -> DataFrame:
    """From anchors sorted by gram and context: kind 1, strings that repeat an earlier context; kind 2, first rows of contexts whose gram has others. Runs are followed across batches with one pending row, so a gram of any count needs no memory."""

    def run(batches):
        last = None  # the row before: gram, ctx
        lead = None  # first row of the current context
        many = False  # the current gram has had other contexts
        for b in batches:
            gram, ctx, doc, th, pk = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            n = len(gram)
            if not n:
                continue
            new_gram, new_ctx = np.ones(n, bool), np.ones(n, bool)
            new_gram[1:] = gram[1:] != gram[:-1]
            new_ctx[1:] = new_gram[1:] | (ctx[1:] != ctx[:-1])
            if last is not None:
                new_gram[0] = gram[0] != last[0]
                new_ctx[0] = new_gram[0] or ctx[0] != last[1]
            heads = np.flatnonzero(new_ctx)
            # the pending lead stands before this batch as row -1
            cols = [np.concatenate([[x if lead is not None else 0], y]) for x, y in zip(lead or (0,) * 5, (gram, ctx, doc, th, pk))]
            at = np.maximum.accumulate(np.where(new_ctx, np.arange(1, n + 1), 0))
            other = ~new_ctx & ((doc != cols[2][at]) | (th != cols[3][at]) | (pk != cols[4][at]))
            yield _with_kind(1, gram[other], ctx[other], doc[other], th[other], pk[other])
            # leads in order: the pending one, then this batch's; a lead is told once its successor is seen
            leads = np.concatenate([[0] if lead is not None else np.zeros(0, np.int64), heads + 1]).astype(np.int64)
            if len(leads):
                g = cols[0][leads]
                after = np.zeros(len(leads), bool)
                after[:-1] = g[1:] == g[:-1]
                prior = np.zeros(len(leads), bool)
                prior[1:] = g[1:] == g[:-1]
                if lead is not None:
                    prior[0] = many
                told = (after | prior)[:-1]
                pick = leads[:-1][told]
                yield _with_kind(2, *(c[pick] for c in cols))
                lead = tuple(int(c[leads[-1]]) for c in cols)
                many = bool(prior[-1])
            last = (gram[-1], ctx[-1])
        if lead is not None and many:
            yield _with_kind(2, *(np.array([x]) for x in lead))

    rows = found.where("kind = 0").drop("kind").repartition("gram").sortWithinPartitions("gram", "ctx", "doc", "th", "pk")
    return arrow_map(rows, run, "kind int, " + _ANCHOR)


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Text around each wanted anchor: gram, doc, th, pk, lead (bytes before the anchor), bytes."""
    lists = wanted.groupBy("doc", "th").agg(F.collect_list(F.struct("gram", "pk")).alias("at"))

    def run(batches):
        for b in batches:
            raw, off = text_buffers(b.column(2))
            at = b.column(3)
            size = np.diff(at.offsets.to_numpy())
            flat = at.flatten()
            gram, pk = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            row = np.repeat(np.arange(len(b)), size)
            p = pk >> 16
            lo = np.maximum(0, p - SPAN)
            hi = np.minimum(off[row + 1] - off[row], p + WINDOW)
            for i in range(0, len(p), 50_000):
                s = slice(i, i + 50_000)
                body = pa.array([raw[a:z].tobytes() for a, z in zip((off[row[s]] + lo[s]).tolist(), (off[row[s]] + hi[s]).tolist())], pa.binary())
                ids = [b.column(k).take(pa.array(row[s])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(gram[s]), *ids, pa.array(pk[s]), pa.array(p[s] - lo[s]), body], names=["gram", "doc", "th", "pk", "lead", "body"])

    rows = docs.join(lists, ["doc", "th"]).dropDuplicates(["doc", "th"]).select("doc", "th", "text", "at")
    return arrow_map(rows, run, "gram long, doc long, th long, pk long, lead long, body binary")


_GONE = "doc long, th long, start long, n long"


def _gone(doc, th, start, n) -> pa.Table:
    return pa.table([pa.array(x, pa.int64()) for x in (doc, th, start, n)], names=["doc", "th", "start", "n"])


def _bucket(t: pa.Table) -> pa.Table:
    """Strings of a bucket's contexts that repeat an earlier one: doc, th, start, n (n + 1 strings from start on).

    An anchor's strings fall into ranges of offsets. Those of a range share a core; contexts alike over a whole
    range are settled by hash, and those alike only in their core go to the transforms.
    """
    doc, th, pk, lead = (t.column(c).to_numpy() for c in ("doc", "th", "pk", "lead"))
    body = t.column("body").combine_chunks()
    if isinstance(body, pa.ChunkedArray):
        body = body.chunk(0)
    offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
    raw = np.frombuffer(body.buffers()[2], np.uint8)
    place, back, width = pk >> 16, pk >> 8 & 255, pk & 255
    at = offsets[:-1] + lead
    data = raw[: offsets[-1]]
    sums = [(_prefix(data, base), _powers(base, len(data) + 1)[1]) for base in (_A, _B)]

    def digest(a, z, s):
        total, down = sums[s]
        return _mix((total[z] - total[a]) * down[a])

    out = []
    left = []
    for r in range(RANGES):
        o0, o1 = r * STEP, min(SPAN, r * STEP + STEP - 1)
        near, far = np.maximum(o0, back - width), np.minimum(o1, back)
        s = np.flatnonzero(near <= far)
        a, z = at[s] - far[s], at[s] - near[s] + WINDOW
        core = digest(at[s] - o0, at[s] - o1 + WINDOW, 0)
        order = np.lexsort((place[s] - far[s], th[s], doc[s], digest(a, z, 1), digest(a, z, 0), core))
        s, a, z, core = s[order], a[order], z[order], core[order]
        h0, h1 = digest(a, z, 0), digest(a, z, 1)
        same = np.zeros(len(s), bool)
        same[1:] = (core[1:] == core[:-1]) & (h0[1:] == h0[:-1]) & (h1[1:] == h1[:-1]) & (z[1:] - a[1:] == z[:-1] - a[:-1])
        g = s[same]
        out.append(_gone(doc[g], th[g], place[g] - far[g], far[g] - near[g]))
        s, a, z, core = s[~same], a[~same], z[~same], core[~same]
        if len(s):
            edge = np.concatenate([[True], core[1:] != core[:-1]])
            many = np.bincount(np.cumsum(edge) - 1)[np.cumsum(edge) - 1] > 1
            s, a, z = s[many], a[many], z[many]
            left.append((s, a, z, place[s] - far[s]))
    if left:
        s, a, z, start = (np.concatenate(x) for x in zip(*left))
        string, offset, group = repeated([data[i:j] for i, j in zip(a.tolist(), z.tolist())])
        d, h, p = doc[s][string], th[s][string], start[string] + offset
        order = np.lexsort((p, h, d, group))
        later = np.zeros(len(order), bool)
        later[1:] = group[order][1:] == group[order][:-1]
        g = order[later]
        out.append(_gone(d[g], h[g], p[g], np.zeros(len(g), np.int64)))
    return pa.concat_tables(out) if out else _gone(*[[]] * 4)


def _hot_strings(contexts: DataFrame) -> DataFrame:
    """Every string of the contexts with a 128-bit hash: w1, w2, doc, th, start."""

    def run(batches):
        for b in batches:
            names = ("doc", "th", "pk", "lead")
            doc, th, pk, lead = (b.column(c).to_numpy(zero_copy_only=False) for c in names)
            for i in range(len(b)):
                data = np.frombuffer(b.column("body")[i].as_buffer(), np.uint8)
                back, width, place = int(pk[i]) >> 8 & 255, int(pk[i]) & 255, int(pk[i]) >> 16
                a = int(lead[i]) - back + np.arange(width + 1)
                w = []
                for base in (_A, _B):
                    total = _prefix(data, base)
                    w.append(_mix((total[a + WINDOW] - total[a]) * _powers(base, len(data) + 1)[1][a]).view(np.int64))
                k = len(a)
                yield pa.RecordBatch.from_arrays([pa.array(w[0]), pa.array(w[1]), pa.array(np.full(k, doc[i])), pa.array(np.full(k, th[i])), pa.array(place - back + np.arange(k))], names=["w1", "w2", "doc", "th", "start"])

    return arrow_map(contexts, run, "w1 long, w2 long, doc long, th long, start long")


def removals(docs: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """(doc, th, start, n): strings start .. start + n of WINDOW bytes that occur earlier too. ``docs`` has doc, th, text."""
    found = scratch.save(_find_anchors(docs), "anchors")
    told = scratch.save(_settle(found), "settled")
    wanted = told.where("kind = 2").select("gram", "doc", "th", "pk")
    contexts = scratch.save(_contexts(docs, wanted), "contexts")
    counts = scratch.save(contexts.groupBy("gram").count().where(F.col("count") > hot).select("gram"), "hot")
    whole = found.where("kind = 1").union(told.where("kind = 1")).selectExpr("doc", "th", "shiftright(pk, 16) - (shiftright(pk, 8) & 255) as start", "pk & 255 as n")
    n = contexts.count()
    buckets = max(1, n // BUCKET_CONTEXTS)
    cool = contexts.join(counts, "gram", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)))
    parts = cool.repartition(max(1, min(buckets, 4000)), "bucket").groupBy("bucket").applyInArrow(_bucket, _GONE)
    strings = scratch.save(_hot_strings(contexts.join(counts, "gram", "left_semi")), "strings")
    first = strings.groupBy("w1", "w2").agg(F.min(F.struct("doc", "th", "start")).alias("first"), F.count("*").alias("many")).where("many > 1")
    late = strings.join(first, ["w1", "w2"]).where(F.struct("doc", "th", "start") != F.col("first")).select("doc", "th", "start", F.lit(0).cast("long").alias("n"))
    out = scratch.save(whole.unionByName(parts).unionByName(late), "gone")
    scratch.drop(found)
    scratch.drop(contexts)
    return out


def spans(start: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings cover."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    lo = start[order]
    hi = np.maximum.accumulate(lo + n[order] + WINDOW)
    edge = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return list(zip(lo[edge].tolist(), hi[np.append(edge[1:], len(lo)) - 1].tolist()))


def dedup(docs: DataFrame, keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes).

    A byte goes if a string of WINDOW bytes that covers it also starts earlier: in a smaller doc_id, or earlier
    in the same document. Null text is empty and texts under WINDOW bytes lose nothing. A null doc_id comes before
    all others. Rows of equal doc_id and different text are ordered by a hash of the text; rows alike in
    both are one document, each with its result. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    alone = base.groupBy("doc_id").count().where("count > 1").limit(1).count() == 0
    keyed = base.withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))).withColumn("th", F.lit(0).cast("long") if alone else F.xxhash64("text"))
    gone = removals(keyed.select("doc", "th", "text"), scratch, hot)
    lists = gone.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "n")).alias("at"))

    def run(batches):
        for b in batches:
            raw, off = text_buffers(b.column(1))
            rows = []
            for i in range(len(b)):
                data = memoryview(raw[off[i] : off[i + 1]])
                at = b.column(2)[i]
                cut = []
                if at.is_valid:
                    pairs = at.values
                    cut = spans(pairs.field(0).to_numpy(zero_copy_only=False), pairs.field(1).to_numpy(zero_copy_only=False))
                digest, kept, last = hashlib.sha256(), [], 0
                for lo, hi in [*cut, (len(data), len(data))]:
                    digest.update(data[last:lo])
                    if keep_text:
                        kept.append(bytes(data[last:lo]))
                    last = hi
                rows.append((len(data), sum(hi - lo for lo, hi in cut), len(cut), digest.hexdigest(), b"".join(kept)))
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + keep_text])]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
    rows = keyed.join(lists, ["doc", "th"], "left").select("doc_id", "text", "at")
    return arrow_map(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def op5_suffixes(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
