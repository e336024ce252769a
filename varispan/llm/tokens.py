"""Token ids in a grammar-compressed shard format with random access.

Documents are dealt by ranges of doc_id, encoded, and each shard's ids are compressed by Re-Pair: rounds
that replace frequent id pairs by nonterminals. A shard holds its rules, their expansion lengths and each
document's first symbol, so one document decodes without the rest. Shards are rows of a Parquet table
that Spark writes, so the commit protocol covers lost executors and any Hadoop file system serves.
"""

from __future__ import annotations

import ctypes
import os
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map

END = 1
SHARD_SCHEMA = "part int, base long, first_id int, doc_id array<long>, n_tokens array<long>, first_symbol array<long>, rules binary, rule_length binary, symbols binary"
SHARD_IDS = 4_000_000
SHARD_BYTES = 6 << 20
#: Words whose ids a Python worker remembers; the store starts anew when full.
CACHE_WORDS = 800_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words and what stands between them, in every mix that the short cut takes apart.
_PROBE = ["a", "ab", "Word", "don't", "é", "Ünïx", "日本", "x1", "...", "'s"]


def parts_words(tok) -> bool:
    """True if the tokenizer gives a line the ids of its words one by one, in any case of letters and with punctuation after them: tried on all pairs of a few words."""
    ids = lambda t: tok.encode(t, add_special_tokens=False).ids
    alone = {w: ids(w) for w in _PROBE}
    joints = (" ", "\n", "  ")
    return all(ids(v + j + w) == alone[v] + alone[w] for v in _PROBE for w in _PROBE for j in joints) and all(
        ids(v.lower()) == ids(v.upper()) and ids("ab" + p) == alone["ab"] + ids(p) for v in ("Word", "aB") for p in ("!", ",", "...", "?!", "-")
    )


def word_mark(tok) -> tuple[str, int] | None:
    """A special token, with its id, that parts words without a trace: tried on all pairs of a few words. None unless all added tokens begin with "<|"."""
    ids = lambda t: tok.encode(t, add_special_tokens=False).ids
    added = tok.get_added_tokens_decoder()
    if any(not t.content.startswith("<|") for t in added.values()):
        return None
    for mark, t in added.items():
        if all(ids(v + t.content + w + t.content) == [*ids(v), mark, *ids(w), mark] for v in (*_PROBE, "", "<", "|>") for w in (*_PROBE, "", "<", "|>")):
            return t.content, mark
    return None


class Encoder:
    """Ids of whole texts, equal to the library's own.

    A tokenizer that lower-cases and parts words at white space and punctuation (``parts_words``) goes piece by piece: the text is cut at spaces and line feeds, where this kind of tokenizer always cuts; each distinct piece is
    encoded once. A run of Latin letters followed only by ASCII punctuation is cut between the two,
    where its pre-tokenizer cuts as well (not so where lower-casing or NFC makes a mark of a letter's end). Pieces with "<|" (special tokens) are handed over as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # Tasks fill the cores already; the library's own threads would only add to the time and memory of each.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        self.by_piece = parts_words(self.tok)
        self.mark = word_mark(self.tok) if self.by_piece else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word by itself, end to end, and their numbers; a hundred words are one call, with a special token between them."""
        if self.mark is not None and not any("<|" in w for w in words):
            text, mark = self.mark
            calls = [text.join(words[i : i + 100]) + text for i in range(0, len(words), 100)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(calls, add_special_tokens=False)])
            ends = np.flatnonzero(ids == mark)
            return ids[ids != mark], np.diff(ends, prepend=-1) - 1
        if self.mark is not None and len(words) > 1:
            half = len(words) // 2
            (a, m), (b, n) = self._alone(words[:half]), self._alone(words[half:])
            return np.concatenate([a, b]), np.concatenate([m, n])
        found = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where each piece's ids are in the store: run i is flat[at[i] : at[i + 1]]. Pieces may repeat."""
        code = pc.dictionary_encode(pieces)
        words = code.dictionary.to_pylist()
        if len(self.known) + len(words) > CACHE_WORDS:
            self._forget()
        known = self.known
        place = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            new = [words[i] for i in fresh.tolist()]
            made = [self._alone(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
            flat, size = (np.concatenate(x) for x in zip(*made))
            place[fresh] = np.arange(len(known), len(known) + len(new))
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.flat = np.concatenate([self.flat, flat])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
        return place[code.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end with END after each, and the number per text. Null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_piece:
            found = [e.ids + [END] for e in self.tok.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        code = pc.dictionary_encode(split.flatten())
        chunk = code.dictionary
        plain = pc.invert(pc.match_substring(chunk, "<|"))
        low = pc.if_else(plain, pc.ascii_lower(chunk), chunk)
        cut = pc.extract_regex(low, r"^(?P<w>[a-zA-ZÀ-ÖØ-öø-įı-ſ]+)(?P<p>[!-/:-@\[-`{-~]+)$")
        cut_ok = pc.and_(plain, pc.is_valid(cut))
        stem = pc.if_else(cut_ok, cut.field("w"), low)
        rest = pc.if_else(cut_ok, cut.field("p"), "")
        n = len(chunk)
        place = self._places(pa.concat_arrays([stem, rest]))
        # stem then rest of each distinct chunk, end to end
        flat, size = gather(self.flat, self.at, place.reshape(2, n).T.ravel())
        flat, size = ragged(flat, size.reshape(n, 2).sum(1), code.indices.to_numpy(zero_copy_only=False))
        ends = np.concatenate([[0], np.cumsum(size)])
        cuts = ends[np.concatenate([[0], np.cumsum(per_text)])]
        per = np.diff(cuts) + 1
        out = np.empty(len(flat) + len(per), np.uint32)
        last = np.cumsum(per) - 1
        body = np.ones(len(out), bool)
        body[last] = False
        out[body] = flat
        out[last] = END
        return out, per


def give_back() -> None:
    """Hand freed memory back to the system: a worker lives on between tasks, and what its allocators keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def gather(flat: np.ndarray, at: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``order`` of the runs flat[at[i] : at[i + 1]], end to end, and their sizes."""
    size = (at[1:] - at[:-1])[order]
    total = int(size.sum())
    if not total:
        return flat[:0], size
    begin = np.cumsum(size) - size
    index = np.arange(total) + np.repeat(at[:-1][order] - begin, size)
    return flat[index], size


def ragged(flat: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return gather(flat, np.concatenate([[0], np.cumsum(size)]), order)


def repair(ids: np.ndarray, last: np.ndarray, first_id: int, least: int = 24, most: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (symbols, which of them end a document, rules as pairs).

    Each round counts all pairs of neighbours, takes up to ``most`` of the most frequent (``least`` or more
    occurrences) so that no id is the left of one and the right of another, and replaces every
    occurrence; nothing overlaps then but a pair of one id with itself, which is replaced from the left, so a round equals as many single replacements.
    Rounds end when no pair is that frequent (a rule is 12 bytes, an occurrence saves 2 or 4) or no id is left. Rules start at
    ``first_id`` and stay under 2 ** 16 while ids do. Pairs across documents (``last``) are never joined.
    """
    wide = first_id >= 1 << 16
    seq = ids.astype(np.uint32)
    end = last.copy()
    rules: list[np.ndarray] = []
    made = 0
    limit = (1 << 32) - 1 - first_id if wide else (1 << 16) - first_id
    while len(seq) > 1 and made < limit:
        joint = ~end[:-1]
        if wide:
            key = seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:]
        else:
            key = seq[:-1] << np.uint32(16) | seq[1:]
        run = np.sort(key[joint])
        if not len(run):
            break
        edge = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        count = np.diff(np.append(edge, len(run)))
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        if len(often) > 4 * most:
            often = often[np.argpartition(-count[often], 4 * most)[: 4 * most]]
        often = often[np.lexsort((run[edge[often]], -count[often]))]
        pairs = run[edge[often]]
        shift, mask = (np.uint64(32), np.uint64((1 << 32) - 1)) if wide else (np.uint32(16), np.uint32((1 << 16) - 1))
        lefts, rights, taken = set(), set(), []
        for a, b in zip((pairs >> shift).tolist(), (pairs & mask).tolist()):
            if a not in rights and b not in lefts:
                lefts.add(a)
                rights.add(b)
                taken.append((a, b))
                if len(taken) >= min(most, limit - made):
                    break
        if not taken:
            break
        pair = np.array(taken, np.int64)
        ls, rs = np.unique(pair[:, 0]), np.unique(pair[:, 1])
        top = int(max(seq.max(), pair.max())) + 1
        kind = np.int16 if most < 1 << 15 else np.int32
        lrank, rrank = np.zeros(top, kind), np.zeros(top, kind)
        lrank[ls], rrank[rs] = np.arange(1, len(ls) + 1), np.arange(1, len(rs) + 1)
        table = np.zeros((len(ls) + 1, len(rs) + 1), np.uint32 if wide else np.uint16)
        table[lrank[pair[:, 0]], rrank[pair[:, 1]]] = first_id + made + np.arange(len(pair))
        # only places whose id is some rule's left side are looked at further
        hit = np.flatnonzero(lrank[seq[:-1]])
        right = rrank[seq[hit + 1]]
        hit, right = hit[right > 0], right[right > 0]
        new = table[lrank[seq[hit]], right]
        made_here = (new > 0) & joint[hit]
        hit, new = hit[made_here], new[made_here]
        if (pair[:, 0] == pair[:, 1]).any():
            # only in a run of one id do places follow each other: every other one of them counts, from the left
            begin = np.flatnonzero(np.diff(hit, prepend=-2) > 1)
            rank = np.arange(len(hit)) - np.repeat(begin, np.diff(np.append(begin, len(hit))))
            hit, new = hit[rank % 2 == 0], new[rank % 2 == 0]
        seq[hit] = new
        end[hit] = end[hit + 1]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq, end = seq[keep], end[keep]
        rules.append(pair)
        made += len(pair)
    table = np.concatenate(rules).astype(np.uint32) if rules else np.zeros((0, 2), np.uint32)
    return seq, end, table


def rule_lengths(rules: np.ndarray, first_id: int) -> np.ndarray:
    """Number of ids that each rule expands to; a rule refers to earlier ones only."""
    size = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        size[i] = (size[a - first_id] if a >= first_id else 1) + (size[b - first_id] if b >= first_id else 1)
    return size


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_id: int) -> np.ndarray:
    """Ids of a run of symbols: each rule's expansion is laid out once, then copied where it is used."""
    flat: list[np.ndarray] = []
    for a, b in rules.tolist():
        flat.append(np.concatenate([flat[x - first_id] if x >= first_id else np.array([x], np.uint32) for x in (a, b)]))
    table = np.concatenate([np.arange(first_id, dtype=np.uint32), *flat])
    at = np.concatenate([np.arange(first_id + 1), first_id + np.cumsum(lengths)])
    return gather(table, at, symbols)[0]


def pack(values: np.ndarray, wide: bool) -> bytes:
    return values.astype("<u4" if wide else "<u2").tobytes()


def unpack(data: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(data, "<u4" if wide else "<u2").astype(np.uint32)


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order and write shards to ``path``.

    Partitions are ranges of doc_id, so partition order is document order; equal ids lie together, ordered
    by text, and null ids come first. A shard ends at ``shard_ids`` ids, and memory is bounded by that and
    the longest text.
    """
    tokenizer = tokenizer or default_tokenizer()

    def run(batches):
        enc = _encoder(tokenizer)
        part = TaskContext.get().partitionId()
        base, held = 0, []

        def shard():
            ids = np.concatenate([x[1] for x in held])
            per = np.concatenate([x[2] for x in held])
            last = np.zeros(len(ids), bool)
            last[np.cumsum(per) - 1] = True
            seq, end, rules = repair(ids, last, enc.size)
            wide = enc.size >= 1 << 16
            first = np.concatenate([[0], np.flatnonzero(end)[:-1] + 1])
            row = {
                "part": part, "base": base, "first_id": enc.size,
                "doc_id": pa.concat_arrays([x[0] for x in held]).to_pylist(), "n_tokens": per.tolist(), "first_symbol": first.tolist(),
                "rules": pack(rules.ravel(), wide), "rule_length": rule_lengths(rules, enc.size).astype("<i8").tobytes(), "symbols": pack(seq, wide),
            }
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=_ARROW), len(ids)

        size = 0
        for b in batches:
            text = b.column(1)
            weight = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < len(b):
                j = max(i + 1, int(np.searchsorted(weight, (weight[i - 1] if i else 0) + SHARD_BYTES, side="right")))
                ids, per = enc.encode(text.slice(i, j - i))
                held.append((b.column(0).slice(i, j - i), ids, per))
                size += len(ids)
                i = j
                give_back()
                if size >= shard_ids:
                    out, n = shard()
                    yield out
                    give_back()
                    base, size = base + n, 0
        if held:
            yield shard()[0]
            give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    arrow_map(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"), run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


_ARROW = pa.schema([("part", pa.int32()), ("base", pa.int64()), ("first_id", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("first_symbol", pa.list_(pa.int64())), ("rules", pa.binary()), ("rule_length", pa.binary()), ("symbols", pa.binary())])
_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def read_document(shard, i: int) -> np.ndarray:
    """Ids of the shard's i-th document, decoded from its own symbols alone."""
    wide = shard["first_id"] >= 1 << 16
    symbols, first = unpack(shard["symbols"], wide), list(shard["first_symbol"])
    stop = first[i + 1] if i + 1 < len(first) else len(symbols)
    rules = unpack(shard["rules"], wide).reshape(-1, 2)
    return expand(symbols[first[i] : stop], rules, np.frombuffer(shard["rule_length"], "<i8"), shard["first_id"])


def read_shards(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_symbols) of every document, decoded from the files.

    ``start`` adds the ids of earlier partitions, one number per partition that wrote, to the shard's own
    base and the documents before in the shard.
    """
    files = spark.read.schema(SHARD_SCHEMA).parquet(path)
    totals = files.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    before, run_ = {}, 0
    for r in totals:
        before[r.part] = run_
        run_ += r.n

    def run(batches):
        for b in batches:
            for row in range(len(b)):
                s = {n: b.column(n)[row].as_py() for n in ("part", "base", "first_id", "n_tokens", "first_symbol", "rules", "rule_length", "symbols")}
                wide = s["first_id"] >= 1 << 16
                symbols, rules = unpack(s["symbols"], wide), unpack(s["rules"], wide).reshape(-1, 2)
                ids = expand(symbols, rules, np.frombuffer(s["rule_length"], "<i8"), s["first_id"]).astype("<u4")
                per = np.array(s["n_tokens"], np.int64)
                ends = np.cumsum(per)
                crc = np.fromiter((zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), per.tolist())), np.int64, len(per))
                first = np.array(s["first_symbol"], np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[row].values, pa.array(before[s["part"]] + s["base"] + ends - per), pa.array(per), pa.array(crc), pa.array(np.diff(np.append(first, len(symbols))))], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_symbols"])

    return arrow_map(files, run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_symbols long")


def token_output(spark, docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write the shards (to ``path``, else to the shared folder) and return what reads back from them.

    One row per input row. Null and empty texts are the end id alone. Equal doc_ids are ordered by text,
    null ids come first. Other columns are ignored; an empty table gives an empty result.
    """
    path = path or Scratch(spark, "tokens").path("shards")
    write_shards(docs, path, tokenizer)
    return read_shards(spark, path)


def op9_tokens(spark, sf_dir: str) -> DataFrame:
    return token_output(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids of all that is left, as digests read from the shards."""
    return token_output(spark, docs)
