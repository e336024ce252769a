import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from varispan.llm import tokens


@pytest.fixture(scope="module")
def library():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def plain(tok, rows):
    out, start = [], 0
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_equals_library(spark, sf, texts, library):
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.op9_tokens(spark, sf).collect())
    assert got == plain(library, texts)


def test_encoder_on_hard_texts(library):
    rng = random.Random(8)
    alphabet = ["a", "B", "é", "É", "ß", "İ", "ı", "ſ", "'s", "'", "’", "!", "<|", "<|endoftext|>", "|>", "1", "23", " ", "\n", "\t", " ", " ", "é", "́", "中", "😀", ".", "...", "ŉ", "ǅ", "\x00", "don't", "I'LL", "#", "_", "‍"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", " ", "a" * 5000]
    import pyarrow as pa

    ids, per = tokens.Encoder(tokens.default_tokenizer()).encode(pa.array(texts + [None]))
    ends = np.cumsum(per)
    for t, e, n in zip(texts + [""], ends, per):
        want = library.encode(t, add_special_tokens=False).ids + [1]
        assert ids[e - n : e].tolist() == want, repr(t)


@pytest.mark.parametrize("first_id", [50, 70_000])
def test_grammar_round_trip_and_random_access(first_id):
    rng = np.random.default_rng(2)
    phrase = rng.integers(0, 40, 12)
    docs = [np.concatenate([np.tile(phrase, int(k)), rng.integers(0, 50, int(n))]) for k, n in rng.integers(0, 30, (40, 2))]
    docs = [np.append(d, 1) for d in docs] + [np.array([1]), np.full(200, 7)]
    ids = np.concatenate(docs).astype(np.uint32)
    last = np.zeros(len(ids), bool)
    last[np.cumsum([len(d) for d in docs]) - 1] = True
    seq, end, rules = tokens.repair(ids, last, first_id)
    lengths = tokens.rule_lengths(rules, first_id)
    assert len(seq) < len(ids) / 2 and len(rules)
    assert tokens.expand(seq, rules, lengths, first_id).tolist() == ids.tolist()
    wide = first_id >= 1 << 16
    shard = {"first_id": first_id, "symbols": tokens.pack(seq, wide), "rules": tokens.pack(rules.ravel(), wide), "rule_length": lengths.astype("<i8").tobytes(), "first_symbol": np.concatenate([[0], np.flatnonzero(end)[:-1] + 1]).tolist()}
    for i, d in enumerate(docs):
        assert tokens.read_document(shard, i).tolist() == d.tolist()


@pytest.mark.parametrize("first_id", [100, 70_000])
def test_grammar_is_finished(first_id):
    rng = np.random.default_rng(7)
    ids = np.concatenate([np.repeat(rng.integers(2, 60, 400), rng.integers(1, 40, 400)), rng.zipf(1.5, 20_000) % 90, np.tile(np.arange(2, 50), 60)]).astype(np.uint32)
    last = ids == 1
    last[-1] = True
    seq, end, rules = tokens.repair(ids, last, first_id)
    assert (tokens.expand(seq, rules, tokens.rule_lengths(rules, first_id), first_id) == ids).all()
    assert (rules[:, 0] == rules[:, 1]).any() and end.sum() == last.sum()
    pairs = Counter((a, b) for a, b, e in zip(seq[:-1].tolist(), seq[1:].tolist(), end[:-1].tolist()) if not e)
    assert max(pairs.values()) < 24


def test_many_small_shards(spark, tmp_path, library):
    rows = [(i, f"shared words here {i} shared words here " * (i % 5)) for i in range(50)]
    path = f"file://{tmp_path}/shards"
    tokens.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path, shard_ids=64)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_shards(spark, path).collect())
    assert got == plain(library, rows)


def test_odd_rows(odd, nothing, library, spark):
    rows = tokens.token_output(spark, odd).collect()
    assert len(rows) == odd.count()
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert {r.doc_id for r in sorted(rows, key=lambda r: r.start)[:2]} == {None}
    assert tokens.token_output(spark, nothing).count() == 0


def test_a_tokenizer_of_another_kind_is_not_cut_to_words(spark):
    """Byte-level ids depend on the spaces before words; texts then go to the library whole."""
    import public_tokenizers
    from tokenizers import Tokenizer

    assert tokens.parts_words(Tokenizer.from_file(tokens.default_tokenizer()))
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    assert not tokens.parts_words(own)
    texts = ["Some words,  and a line\nmore", "", None, "don't 12 é"]
    ids, per = tokens.Encoder(path).encode(pa.array(texts, pa.string()))
    want = [own.encode(t or "", add_special_tokens=False).ids + [tokens.END] for t in texts]
    assert ids.tolist() == sum(want, []) and per.tolist() == [len(w) for w in want]


def test_words_joined_by_a_mark_have_their_own_ids():
    """Joined calls, calls of one word and the library agree, special tokens and parts of them in words included; a tokenizer with other added tokens gets no mark."""
    enc, alone = (tokens.Encoder(tokens.default_tokenizer()) for _ in range(2))
    assert enc.mark is not None
    alone.mark = None
    texts = ["<|endoftext|>", None, "", "a<|endoftext|>b <|x <", "<<|endoftext|", "|> x|> <|", "é" * 50 + "<|startoftext|>", *(f"word{i}, Straße{i}! ½ don't" for i in range(700))]
    want = [[*enc.tok.encode(x or "", add_special_tokens=False).ids, tokens.END] for x in texts]
    for e in (enc, alone):
        ids, per = e.encode(pa.array(texts))
        assert ids.tolist() == [i for w in want for i in w] and per.tolist() == [len(w) for w in want]
    enc.tok.add_special_tokens(["[SEP]"])
    assert tokens.word_mark(enc.tok) is None
