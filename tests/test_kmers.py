import bz2
import gzip
import random
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varispan.functions import alphabet as A
from varispan.operators.kmers import KmerSpec, explode_kmers, kmers, split_columns
from varispan.sources import fasta, kmerfile
from varispan.streaming import kmers as stream

PAIRS = dict(zip("ACGTRYKMBVDHSWNacgtrykmbvdhswn", "TGCAYRMKVBHDSWNtgcayrmkvbhdswn"))


def rc(s):
    return "".join(PAIRS[c] for c in reversed(s))


def values(df, column="kmer"):
    return sorted(r[column] for r in df.collect())


def frame(spark, seqs):
    return spark.createDataFrame([(s,) for s in seqs], "seq string")


def plain(seqs, k):
    return [s[i : i + k] for s in seqs for i in range(len(s) - k + 1)]


@pytest.fixture(scope="module")
def seqs():
    rng = random.Random(1)
    return ["".join(rng.choice("ACGTacgtNn") for _ in range(n)) for n in (0, 1, 3, 4, 5, 40, 200)]


def test_kmers_equal_slices(spark, seqs):
    df = frame(spark, seqs)
    assert values(kmers(df, KmerSpec(k=5))) == sorted(plain(seqs, 5))
    assert values(kmers(df, KmerSpec(k=(3, 5)))) == sorted(plain(seqs, 3) + plain(seqs, 5))
    assert values(kmers(df, KmerSpec())) == sorted(seqs)
    assert explode_kmers(df, (5,)).count() == sum(max(0, len(s) - 4) for s in seqs)


def test_tiles_cover_long_sequences_once(spark, monkeypatch, seqs):
    monkeypatch.setattr("varispan.operators.kmers.TILE", 7)
    assert values(kmers(frame(spark, seqs), KmerSpec(k=4))) == sorted(plain(seqs, 4))


def test_filters_and_maps(spark, seqs):
    df, all4 = frame(spark, seqs), plain(seqs, 4)
    assert values(kmers(df, KmerSpec(k=4, omit_soft=True))) == sorted(m for m in all4 if m.isupper())
    assert values(kmers(df, KmerSpec(k=4, map_soft=True))) == sorted(m.upper() for m in all4)
    assert values(kmers(df, KmerSpec(k=4, allow="ACgt"))) == sorted(m for m in all4 if set(m) <= set("ACgt"))
    assert values(kmers(df, KmerSpec(k=4, disallow="Nn"))) == sorted(m for m in all4 if not set(m) & set("Nn"))
    # A alone is not closed under complement: it is looked for on both strands
    got = values(kmers(df, KmerSpec(k=4, complements=True, disallow="A")))
    assert got == sorted(x for m in all4 for x in (m, rc(m)) if "A" not in x)
    assert values(kmers(df, KmerSpec(k=4, complements=True))) == sorted(x for m in all4 for x in (m, rc(m)))
    assert values(kmers(df, KmerSpec(k=4, canonicals=True))) == sorted(min(m, rc(m)) for m in all4)


def test_palindromes_come_twice(spark):
    assert values(kmers(frame(spark, ["ACGT"]), KmerSpec(k=4, complements=True))) == ["ACGT", "ACGT"]


def test_expansion(spark):
    assert values(kmers(frame(spark, ["ARn"]), KmerSpec(expand_iupac=True))) == sorted("A" + x + y for x, y in product("AG", "acgt"))


def test_rna_round_trip(spark):
    assert values(kmers(frame(spark, ["AUGC"]), KmerSpec(k=4, rna=True, complements=True))) == sorted(["AUGC", "GCAU"])


def test_split_order(spark):
    df = frame(spark, ["abcdefghij"])
    assert values(kmers(df, KmerSpec(split=(2, 3, -1)))) == ["ab,cde,fghi,j"]
    # back parts are told in the order given
    assert values(kmers(df, KmerSpec(split=(2, -1, -3)))) == ["ab,cdef,j,ghi"]
    row = df.select(*[c.alias(f"c{i}") for i, c in enumerate(split_columns(F.col("seq"), (4, -8)))]).first()
    assert (row.c0, row.c1, row.c2) == ("abcd", "", "efghij")


def test_sort_by_columns_then_line(spark):
    df = frame(spark, ["TAA", "AAC", "TAC", "AGA"])
    rows = [r.kmer for r in kmers(df, KmerSpec(split=(1, -1), sort_columns=(2,))).collect()]
    assert rows == ["A,G,A", "T,A,A", "A,A,C", "T,A,C"]


@pytest.mark.parametrize("bad", [{"omit_soft": True, "map_soft": True}, {"complements": True, "canonicals": True}, {"k": 0}])
def test_conflicts(bad):
    with pytest.raises(ValueError):
        KmerSpec(**bad)


def test_unknown_letters_have_no_complement(spark):
    with pytest.raises(Exception, match="no complement"):
        kmers(frame(spark, ["AXC"]), KmerSpec(k=3, complements=True)).collect()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ACGTRYKMBVDHSWNacgt", min_size=1, max_size=12), min_size=1, max_size=5))
def test_complement_is_its_own_inverse(spark, given_seqs):
    m = F.col("seq")
    for r in frame(spark, given_seqs).select("seq", A.reverse_complement(A.reverse_complement(m)).alias("twice"), A.canonical(m).alias("c"), A.canonical(A.reverse_complement(m)).alias("c2")).collect():
        assert r.twice == r.seq and r.c == r.c2 == min(r.seq, rc(r.seq))


def test_consensus_cases(spark):
    cases = [(["A", "G"], "R"), (["AC", "AC"], "AC"), (["A", "CC"], "--"), (["*", "A"], "N"), (["A", "?"], "N"), (["R", "C"], "V"), (["A", "C", "G", "T"], "N"), (["a", "g"], "R")]
    df = spark.createDataFrame([(a, b) for a, b in cases], "s array<string>, want string")
    assert all(r.got == r.want for r in df.select("want", A.consensus(F.col("s")).alias("got")).collect())


def test_dots_and_back(spark):
    r = spark.createDataFrame([("ACGT", "AGGA")], "a string, b string").select(A.dots(F.col("a"), F.col("b")).alias("d"), A.undots(F.col("a"), A.dots(F.col("a"), F.col("b"))).alias("u")).first()
    assert (r.d, r.u) == (".G.A", "AGGA")


def test_occurrences_overlap(spark):
    r = spark.createDataFrame([("AAAA", "AA"), ("A", "AA")], "s string, q string").select(A.occurrences(F.col("s"), F.col("q")).alias("at")).collect()
    assert [x["at"] for x in r] == [[1, 2, 3], []]


def test_fasta_forms(spark, tmp_path):
    (tmp_path / "a.x.fa").write_bytes(b">one > two\r\nACG\r\nT\r\n>empty\r\n>b\r\nGG\r\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">c\nAC\nGT\n")
    with bz2.open(tmp_path / "c.fa.bz2", "wt") as f:
        f.write(">d note\nTT\n")
    got = fasta.read_sequences(spark, [str(tmp_path / n) for n in ("a.x.fa", "b.fa.gz", "c.fa.bz2")])
    assert sorted((r.label, r.seq_id, r.seq) for r in got.collect()) == [("a", "b", "GG"), ("a", "one", "ACGT"), ("b", "c", "ACGT"), ("c", "d", "TT")]


def test_lines_keep_the_first(spark, tmp_path):
    (tmp_path / "s.txt").write_text("  ACG \n\nTT\t\n")
    assert sorted(r.seq for r in fasta.read_sequences(spark, str(tmp_path / "s.txt")).collect()) == ["ACG", "TT"]


def test_rna_is_told_by_the_first_sequence_with_either(spark):
    assert fasta.is_rna(frame(spark, ["ACG", "AUG"]))
    assert not fasta.is_rna(frame(spark, ["ATG", "AUG"]).coalesce(1))
    assert not fasta.is_rna(frame(spark, ["AC"]))


def test_stems(spark):
    df = spark.createDataFrame([("/x/ab.c.fasta.gz",)], "p string")
    r = df.select(fasta.stem_of(F.col("p")).alias("stem"), fasta.label_of(F.col("p")).alias("label")).first()
    assert (r.stem, r.label) == ("ab.c", "ab")


def test_kmer_lines(spark, tmp_path):
    (tmp_path / "g.csv").write_text("AA,C,TT\nAA,C,TT\nAA,G,TT,x;y(3)\n")
    rows = sorted((r.l, r.d, r.r, r.label, r.n) for r in kmerfile.read_kmers(spark, str(tmp_path / "g.csv")).collect())
    assert rows == [("AA", "C", "TT", "g", 2), ("AA", "G", "TT", "x", 1), ("AA", "G", "TT", "y", 3)]
    (tmp_path / "bad.csv").write_text("AA,C\n")
    with pytest.raises(Exception, match="not a k-mer line"):
        kmerfile.read_kmers(spark, str(tmp_path / "bad.csv")).collect()


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spec = KmerSpec(k=3, canonicals=True)

    def run():
        q = stream.write_stream(stream.kmer_stream(stream.read_stream(spark, str(tmp_path / "in")), spec), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(60)

    (tmp_path / "in/1.txt").write_text(">h\nACGTA\n")
    run()
    (tmp_path / "in/2.txt").write_text("TTTT\n")
    run()
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(min(m, rc(m)) for m in plain(["ACGTA", "TTTT"], 3))


def test_time_does_not_grow_with_the_length_of_a_row(spark, tmp_path):
    """The same bases in rows a hundred times as long take no more than a few times as long (the square would be a hundred)."""
    import random
    import time

    from varispan.operators.kmers import KmerSpec, kmers

    base = "".join(random.Random(1).choice("ACGT") for _ in range(400_000))
    took = []
    for i, n in enumerate((1_000, 1_000, 100_000)):
        path = str(tmp_path / str(i))
        spark.createDataFrame([(base[j : j + n],) for j in range(0, len(base), n)], "seq string").coalesce(1).write.parquet(path)
        began = time.time()
        kmers(spark.read.parquet(path), KmerSpec(k=28)).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[2] < 8 * took[1] + 2


def test_letters_of_several_bytes(spark):
    from varispan.operators.kmers import KmerSpec, kmers

    rows = spark.createDataFrame([("AéCGT",), ("ACG",)], "seq string")
    assert sorted(r.kmer for r in kmers(rows, KmerSpec(k=3)).collect()) == ["ACG", "AéC", "CGT", "éCG"]
