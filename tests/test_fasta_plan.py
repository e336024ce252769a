import pytest

from varispan.functions import thermo as T
from varispan.operators import conserve as C
from varispan.operators import primers as P
from varispan.operators import render as R
from varispan.plans import fasta_plan
from varispan.plans.params import amplicon_sizes

HEAD = "ACGCACAAGGACAAGTGCCACTAAACCAGCCAGCCCTGACGCAGATCATCCCGCGCTTACT"
TAIL = "ACCAAGCTGCGAGAGTATCTTGTCGATGGGAACGATAG"


@pytest.fixture(scope="module")
def genomes(tmp_path_factory):
    """Five genomes of a hundred bases that differ in one."""
    d = tmp_path_factory.mktemp("genomes")
    for name, base in (("in0", "G"), ("in1", "T"), ("out0", "C"), ("out1", "C"), ("out2", "C")):
        (d / f"{name}.fa").write_text(f">{name}\n{HEAD}{base}{TAIL}\n")
    return [str(d / f"in{i}.fa") for i in range(2)], [str(d / f"out{i}.fa") for i in range(3)]


def rows(df):
    return sorted((r.left_seq, r.diag_seq, r.right_seq) for r in df.select("left_seq", "diag_seq", "right_seq").collect())


def test_single_base_regions(spark, genomes):
    got = fasta_plan.search(spark, *genomes, (25, 1, 2))
    assert rows(got) == [("CGACAAGATACTCTCGCAGCTTGGT", "M", "AG"), ("TGACGCAGATCATCCCGCGCTTACT", "K", "AC")]


def test_wide_regions_are_each_others_reverse(spark, genomes):
    got = rows(fasta_plan.search(spark, *genomes, (30, 40, 30)))
    assert len(got) == 2 and {"".join(r).count("K") + "".join(r).count("M") for r in got} == {1}


def test_no_diagnostic_part(spark, genomes):
    got = rows(fasta_plan.search(spark, genomes[0] + genomes[1], [], (30, 0, 30)))
    assert len(got) == 4 and all(d == "" for _, d, _ in got)


def test_primers_and_text(spark, genomes):
    got = fasta_plan.search(spark, *genomes, (30, 40, 30), primers=P.PrimerOptions(max_sec_tm=99))
    found = fasta_plan.alignments_text(got, ["in0", "in1"]).collect()
    assert found
    for r in found:
        assert 70 <= r.pair_product_size <= 150 and r.left_self_any_th is None
        assert "└" in r.alignment and "Primer statistics" in r.alignment
    bare = [r.alignment for r in fasta_plan.alignments_text(fasta_plan.search(spark, *genomes, (25, 1, 2)), ["in0", "in1"]).collect()]
    one = next(b for b in bare if b.startswith("TGACG"))
    assert one.splitlines()[:3] == ["TGACGCAGATCATCCCGCGCTTACTGAC : in0", "TGACGCAGATCATCCCGCGCTTACTTAC : in1", "TGACGCAGATCATCCCGCGCTTACTCAC : out0;out1;out2"]
    assert one.splitlines()[3] == " " * 24 + "{#}"
    dots = [r.alignment for r in fasta_plan.alignments_text(fasta_plan.search(spark, *genomes, (25, 1, 2)), ["in0", "in1"], dots=True).collect()]
    assert next(b for b in dots if b.startswith("TGACG")).splitlines()[1] == "." * 25 + "T" + ".." + " : in1"


def test_intersection_is_by_file_not_label(spark):
    data = [("f1", "a", "AC"), ("f2", "a", "AC"), ("f1", "a", "GG")]
    df = spark.createDataFrame(data, "file string, label string, k string").selectExpr("file", "label", "substring(k, 1, 1) l", "'' d", "substring(k, 2, 1) r")
    got = C.conserved(C.count_amplicons(df), ["f1", "f2"]).collect()
    assert [(r.l, r.r, r.amplicons[0].labels[0].n) for r in got] == [("A", "C", 2)]


def test_unique_columns_need_no_conserved_ingroup(spark):
    df = spark.createDataFrame([("A", "x", "GA"), ("A", "y", "TA"), ("A", "z", "CA")], "l string, label string, d string").selectExpr("label file", "label", "l", "d", "'T' r")
    got = C.conserved(C.count_amplicons(df), ["x", "y", "z"])
    r = got.select(C.unique_columns(got.amplicons, ["x", "y"]).alias("u"), C.variable_columns(got.amplicons).alias("v"), C.unique_columns(got.amplicons, ["x", "y", "z"]).alias("all")).first()
    assert (r.u, r.v, r["all"]) == ([0], [0], [0, 1])


@pytest.mark.parametrize(
    "given, want",
    [
        ({"amplicon": 10, "diagnostic": 3}, (3, 4, 3)),
        ({"amplicon": 10, "diagnostic": 4, "left": 9}, (3, 4, 3)),
        ({"amplicon": 10, "conserved": 3}, (3, 4, 3)),
        ({"amplicon": 10, "left": 2, "right": 3}, (2, 5, 3)),
        ({"diagnostic": 2, "conserved": 4}, (4, 2, 4)),
        ({"diagnostic": 2, "left": 4, "right": 0}, (4, 2, 0)),
    ],
)
def test_sizes(given, want):
    assert amplicon_sizes(**given) == want


@pytest.mark.parametrize("given", [{}, {"amplicon": 5}, {"diagnostic": 5, "left": 2}, {"amplicon": 4, "conserved": 3}])
def test_sizes_that_do_not_suffice(given):
    with pytest.raises(ValueError):
        amplicon_sizes(**given)


#: sequence, melting temperature, penalty, GC percent, end stability
PRIMERS = [
    ("CACAAGGACAAGTGCCACTAAACCAG", 64.24706, 7.74706, 50.0, 4.0),
    ("TCGTTCCCATCGACAAGATACTCTC", 61.93757, 6.43757, 48.0, 3.2),
    ("ctgggatactactaccatttgaccaattc", 61.54051, 2.04051, 41.37931, 2.17),
    ("cggagaccaattTtccaaatgtcaG", 60.84751, 5.34751, 44.0, 3.51),
]


def test_primer_figures(spark):
    from pyspark.sql import functions as F

    from varispan.functions import alphabet as A

    df = spark.createDataFrame(PRIMERS, "s string, tm double, penalty double, gc double, stab double")
    s = F.col("s")
    for r in df.select("*", T.tm_column(s).alias("tm2"), T.penalty_column(T.tm_column(s), F.length(s)).alias("p2"), A.gc_percent(s).alias("gc2"), T.end_stability_column(s).alias("e2")).collect():
        assert (round(r.tm2, 5), round(r.p2, 5), round(r.gc2, 5), r.e2) == (r.tm, r.penalty, r.gc, r.stab)
        assert (round(T.tm(r.s), 5), T.end_stability(r.s), round(T.gc(r.s), 5)) == (r.tm, r.stab, r.gc)


def test_product_figures():
    template = HEAD + "K" + TAIL
    at = template.index(PRIMERS[0][0])
    end = template.index(P.reverse_complement(PRIMERS[1][0])) + len(PRIMERS[1][0]) - 1
    pair = {"left_start": at, "left_len": 26, "right_end": end, "right_len": 25, "left_tm": PRIMERS[0][1], "right_tm": PRIMERS[1][1]}
    assert end - at + 1 == 94
    assert {k: round(v, 5) for k, v in R.product_figures(template, pair).items()} == {"Product Tm": 84.32116, "Product Tm Oligo Tm Diff": 22.38359, "T Opt A": 62.70608}


def test_designer_meets_its_limits():
    o = P.PrimerOptions()
    pair = P.NearestNeighborDesigner().design(HEAD + "K" + TAIL, 55, 10, o)
    assert pair is None or (o.amp_size[0] <= pair["pair_product_size"] <= o.amp_size[1] and pair["left_start"] + pair["left_len"] <= 55)
    assert P.NearestNeighborDesigner().design("A" * 200, 90, 10, o) is None


def test_settings_text():
    assert P.parse_settings("A=5\nB=1.5\nC=1-2 3-4\nD=x\n=\n") == {"A": 5, "B": 1.5, "C": [[1, 2], [3, 4]], "D": "x"}


@pytest.mark.parametrize("n", [1, 62, 63, 64, 130])
def test_keys_of_many_files(spark, n):
    files = [f"f{i}" for i in range(n)]
    data = [(f, "x", "A", "", "C") for f in files] + [(f, "x", "A", "", "G") for f in files[:-1]] + [("other", "x", "A", "", "T")]
    df = spark.createDataFrame(data, "file string, label string, l string, d string, r string")
    assert [r.r for r in C.in_all_files(C.count_amplicons(df), files).collect()] == ["C"]


def test_find_on_both_strands(spark):
    from varispan.operators import search as S

    seqs = spark.createDataFrame([("f.fa", "f", "c1", "TTACGGTTTTCCGTAAAAC"), ("g.fa", "g", "c2", "ACGGACGG")], "file string, label string, seq_id string, seq string")
    got = sorted((r.seq_id, r.strand, r.start, r.end, r.sequence) for r in S.find(seqs, spark.createDataFrame([("ACGG",)], "query string"), 3).collect())
    assert got == [("c1", "forward", 1, 10, "TTACGGTTT"), ("c1", "reverse", 8, 18, "tttacggaaa"), ("c2", "forward", 1, 8, "ACGGACG"), ("c2", "forward", 2, 12, "CGGACGG")]
    own = S.find(seqs, spark.createDataFrame([("ACGG", "g"), ("ACGG", "h")], "query string, label string"))
    assert sorted((r.label, r.start) for r in own.collect()) == [("g", 1), ("g", 5)]


def test_annotated_alignments(spark, tmp_path):
    from varispan.operators import search as S
    from varispan.sources.fasta import read_sequences

    (tmp_path / "f.fa").write_text(">c1\nTTACGGTTTT\n")
    (tmp_path / "g.fa").write_text(">c2\nAACCAT\n")
    (tmp_path / "a.txt").write_text(">1\nACGG : f\n{--}\n.T.. : g(2)\n>2\nTTTT : f\n")
    lines = S.read_alignments(spark, str(tmp_path / "a.txt"))
    assert sorted((r.alignment, r.line, r.query, r.label) for r in lines.collect()) == [(1, 0, "ACGG", "f"), (1, 1, "ATGG", "g"), (2, 0, "TTTT", "f")]
    out = S.annotate(lines, read_sequences(spark, [str(tmp_path / "f.fa"), str(tmp_path / "g.fa")]), 1)
    assert [r.line for r in out.orderBy("alignment", "n").collect()] == [
        "# Alignment 1", "TACGGT | f.fa | chrom=c1 | start=2 | end=8 | strand=forward", "ATG.T | g.fa | chrom=c2 | start=2 | end=8 | strand=reverse",
        "# Alignment 2", "GTTTT | f.fa | chrom=c1 | start=6 | end=12 | strand=forward",
    ]


def test_standard_input(spark, tmp_path):
    import gzip
    import io

    from varispan.sources.fasta import read_sequences
    from varispan.sources.stdin import path_of

    for data in (b">a\nACGT\nAC\n", gzip.compress(b">a\nACGT\nAC\n")):
        assert [r.seq for r in read_sequences(spark, path_of(spark, "-", io.BytesIO(data))).collect()] == ["ACGTAC"]
    assert path_of(spark, "x.fa") == "x.fa"
