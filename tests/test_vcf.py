import random

import numpy as np
import pytest

from varispan.operators import regions as R
from varispan.operators import variants as V
from varispan.operators import windows as W
from varispan.plans import vcf_plan
from varispan.sources import groups as G
from varispan.sources import vcf

FORMAT = "GT:AD:DP:GQ"


def genome(n=2000, seed=3):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def call(n_alleles, allele, dp=20, gq=50):
    ad = [0] * n_alleles
    ad[allele] = dp
    return f"{allele}/{allele}:{','.join(map(str, ad))}:{dp}:{gq}"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Two chromosomes; a clean diagnostic SNP of group A on chr1 at 1000, an unconserved one at 1500, an indel on chr2."""
    d = tmp_path_factory.mktemp("vcf")
    ref = {"chr1": genome(), "chr2": genome(seed=4)}
    (d / "ref.fa").write_text("".join(f">{c} note\n{s[:900]}\n{s[900:]}\n" for c, s in ref.items()))
    samples = [f"{g}{i}" for g in "ABC" for i in range(4)]
    (d / "meta.csv").write_text("sample_id,group\n" + "".join(f"{s},{s[0]}\n" for s in samples))
    alt = {"A": "C", "C": "G", "G": "T", "T": "A"}
    lines = ["##x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(samples)]

    def add(chrom, pos, ref_allele, alts, allele_of, qual="60", info="MQ=60", **kw):
        lines.append("\t".join([chrom, str(pos), ".", ref_allele, alts, qual, ".", info, FORMAT, *(call(1 + alts.count(",") + 1, allele_of(s), **kw) for s in samples)]))

    c1, c2 = ref["chr1"], ref["chr2"]
    far = lambda s: 0
    for p in (700, 1300):
        add("chr1", p, c1[p - 1], alt[c1[p - 1]], far)
    add("chr1", 1000, c1[999], alt[c1[999]], lambda s: int(s[0] == "A"))
    add("chr1", 1500, c1[1499], alt[c1[1499]], lambda s: int(s in ("A0", "B0")))
    add("chr1", 1700, c1[1699], alt[c1[1699]], lambda s: int(s[0] == "B"), qual=".", info="DP=3")
    add("chr2", 700, c2[699], alt[c2[699]], far)
    add("chr2", 1000, c2[999:1002], c2[999], lambda s: int(s[0] == "C"))
    add("chr2", 1300, c2[1299], alt[c2[1299]], far)
    head, body = lines[:2], sorted(lines[2:], key=lambda x: (x.split("\t")[0], int(x.split("\t")[1])))
    (d / "v.vcf").write_text("\n".join(head + body) + "\n")
    return d, ref


def test_calls_and_missing_values(spark, files):
    d, _ = files
    rows = vcf.read_calls(spark, str(d / "v.vcf"))
    assert rows.count() == 8 * 12
    assert vcf.sample_names(spark, str(d / "v.vcf"))[:2] == ["A0", "A1"]
    bare = rows.where("chrom = 'chr1' and pos = 1700").first()
    assert bare.qual is None and bare.mq is None and bare.dp == 20
    assert vcf.read_calls(spark, str(d / "v.vcf"), ["chr1"], (900, 1100)).select("pos").distinct().collect()[0].pos == 1000


def test_grouped_sites(spark, files):
    d, ref = files
    members = G.read_groups(spark, str(d / "meta.csv"))
    rows = {(r.chrom, r.pos, r.grp): r for r in V.group_variants(vcf.read_calls(spark, str(d / "v.vcf")), members).collect()}
    assert len(rows) == 8 * 3
    a = rows["chr1", 1000, "A"]
    assert a.sample_count == 4 and a.diagnostic == a.conserved and a.diagnostic != ref["chr1"][999]
    # what B and C share is not diagnostic for either
    assert rows["chr1", 1000, "B"].diagnostic is None and rows["chr1", 1000, "B"].conserved == ref["chr1"][999]
    assert rows["chr1", 1500, "A"].conserved is None
    # unknown quality fails the filters
    assert rows["chr1", 1700, "B"].conserved is None


def test_failing_group_silences_all(spark):
    """A group without passing samples has no alleles, is not conserved, and leaves no group diagnostic."""
    names = [("s%d" % i, g) for i, g in enumerate("AAABBBCCC")]
    members = spark.createDataFrame(names, "sample string, grp string")
    schema = "chrom string, pos int, site_idx long, ref string, alleles array<string>, rlen int, qual double, mq double, sample string, gt array<string>, dp int, gq int, ad array<int>"
    data = [("c", 5, 0, "T", ["T", "C"], 1, 50.0, 50.0, s, None, None if g == "C" else 20, 60, [20, 0] if g == "A" else [None, 20]) for s, g in names]
    rows = {r.grp: r for r in V.group_variants(spark.createDataFrame(data, schema), members).collect()}
    assert {g: r.allele_counts for g, r in rows.items()} == {"A": {"T": 3}, "B": {"C": 3}, "C": {}}
    assert [rows[g].conserved for g in "ABC"] == ["T", "C", None]
    assert all(r.diagnostic is None for r in rows.values())
    assert rows["C"].missing == ["s6", "s7", "s8"]


def test_group_errors(spark, files):
    d, _ = files
    with pytest.raises(ValueError, match="unknown"):
        G.read_groups(spark, str(d / "meta.csv"), groups=["A", "Z"])
    with pytest.raises(ValueError, match="under 9"):
        G.read_groups(spark, str(d / "meta.csv"), min_samples=9)
    members = G.read_groups(spark, str(d / "meta.csv"))
    with pytest.raises(ValueError, match="not in the VCF"):
        G.check_samples(members, ["A0"])
    assert G.check_samples(members, ["A0"], force=True).count() == 1


def test_regions_end_to_end(spark, files):
    d, ref = files
    got = vcf_plan.search(spark, str(d / "meta.csv"), str(d / "ref.fa"), str(d / "v.vcf"), options=R.RegionOptions(align=True)).collect()
    by = {(r.chrom, r.pos, r.group): r for r in got}
    assert by["chr1", 1500, "A"].type == "Undiagnostic"
    hit = by["chr1", 1000, "A"]
    assert hit.type in ("Diagnostic", "No primers")
    for r in got:
        if r.type == "Diagnostic":
            # the seven stretches tile the region, and the target sequence differs from the reference in n_diag bases
            whole = "".join(r[c] for c in R.CSV[14:21])
            low = ref[r.chrom][r.reg_from - 1 : r.reg_to].lower()
            assert R.edit_distance(whole.lower(), low) <= r.n_diag + 2
            assert r.fwd_from < r.diag_from <= r.diag_to < r.rev_to
            assert r.region_id == f"{r.chrom}:{r.fwd_from}-{r.rev_to}"
            assert "is diagnostic for" in r.alignment and "Primer statistics" in r.alignment
    assert any(r.type == "Diagnostic" for r in got)
    counts = {(r.type, r.group): r.n for r in R.type_counts(spark.createDataFrame([(r.type, r.group) for r in got], "type string, `group` string")).collect()}
    assert sum(counts.values()) == len(got)


def test_positions_choose_windows_not_neighbours(spark, files):
    """A range that holds one window alone tells that window as the whole search does."""
    d, _ = files
    args = (spark, str(d / "meta.csv"), str(d / "ref.fa"), str(d / "v.vcf"))
    whole = {(r.chrom, r.pos, r.group): (r.type, r.region_id) for r in vcf_plan.search(*args).collect()}
    part = {(r.chrom, r.pos, r.group): (r.type, r.region_id) for r in vcf_plan.search(*args, pos=(990, 1005)).collect()}
    assert any(kind == "Diagnostic" for kind, _ in part.values())
    assert part == {k: v for k, v in whole.items() if 990 <= k[1] <= 1005}


def test_far_windows_need_no_python(spark, files):
    """What the plan tells of windows far from diagnostic sites is what the classifier says of them."""
    d, _ = files
    args = (spark, str(d / "meta.csv"), str(d / "ref.fa"), str(d / "v.vcf"))
    key = lambda rows: sorted((r.chrom, r.pos, r.group, r.type) for r in rows)
    near = R.RegionOptions(tile=1000, halo=150)
    everything = vcf_plan.search(*args).collect()
    assert [k for k in key(vcf_plan.search(*args, options=near).collect()) if k[3] == "Undiagnostic"] == [k for k in key(everything) if k[3] == "Undiagnostic"]


def test_tiles_agree(spark, files):
    d, _ = files
    args = (spark, str(d / "meta.csv"), str(d / "ref.fa"), str(d / "v.vcf"))
    key = lambda rows: sorted((r.chrom, r.pos, r.group, r.type, r.region_id or "") for r in rows)
    assert key(vcf_plan.search(*args).collect()) == key(vcf_plan.search(*args, options=R.RegionOptions(tile=700, halo=690)).collect())


def make(pos, ref_len, group_len, conserved="A", diagnostic=None):
    return W.Variant("c", pos, "A" * ref_len, ref_len, {"g": ({"A" * group_len: 3}, conserved, diagnostic, []), "h": ({"T": 3}, "T", None, [])})


def test_window_fold_is_not_a_running_maximum():
    spans = [(1, 8, 1), (2, 2, 5), (3, 1, 4), (5, 1, 4), (5, 2, 1), (8, 8, 1)]
    assert W.window_starts(spans, 9) == [0, 0, 0, 2, 2, 3]


def test_unit_windows_equal_fold(spark):
    rng = random.Random(1)
    pos = sorted(rng.sample(range(1, 200), 60))
    rows = [("c", "g", p, "A" if rng.random() < 0.8 else None, "A" if rng.random() < 0.3 else None) for p in pos]
    got = {r.pos: r for r in W.unit_windows(spark.createDataFrame(rows, "chrom string, grp string, pos int, conserved string, diagnostic string"), 9).collect()}
    starts = W.window_starts([(p - 1, 1, 1) for p in pos], 9)
    for e, p in enumerate(pos):
        part = rows[starts[e] : e + 1]
        assert (got[p].from_pos, got[p].n_vars) == (part[0][2], len(part))
        assert got[p].n_diagnostic == sum(r[4] is not None for r in part)


def track(variants, width=9):
    return W.Track("g", variants, width)


def test_border_stops_at_the_first_site_that_differs():
    rng = random.Random(2)
    for _ in range(100):
        gaps = [rng.randint(1, 6) for _ in range(rng.randint(0, 6))]
        fixed = [rng.random() < 0.7 for _ in gaps]
        edge = 100
        for side in (1, -1):
            places = [edge + side * sum(gaps[: i + 1]) for i in range(len(gaps))]
            sites = sorted([make(edge, 1, 1), *(make(p, 1, 1, "A" if f else None) for p, f in zip(places, fixed))], key=lambda v: v.pos)
            at = next(i for i, v in enumerate(sites) if v.pos == edge)
            near = np.arange(at + 1, len(sites)) if side > 0 else np.arange(at - 1, -1, -1)
            bad = [abs(p - edge) - 1 for p, f in zip(places, fixed) if not f]
            reach = [abs(p - edge) for p in places]
            want = 14 if any(d >= 14 and (not bad or d - 1 <= bad[0]) for d in reach) else bad[0] if bad else max(reach, default=0)
            assert track(sites).border(at, near, 14) == (want, want)


def test_border_counts_group_bases():
    # an insertion of two at 105, then a site that differs at 110: four bases, the insertion and four more
    sites = [make(100, 1, 1), make(105, 1, 3), make(110, 1, 1, None)]
    assert track(sites).border(0, np.array([1, 2]), 50) == (9, 11)
    assert track(sites).border(0, np.array([1, 2]), 8) == (6, 8)
    # the edge's own deletion counts on the side of higher places only
    sites = [make(90, 1, 1, None), make(100, 3, 1), make(110, 1, 1, None)]
    assert track(sites).border(1, np.array([2]), 50) == (9, 7)
    assert track(sites).border(1, np.array([0]), 50) == (9, 9)


def test_places_past_insertions_and_deletions():
    rng = random.Random(5)
    for _ in range(100):
        at, sites = 0, []
        for _ in range(6):
            at += rng.randint(4, 9)
            sites.append(make(at + 1, rng.randint(1, 3), rng.randint(1, 4)))
        origin, offset = rng.randint(0, 20), rng.randint(0, 60)
        begin, shift = [], 0
        for v in sites:
            if v.start >= origin:
                begin.append((v.start - origin + shift, v.shift("g")))
                shift += v.shift("g")
        assert track(sites).place(slice(0, 6), origin, offset) == origin + offset - sum(s for b, s in begin if b < offset)


def test_sequence_splices_and_marks():
    v = make(4, 1, 2, diagnostic="AA")
    assert "".join(R.sequence("ACGTACGT", 0, [v], 1, 5, "g")) == "cgAAac"
    # an overlapping one: the site that ends first has the say
    assert "".join(R.sequence("ACGTACGTAC", 0, [make(2, 4, 4), make(4, 1, 1, diagnostic="A")], 0, 9, "g")) == "aaaAaCGTAC".lower()[:3] + "A" + "acgtac"
    assert R.sequence("ACGTACGT", 0, [v], 1, 5, "g", True) == ["c", "g", "<AA3>", "a", "c"]
    assert "".join(R.sequence("ACGTACGT", 0, [v], 1, 5, None)) == "cgAac"
    assert "".join(R.sequence("ACGTACGT", 0, [v], 0, 1, "g")) == "ac"


def test_early_types(spark):
    v = [make(10, 1, 1, "A", "A"), make(12, 1, 1, "A"), make(40, 1, 1, None, None)]
    c = R.Classifier("g", v, "A" * 100, 0, R.RegionOptions(), {"g": 3, "h": 3})
    assert c.verdict(1)[0] == "Misplaced"
    assert c.verdict(2)[0] == "Undiagnostic"
    lone = R.Classifier("g", v[:1], "A" * 100, 0, R.RegionOptions(), {"g": 3, "h": 3})
    # no neighbours: the conserved border counts as nothing
    assert lone.verdict(0)[0] == "Unconserved"
