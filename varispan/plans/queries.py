"""Operators over the driver's tables, each beside the SQL that gives the same rows.

Sequences are the ACGT letters of ``documents.text`` labelled by language; variant calls come from ``lineitem`` and ``part``.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions import thermo as T
from ..operators import conserve as C
from ..operators import primers as P
from ..operators import regions as R
from ..operators import search as S
from ..operators import variants as V
from ..operators import windows as W
from ..operators.kmers import KmerSpec, kmers

INGROUP = ["en"]
SIZES = (5, 1, 2)
FIND = ["ACGTA", "TTGCA"]
STEP = 40
BLOCK = 4096
FILTERS = V.VariantFilters(min_samples=3, min_samp_prop=0.7, min_reads=5, min_geno_qual=30)


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark, sf_dir: str, keep: str = "ACGTacgt", upper: bool = True) -> DataFrame:
    seq = F.regexp_replace("text", f"[^{keep}]+", "")
    return read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"), F.col("lang").alias("file"), (F.upper(seq) if upper else seq).alias("seq"))


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy("kmer").agg(F.count("*").alias("n"))


def _k(spec: KmerSpec, keep: str = "ACGTacgt", upper: bool = True):
    return lambda spark, d: _counted(kmers(sequences(spark, d, keep, upper).select("seq"), spec))


def k08(spark, d):
    found = _counted(kmers(read(spark, d, "documents").select(F.upper(F.regexp_replace("text", "[^ACGTRYSWKMBDHVNacgtryswkmbdhvn]", "")).alias("seq")), KmerSpec(k=3)))
    return kmers(found, KmerSpec(expand_iupac=True), "kmer").groupBy("kmer").agg(F.sum("n").alias("n"))


def k11(spark, d):
    rna = sequences(spark, d).select(A.to_rna(F.col("seq")).alias("seq"))
    return _counted(kmers(rna, KmerSpec(k=6, rna=True, canonicals=True)))


def k12(spark, d):
    found = _counted(kmers(sequences(spark, d).select("seq"), KmerSpec(k=6, split=(2, -2))))
    f = F.split("kmer", ",")
    from pyspark.sql import Window

    # at most 4 ** 6 distinct rows are ranked
    return found.select("kmer", F.row_number().over(Window.orderBy(F.get(f, F.lit(0)), F.get(f, F.lit(2)), "kmer")).cast("long").alias("place"))


def amplicon_rows(spark, d) -> DataFrame:
    return C.amplicon_counts(sequences(spark, d), *SIZES)


def alignments(spark, d) -> DataFrame:
    # one file per label of the table
    files = [r.lang for r in read(spark, d, "documents").select("lang").distinct().where("lang is not null").orderBy("lang").collect()]
    return C.conserved(amplicon_rows(spark, d), files)


def j01(spark, d):
    return alignments(spark, d).select("l", "r", F.size("amplicons").cast("long").alias("n_amplicons"))


def j02(spark, d):
    rows = amplicon_rows(spark, d).drop("file")
    return C.intersect(rows.where("label = 'de'"), rows.where("label = 'es'"))


def j04(spark, d):
    rows = amplicon_rows(spark, d).drop("file")
    return C.merge_equal(C.merge(rows.where("label = 'fr'"), rows.where("label in ('fr', 'es')")))


def j14(spark, d, query: str = "ACGT"):
    seqs = sequences(spark, d)
    hits = F.array(*[F.struct(F.lit(s).alias("strand"), A.occurrences(F.col("seq"), F.lit(q)).alias("at")) for s, q in (("+", query), ("-", query[::-1].translate(str.maketrans("ACGT", "TGCA"))))])
    return seqs.select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.strand", F.explode("h.at").alias("start"))


def a02(spark, d):
    return alignments(spark, d).select("l", "r", F.explode("amplicons").alias("a")).select("l", "a.d", "r", C.label_text(F.col("a.labels")).alias("labels"))


def _places(col):
    return F.array_join(F.transform(col, lambda p: p.cast("string")), ",")


def a04(spark, d):
    return alignments(spark, d).select("l", "r", _places(C.variable_columns(F.col("amplicons"))).alias("places"))


def a05(spark, d):
    return alignments(spark, d).select("l", "r", _places(C.unique_columns(F.col("amplicons"), INGROUP)).alias("places"))


def a06(spark, d):
    return C.diagnostic(alignments(spark, d), INGROUP).select("l", "r", F.size("amplicons").cast("long").alias("n_amplicons"))


def a07(spark, d):
    return C.csv_rows(alignments(spark, d), None).select("left_seq", "diag_seq", "right_seq")


def a08(spark, d):
    return C.csv_rows(C.diagnostic(alignments(spark, d), INGROUP), INGROUP).select("left_seq", "diag_seq", "right_seq")


def t02(spark, d):
    left, diag, _ = SIZES
    return alignments(spark, d).select("l", "r", C.brackets(F.col("amplicons"), left, diag, INGROUP).alias("bracket"))


def t03(spark, d):
    return alignments(spark, d).select("l", "r", F.array_join(C.dotted(F.col("l"), F.col("amplicons"), F.col("r")), "|").alias("text"))


def t08(spark, d):
    """Every place of two sequences on either strand, with two bases of padding."""
    seqs = sequences(spark, d).select(F.col("doc_id").cast("string").alias("file"), "label", F.col("doc_id").cast("string").alias("seq_id"), "seq")
    wanted = spark.createDataFrame([(q,) for q in FIND], "query string")
    return S.find(seqs, wanted, 2).select(F.col("seq_id").cast("long").alias("doc_id"), "query", "strand", F.col("start").cast("long").alias("first"), F.col("end").cast("long").alias("last"), "sequence")


def a17(spark, d):
    return alignments(spark, d).select("l", "r", F.levenshtein("l", F.concat("r", F.get("amplicons", F.lit(0))["d"])).cast("long").alias("edits"))


# --- variants ---

_GT = """
with b as (
  select l_partkey p, l_suppkey % 12 s, cast(max(l_quantity) as int) dp, cast(20 + 5 * sum(l_linenumber) as int) gq, max(cast(l_orderkey % 97 = 0 as int)) noise
  from lineitem group by 1, 2)
select concat('chr', cast(p % 4 as string)) chrom, cast((p {div} 4) * 2 + 1 as int) pos, concat('s', cast(s as string)) sample, concat('g', cast(s % 3 as string)) grp, dp, gq,
  cast(p_size + 20 as double) mq, cast(p_size as double) qual, substring('ACGT', cast(p % 4 + 1 as int), 1) ref, substring('ACGT', cast((p + 1 + p % 3) % 4 + 1 as int), 1) alt,
  case when noise = 1 then 1 when p % 5 = 0 and s % 3 = (p {div} 5) % 3 then 1 else 0 end gt_alt
from b join part on p = p_partkey"""


def gt(spark, d) -> DataFrame:
    names = {}
    for t in ("lineitem", "part"):
        names[t] = read(spark, d, t)
    return spark.sql(_GT.format(div="div").replace("from lineitem", "from {lineitem}").replace("join part", "join {part}"), **names)


def call_rows(spark, d) -> DataFrame:
    none = F.lit(0)
    return gt(spark, d).select(
        "chrom", "pos", F.lit(0).cast("long").alias("site_idx"), "ref", F.array("ref", "alt").alias("alleles"), F.lit(1).alias("rlen"), "qual", "mq", "sample",
        F.array(F.when(F.col("gt_alt") == 1, F.col("alt")).otherwise(F.col("ref"))).alias("gt"), "dp", "gq",
        F.when(F.col("gt_alt") == 1, F.array(none, F.col("dp"))).otherwise(F.array(F.col("dp"), none)).alias("ad"),
    )


def grouped(spark, d) -> DataFrame:
    # samples and their groups are few, as in a file's header, and are told once: else each table made of them reads the calls again
    members = gt(spark, d).select("sample", "grp").distinct().collect()
    names = [r.sample for r in members if r.sample is not None]
    return V.group_variants(call_rows(spark, d), spark.createDataFrame(members, "sample string, grp string"), FILTERS, names)


def j09(spark, d):
    rows = call_rows(spark, d).join(gt(spark, d).select("sample", "grp").distinct(), "sample")
    return rows.groupBy("chrom", "grp").agg(F.count("*").alias("n_calls"), F.count_distinct("sample").alias("n_samples"))


def j10(spark, d):
    """Sample and site pairs that no call speaks for, among samples of group g0."""
    rows = gt(spark, d)
    want = rows.select("chrom", "pos").distinct().join(rows.where("grp = 'g0'").select("sample").distinct(), how="cross")
    return want.join(rows, ["chrom", "pos", "sample"], "left_anti").groupBy("chrom", "sample").agg(F.count("*").alias("n_missing"))


def a09(spark, d):
    return grouped(spark, d).select("chrom", "pos", "grp", "sample_count", "group_size")


def _counts_text():
    return F.array_join(F.transform(F.array_sort(F.map_keys("allele_counts")), lambda a: F.concat(a, F.lit("="), F.element_at("allele_counts", a).cast("string"))), ",")


def a11(spark, d):
    return grouped(spark, d).select("chrom", "pos", "grp", _counts_text().alias("counts"))


def a13(spark, d):
    return grouped(spark, d).where("conserved is not null").select("chrom", "pos", "grp", "conserved")


def a14(spark, d):
    return grouped(spark, d).where("diagnostic is not null").select("chrom", "pos", "grp", "diagnostic")


def a15(spark, d):
    return grouped(spark, d).select("chrom", "pos", "grp", V.longest_allele(F.col("allele_counts"), F.col("ref")).cast("long").alias("longest"))


def a16(spark, d):
    rows = grouped(spark, d)
    sites = rows.groupBy("chrom", "pos").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("missing")))), ";").alias("missing"), F.count("diagnostic").alias("n"))
    return sites.where("n > 0").select("chrom", "pos", "missing")


def w01(spark, d):
    return W.unit_windows(grouped(spark, d), 9).select("chrom", "grp", "pos", "n_vars", "n_diagnostic", "n_conserved", "from_pos")


def r01(spark, d):
    return W.early_type(W.unit_windows(grouped(spark, d), 9)).select("chrom", "grp", "pos", "type")


def a10(spark, d):
    return r01(spark, d).groupBy("type", "grp").agg(F.count("*").alias("n"))


def w06(spark, d):
    from pyspark.sql import Window

    upto = Window.partitionBy("chrom", "grp").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return grouped(spark, d).select("chrom", "grp", "pos", F.sum("sample_count").over(upto).alias("running"))


def q01(spark, d):
    return V.group_sequences(grouped(spark, d))


def r04(spark, d):
    """Verdicts on windows of sites STEP bases apart, from calls to primer design; found regions with and without primers count as one kind."""
    rows = grouped(spark, d).withColumn("pos", (F.expr("(pos - 1) div 2") * STEP + 1).cast("int")).select(*R.READ).persist(StorageLevel.MEMORY_AND_DISK)
    longest = rows.groupBy("chrom").agg(F.max("pos").alias("n"))
    # made in blocks on all cores: the letters of whole chromosomes took a single task 53 s for 48 million bases
    runs = longest.select("chrom", F.expr("n div 32").alias("n")).select("chrom", "n", F.explode(F.sequence(F.lit(0), "n", F.lit(BLOCK))).alias("at")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chrom", "at")
    letters = F.array_join(F.transform(F.sequence("at", F.least("n", F.col("at") + (BLOCK - 1))), lambda i: F.md5(F.concat("chrom", i.cast("string")))), "")
    blocks = runs.select("chrom", F.struct("at", F.translate(letters, "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq")).alias("x"))
    reference = blocks.groupBy("chrom").agg(F.array_join(F.array_sort(F.collect_list("x"))["seq"], "").alias("seq"))
    found = R.find_regions(rows, reference, R.RegionOptions(tile=8000, halo=2000))
    return found.select("chrom", F.col("group").alias("grp"), F.col("pos").cast("long").alias("pos"), F.when(F.col("type").isin("Diagnostic", "No primers"), "Region").otherwise(F.col("type")).alias("type"))


def p01_gc(spark, d):
    return sequences(spark, d).where("length(seq) > 0").select("doc_id", F.round(A.gc_percent(F.col("seq")), 6).alias("gc"))


def p01_tm(spark, d):
    found = _counted(kmers(sequences(spark, d).select("seq"), KmerSpec(k=8)))
    return found.select("kmer", F.round(T.tm_column(F.col("kmer")), 6).alias("tm"), T.end_stability_column(F.col("kmer")).alias("end_stability"))


def p01_pair(spark, d):
    """Usable 20-mers by document: within temperature and GC limits, a G or C at the end, no run of five."""
    found = P.usable_kmers(sequences(spark, d).select("doc_id", "seq"), 20, P.PrimerOptions(max_end_gc=5))
    return found.groupBy("doc_id").agg(F.sum("n").alias("n"), F.round(F.min("least_penalty"), 6).alias("least_penalty"))


def flagship(spark, d):
    return a08(spark, d)


QUERIES = {
    "k01_kmers": _k(KmerSpec(k=6)),
    "k02_multi_k": _k(KmerSpec(k=(4, 6))),
    "k03_omitsoft": _k(KmerSpec(k=3, omit_soft=True), "ACGTNacgtn", False),
    "k04_mapsoft": _k(KmerSpec(k=6, map_soft=True), upper=False),
    "k05_complements": _k(KmerSpec(k=6, complements=True)),
    "k06_allow": _k(KmerSpec(k=4, allow="ACgt"), "ACGTNacgtn", False),
    "k07_disallow": _k(KmerSpec(k=4, disallow="Nn"), "ACGTNacgtn", False),
    "k08_expand_iupac": k08,
    "k09_canonical": _k(KmerSpec(k=6, canonicals=True)),
    "k10_split": _k(KmerSpec(k=6, split=(2, -1))),
    "k11_rna": k11,
    "k12_sorted": k12,
    "j01_conserved_keys": j01,
    "j02_intersect": j02,
    "j04_merge": j04,
    "j14_grep": j14,
    "a02_labels": a02,
    "a04_variable_cols": a04,
    "a05_unique_cols": a05,
    "a06_filter": a06,
    "a07_consensus": a07,
    "a08_ingroup_consensus": a08,
    "a17_edit_distance": a17,
    "t02_bracket": t02,
    "t03_dots": t03,
    "t08_find": t08,
    "j09_groups": j09,
    "j10_anti": j10,
    "a09_sample_counts": a09,
    "a11_alleles": a11,
    "a13_conserved": a13,
    "a14_diagnostic": a14,
    "a15_lens": a15,
    "a16_missing": a16,
    "w01_window": w01,
    "w06_cumulative": w06,
    "r01_early_types": r01,
    "r04_regions": r04,
    "a10_region_types": a10,
    "q01_sequence": q01,
    "p01_gc": p01_gc,
    "p01_tm": p01_tm,
    "p01_pair": p01_pair,
}

# --- SQL ---


def _sql_kmers(k: int, keep: str = "ACGTacgt", upper: bool = True, extra: str = "") -> str:
    seq = f"regexp_replace(text, '[^{keep}]', '', 'g')"
    seq = f"upper({seq})" if upper else seq
    return f"select doc_id, lang, unnest(list_transform(range(1, length(seq) - {k} + 2), lambda i: substring(seq, i::int, {k}))) as kmer from (select doc_id, lang, {seq} as seq from documents) where length(seq) >= {k} {extra}"


def _sql_count(rows: str, where: str = "") -> str:
    return f"select kmer, count(*) as n from ({rows}) {where} group by 1"


_RC = "reverse(translate(kmer, 'ACGT', 'TGCA'))"
_CODES = ", ".join(f"('{k}', '{b}')" for k, v in A.BASES.items() for b in v)
_L, _D, _R = SIZES
_AMPLICONS = f"""
k as ({_sql_kmers(_L + _D + _R)}),
both_strands as (select lang, kmer from k union all select lang, {_RC} from k),
cnt as (select lang as label, substring(kmer, 1, {_L}) as l, substring(kmer, {_L + 1}, {_D}) as d, substring(kmer, {_L + _D + 1}, {_R}) as r, count(*) as n from both_strands group by all),
keys as (select l, r from cnt group by 1, 2 having count(distinct label) = (select count(distinct lang) from documents)),
amp as (select cnt.* from cnt join keys using (l, r)),
col as (select l, r, count(distinct d) as bases, count(distinct d) filter (label = 'en') as ins, bool_or(shared) as shared from (select *, bool_or(label = 'en') over w and bool_or(label <> 'en') over w as shared from amp window w as (partition by l, r, d)) group by 1, 2)"""
_SET = "string_agg(distinct {d}, '' order by {d})"
_IUPAC = "(values " + ", ".join(f"('{''.join(v)}', '{k}')" for k, v in A.BASES.items()) + ") as iupac(bases, code)"


def _gt_sql() -> str:
    return _GT.format(div="//").replace("as string", "as varchar")


_CELLS = f"""
gt as ({_gt_sql()}),
groups as (select grp, count(distinct sample) as group_size from gt group by 1),
sites as (select chrom, pos, any_value(ref) as ref, any_value(alt) as alt, any_value(mq) as mq, any_value(qual) as qual from gt group by 1, 2),
calls as (select *, dp >= 5 and gq >= 30 as ok from gt),
part_cells as (select chrom, pos, grp, count(*) filter (ok) as sample_count, list(sample order by sample) filter (not ok) as missing, count(*) filter (ok and gt_alt = 0) as nref, count(*) filter (ok and gt_alt = 1) as nalt from calls group by 1, 2, 3),
cells as (select s.*, g.grp, g.group_size, coalesce(sample_count, 0) as sample_count, missing, coalesce(nref, 0) as nref, coalesce(nalt, 0) as nalt from sites s cross join groups g left join part_cells p on p.chrom = s.chrom and p.pos = s.pos and p.grp = g.grp),
facts as (select *, sample_count >= 3 and sample_count / group_size >= 0.7 as enough, mq >= 40 and qual >= 10 as usable, case when nref > 0 and nalt > 0 then null when nref > 0 then ref when nalt > 0 then alt end as single from cells),
v as (
  select *, case when usable and enough then single end as conserved,
    case when usable and min(enough::int) over w = 1 and single is not null and (case when single = ref then sum((nref > 0)::int) over w else sum((nalt > 0)::int) over w end) = 1 then single end as diagnostic
  from facts window w as (partition by chrom, pos)),
win as (
  select chrom, grp, pos, count(*) over f as n_vars, count(diagnostic) over f as n_diagnostic, count(conserved) over f as n_conserved, diagnostic is not null as last_diagnostic, min(pos) over f as from_pos
  from v window f as (partition by chrom, grp order by pos range between 8 preceding and current row)),
types as (select chrom, grp, pos, case when n_diagnostic < 1 then 'Undiagnostic' when n_conserved < n_vars then 'Unconserved' when n_diagnostic = 1 and not last_diagnostic then 'Misplaced' else 'Candidate' end as type from win)"""


def _cells(select: str) -> str:
    return f"with {_CELLS.lstrip()} {select}"


def _amps(select: str) -> str:
    return f"with {_AMPLICONS.lstrip()} {select}"


def _sql_map(table: dict, i: int) -> str:
    return "map([" + ", ".join(f"'{k}'" for k in table) + "], [" + ", ".join(f"{(v[i] if isinstance(v, tuple) else v)!r}::double" for v in table.values()) + "])"


def _sql_tm(k: int) -> str:
    def stacks(i):
        return f"list_sum(list_transform(range(1, {k}), lambda i: {_sql_map(T.STACKS, i)}[substring(kmer, i::int, 2)])) + {_sql_map(T._END, i)}[substring(kmer, 1, 1)] + {_sql_map(T._END, i)}[substring(kmer, {k}, 1)]"

    same = f"{_RC} = kmer"
    return f"(1000 * ({stacks(0)}) / ({stacks(1)} + case when {same} then -1.4 else 0 end + 0.368 * {k - 1} * ln({T.SODIUM!r}) + 1.987 * ln(case when {same} then 5e-8 else 1.25e-8 end)) - 273.15)"


_STAB = f"round(list_sum(list_transform(range(4, 8), lambda i: {_sql_map(T._STABILITY, 0)}[substring(kmer, i::int, 2)])) - {_sql_map(T._END_STABILITY, 0)}[substring(kmer, 4, 1)] - {_sql_map(T._END_STABILITY, 0)}[substring(kmer, 8, 1)], 2)"
_FAR = """case when {0}1 is null then 0 when {0}1 >= 150 then 150 when not {0}c1 then {0}1 - 1 when {0}2 is null then {0}1 when {0}2 >= 150 then 150 when not {0}c2 then {0}2 - 1
  when {0}3 is null then {0}2 when {0}3 >= 150 then 150 when not {0}c3 then {0}3 - 1 when {0}4 is null then {0}3 else 150 end"""
_NEAR = ", ".join(f"abs({f}(pos, {i}) over w - pos) as {n}{i}, {f}(conserved is not null, {i}) over w as {n}c{i}" for f, n in (("lead", "u"), ("lag", "d")) for i in (1, 2, 3, 4))
_UNIQUE = "case when shared then '' else '0' end"

SQL = {
    "k01_kmers": _sql_count(_sql_kmers(6)),
    "k02_multi_k": _sql_count(f"{_sql_kmers(4)} union all {_sql_kmers(6)}"),
    "k03_omitsoft": _sql_count(_sql_kmers(3, "ACGTNacgtn", False), "where kmer = upper(kmer) and kmer <> lower(kmer)"),
    "k04_mapsoft": f"select upper(kmer) as kmer, count(*) as n from ({_sql_kmers(6, upper=False)}) group by 1",
    "k05_complements": _sql_count(f"select kmer from ({_sql_kmers(6)}) union all select {_RC} from ({_sql_kmers(6)})"),
    "k06_allow": _sql_count(_sql_kmers(4, "ACGTNacgtn", False), "where not regexp_matches(kmer, '[^ACgt]')"),
    "k07_disallow": _sql_count(_sql_kmers(4, "ACGTNacgtn", False), "where not regexp_matches(kmer, '[Nn]')"),
    "k08_expand_iupac": f"with c(code, base) as (values {_CODES}), k as (select kmer, count(*) as n from (select unnest(list_transform(range(1, length(seq) - 1), lambda i: substring(seq, i::int, 3))) as kmer from (select upper(regexp_replace(text, '[^ACGTRYSWKMBDHVNacgtryswkmbdhvn]', '', 'g')) as seq from documents) where length(seq) >= 3) group by 1) select a.base || b.base || c3.base as kmer, sum(n)::bigint as n from k join c a on a.code = substring(kmer, 1, 1) join c b on b.code = substring(kmer, 2, 1) join c c3 on c3.code = substring(kmer, 3, 1) group by 1",
    "k09_canonical": f"select least(kmer, {_RC}) as kmer, count(*) as n from ({_sql_kmers(6)}) group by 1",
    "k10_split": f"select substring(kmer, 1, 2) || ',' || substring(kmer, 3, 3) || ',' || substring(kmer, 6, 1) as kmer, count(*) as n from ({_sql_kmers(6)}) group by 1",
    "k11_rna": f"select translate(least(kmer, {_RC}), 'T', 'U') as kmer, count(*) as n from ({_sql_kmers(6)}) group by 1",
    "k12_sorted": f"select kmer, row_number() over (order by split_part(kmer, ',', 1), split_part(kmer, ',', 3), kmer) as place from (select distinct substring(kmer, 1, 2) || ',' || substring(kmer, 3, 2) || ',' || substring(kmer, 5, 2) as kmer from ({_sql_kmers(6)}))",
    "j01_conserved_keys": _amps("select l, r, count(distinct d) as n_amplicons from amp group by 1, 2"),
    "j02_intersect": _amps("select cnt.l, cnt.d, cnt.r, label, n from cnt where label in ('de', 'es') and exists (select 1 from cnt x where x.l = cnt.l and x.r = cnt.r and x.label = 'de') and exists (select 1 from cnt x where x.l = cnt.l and x.r = cnt.r and x.label = 'es')"),
    "j04_merge": _amps("select l, d, r, label, (case when label = 'fr' then 2 * n else n end)::bigint as n from cnt where label in ('fr', 'es')"),
    "j14_grep": "with s as (select doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) as seq from documents), q(strand, q) as (values ('+', 'ACGT'), ('-', 'ACGT')) select doc_id, strand, unnest(list_filter(range(1, length(seq) - 2), lambda i: substring(seq, i::int, 4) = q))::int as start from s cross join q where length(seq) >= 4",
    "a02_labels": _amps("select l, d, r, string_agg(case when n = 1 then label else label || '(' || n || ')' end, ';' order by label) as labels from amp group by 1, 2, 3"),
    "a04_variable_cols": _amps("select l, r, case when bases > 1 then '0' else '' end as places from col"),
    "a05_unique_cols": _amps(f"select l, r, {_UNIQUE} as places from col"),
    "a06_filter": _amps("select l, r, bases as n_amplicons from col where not shared"),
    "a07_consensus": _amps(f"select l as left_seq, code as diag_seq, r as right_seq from (select l, r, {_SET.format(d='d')} as bases from amp group by 1, 2) join {_IUPAC} using (bases)"),
    "a08_ingroup_consensus": _amps(f"select l as left_seq, code as diag_seq, r as right_seq from (select amp.l, amp.r, {_SET.format(d='d')} as bases from amp join col on amp.l = col.l and amp.r = col.r where not shared and label = 'en' group by 1, 2) join {_IUPAC} using (bases)"),
    "a17_edit_distance": _amps("select l, r, levenshtein(l, r || min(d))::bigint as edits from amp group by 1, 2"),
    "t02_bracket": _amps(f"select l, r, '{' ' * (_L - 1)}{{' || case when not shared then '#' when bases > 1 then '*' else '-' end || '}}' as bracket from col"),
    "t03_dots": _amps(f"select l, r, string_agg(case when d = top then '{'.' * (_L + _D + _R)}' else '{'.' * _L}' || d || '{'.' * _R}' end, '|' order by d) as text from (select distinct l, r, d, min(d) over (partition by l, r) as top from amp) group by 1, 2"),
    "t08_find": f"""with s as (select doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) as seq from documents),
q(query) as (values {', '.join(f"('{q}')" for q in FIND)}),
p as (select query, 'forward' as strand, query as piece from q union all select query, 'reverse', reverse(translate(query, 'ACGT', 'TGCA')) from q),
h as (select doc_id, query, strand, seq, unnest(list_filter(range(1, length(seq) - length(piece) + 2), lambda i: substring(seq, i::int, length(piece)) = piece)) as pos from s cross join p where length(seq) >= length(piece)),
t as (select doc_id, query, strand, greatest(pos - 2, 1) as first, pos + length(query) + 2 as last, substring(seq, greatest(pos - 2, 1)::int, (pos + length(query) + 2 - greatest(pos - 2, 1))::int) as x from h)
select doc_id, query, strand, first::bigint as first, last::bigint as last, case when strand = 'forward' then x else lower(reverse(translate(x, 'ACGT', 'TGCA'))) end as sequence from t""",
    "j09_groups": _cells("select chrom, grp, count(*) as n_calls, count(distinct sample) as n_samples from gt group by 1, 2"),
    "j10_anti": _cells("select chrom, s.sample, count(*) as n_missing from sites cross join (select distinct sample from gt where grp = 'g0') s where not exists (select 1 from gt where gt.chrom = sites.chrom and gt.pos = sites.pos and gt.sample = s.sample) group by 1, 2"),
    "a09_sample_counts": _cells("select chrom, pos, grp, sample_count, group_size from v"),
    "a11_alleles": _cells("select chrom, pos, grp, array_to_string(list_sort(list_filter([case when nref > 0 then ref || '=' || nref end, case when nalt > 0 then alt || '=' || nalt end], lambda x: x is not null)), ',') as counts from v"),
    "a13_conserved": _cells("select chrom, pos, grp, conserved from v where conserved is not null"),
    "a14_diagnostic": _cells("select chrom, pos, grp, diagnostic from v where diagnostic is not null"),
    "a15_lens": _cells("select chrom, pos, grp, 1::bigint as longest from v"),
    "a16_missing": _cells("select chrom, pos, coalesce((select string_agg(distinct sample, ';' order by sample) from calls where not ok and calls.chrom = x.chrom and calls.pos = x.pos), '') as missing from (select chrom, pos from v group by 1, 2 having count(diagnostic) > 0) x"),
    "w01_window": _cells("select chrom, grp, pos, n_vars, n_diagnostic, n_conserved, from_pos from win"),
    "w06_cumulative": _cells("select chrom, grp, pos, sum(sample_count) over (partition by chrom, grp order by pos rows unbounded preceding)::bigint as running from v"),
    "r01_early_types": _cells("select chrom, grp, pos, type from types"),
    "r04_regions": _cells(f"""select chrom, grp, pos, case when not diag then 'Undiagnostic' when u1 is null or d1 is null or {_FAR.format('u')} < 44 or {_FAR.format('d')} < 43 then 'Unconserved' else 'Region' end as type
from (select chrom, grp, pos, diag, {_NEAR} from (select chrom, grp, ((pos - 1) // 2 * {STEP} + 1)::bigint as pos, diagnostic is not null as diag, conserved from v) window w as (partition by chrom, grp order by pos))"""),
    "a10_region_types": _cells("select type, grp, count(*) as n from types group by 1, 2"),
    "q01_sequence": _cells(f"select chrom, grp, string_agg(case when diagnostic is not null then upper(coalesce(code, 'N')) else lower(coalesce(code, 'N')) end, '' order by pos) as seq from (select v.*, case when nref > 0 and nalt > 0 then least(ref, alt) || greatest(ref, alt) when nref > 0 then ref when nalt > 0 then alt end as bases from v) left join {_IUPAC} using (bases) group by 1, 2"),
    "p01_gc": "select doc_id, round(100.0 * length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq), 6)::double as gc from (select doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) as seq from documents) where length(seq) > 0",
    "p01_tm": f"select kmer, round({_sql_tm(8)}, 6) as tm, {_STAB} as end_stability from (select distinct kmer from ({_sql_kmers(8)}))",
    "p01_pair": f"select doc_id, count(*) as n, round(min(abs(tm - {T.OPT_TM}) + {abs(20 - T.OPT_SIZE)}), 6) as least_penalty from (select doc_id, {_sql_tm(20)} as tm from ({_sql_kmers(20)}) where 100.0 * length(regexp_replace(kmer, '[^GC]', '', 'g')) / 20 between 40 and 70 and regexp_matches(kmer, '[GC]$') and not regexp_matches(kmer, 'A{{5}}|C{{5}}|G{{5}}|T{{5}}')) where tm between 53 and 68 group by 1",
}
