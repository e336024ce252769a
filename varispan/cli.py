"""Command line: ``kmers`` (k-mer extraction), ``conserved`` (regions with conserved ends), ``variants`` (regions from variant calls), ``find`` and ``annotate`` (places of sequences and of alignments in genomes).

Input named ``-`` is standard input. Results go to standard output, or to a folder that Spark writes (compressed if its name ends in .gz or .bz2).
"""

from __future__ import annotations

import argparse
import csv
import logging
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators.kmers import KmerSpec, kmers
from .operators.primers import COLUMNS, PrimerOptions
from .operators.regions import RegionOptions, type_counts
from .operators.variants import VariantFilters
from .plans import fasta_plan, vcf_plan
from .plans.params import amplicon_sizes
from .operators.search import annotate, find, read_alignments
from .sources.fasta import is_rna, read_sequences
from .sources.stdin import path_of

log = logging.getLogger("varispan")


def _session(cores: int | None, memory: str | None = None) -> SparkSession:
    """The session of spark-submit if there is one; else a local one."""
    builder = SparkSession.builder.appName("varispan").config("spark.ui.showConsoleProgress", "false")
    if SparkSession.getActiveSession() is None and cores:
        builder = builder.config("spark.master", f"local[{cores}]")
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    return builder.getOrCreate()


def _compression(path: str) -> str:
    return "gzip" if path.endswith(".gz") else "bzip2" if path.endswith(".bz2") else "none"


def _counted(df: DataFrame, write) -> int:
    """Rows that ``write`` wrote, counted on the way."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def write_lines(df: DataFrame, path: str | None, out=None) -> int:
    """One string column to a folder, or row by row to standard output; the number of rows."""
    if path:
        return _counted(df, lambda rows: rows.write.mode("overwrite").option("compression", _compression(path)).text(path))
    out, n = out or sys.stdout, 0
    for (line,) in df.toLocalIterator():
        out.write(line + "\n")
        n += 1
    return n


def write_csv(df: DataFrame, path: str | None, out=None) -> int:
    if path:
        return _counted(df, lambda rows: rows.write.mode("overwrite").option("header", True).option("compression", _compression(path)).csv(path))
    rows, n = csv.writer(out or sys.stdout, lineterminator="\n"), 0
    rows.writerow(df.columns)
    for r in df.toLocalIterator():
        rows.writerow(["" if v is None else v for v in r])
        n += 1
    return n


def _primer_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--tm", type=float, nargs=2, default=(53, 68), metavar=("MIN", "MAX"), help="melting temperature of primers")
    p.add_argument("--gc", type=float, nargs=2, default=(40, 70), metavar=("MIN", "MAX"), help="GC percent of primers")
    p.add_argument("--amp_size", type=int, nargs=2, default=(70, 150), metavar=("MIN", "MAX"), help="size of the product")
    p.add_argument("--primer_size", type=int, nargs=2, default=(25, 35), metavar=("MIN", "MAX"))
    p.add_argument("--max_sec_tm", type=float, default=40, help="highest temperature of secondary structures; taken, but this designer does not model them")
    p.add_argument("--gc_clamp", type=int, default=1, help="G or C at the 3' end")
    p.add_argument("--max_end_gc", type=int, default=4, help="most G or C in the last five bases")


def _primers(a) -> PrimerOptions:
    return PrimerOptions(tuple(a.tm), tuple(a.gc), tuple(a.amp_size), tuple(a.primer_size), a.max_sec_tm, a.gc_clamp, a.max_end_gc)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="varispan", description=__doc__.splitlines()[0])
    top.add_argument("--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True)

    k = sub.add_parser("kmers", help="k-mers of a FASTA file or of one sequence per line")
    k.add_argument("file", nargs="+")
    k.add_argument("-k", "--kmers", type=int, nargs="+", help="sizes; without any, whole sequences")
    strand = k.add_mutually_exclusive_group()
    strand.add_argument("--canonicals", action="store_true", help="the lesser of both strands")
    strand.add_argument("--complements", action="store_true", help="both strands")
    k.add_argument("--allow", help="keep k-mers of these characters only")
    k.add_argument("--disallow", help="drop k-mers with any of these characters")
    k.add_argument("--expand-iupac", action="store_true")
    mask = k.add_mutually_exclusive_group()
    mask.add_argument("--omit-softmask", action="store_true", help="drop k-mers with lower-case letters")
    mask.add_argument("--map-softmask", action="store_true", help="to upper case")
    k.add_argument("--split", type=int, nargs="+", help="sizes to cut from the front (positive) or back (negative)")
    k.add_argument("-p", "--parallel", type=int, help="cores of a local session")
    k.add_argument("-s", "--sort", action="store_true")
    k.add_argument("--sort-np", type=int, help="partitions of the sort")
    k.add_argument("--sort-mem", help="memory of a local session, such as 8g")
    k.add_argument("--sort-cols", type=int, nargs="+", help="fields to sort by, from 0, before the whole line")
    k.add_argument("--output")

    c = sub.add_parser("conserved", help="regions conserved at both ends that tell an ingroup from an outgroup")
    c.add_argument("files", nargs="+", help="genomes of the ingroup")
    c.add_argument("--outgroup", nargs="+", default=[])
    c.add_argument("-c", "--conserved", type=int)
    c.add_argument("--conserved-left", type=int)
    c.add_argument("--conserved-right", type=int)
    c.add_argument("-d", "--diagnostic", type=int)
    c.add_argument("-a", "--amplicon", type=int)
    c.add_argument("--omit-soft", action="store_true", help="leave out soft-masked k-mers instead of reading them as upper case")
    c.add_argument("--cores", type=int)
    c.add_argument("--dot-alignment", action="store_true")
    c.add_argument("-o", "--out_align", help="folder for alignments; - for standard output")
    c.add_argument("-s", "--out_csv", help="folder for the table; default is standard output")
    c.add_argument("-w", "--workdir", help="kept for old scripts: Spark's own local folders are used")
    c.add_argument("-p", "--primer3", action=argparse.BooleanOptionalAction, default=False, help="design primers and keep regions that have some")
    c.add_argument("--order-by", help="column of the result to sort by, such as pair_penalty")
    c.add_argument("--verbose", action="store_true")
    _primer_options(c)

    v = sub.add_parser("variants", help="regions from variant calls that tell groups of samples apart")
    v.add_argument("metadata", help="CSV of samples and groups")
    v.add_argument("reference", help="FASTA")
    v.add_argument("--vcf", required=True)
    v.add_argument("--sample_col", default="sample_id")
    v.add_argument("--group_col", default="group")
    v.add_argument("--index", help="kept for old scripts: no index is needed")
    v.add_argument("--groups", nargs="+", help="groups to tell apart; all by default")
    v.add_argument("--out_csv")
    v.add_argument("--out_align")
    v.add_argument("--chroms", nargs="+")
    v.add_argument("--pos", type=int, nargs=2, metavar=("FROM", "TO"))
    for name, kind in (("min_samples", int), ("min_samp_prop", float), ("min_reads", int), ("min_geno_qual", int), ("min_map_qual", float), ("min_var_qual", float), ("min_freq", float)):
        v.add_argument(f"--{name}", type=kind, default=getattr(VariantFilters, name))
    v.add_argument("--min_bases", type=int, default=1, help="least edit distance to other groups")
    v.add_argument("--cores", type=int)
    v.add_argument("--log")
    v.add_argument("--log_level", default="WARNING")
    v.add_argument("--var_location", type=int, nargs=2, default=(6, 14), metavar=("FROM", "TO"))
    v.add_argument("--crrna_len", type=int, default=28)
    v.add_argument("--force", action="store_true", help="go on without samples that the VCF lacks")
    v.add_argument("--order-by")
    _primer_options(v)

    f = sub.add_parser("find", help="places of a sequence in genomes, on both strands")
    f.add_argument("file", nargs="+")
    f.add_argument("sequence")
    f.add_argument("--padding", type=int, default=0)
    f.add_argument("--cores", type=int)

    n = sub.add_parser("annotate", help="places of an alignment's sequences in the genomes it is of")
    n.add_argument("alignment")
    n.add_argument("-r", "--ref", nargs="+", required=True, help="the genomes")
    n.add_argument("-p", "--padding", type=int, default=0, help="bases to either side")
    n.add_argument("-o", "--output")
    n.add_argument("--cores", type=int)
    return top


def run_kmers(a) -> None:
    spark = _session(a.parallel, a.sort_mem)
    if a.sort_np:
        spark.conf.set("spark.sql.shuffle.partitions", a.sort_np)
    rows = read_sequences(spark, [path_of(spark, f) for f in a.file])
    spec = KmerSpec(
        k=tuple(a.kmers) if a.kmers else None, omit_soft=a.omit_softmask, map_soft=a.map_softmask, complements=a.complements, allow=a.allow, disallow=a.disallow, expand_iupac=a.expand_iupac,
        canonicals=a.canonicals, split=tuple(a.split) if a.split else None, rna=is_rna(rows), sort=a.sort, sort_columns=tuple(a.sort_cols) if a.sort_cols else None,
    )
    log.info("%d k-mers", write_lines(kmers(rows.select("seq"), spec).select("kmer"), a.output))


def run_conserved(a) -> None:
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING)
    sizes = amplicon_sizes(a.amplicon, a.diagnostic, a.conserved, a.conserved_left, a.conserved_right)
    spark = _session(a.cores)
    found = fasta_plan.search(spark, a.files, a.outgroup, sizes, a.omit_soft, _primers(a) if a.primer3 else None, a.order_by)
    log.info("amplicons of %d + %d + %d bases in %d files", *sizes, len(a.files) + len(a.outgroup))
    if a.out_align:
        # both outputs come from one table: it is computed once
        found = found.persist()
        labels = fasta_plan.labels_of(spark, a.files)
        write_lines(fasta_plan.alignments_text(found, labels, a.dot_alignment).select("alignment"), None if a.out_align == "-" else a.out_align)
    if a.out_csv or a.out_align != "-":
        write_csv(found.select("left_seq", "diag_seq", "right_seq", *(COLUMNS if a.primer3 else [])), a.out_csv)


def run_variants(a) -> None:
    logging.basicConfig(level=a.log_level.upper(), filename=a.log)
    spark = _session(a.cores)
    options = RegionOptions(a.crrna_len, tuple(a.var_location), min_bases=a.min_bases, primers=_primers(a), align=bool(a.out_align))
    filters = VariantFilters(a.min_samples, a.min_samp_prop, a.min_reads, a.min_geno_qual, a.min_map_qual, a.min_var_qual, a.min_freq)
    regions = vcf_plan.search(spark, a.metadata, a.reference, path_of(spark, a.vcf), a.groups, a.sample_col, a.group_col, a.chroms, tuple(a.pos) if a.pos else None, filters, options, a.force).persist()
    log.info("%d regions", write_csv(vcf_plan.csv_rows(regions, a.order_by), a.out_csv))
    if a.out_align:
        write_lines(regions.where(F.col("alignment").isNotNull()).select("alignment"), a.out_align)
    for r in type_counts(regions).orderBy("type", "group").collect():
        log.info("%s %s: %d", r.type, r.group or "", r.n)
        print(f"{r.type}{' ' + r.group if r.group else ''}: {r.n}", file=sys.stderr)


def run_find(a) -> None:
    spark = _session(a.cores)
    wanted = spark.createDataFrame([(a.sequence,)], "query string")
    found = find(read_sequences(spark, a.file), wanted, a.padding).orderBy("file", F.col("strand") == "reverse", "seq_id", "start")
    write_lines(found.select(F.concat(F.rpad("seq_id", F.greatest(F.lit(8), F.length("seq_id")), " "), F.lit(" "), F.rpad(F.col("start").cast("string"), 8, " "), F.lit("   "), "sequence", F.lit("   "), F.col("end").cast("string"))), None)


def run_annotate(a) -> None:
    spark = _session(a.cores)
    lines = annotate(read_alignments(spark, path_of(spark, a.alignment)), read_sequences(spark, a.ref), a.padding)
    write_lines(lines.orderBy("alignment", "n").select("line"), a.output)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    {"kmers": run_kmers, "conserved": run_conserved, "variants": run_variants, "find": run_find, "annotate": run_annotate}[a.command](a)
