"""Per-site, per-group allele counts, conserved and diagnostic alleles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alphabet as A

SITE = ["chrom", "pos", "site_idx"]


@dataclass(frozen=True)
class VariantFilters:
    min_samples: int = 3
    min_samp_prop: float = 0.9
    min_reads: int = 10
    min_geno_qual: int = 40
    min_map_qual: float = 40
    min_var_qual: float = 10
    min_freq: float | None = 0.1


def passes(f: VariantFilters) -> Column:
    """A call with enough reads and quality; unknown values do not pass."""
    return F.coalesce((F.col("dp") >= f.min_reads) & (F.col("gq") >= f.min_geno_qual), F.lit(False))


def present_alleles(f: VariantFilters) -> Column:
    """Distinct alleles of a call: by reads (any, and ``min_freq`` of all reads), or as called where ``min_freq`` is None."""
    if f.min_freq is None:
        return F.coalesce("gt", F.array().cast("array<string>"))
    reads = F.transform("ad", lambda n: F.coalesce(n, F.lit(0)))
    total = F.aggregate(reads, F.lit(0), lambda a, n: a + n)
    kept = F.filter(F.zip_with("alleles", reads, lambda a, n: F.when((n > 0) & (n >= f.min_freq * total), a)), lambda a: a.isNotNull())
    return F.array_distinct(F.coalesce(kept, F.array().cast("array<string>")))


def count_map(items: Column) -> Column:
    """Map of each distinct item to its number."""
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(items)), lambda a: F.struct(a, F.size(F.filter(items, lambda x: x == a)).cast("long"))))


def allele_lengths(counts: Column) -> Column:
    """Map of each allele to its length: a spanning deletion has none, alternatives their longest."""
    return F.transform_values(counts, lambda a, _: F.array_max(F.transform(F.split(a, "/"), lambda p: F.when(p == "*", 0).otherwise(F.length(p)))))


def longest_allele(counts: Column, ref: Column) -> Column:
    return F.coalesce(F.array_max(F.map_values(allele_lengths(counts))), F.length(ref))


def group_variants(calls: DataFrame, sample_groups: DataFrame, f: VariantFilters | None = None, samples: list[str] | None = None) -> DataFrame:
    """One row per site and group: ref, alleles, rlen, qual, mq, grp, group_size, sample_count, missing, allele_counts, conserved, diagnostic.

    A site's calls lie in one input row or partition, so the partial aggregation leaves a row per site and group to
    shuffle. ``samples`` are those that have calls, where known: else the calls are read once more for them. A group without a call at a site has no samples there, and then no group is diagnostic.
    """
    f = f or VariantFilters()
    present = calls.select("sample").distinct() if samples is None else calls.sparkSession.createDataFrame([(s,) for s in samples], "sample string")
    mine = sample_groups.join(present, "sample", "left_semi")
    sizes = mine.groupBy("grp").agg(F.count("*").alias("group_size"))
    every = F.sort_array(F.collect_list(F.struct("grp", "group_size")))
    all_groups = sample_groups.select("grp").distinct().join(sizes, "grp", "left").agg(every.alias("groups"))
    ok = passes(f)
    facts = ["ref", "alleles", "rlen", "qual", "mq"]
    seen = calls.join(mine, "sample").groupBy(*SITE, "grp").agg(
        *[F.first(c).alias(c) for c in facts],
        F.count_if(ok).alias("sample_count"),
        F.sort_array(F.collect_list(F.when(~ok, F.col("sample")))).alias("missing"),
        F.flatten(F.collect_list(F.when(ok, present_alleles(f)))).alias("found"),
    )
    # groups that no call speaks for still count: one row per site and group (groups are few by the file's own size)
    at = seen.groupBy(*SITE).agg(*[F.first(c).alias(c) for c in facts], F.collect_list(F.struct("grp", "sample_count", "missing", "found")).alias("g")).crossJoin(F.broadcast(all_groups))
    one = F.explode(F.transform("groups", lambda x: F.struct(x["grp"].alias("grp"), x["group_size"].alias("group_size"), F.get(F.filter("g", lambda y: y["grp"] == x["grp"]), F.lit(0)).alias("v"))))
    rows = at.select(*SITE, *facts, one.alias("x")).select(*SITE, *facts, "x.grp", "x.group_size", F.coalesce("x.v.sample_count", F.lit(0)).cast("long").alias("sample_count"), F.coalesce("x.v.missing", F.array().cast("array<string>")).alias("missing"), count_map(F.coalesce("x.v.found", F.array().cast("array<string>"))).alias("allele_counts"))
    return call_groups(rows, f)


def call_groups(rows: DataFrame, f: VariantFilters) -> DataFrame:
    """Adds conserved and diagnostic to rows of (site, grp, group_size, sample_count, allele_counts, qual, mq)."""
    site = Window.partitionBy(*SITE)
    enough = F.coalesce((F.col("sample_count") >= f.min_samples) & (F.col("sample_count") / F.col("group_size") >= f.min_samp_prop), F.lit(False))
    usable = F.coalesce((F.col("mq") >= f.min_map_qual) & (F.col("qual") >= f.min_var_qual), F.lit(False))
    keys = F.map_keys("allele_counts")
    single = F.when(F.size(keys) == 1, F.get(keys, F.lit(0)))
    rows = rows.withColumn("conserved", F.when(usable & enough, single))
    rows = rows.withColumn("_all", F.min(enough.cast("int")).over(site)).withColumn("_sets", F.collect_list(F.struct("grp", keys.alias("a"))).over(site))
    elsewhere = F.exists("_sets", lambda x: (x["grp"] != F.col("grp")) & F.array_contains(x["a"], F.col("_single")))
    return rows.withColumn("_single", single).withColumn("diagnostic", F.when(usable & (F.col("_all") == 1) & F.col("_single").isNotNull() & ~elsewhere, F.col("_single"))).drop("_all", "_sets", "_single")


def group_sequences(grouped: DataFrame) -> DataFrame:
    """(chrom, grp, seq): each group's consensus over the sites of a chromosome in order, upper-case where diagnostic, N without data."""
    base = F.when(F.size("allele_counts") == 0, "N").otherwise(A.consensus(F.map_keys("allele_counts")))
    token = F.when(F.col("diagnostic").isNotNull(), F.upper(base)).otherwise(F.lower(base))
    rows = grouped.groupBy("chrom", "grp").agg(F.array_sort(F.collect_list(F.struct("pos", "site_idx", token.alias("t")))).alias("x"))
    return rows.select("chrom", "grp", F.array_join(F.transform("x", lambda v: v["t"]), "").alias("seq"))
