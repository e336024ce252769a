"""From variant calls to diagnostic regions."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.regions import CSV, RegionOptions, find_regions
from ..operators.variants import VariantFilters, group_variants
from ..sources.fasta import read_fasta
from ..sources.groups import check_samples, read_groups
from ..sources.vcf import calls, read_sites, sample_names


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    return read_fasta(spark, [path]).select(F.col("seq_id").alias("chrom"), "seq")


def search(
    spark: SparkSession, metadata: str, reference: str, vcf: str, groups: list[str] | None = None, sample_col: str = "sample_id", group_col: str = "group",
    chroms: list[str] | None = None, pos: tuple[int, int] | None = None, filters: VariantFilters | None = None, options: RegionOptions | None = None, force: bool = False,
) -> DataFrame:
    """All windows with their types; see ``find_regions``. ``pos`` holds for the last variant of a window; its neighbours are read beyond."""
    filters, options = filters or VariantFilters(), options or RegionOptions()
    members = read_groups(spark, metadata, sample_col, group_col, groups, filters.min_samples if not force else 0)
    names = sample_names(spark, vcf)
    members = check_samples(members, names, force)
    seen = (max(1, min(pos) - options.halo), max(pos) + options.halo) if pos else None
    grouped = group_variants(calls(read_sites(spark, vcf, chroms, seen), names), members, filters, names).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r.grp: r.n for r in members.groupBy("grp").agg(F.count_if(F.col("sample").isin(names)).alias("n")).collect()}
    found = find_regions(grouped, read_reference(spark, reference), options, sizes)
    return found.where(F.col("pos").between(min(pos), max(pos))) if pos else found


def csv_rows(regions: DataFrame, order_by: str | None = None) -> DataFrame:
    """The output table: the 41 columns of the diagnostic regions."""
    out = regions.where("type = 'Diagnostic'").select(*CSV)
    return out.orderBy(order_by) if order_by else out
