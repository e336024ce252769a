"""Sample groups from a table with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_groups(spark: SparkSession, path: str, sample_col: str = "sample_id", group_col: str = "group", groups: list[str] | None = None, min_samples: int = 0) -> DataFrame:
    """(sample, grp) of the selected groups, all if none are given. Fails on columns or groups that do not exist, groups that are too small and fewer than two groups."""
    table = spark.read.option("header", True).csv(path)
    for c in (sample_col, group_col):
        if c not in table.columns:
            raise ValueError(f"{path} has no column {c}")
    rows = table.select(F.col(sample_col).alias("sample"), F.col(group_col).alias("grp")).where("sample is not null and grp is not null")
    sizes = {r.grp: r.n for r in rows.groupBy("grp").agg(F.count_distinct("sample").alias("n")).collect()}
    if missing := sorted(set(groups or []) - set(sizes)):
        raise ValueError(f"unknown groups: {', '.join(missing)}")
    picked = sorted(groups or sizes)
    if small := [g for g in picked if sizes[g] < min_samples]:
        raise ValueError(f"groups of under {min_samples} samples: {', '.join(small)}")
    if len(picked) < 2:
        raise ValueError("two groups or more are needed")
    return rows.where(F.col("grp").isin(picked)).distinct()


def check_samples(sample_groups: DataFrame, in_vcf: list[str], force: bool = False) -> DataFrame:
    """The groups' samples that the VCF has. Others fail, or go if ``force``."""
    known = sample_groups.sparkSession.createDataFrame([(s,) for s in in_vcf], "sample string")
    missing = [r.sample for r in sample_groups.join(known, "sample", "left_anti").orderBy("sample").collect()]
    if missing and not force:
        raise ValueError(f"samples not in the VCF: {', '.join(missing)}")
    return sample_groups.join(known, "sample", "left_semi")
