"""Text tables of split k-mers: left,diag,right with an optional label multiset, as ``a;b(2)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fasta import label_of


def read_kmers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(l, d, r, label, n) from lines of three fields (labelled by file) or four; other lines fail."""
    raw = spark.read.text(paths).select(F.split("value", ",").alias("f"), label_of(F.col("_metadata.file_path")).alias("own"))
    fields = F.when(F.size("f").isin(3, 4), F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not a k-mer line: "), F.array_join("f", ","))).cast("array<string>"))
    rows = raw.select(fields.alias("f"), "own")
    labels = F.when(F.size("f") == 4, F.split(F.get("f", F.lit(3)), ";")).otherwise(F.array("own"))
    flat = rows.select(F.get("f", F.lit(0)).alias("l"), F.get("f", F.lit(1)).alias("d"), F.get("f", F.lit(2)).alias("r"), F.explode(labels).alias("x"))
    count = F.coalesce(F.regexp_extract("x", r"\((\d+)\)$", 1).try_cast("long"), F.lit(1))
    named = flat.select("l", "d", "r", F.regexp_replace("x", r"\(\d+\)$", "").alias("label"), count.cast("long").alias("n"))
    return named.groupBy("l", "d", "r", "label").agg(F.sum("n").alias("n"))


def kmer_lines(alignments: DataFrame) -> DataFrame:
    """Four-field lines, one per amplicon, of alignments (l, r, amplicons)."""
    from ..operators.conserve import label_text

    rows = alignments.select("l", "r", F.explode("amplicons").alias("a"))
    return rows.select(F.concat_ws(",", "l", "a.d", "r", label_text(F.col("a.labels"))).alias("value"))
