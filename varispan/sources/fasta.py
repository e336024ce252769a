"""Sequence files: FASTA or one sequence per line, plain, .gz or .bz2."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SEQUENCE_ENDINGS = r"\.(gz|bz2|fna|fasta|fa|ffn|frn)$"


def label_of(path: Column) -> Column:
    """File name down to its first dot."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.split_part(name, F.lit("."), F.lit(1))


def file_name() -> Column:
    """Path of the file of a row, without URL escapes."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def stem_of(path: Column) -> Column:
    """File name without directories and without trailing sequence and compression endings."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    for _ in range(2):
        name = F.regexp_replace(name, _SEQUENCE_ENDINGS, "")
    return name


def files_of(sequences: DataFrame) -> list[str]:
    """The values of ``file`` in what was read, from the list of files alone."""
    # an empty authority is told there and left out in the rows
    return sorted({re.sub("^([a-z0-9]+):///", r"\1:/", unquote(f)) for f in sequences.inputFiles()})


def looks_like_fasta(spark: SparkSession, paths: list[str]) -> bool:
    """True if the first line of the first file holds a ``>``."""
    first = spark.read.text(paths[0]).limit(1).first()
    return first is not None and ">" in first[0]


def read_fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, label, seq_id, seq) per record with a sequence. Records start at lines that start with ``>``; the id is the header's first word.

    Records are the input format's own rows (split at a line feed before ``>``), so a file of many records is read in
    parallel and no header is matched to its lines by position.
    """
    # the first record keeps its own mark; the others have lost it to the separator
    raw = spark.read.option("lineSep", "\n>").text(paths).select(file_name().alias("file"), "value")
    body = F.regexp_replace("value", "^>", "")
    header = F.regexp_extract(body, r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace(body, r"^[^\r\n]*", ""), r"\s+", "")
    return raw.select("file", label_of(F.col("file")).alias("label"), F.regexp_extract(header, r"^\s*(\S*)", 1).alias("seq_id"), seq.alias("seq")).where("seq <> ''")


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, label, seq_id, seq): one sequence per stripped line; blank lines are left out. seq_id is null."""
    raw = spark.read.text(paths).select(file_name().alias("file"), F.trim(F.regexp_replace("value", r"[\r\t]", " ")).alias("seq"))
    return raw.where("seq <> ''").select("file", label_of(F.col("file")).alias("label"), F.lit(None).cast("string").alias("seq_id"), "seq")


def read_sequences(spark: SparkSession, paths: str | list[str], fasta: bool | None = None) -> DataFrame:
    """FASTA or lines, told by the first line if not given."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    fasta = looks_like_fasta(spark, paths) if fasta is None else fasta
    return read_fasta(spark, paths) if fasta else read_lines(spark, paths)


def is_rna(sequences: DataFrame) -> bool:
    """RNA if the first sequence with a T or U has a U and no T; neither anywhere counts as DNA. The first is that of least file, then of least place in it."""
    told = sequences.select(F.col("file") if "file" in sequences.columns else F.lit("").alias("file"), F.monotonically_increasing_id().alias("place"), F.col("seq").rlike("[Tt]").alias("dna"), F.col("seq").rlike("[Uu]").alias("rna"))
    seen = told.where("dna or rna").agg(F.min_by("dna", F.struct("file", "place")).alias("dna")).first()
    return seen.dna is False
