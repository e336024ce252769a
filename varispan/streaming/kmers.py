"""The k-mer steps over a stream: they hold no state, so the batch plan serves as it is."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.kmers import KmerSpec, kmers


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(seq) of text files with one sequence per line that appear in ``folder``."""
    lines = spark.readStream.text(folder).select(F.trim("value").alias("seq"))
    return lines.where("seq <> '' and not startswith(seq, '>')")


def kmer_stream(sequences: DataFrame, spec: KmerSpec) -> DataFrame:
    """K-mers of a streamed (seq); sorting has no meaning on a stream and is left out."""
    return kmers(sequences, replace(spec, sort=False, sort_columns=None))


def write_stream(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append k-mers as text, all that is there now; the checkpoint makes a restart go on where it stopped."""
    return df.select(F.col("kmer").alias("value")).writeStream.format("text").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
