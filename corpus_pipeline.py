"""Corpus pipeline: documents to packed token ids in stages, each written as Parquet and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame

from varispan.llm import decontaminate, mixing, quality, simhash, tokens
from varispan.llm.common import Scratch

STAGES = [
    ("quality classifier", quality.stage),
    ("simhash near-dedup", simhash.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing to target weights", mixing.stage),
    ("token-id output", tokens.stage),
]

#: No SQL: the stages hold a trained classifier, a latent-space search and a tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents of ``sf_dir``; the last stage's rows."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-").replace("/", "-"))
    return docs
