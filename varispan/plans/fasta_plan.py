"""From genomes to diagnostic regions with conserved ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from ..operators import conserve as C
from ..operators.primers import PrimerOptions, design_rows
from ..operators.render import amplicon_alignment
from ..sources.fasta import files_of, label_of, read_sequences


def regions(sequences: DataFrame, files: list[str], sizes: tuple[int, int, int], ingroup: list[str], has_outgroup: bool, omit_soft: bool = False) -> DataFrame:
    """l, r, amplicons, left_seq, diag_seq, right_seq of each region. ``sequences``: file, label, seq; ``files``: all values of file. Without a diagnostic part nothing is tested."""
    left, diag, right = sizes
    found = C.conserved(C.amplicon_counts(sequences, left, diag, right, omit_soft), files)
    if diag > 0:
        found = C.diagnostic(found, ingroup)
    return C.csv_rows(found, ingroup if has_outgroup else None)


def labels_of(spark: SparkSession, paths: list[str]) -> list[str]:
    """Labels of the given files, which the user has named one by one."""
    return [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(label_of(F.col("p"))).collect()]


def search(spark: SparkSession, ingroup: list[str], outgroup: list[str], sizes: tuple[int, int, int], omit_soft: bool = False, primers: PrimerOptions | None = None, order_by: str | None = None) -> DataFrame:
    """Regions of the given files; with ``primers`` only those for which a pair is found, with its columns."""
    paths = [*ingroup, *outgroup]
    sequences = read_sequences(spark, paths)
    labels = labels_of(spark, ingroup)
    out = regions(sequences, files_of(sequences), sizes, labels, bool(outgroup), omit_soft)
    if primers is not None:
        template = F.concat("left_seq", "diag_seq", "right_seq")
        out = design_rows(out.withColumn("template", template).withColumn("target_start", F.lit(sizes[0])).withColumn("target_len", F.lit(sizes[1])), primers)
    return out.orderBy(order_by) if order_by else out


def alignments_text(found: DataFrame, ingroup: list[str] | None, dots: bool = False) -> DataFrame:
    """Regions (with their primer pairs, where designed) and the text of each one's alignment, as a column. Labels and marks are worked out
    in the plan; only the layout runs in Python, a batch of rows at a time.
    """
    ship(found.sparkSession)
    mine = F.array(*[F.lit(x) for x in ingroup or []]).cast("array<string>")
    rows = F.transform("amplicons", lambda a: F.struct(a["d"].alias("d"), C.label_text(a["labels"]).alias("labels"), F.exists(a["labels"], lambda x: F.array_contains(mine, x["label"])).alias("inside")))
    marked = found.withColumns({"_rows": rows, "_variable": C.variable_columns(F.col("amplicons")), "_unique": C.unique_columns(F.col("amplicons"), ingroup or [])})
    paired = "left_start" in found.columns
    keep = [c for c in found.columns if c != "amplicons"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(*keep).schema) + ", alignment string"

    def run(frames: Iterator[pd.DataFrame]):
        for f in frames:
            texts = []
            for r in f.to_dict("records"):
                pair, template = (r, r["template"]) if paired else (None, None)
                texts.append(amplicon_alignment(r["l"], r["r"], [(x["d"], x["labels"], x["inside"]) for x in r["_rows"]], list(r["_variable"]), list(r["_unique"]), dots, template, pair))
            yield f[keep].assign(alignment=texts)

    return marked.select(*keep, "_rows", "_variable", "_unique").mapInPandas(run, schema)
