"""Sequences looked up in genomes: every place of each query on either strand, and alignments annotated with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import alphabet as A
from .kmers import explode_kmers


def find(sequences: DataFrame, queries: DataFrame, padding: int = 0) -> DataFrame:
    """``queries`` (query, and label if it is to be looked for in those sequences alone) with label, file, seq_id, record, strand, start, end, sequence of each place.

    ``sequences``: file, label, seq_id, seq. start is the first padded base, counted from one, end the first base after the
    padding; the sequence is lower-case on the minus strand. Places are cut at a sequence's start and run out at its end.
    Sequences are cut to pieces of the queries' sizes and joined to them, so no query reads a genome of its own.
    """
    keys = ["label"] if "label" in queries.columns else []
    rows = sequences.withColumn("record", F.xxhash64("file", "seq_id", "seq"))
    wanted = queries.where("query <> ''").select("query", *keys).distinct()
    both = wanted.select("query", *keys, F.explode(F.array(F.struct(F.lit("forward").alias("strand"), F.col("query").alias("piece")), F.struct(F.lit("reverse").alias("strand"), A.reverse_complement(F.col("query"), strict=False).alias("piece")))).alias("s")).select("query", *keys, "s.*")
    sizes = tuple(sorted(r.n for r in wanted.select(F.length("query").alias("n")).distinct().collect()))
    if not sizes:
        sizes = (1,)
    pieces = explode_kmers(rows.select("record", *keys, "seq"), sizes, out="piece", place="pos")
    hits = pieces.join(both, ["piece", *keys]).select("record", "query", *keys, "strand", "pos").distinct()
    first = F.greatest(F.col("pos") - padding, F.lit(1))
    text = A.piece(F.col("seq"), A.as_bytes(F.col("seq")), first, F.col("pos") + F.length("query") + padding - first)
    placed = hits.drop(*keys).join(rows, "record").select("query", "label", "file", "seq_id", "record", "strand", first.alias("start"), (F.col("pos") + F.length("query") + padding).alias("end"), text.alias("text"))
    own = F.when(F.col("strand") == "reverse", F.lower(A.reverse_complement(F.col("text"), strict=False))).otherwise(F.col("text"))
    return placed.withColumn("sequence", own).drop("text").join(queries, ["query", *keys])


def read_alignments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(alignment, line, query, tag_no, label) of alignment files: alignments begin at ``>``, their later lines have dots where they equal the first."""
    raw = spark.read.option("lineSep", "\n>").text(paths).select(F.monotonically_increasing_id().alias("id"), F.split("value", "\n").alias("lines"))
    rows = raw.select("id", F.filter(F.transform(F.expr("slice(lines, 2, size(lines))"), F.trim), lambda x: (x != "") & ~x.startswith("{")).alias("lines"))
    # numbers go on from file part to file part; there are as many parts as tasks
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    sizes = {r.p: r.n for r in raw.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, upto = {}, 0
    for p in sorted(sizes):
        before[p], upto = upto, upto + sizes[p]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), part) if before else F.lit(0)
    seq = lambda x: F.trim(F.split_part(x, F.lit(":"), F.lit(1)))
    top = seq(F.get("lines", F.lit(0)))
    lines = rows.select((offset + place + 1).cast("long").alias("alignment"), top.alias("top"), F.posexplode("lines").alias("line", "text"))
    tags = F.transform(F.split(F.split_part("text", F.lit(":"), F.lit(2)), ";"), lambda t: F.trim(F.split_part(t, F.lit("("), F.lit(1))))
    return lines.select("alignment", "line", F.when(F.col("line") == 0, F.col("top")).otherwise(A.undots(F.col("top"), seq(F.col("text")))).alias("query"), F.posexplode(tags).alias("tag_no", "label"))


def annotate(alignments: DataFrame, sequences: DataFrame, padding: int = 0) -> DataFrame:
    """(alignment, n, line) of text: every place of each aligned sequence in the genome of its label, padded, with dots where it equals the alignment's first place. n is 0 for the heading."""
    found = find(sequences, alignments, padding)
    order = Window.partitionBy("alignment").orderBy("line", "tag_no", F.col("strand") == "reverse", "seq_id", "start", "record")
    name = F.regexp_extract("file", r"([^/]*)$", 1)
    note = F.concat_ws(" | ", name, F.concat(F.lit("chrom="), "seq_id"), F.concat(F.lit("start="), "start"), F.concat(F.lit("end="), "end"), F.concat(F.lit("strand="), "strand"))
    rows = found.withColumn("text", F.upper("sequence")).withColumn("n", F.row_number().over(order)).withColumn("first", F.first("text").over(order))
    body = rows.select("alignment", "n", F.concat_ws(" | ", F.when(F.col("n") == 1, F.col("text")).otherwise(A.dots(F.col("first"), F.substring("text", F.lit(1), F.length("first")))), note).alias("line"))
    heads = alignments.select("alignment").distinct().select("alignment", F.lit(0).alias("n"), F.concat(F.lit("# Alignment "), "alignment").alias("line"))
    return heads.unionByName(body)
