"""K-mers with conserved ends across genomes: intersection, diagnostic columns, consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alphabet as A
from .kmers import KmerSpec, kmers


def split_kmers(sequences: DataFrame, left: int, diag: int, right: int, omit_soft: bool = False) -> DataFrame:
    """(file, label, l, d, r) of both strands of every k-mer without N."""
    spec = KmerSpec(k=left + diag + right, omit_soft=omit_soft, map_soft=not omit_soft, complements=True, disallow="Nn")
    rows = kmers(sequences.select("file", "label", "seq"), spec)
    m = F.col("kmer")
    return rows.select("file", "label", F.substring(m, 1, left).alias("l"), F.substring(m, left + 1, diag).alias("d"), F.substring(m, left + diag + 1, right).alias("r"))


def count_amplicons(rows: DataFrame) -> DataFrame:
    """(file, label, l, d, r, n): equal amplicons of a file merged, which also evens out low-complexity keys before they are grouped."""
    return rows.groupBy("l", "r", "d", "label", "file").agg(F.count("*").alias("n"))


#: K-mers of up to so many bases are counted on one strand before they are split: there are 4 ** FEW of them at most to a file.
FEW = 12


def amplicon_counts(sequences: DataFrame, left: int, diag: int, right: int, omit_soft: bool = False) -> DataFrame:
    """``count_amplicons`` of ``split_kmers``. Where k-mers are short, complements and parts are made of each different one alone, not of each occurrence."""
    k = left + diag + right
    if k > FEW:
        return count_amplicons(split_kmers(sequences, left, diag, right, omit_soft))
    one = kmers(sequences.select("file", "label", "seq"), KmerSpec(k=k, omit_soft=omit_soft, map_soft=not omit_soft))
    counted = one.groupBy("kmer", "label", "file").agg(F.count("*").alias("n"))
    both = kmers(counted, KmerSpec(complements=True, disallow="Nn"), "kmer")
    m = F.col("kmer")
    parts = both.select("file", "label", F.substring(m, 1, left).alias("l"), F.substring(m, left + 1, diag).alias("d"), F.substring(m, left + diag + 1, right).alias("r"), "n")
    return parts.groupBy("l", "r", "d", "label", "file").agg(F.sum("n").alias("n"))


#: Files to a word of the mask of a key's files.
WORD = 63


def in_all_files(counted: DataFrame, files: list[str]) -> DataFrame:
    """(l, r) of the keys found in all ``files``: masks of files are joined map-side, so what most keys bring to the shuffle is one row a task.

    ``n`` is looked at so that no column of ``counted`` is pruned here: its shuffle is then the same as that of the rows, and is made once.
    """
    number = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(files) for x in (f, i)]), F.col("file"))
    words = range(0, len(files), WORD)
    bit = lambda w: F.when(number.between(w, w + WORD - 1) & (F.col("n") > 0), F.call_function("shiftleft", F.lit(1).cast("long"), number - w))
    masks = counted.groupBy("l", "r").agg(*[F.bit_or(bit(w)).alias(f"_m{w}") for w in words])
    for w in words:
        masks = masks.where(F.col(f"_m{w}") == (1 << min(WORD, len(files) - w)) - 1)
    return masks.select("l", "r")


def conserved(counted: DataFrame, files: list[str]) -> DataFrame:
    """Alignments (l, r, amplicons) of the keys found in all ``files``, values of ``counted.file``.

    ``amplicons`` is an array of (d, labels) in order of d, ``labels`` one of (label, n). Only rows of such keys are gathered;
    a key's array is bounded by its distinct (d, label), not by its occurrences.
    """
    rows = counted.join(in_all_files(counted, files), ["l", "r"], "left_semi")
    one = rows.groupBy("l", "r", "d", "label").agg(F.sum("n").alias("n"))
    amplicons = one.groupBy("l", "r", "d").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("labels"))
    return amplicons.groupBy("l", "r").agg(F.array_sort(F.collect_list(F.struct("d", "labels"))).alias("amplicons"))


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairwise form: amplicon rows (l, d, r, label, n) of both sides whose key is on both, label counts added."""
    keys = left.select("l", "r").distinct().intersect(right.select("l", "r"))
    rows = left.unionByName(right).join(keys, ["l", "r"], "left_semi")
    return rows.groupBy("l", "d", "r", "label").agg(F.sum("n").alias("n"))


def merge(left: DataFrame, right: DataFrame, ordered: bool = False) -> DataFrame:
    """Bag union, in order of (l, r, d) if asked for."""
    out = left.unionByName(right)
    return out.orderBy("l", "r", "d") if ordered else out


def merge_equal(rows: DataFrame) -> DataFrame:
    """Equal amplicons merged, their label counts added."""
    return rows.groupBy("l", "d", "r", "label").agg(F.sum("n").alias("n"))


def label_text(labels: Column) -> Column:
    """``a;b(2)``: labels in order, counts above one in brackets."""
    return F.array_join(F.transform(F.array_sort(labels), lambda x: F.when(x["n"] == 1, x["label"]).otherwise(F.concat(x["label"], F.lit("("), x["n"].cast("string"), F.lit(")")))), ";")


def _width(amplicons: Column) -> Column:
    return F.length(F.get(amplicons, F.lit(0))["d"])


def _places(amplicons: Column) -> Column:
    d = _width(amplicons)
    return F.when(d > 0, F.sequence(F.lit(0), d - 1)).otherwise(F.array().cast("array<int>"))


def variable_columns(amplicons: Column) -> Column:
    """Offsets in the diagnostic part with more than one base."""
    ds = F.transform(amplicons, lambda a: a["d"])
    return F.filter(_places(amplicons), lambda p: F.size(A.bases_at(ds, p + 1)) > 1)


def brackets(amplicons: Column, left: int, diag: int, ingroup: list[str]) -> Column:
    """``{---}`` over the diagnostic part: ``*`` at variable offsets, ``#`` at those unique to the ingroup."""
    variable, unique = variable_columns(amplicons), unique_columns(amplicons, ingroup)
    mark = lambda p: F.when(F.array_contains(unique, p), "#").when(F.array_contains(variable, p), "*").otherwise("-")
    return F.concat(F.lit(" " * (left - 1) + "{"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(diag - 1)), mark), ""), F.lit("}"))


def dotted(left: Column, amplicons: Column, right: Column) -> Column:
    """Array of the whole amplicons, with dots where they equal the first."""
    whole = F.transform(amplicons, lambda a: F.concat(left, a["d"], right))
    return F.transform(whole, lambda x: A.dots(F.get(whole, F.lit(0)), x))


def _of(amplicons: Column, ingroup: list[str], inside: bool) -> Column:
    mine = F.array(*[F.lit(x) for x in ingroup]) if ingroup else F.array().cast("array<string>")
    some = lambda a: F.exists(a["labels"], lambda x: F.array_contains(mine, x["label"]) if inside else ~F.array_contains(mine, x["label"]))
    return F.transform(F.filter(amplicons, some), lambda a: a["d"])


def unique_columns(amplicons: Column, ingroup: list[str]) -> Column:
    """Offsets where no base of the ingroup is one of the outgroup. The ingroup itself may vary; with no outgroup every offset counts."""
    ins, outs = _of(amplicons, ingroup, True), _of(amplicons, ingroup, False)
    return F.filter(_places(amplicons), lambda p: F.size(F.array_intersect(A.bases_at(ins, p + 1), A.bases_at(outs, p + 1))) == 0)


def diagnostic(alignments: DataFrame, ingroup: list[str]) -> DataFrame:
    """Alignments with an offset unique to the ingroup."""
    return alignments.where(F.size(unique_columns(F.col("amplicons"), ingroup)) > 0)


def consensus_of(amplicons: Column, ingroup: list[str] | None) -> Column:
    """IUPAC consensus of the diagnostic parts, of all amplicons or those whose labels are all of the ingroup; a single amplicon counts in any case."""
    if ingroup is None:
        return A.consensus(F.transform(amplicons, lambda a: a["d"]))
    mine = F.array(*[F.lit(x) for x in ingroup])
    pure = F.filter(amplicons, lambda a: F.forall(a["labels"], lambda x: F.array_contains(mine, x["label"])))
    used = F.when(F.size(amplicons) == 1, amplicons).otherwise(pure)
    return A.consensus(F.transform(used, lambda a: a["d"]))


def csv_rows(alignments: DataFrame, ingroup: list[str] | None) -> DataFrame:
    """left_seq, diag_seq, right_seq beside the alignment's own columns. Ends are equal in all amplicons, so they are their own consensus."""
    ends = [A.consensus(F.array(c)) for c in ("l", "r")]
    return alignments.withColumns({"left_seq": ends[0], "diag_seq": consensus_of(F.col("amplicons"), ingroup), "right_seq": ends[1]})
