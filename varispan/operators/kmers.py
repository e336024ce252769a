"""K-mers of sequences and the filters and maps over them, in one fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alphabet as A

#: Starts that are generated at once.
TILE = 1 << 16


@dataclass(frozen=True)
class KmerSpec:
    """Steps in the order they apply: RNA to DNA, k-mers, soft mask, complements, allow, disallow, IUPAC, canonical, split, DNA to RNA."""

    k: int | tuple[int, ...] | None = None
    omit_soft: bool = False
    map_soft: bool = False
    complements: bool = False
    allow: str | None = None
    disallow: str | None = None
    expand_iupac: bool = False
    canonicals: bool = False
    split: tuple[int, ...] | None = None
    rna: bool = False
    sort: bool = False
    sort_columns: tuple[int, ...] | None = None

    def __post_init__(self):
        if self.omit_soft and self.map_soft:
            raise ValueError("soft-masked k-mers can be left out or mapped to upper case, not both")
        if self.complements and self.canonicals:
            raise ValueError("complements and canonicals exclude each other")
        if any(k < 1 for k in self.sizes):
            raise ValueError("k must be positive")

    @property
    def sizes(self) -> tuple[int, ...]:
        return () if self.k is None else (self.k,) if isinstance(self.k, int) else tuple(self.k)


def explode_kmers(df: DataFrame, sizes: tuple[int, ...], column: str = "seq", out: str = "kmer", place: str | None = None) -> DataFrame:
    """One row per k-mer for each k; all other columns are kept, and ``place`` is its start, from one, if named. A sequence shorter than k gives none.

    Starts are generated in runs of TILE, so no array grows with a chromosome. A k-mer is cut from the sequence's bytes, which
    takes the same time at any start; from its characters only where the sequence is not ASCII.
    """
    keep = [c for c in df.columns if c != column]
    parts = []
    for k in sizes:
        n = F.length(column)
        rows = df.where(n >= k).select("*", (n - k + 1).alias("_n"), A.as_bytes(F.col(column)).alias("_bytes"))
        runs = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("_n"), F.lit(TILE))).alias("_from"))
        starts = runs.select(*keep, column, "_bytes", F.explode(F.sequence(F.col("_from"), F.least("_n", F.col("_from") + (TILE - 1)))).alias("_at"))
        parts.append(starts.select(*keep, *([F.col("_at").alias(place)] if place else []), A.piece(F.col(column), F.col("_bytes"), F.col("_at"), F.lit(k)).alias(out)))
    out_df = parts[0]
    for p in parts[1:]:
        out_df = out_df.unionByName(p)
    return out_df


def split_columns(col: Column, sizes: tuple[int, ...]) -> list[Column]:
    """Parts of a sequence: sizes of zero or more are taken from the front of what is left, negative ones from its back.

    The parts come out as all front ones, the rest, then all back ones, each in the order of ``sizes``.
    """
    front, back, rest = [], [], col
    for n in sizes:
        if n >= 0:
            front.append(F.substring(rest, F.lit(1), F.lit(n)))
            rest = F.substring(rest, F.lit(n + 1), F.length(rest))
        else:
            back.append(F.substring(rest, F.greatest(F.length(rest) + n + 1, F.lit(1)), F.lit(-n)))
            rest = F.substring(rest, F.lit(1), F.greatest(F.length(rest) + n, F.lit(0)))
    return [*front, rest, *back]


def kmers(df: DataFrame, spec: KmerSpec, column: str = "seq", out: str = "kmer") -> DataFrame:
    """``df`` with ``column`` replaced by its k-mers under ``spec``. Works alike on streams (unsorted).

    Filters stand before the step that multiplies rows wherever the result is the same.
    """
    df = df.where(F.col(column).isNotNull())
    if spec.rna:
        df = df.withColumn(column, A.to_dna(F.col(column)))
    df = explode_kmers(df, spec.sizes, column, out) if spec.sizes else df.withColumnRenamed(column, out)
    m = F.col(out)
    if spec.omit_soft:
        df = df.where(A.unmasked(m))
    if spec.map_soft:
        df = df.withColumn(out, F.upper(m))
    # a set closed under complement may be looked for before the strands part, but for letters that have no complement at all
    early = spec.disallow is not None and _self_paired(spec.disallow) and not (spec.complements and set(spec.disallow) - set(A.KNOWN))
    if spec.disallow and early:
        df = df.where(A.without(m, spec.disallow))
    if spec.complements:
        df = df.withColumn(out, F.explode(F.array(m, A.reverse_complement(m))))
    if spec.allow is not None:
        df = df.where(A.only(m, spec.allow))
    if spec.disallow and not early:
        df = df.where(A.without(m, spec.disallow))
    if spec.expand_iupac:
        df = df.withColumn(out, F.explode(A.expansions(m)))
    if spec.canonicals:
        df = df.withColumn(out, A.canonical(m, strict=True))
    parts = split_columns(m, spec.split) if spec.split is not None else [m]
    if spec.rna:
        parts = [A.to_rna(p) for p in parts]
    df = df.withColumn(out, F.concat_ws(",", *parts))
    if spec.sort or spec.sort_columns:
        fields = F.split(out, ",")
        df = df.orderBy(*[F.get(fields, F.lit(i)) for i in spec.sort_columns or ()], out)
    return df


def _self_paired(chars: str) -> bool:
    """True if the set is closed under complement, so that a filter on it may stand before the strands part."""
    pairs = dict(zip(A.KNOWN, A.PAIRED))
    return all(pairs.get(c, c) in chars for c in chars)
