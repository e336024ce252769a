"""Nucleotide expressions: Column to Column. Those over arrays are higher-order functions, which run interpreted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ambiguity codes and the bases they stand for.
CODES = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
BASES = {**{b: b for b in "ACGT"}, **CODES}
_BY_SET = {v: k for k, v in BASES.items()}
_PAIR_FROM = "ACGTRYKMBVDHSWN"
_PAIR_TO = "TGCAYRMKVBHDSWN"
#: Letters that have a complement, and those complements.
KNOWN = _PAIR_FROM + _PAIR_FROM.lower()
PAIRED = _PAIR_TO + _PAIR_TO.lower()


def as_bytes(col: Column) -> Column:
    """The bytes of an ASCII sequence, null for any other: where they are known, a place is reached without reading up to it."""
    return F.when(F.octet_length(col) == F.length(col), col.cast("binary"))


def piece(col: Column, raw: Column, start: Column, size: Column) -> Column:
    """``size`` characters from ``start`` (from one) on; ``raw`` is ``as_bytes`` of the sequence, told once per sequence."""
    return F.when(raw.isNotNull(), F.substring(raw, start, size).cast("string")).otherwise(F.substring(col, start, size))


def only(col: Column, chars: str) -> Column:
    """True if every character is one of ``chars``."""
    return F.translate(col, chars, "") == ""


def without(col: Column, chars: str) -> Column:
    """True if no character is one of ``chars``; case counts."""
    return F.translate(col, chars, "") == col


def unmasked(col: Column) -> Column:
    """True if there is an upper-case letter and no lower-case one (soft masking)."""
    return (col == F.upper(col)) & (col != F.lower(col))


def reverse_complement(col: Column, strict: bool = True) -> Column:
    """Reverse complement with ambiguity codes, case kept. ``strict`` fails on other characters."""
    out = F.reverse(F.translate(col, KNOWN, PAIRED))
    if not strict:
        return out
    return F.when(only(col, KNOWN), out).when(col.isNotNull(), F.raise_error(F.concat(F.lit("no complement for a character of "), col)).cast("string"))


def canonical(col: Column, strict: bool = False) -> Column:
    """The lesser of a sequence and its reverse complement."""
    return F.least(col, reverse_complement(col, strict))


def to_dna(col: Column) -> Column:
    return F.translate(col, "Uu", "Tt")


def to_rna(col: Column) -> Column:
    return F.translate(col, "Tt", "Uu")


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def expansions(col: Column) -> Column:
    """Every unambiguous reading of a sequence, as an array: the product of the bases each code stands for. Case is kept; other characters stand for themselves."""
    table = {**CODES, **{k.lower(): v.lower() for k, v in CODES.items()}}
    options = _lookup(table)
    chars = F.filter(F.split(col, ""), lambda c: c != "")

    def extend(done: Column, c: Column) -> Column:
        choice = F.filter(F.split(F.coalesce(F.element_at(options, c), c), ""), lambda b: b != "")
        return F.flatten(F.transform(done, lambda p: F.transform(choice, lambda b: F.concat(p, b))))

    return F.aggregate(chars, F.array(F.lit("")), extend)


def bases_at(seqs: Column, place: Column) -> Column:
    """Distinct characters of an array of sequences at a place counted from one."""
    return F.array_distinct(F.transform(seqs, lambda s: F.substring(s, place, 1)))


def consensus(seqs: Column) -> Column:
    """One IUPAC sequence for an array of them: dashes to the longest length if lengths differ; a column with
    ``*``, ``N`` or ``?`` gives N; ambiguity codes count as the bases they stand for; other sets fail."""
    longest = F.array_max(F.transform(seqs, F.length))
    even = F.size(F.array_distinct(F.transform(seqs, F.length))) <= 1
    stands = _lookup({**CODES, **{b: b for b in "ACGT"}})
    code = _lookup(_BY_SET)

    def column(i: Column) -> Column:
        here = F.transform(bases_at(seqs, i), F.upper)
        every = F.array_sort(F.array_distinct(F.filter(F.split(F.array_join(F.transform(here, lambda b: F.coalesce(F.element_at(stands, b), b)), ""), ""), lambda b: b != "")))
        hidden = F.exists(here, lambda b: b.isin("*", "N", "?"))
        return F.when(hidden, "N").otherwise(F.element_at(code, F.array_join(every, "")))

    cols = F.transform(F.when(longest > 0, F.sequence(F.lit(1), longest)).otherwise(F.array().cast("array<int>")), column)
    text = F.when(F.exists(cols, lambda c: c.isNull()), F.raise_error(F.concat(F.lit("no code for a column of "), F.array_join(seqs, ","))).cast("string")).otherwise(F.array_join(cols, ""))
    return F.when(even, text).otherwise(F.repeat(F.lit("-"), longest))


def gc_percent(col: Column) -> Column:
    """100 GC / length; ambiguity codes do not count as GC."""
    return 100.0 * (F.length(col) - F.length(F.translate(col, "GCgc", ""))) / F.length(col)


def dots(top: Column, other: Column) -> Column:
    """``other`` with a dot where it equals ``top``."""
    return F.array_join(F.zip_with(F.split(top, ""), F.split(other, ""), lambda a, b: F.when(a == b, ".").otherwise(b)), "")


def undots(top: Column, masked: Column) -> Column:
    """The inverse of ``dots``."""
    return F.array_join(F.zip_with(F.split(top, ""), F.split(masked, ""), lambda a, b: F.when(b == ".", a).otherwise(b)), "")


def occurrences(seq: Column, query: Column) -> Column:
    """Starts (from one) of all, also overlapping, occurrences."""
    n = F.length(seq) - F.length(query) + 1
    raw, wanted = seq.cast("binary"), query.cast("binary")
    starts = F.sequence(F.lit(1), n)
    by_byte = F.filter(starts, lambda i: F.substring(raw, i, F.octet_length(query)) == wanted)
    by_letter = F.filter(starts, lambda i: F.substring(seq, i, F.length(query)) == query)
    return F.when(n <= 0, F.array().cast("array<int>")).when(F.octet_length(seq) == F.length(seq), by_byte).otherwise(by_letter)
