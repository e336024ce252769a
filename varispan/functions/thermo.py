"""Nearest-neighbour melting temperatures and the primer figures that follow from them in closed form.

Unified parameters of SantaLucia (1998), 50 mM monovalent and 1.5 mM divalent salt, 0.6 mM dNTP and 50 nM oligo.
Each figure exists as a Column and as a Python function over the same tables.
"""

from __future__ import annotations

from math import log, log10, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stack: (enthalpy in kcal/mol, entropy in cal/mol K).
_HALF = {"AA": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "GT": (-8.4, -22.4), "CT": (-7.8, -21.0), "GA": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9)}
_COMPLEMENT = str.maketrans("ACGT", "TGCA")
STACKS = {**_HALF, **{k.translate(_COMPLEMENT)[::-1]: v for k, v in _HALF.items()}}
_END = {"A": (2.3, 4.1), "T": (2.3, 4.1), "C": (0.1, -2.8), "G": (0.1, -2.8)}
_STABILITY = {"AA": 1.0, "TT": 1.0, "AT": 0.88, "TA": 0.58, "CA": 1.45, "TG": 1.45, "GT": 1.44, "AC": 1.44, "CT": 1.28, "AG": 1.28, "GA": 1.3, "TC": 1.3, "CG": 2.17, "GC": 2.24, "GG": 1.84, "CC": 1.84}
_END_STABILITY = {"A": 1.03, "T": 1.03, "C": 0.98, "G": 0.98}

MONOVALENT, DIVALENT, DNTP, OLIGO = 50.0, 1.5, 0.6, 50.0
SODIUM = (MONOVALENT + 120 * sqrt(DIVALENT - DNTP)) / 1000
OPT_TM, OPT_SIZE = 60.5, 30.0


def tm(seq: str) -> float:
    s = seq.upper()
    h = _END[s[0]][0] + _END[s[-1]][0]
    e = _END[s[0]][1] + _END[s[-1]][1]
    for i in range(len(s) - 1):
        dh, ds = STACKS[s[i : i + 2]]
        h += dh
        e += ds
    same = s.translate(_COMPLEMENT)[::-1] == s
    if same:
        e -= 1.4
    e += 0.368 * (len(s) - 1) * log(SODIUM)
    return 1000 * h / (e + 1.987 * log(OLIGO / 1e9 / (1 if same else 4))) - 273.15


def end_stability(seq: str) -> float:
    s = seq.upper()[-5:]
    return round(sum(_STABILITY[s[i : i + 2]] for i in range(len(s) - 1)) - _END_STABILITY[s[0]] - _END_STABILITY[s[-1]], 2)


def gc(seq: str) -> float:
    return 100.0 * sum(c in "GCgc" for c in seq) / len(seq)


def penalty(melting: float, size: int, opt_tm: float = OPT_TM, opt_size: float = OPT_SIZE) -> float:
    return abs(melting - opt_tm) + abs(size - opt_size)


def product_tm(seq: str) -> float:
    return 81.5 + 16.6 * log10(SODIUM) + 0.41 * gc(seq) - 600 / len(seq)


def annealing(least_oligo_tm: float, of_product: float) -> float:
    return 0.3 * least_oligo_tm + 0.7 * of_product - 14.9


def _sum(col: Column, table: dict[str, float], frm: int, to: Column) -> Column:
    values = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.aggregate(F.sequence(F.lit(frm), to), F.lit(0.0), lambda a, i: a + F.element_at(values, F.substring(col, i, 2)))


def _pick(col: Column, table: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), col)


def tm_column(col: Column) -> Column:
    """``tm`` of each sequence of two bases or more; null for those with other characters."""
    s = F.upper(col)
    n = F.length(s)
    first, last = F.substring(s, 1, 1), F.substring(s, n, 1)
    h = _sum(s, {k: v[0] for k, v in STACKS.items()}, 1, n - 1) + _pick(first, {k: v[0] for k, v in _END.items()}) + _pick(last, {k: v[0] for k, v in _END.items()})
    e = _sum(s, {k: v[1] for k, v in STACKS.items()}, 1, n - 1) + _pick(first, {k: v[1] for k, v in _END.items()}) + _pick(last, {k: v[1] for k, v in _END.items()})
    same = F.reverse(F.translate(s, "ACGT", "TGCA")) == s
    e = e + F.when(same, -1.4).otherwise(0.0) + 0.368 * (n - 1) * F.lit(log(SODIUM))
    melting = 1000 * h / (e + 1.987 * F.when(same, F.lit(log(OLIGO / 1e9))).otherwise(F.lit(log(OLIGO / 4e9)))) - 273.15
    return F.when(n >= 2, melting)


def penalty_column(melting: Column, size: Column) -> Column:
    return F.abs(melting - OPT_TM) + F.abs(size - OPT_SIZE)


def end_stability_column(col: Column) -> Column:
    """Of the last five bases; null for shorter sequences."""
    s = F.upper(F.substring(col, -5, 5))
    total = _sum(s, _STABILITY, 1, F.lit(4)) - _pick(F.substring(s, 1, 1), _END_STABILITY) - _pick(F.substring(s, 5, 1), _END_STABILITY)
    return F.when(F.length(col) >= 5, F.round(total, 2))
