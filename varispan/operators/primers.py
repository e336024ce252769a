"""Primer pairs around a target by the closed-form nearest-neighbour figures.

The self, hairpin and complement columns need a thermodynamic alignment that this designer does not
model: they are null, and no pair is turned down on their account.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..deploy import ship
from ..functions import thermo as T

COLUMNS = [
    "pair_product_size", "pair_penalty", "left_sequence", "right_sequence", "left_penalty", "right_penalty", "left_tm", "right_tm", "left_gc_percent", "right_gc_percent",
    "left_self_any_th", "right_self_any_th", "left_self_end_th", "right_self_end_th", "left_hairpin_th", "right_hairpin_th", "left_end_stability", "right_end_stability", "pair_compl_any_th", "pair_compl_end_th",
]
_KIND = {"pair_product_size": "int", "left_sequence": "string", "right_sequence": "string"}
#: Besides COLUMNS: where the primers lie in the template.
PLACES = ["left_start", "left_len", "right_end", "right_len"]
SCHEMA = ", ".join(f"{c} {_KIND.get(c, 'double')}" for c in COLUMNS) + ", " + ", ".join(f"{c} int" for c in PLACES)


@dataclass(frozen=True)
class PrimerOptions:
    tm: tuple[float, float] = (53, 68)
    gc: tuple[float, float] = (40, 70)
    amp_size: tuple[int, int] = (70, 150)
    primer_size: tuple[int, int] = (25, 35)
    max_sec_tm: float = 40
    gc_clamp: int = 1
    max_end_gc: int = 4
    max_poly_x: int = 4

    @property
    def opt_tm(self) -> float:
        return sum(self.tm) / 2

    @property
    def opt_size(self) -> float:
        return sum(self.primer_size) / 2


class Designer(Protocol):
    def design(self, template: str, target_start: int, target_len: int, options: PrimerOptions) -> dict | None: ...


_OTHER = str.maketrans("ACGTacgt", "TGCAtgca")


def reverse_complement(seq: str) -> str:
    return seq.translate(_OTHER)[::-1]


def acceptable(seq: str, o: PrimerOptions) -> float | None:
    """Penalty of a primer that meets every limit, else none."""
    s = seq.upper()
    if set(s) - set("ACGT") or not o.gc[0] <= T.gc(s) <= o.gc[1]:
        return None
    if any(b * (o.max_poly_x + 1) in s for b in "ACGT"):
        return None
    if o.gc_clamp and set(s[-o.gc_clamp :]) - set("GC"):
        return None
    if sum(c in "GC" for c in s[-5:]) > o.max_end_gc:
        return None
    melting = T.tm(s)
    if not o.tm[0] <= melting <= o.tm[1]:
        return None
    return T.penalty(melting, len(s), o.opt_tm, o.opt_size)


#: Codes of bases by byte, A C G T to 0..3 in either case and 4 for all else; figures of a stack by 4 * code + next code.
_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate("ACGT"):
    _CODE[[ord(_b), ord(_b.lower())]] = _i
_STACK_H, _STACK_S = (np.array([T.STACKS[x + y][i] for x in "ACGT" for y in "ACGT"]) for i in (0, 1))
_END_H, _END_S = (np.array([T._END[x][i] for x in "ACGT"]) for i in (0, 1))


def _melting(code: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``thermo.tm`` of stretches of ``code``, which have no other letters than ACGT: the same terms in the same order."""
    first, last = code[start], code[start + size - 1]
    h, e = _END_H[first] + _END_H[last], _END_S[first] + _END_S[last]
    stack = 4 * code[:-1].astype(np.int64) + code[1:]
    i = np.arange(int(size.max()) - 1)
    on = i < size[:, None] - 1
    at = stack[np.where(on, start[:, None] + i, start[:, None])]
    # running sums go from left to right, where a plain sum would pair its terms
    total = lambda first, table: np.cumsum(np.column_stack([first, np.where(on, table[at], 0.0)]), axis=1)[:, -1]
    h, e = total(h, _STACK_H), total(e, _STACK_S)
    same = (size % 2 == 0) & (first + last == 3)
    for j in np.flatnonzero(same):
        own = code[start[j] : start[j] + size[j]]
        same[j] = (own + own[::-1] == 3).all()
    e = np.where(same, e - 1.4, e) + 0.368 * (size - 1) * log(T.SODIUM)
    return 1000 * h / (e + np.where(same, 1.987 * log(T.OLIGO / 1e9), 1.987 * log(T.OLIGO / 1e9 / 4))) - 273.15


def acceptable_all(seq: str, start: np.ndarray, size: np.ndarray, o: PrimerOptions) -> tuple[np.ndarray, np.ndarray]:
    """``acceptable`` of all stretches of ``seq`` at once: which of them it takes, and their penalties. Running sums tell all but the melting temperature, for those that are left."""
    code = _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    end = start + size
    count = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    other, gc = count(code > 3), count((code == 1) | (code == 2))
    ratio = 100.0 * (gc[end] - gc[start]) / size
    ok = (other[end] == other[start]) & (o.gc[0] <= ratio) & (ratio <= o.gc[1])
    m = o.max_poly_x + 1
    runs = np.ones(max(0, len(code) - m + 1), bool)
    for i in range(1, m):
        runs &= code[i : i + len(runs)] == code[: len(runs)]
    runs = count(runs)
    ok &= (size < m) | (runs[np.maximum(end - m + 1, start)] == runs[start])
    if o.gc_clamp:
        clamp = np.minimum(size, o.gc_clamp)
        ok &= gc[end] - gc[end - clamp] == clamp
    ok &= gc[end] - gc[end - np.minimum(size, 5)] <= o.max_end_gc
    kept = np.flatnonzero(ok)
    if not len(kept):
        return kept, np.zeros(0)
    melting = _melting(code, start[kept], size[kept])
    warm = (o.tm[0] <= melting) & (melting <= o.tm[1])
    return kept[warm], np.abs(melting[warm] - o.opt_tm) + np.abs(size[kept[warm]] - o.opt_size)


#: Letters that are judged at once.
STRETCH = 1 << 18


def usable_kmers(df: DataFrame, k: int, options: PrimerOptions) -> DataFrame:
    """(key, n, least_penalty) of ``df`` of a key and a sequence, in that order: how many k-mers are acceptable and the least penalty.

    One row per sequence or stretch of it that has any, to be added up by key. Sequences are judged many at a time with a letter between
    them that no primer has, long ones in stretches that overlap by k - 1.
    """
    ship(df.sparkSession)
    key, column = df.columns
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n long, least_penalty double"

    def judged(rows: list[int], parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text = "-".join(parts)
        begins = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])[:-1]])
        start = np.arange(len(text) - k + 1)
        kept, penalty = acceptable_all(text, start, np.full(len(start), k), options)
        part, first, n = np.unique(np.searchsorted(begins, kept, "right") - 1, return_index=True, return_counts=True)
        return np.array(rows, np.int64)[part], n, np.minimum.reduceat(penalty, first) if len(kept) else penalty

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows, parts, held, out = [], [], 0, []
            for i, seq in enumerate(batch.column(column).to_pylist()):
                for at in range(0, len(seq or "") - k + 1, STRETCH):
                    rows.append(i)
                    parts.append(seq[at : at + STRETCH + k - 1])
                    held += len(parts[-1])
                    if held >= STRETCH:
                        out.append(judged(rows, parts))
                        rows, parts, held = [], [], 0
            if parts:
                out.append(judged(rows, parts))
            if out:
                at, n, least = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)), pa.array(n, pa.int64()), pa.array(least, pa.float64())], [key, "n", "least_penalty"])

    return df.mapInArrow(run, schema)


class NearestNeighborDesigner:
    """The pair of least summed penalty; ties go to the leftmost, then shortest, left and right primer."""

    def design(self, template: str, target_start: int, target_len: int, options: PrimerOptions) -> dict | None:
        o, n, behind = options, len(template), target_start + target_len
        sizes = np.arange(o.primer_size[0], o.primer_size[1] + 1)

        def ranked(seq: str, start: np.ndarray, size: np.ndarray, place: np.ndarray):
            """(penalty, place, size) of the primers of ``seq``, least first."""
            kept, penalty = acceptable_all(seq, start, size, o)
            order = np.lexsort((size[kept], place[kept], penalty))
            return penalty[order], place[kept][order], size[kept][order]

        # a primer can't lie further out than the largest product allows
        start, size = (x.ravel() for x in np.meshgrid(np.arange(max(0, behind - o.amp_size[1]), target_start), sizes, indexing="ij"))
        fits = start + size <= min(n, target_start)
        lp, ls, ll = ranked(template, start[fits], size[fits], start[fits])
        if not len(lp):
            return None
        end, size = (x.ravel() for x in np.meshgrid(np.arange(behind, min(n, target_start + o.amp_size[1])), sizes, indexing="ij"))
        fits = end - size + 1 >= behind
        rp, re_, rl = ranked(reverse_complement(template), n - 1 - end[fits], size[fits], end[fits])
        if not len(rp):
            return None
        best = None
        for p, s, w in zip(lp.tolist(), ls.tolist(), ll.tolist()):
            if best is not None and p + rp[0] > best[0]:
                break
            product = re_ - s + 1
            fits = np.flatnonzero((o.amp_size[0] <= product) & (product <= o.amp_size[1]))
            if not len(fits):
                continue
            total = p + rp[fits]
            # sums may round to the same
            pair = min((float(total[0]), s, w, int(re_[i]), int(rl[i])) for i in fits[total == total[0]])
            best = pair if best is None else min(best, pair)
        if best is None:
            return None
        return self.describe(template, *best[1:], o)

    def describe(self, template: str, ls: int, ll: int, re_: int, rl: int, o: PrimerOptions) -> dict:
        left, right = template[ls : ls + ll], reverse_complement(template[re_ - rl + 1 : re_ + 1])
        out: dict = {c: None for c in COLUMNS}
        for side, seq in (("left", left), ("right", right)):
            melting = T.tm(seq)
            out |= {f"{side}_sequence": seq, f"{side}_tm": melting, f"{side}_penalty": T.penalty(melting, len(seq), o.opt_tm, o.opt_size), f"{side}_gc_percent": T.gc(seq), f"{side}_end_stability": T.end_stability(seq)}
        out |= {"pair_product_size": re_ - ls + 1, "pair_penalty": out["left_penalty"] + out["right_penalty"]}
        return out | {"left_start": ls, "left_len": ll, "right_end": re_, "right_len": rl}


def product_figures(template: str, pair: dict) -> dict[str, float]:
    """The figures of a pair's product, of the alignment text alone."""
    product = T.product_tm(template[pair["left_start"] : pair["right_end"] + 1])
    low = min(pair["left_tm"], pair["right_tm"])
    return {"Product Tm": product, "Product Tm Oligo Tm Diff": product - low, "T Opt A": T.annealing(low, product)}


def design_rows(df: DataFrame, options: PrimerOptions | None = None, designer: Designer | None = None, keep_failed: bool = False) -> DataFrame:
    """``df`` (with template, target_start, target_len) and the pair's columns; rows without a pair go, or keep nulls. Each row is designed by itself, in Arrow batches."""
    ship(df.sparkSession)
    options, designer = options or PrimerOptions(), designer or NearestNeighborDesigner()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + SCHEMA
    added = COLUMNS + PLACES

    def run(frames: Iterator[pd.DataFrame]):
        for f in frames:
            got = [designer.design(t, int(s), int(n), options) for t, s, n in zip(f["template"], f["target_start"], f["target_len"])]
            keep = [keep_failed or g is not None for g in got]
            f = f[keep].reset_index(drop=True)
            rows = [g or {} for g, k in zip(got, keep) if k]
            for c in added:
                f[c] = pd.Series([r.get(c) for r in rows], dtype="object")
            for c in [*PLACES, "pair_product_size"]:
                f[c] = f[c].astype("Int32")
            for c in added:
                if c not in PLACES and c not in _KIND:
                    f[c] = f[c].astype("Float64")
            yield f

    return df.mapInPandas(run, schema)


def parse_settings(text: str) -> dict:
    """``key=value`` settings; values split at spaces and semicolons, then at commas and dashes, as int unless they hold a dot; ``=`` ends them."""
    import re

    out = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line == "=":
            continue
        key, _, value = line.partition("=")

        def number(x: str):
            try:
                return float(x) if "." in x else int(x)
            except ValueError:
                return x

        parts = [[number(y) for y in re.split(r"[,-]", x) if y] for x in re.split(r"[ ;]+", value) if x]
        flat = [p[0] if len(p) == 1 else p for p in parts]
        out[key] = flat[0] if len(flat) == 1 and not isinstance(flat[0], list) else flat
    return out
