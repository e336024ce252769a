"""Language identification by compression with one zstandard raw-content dictionary per language."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map

_WORD_SIGN = re.compile(r"[^\W\d_]+")
#: Bytes of digits, ASCII punctuation and controls become spaces; letters and all of multi-byte UTF-8 stay.
_ONLY_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """True if a character is a letter (``str.isalpha``); signs such as superscripts and fractions are not."""
    return any(c.isalpha() for run in _WORD_SIGN.finditer(text) for c in run.group())


def normal(text: str) -> bytes:
    """Lower-cased letters with single spaces between runs."""
    return b" ".join(text.lower().encode().translate(_ONLY_LETTERS).split())


def sample(docs: DataFrame, docs_per_lang: int, piece_chars: int) -> DataFrame:
    """(lang, piece): up to ``docs_per_lang`` rows per language, those of smallest hash of doc_id and text. Each task keeps only its own smallest before the shuffle."""
    pick = Window.partitionBy("lang").orderBy("h", "piece")
    rows = docs.where("lang is not null and text is not null").select("lang", F.expr(f"substring(text, greatest(1, (length(text) - {piece_chars}) div 2), {piece_chars})").alias("piece"), F.xxhash64("doc_id", "text").alias("h"))
    return rows.withColumn("r", F.row_number().over(pick)).where(F.col("r") <= docs_per_lang).select("lang", "piece")


def dictionaries(docs: DataFrame, docs_per_lang: int = 200, piece_chars: int = 2000, dict_bytes: int = 256 << 10) -> dict[str, bytes]:
    """Raw dictionary content per language from a bounded sample: at most ``docs_per_lang`` pieces of ``piece_chars``, ``dict_bytes`` in all, for each learned language."""
    got: dict[str, list[bytes]] = {}
    for r in sample(docs, docs_per_lang, piece_chars).orderBy("lang", "piece").collect():
        got.setdefault(r.lang, []).append(normal(r.piece))
    return {k: b" ".join(dict.fromkeys(v))[:dict_bytes] for k, v in sorted(got.items())}


class Sizer:
    """Compressed sizes of a text under every dictionary."""

    def __init__(self, raw: dict[str, bytes], level: int):
        self.langs = list(raw)
        self.by = []
        for lang in self.langs:
            d = zstd.ZstdCompressionDict(raw[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by.append(zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, data: bytes) -> list[int]:
        return [len(c.compress(data)) for c in self.by]


def predict(docs: DataFrame, raw: dict[str, bytes], level: int = 6, margin: float = 0.01) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each row over its whole text.

    The smallest encoding wins, ties to the smaller name. ``score`` is the softmax of minus half the sizes in
    bytes. ``rejected`` marks a lead of under two bytes or under ``margin`` of the runner-up's size; the
    prediction stands beside it. Null text, or one without a letter: ``und``, 0, true.
    """

    def run(batches):
        s = Sizer(raw, level)
        for b in batches:
            langs, scores, rejected = [], [], []
            for t in b.column(1):
                text = t.as_py()
                if not s.langs or text is None or not has_letter(text):
                    langs.append("und")
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                size = np.array(s.sizes(normal(text)))
                best = int(size.argmin())
                rest = np.delete(size, best)
                lead = int(rest.min() - size[best]) if len(rest) else int(size[best])
                langs.append(s.langs[best])
                scores.append(float(1 / np.exp((size[best] - size) / 2).sum()))
                rejected.append(lead < 2 or lead < margin * (size[best] + lead))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, rejected.

    Learns from rows whose crc32(doc_id) mod 3 is not 1. A null doc_id is held out and teaches nothing.
    With nothing to learn from, all is ``und``. Repeated rows come out as often as they came in; columns
    besides doc_id, text and lang are ignored; an empty table gives an empty result.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    out = predict(rows, dictionaries(rows.where(fold != 1)))
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(True)).alias("held_out"), "lang_pred", "score", "rejected")


def op7_langid(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
