"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, arrow_map, chunks, text_buffers, words_of

FEATURES = ("length", "upper", "symbol", "exclaim", "pipe", "digit", "repeat", "echo", "word_length", "sentence", "line")
D = len(FEATURES)

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _SYMBOL, _EXCLAIM, _PIPE, _STOP, _OTHER, _CONT = range(11)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = _LOWER, _UPPER, _DIGIT
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = _SPACE, _LINE
_CLASS[[ord(c) for c in "#$%&*@~^=+<>{}[]\\_`"]] = _SYMBOL
_CLASS[[ord("!"), ord("?")]], _CLASS[ord("|")], _CLASS[ord(".")] = _EXCLAIM, _PIPE, _STOP
_CLASS[128:192] = _CONT
_K = 11
_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("f", T.ArrayType(T.DoubleType()))])


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text. Every share is smoothed towards that of ordinary prose, so short and empty texts give mild values."""
    n = len(off) - 1
    out = np.empty((n, D))
    for i, j in chunks(off):
        part = off[i : j + 1]
        m = j - i
        row = np.repeat(np.arange(m, dtype=np.int64), np.diff(part))
        c = np.bincount(row * _K + _CLASS[raw[part[0] : part[-1]]], minlength=m * _K).reshape(m, _K).astype(float)
        start, end, at, h = words_of(raw, part)
        words = np.bincount(at, minlength=m).astype(float)
        same = np.zeros(len(h), bool)
        np.logical_and(h[1:] == h[:-1], at[1:] == at[:-1], out=same[1:])
        repeat = np.bincount(at[same], minlength=m)
        echo = np.zeros(len(h), bool)
        if len(h) > 2:
            np.logical_and(h[2:] == h[:-2], at[2:] == at[:-2], out=echo[2:])
        echo = np.bincount(at[echo], minlength=m)
        chars = c.sum(1) - c[:, _CONT]
        letters = c[:, _LOWER] + c[:, _UPPER] + c[:, _OTHER]

        def share(count, of, usual, weight):
            return np.log((count + usual * weight) / (of + weight))

        f = out[i:j]
        f[:, 0] = np.log1p(chars)
        f[:, 1] = share(c[:, _UPPER], letters, 0.03, 60)
        f[:, 2] = share(c[:, _SYMBOL], chars, 0.002, 60)
        f[:, 3] = share(c[:, _EXCLAIM], chars, 0.002, 60)
        f[:, 4] = share(c[:, _PIPE], words, 0.01, 3)
        f[:, 5] = share(c[:, _DIGIT], chars, 0.005, 60)
        f[:, 6] = share(repeat, words, 0.01, 15)
        f[:, 7] = share(echo, words, 0.01, 15)
        f[:, 8] = share(letters, words, 5.0, 15)
        f[:, 9] = share(c[:, _STOP], words, 0.08, 30)
        f[:, 10] = share(c[:, _LINE], words, 0.02, 30)
    return out


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, f) of each row over its whole text; null text counts as empty."""

    def run(batches):
        for b in batches:
            raw, off = text_buffers(b.column(1))
            f = statistics(raw, off)
            col = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * D, pa.int32()), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), col], names=["doc_id", "f"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, _SCHEMA)


@dataclass(frozen=True)
class Model:
    """Class means and inverse Cholesky factors of the shrunk covariances, for standardised features."""

    prior: float
    mean: np.ndarray | None = None  # 2 x D
    inv: np.ndarray | None = None  # 2 x D x D
    log_det: np.ndarray | None = None
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None
    temperature: float = 4.0

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), np.log(self.prior / (1 - self.prior)))
        if self.mean is not None:
            x = (x - self.shift) / self.scale
            dist = [(((x - self.mean[k]) @ self.inv[k].T) ** 2).sum(1) + self.log_det[k] for k in (0, 1)]
            odds += (dist[0] - dist[1]) / 2
        return 1 / (1 + np.exp(np.clip(-odds / self.temperature, -700, 700)))


def fit(labelled: DataFrame, shrink: float = 0.1, ridge: float = 1e-3, temperature: float = 4.0) -> Model:
    """Quadratic discriminant from (quality, f). All labelled rows count: each task sums first and second
    moments, and the driver gets two classes' sums whatever the input's size. Each class covariance is
    shrunk by ``shrink`` towards the pooled one and by the same towards its diagonal; ``ridge`` (in
    standard deviations) keeps constant features harmless. With a class unseen the score is the smoothed prior.
    """
    width = 1 + D + D * D

    def run(batches):
        sums = np.zeros((2, width))
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            for k in (0, 1):
                z = x[y == k]
                sums[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        k, i = np.indices(sums.shape)
        yield pa.RecordBatch.from_pydict({"k": k.ravel().astype(np.int32), "i": i.ravel().astype(np.int32), "v": sums.ravel()})

    rows = arrow_map(labelled.where("quality in (0, 1)").select(F.col("quality").cast("int"), "f"), run, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((2, width))
    for r in rows:
        sums[r.k, r.i] = r.v
    n = sums[:, 0]
    prior = float((n[1] + 1) / (n.sum() + 2))
    if n.min() < 2:
        return Model(prior, temperature=temperature)
    mean = sums[:, 1 : 1 + D] / n[:, None]
    second = sums[:, 1 + D :].reshape(2, D, D)
    cov = np.stack([second[k] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)])
    pooled = (cov * n[:, None, None]).sum(0) / n.sum()
    shift = mean[1]
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
    unit = np.outer(scale, scale)
    inv, log_det = [], []
    for k in (0, 1):
        c = ((1 - shrink) * cov[k] + shrink * pooled) / unit
        c = (1 - shrink) * c + shrink * np.diag(np.diag(c)) + ridge * np.eye(D)
        low = np.linalg.cholesky(c)
        inv.append(np.linalg.inv(low))
        log_det.append(2 * np.log(np.diag(low)).sum())
    return Model(prior, (mean - shift) / scale, np.stack(inv), np.array(log_det), shift, scale, temperature)


def score(feats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of features."""

    def run(batches):
        for b in batches:
            s = model.score(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, D))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return arrow_map(feats.select("doc_id", "f"), run, "doc_id long, score double")


def fold(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Learns from labelled rows whose crc32(doc_id) mod 5 is not 0; null or other quality values teach
    nothing. Null and empty texts are scored like any other. A null doc_id is scored and is held out
    (false for ``held_out`` would claim a fold it has not). Repeated rows come out as often as they came
    in; other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    feats = scratch.save(features(docs), "features")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    model = fit(feats.where(fold(5) != 0).join(marks, "doc_id").select("quality", "f"))
    out = score(feats, model)
    return out.select("doc_id", F.coalesce(fold(5) == 0, F.lit(True)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows whose document is predicted 0 go; all other rows stay, null ids too."""
    verdict = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    gone = verdict.where("predicted = 0").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
