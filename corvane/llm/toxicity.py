"""Toxicity by non-negative positive-unlabelled learning (operator 6).

Confirmed toxic documents are the positives, all other text is unlabelled. A few
linear classifiers over hashed words are fitted in numpy by the non-negative
estimator of the risk (Kiryo et al. 2017):

    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-))

where the second term, the risk of the hidden negatives, is never allowed below
zero. Fitting uses a bounded sample, scoring all texts whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import small_batches, without, written
from corvane.llm.words import combine, mix, word_hashes

BITS = 18


@dataclass
class ToxicityModel:
    """``weights``: one row a classifier, one column a hashed word, float32; ``bias``: one a classifier; ``prior``: the class prior used."""

    weights: np.ndarray
    bias: np.ndarray
    prior: float


def _features(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature), each pair once, of runs of rows; sorted."""
    for i, _, h, first in word_hashes(col, punctuation=False):
        row = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
        pair = np.unique(row << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64))
        yield (pair >> BITS) + i, pair & (1 << BITS) - 1


def _sample(docs: DataFrame, n: int) -> DataFrame:
    """About ``n`` rows of different texts, chosen by a hash of the text, so that the same rows give the same sample on any cluster.

    Only hashes are sorted and shuffled, those under a bound that about ``2 * n`` rows are under; the at most ``n`` chosen
    ones are broadcast, and texts are read in place.
    """
    spark = docs.sparkSession
    small_batches(spark)
    hashed = docs.select("text", F.xxhash64("text").alias("h"))
    rows = max(1, docs.count())
    below = -(1 << 63) + int((1 << 64) * min(1.0, 2 * n / rows))
    some = hashed.select("h").filter(F.col("h") < F.lit(below)) if below < 1 << 63 else hashed.select("h")
    chosen = some.distinct().orderBy("h").limit(n)
    return hashed.join(F.broadcast(written(chosen, "sample")), "h")


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    def run(batches):
        for b in batches:
            feats = [np.zeros(0, np.int32)] * len(b)
            for row, f in _features(b["text"]):
                cut = np.flatnonzero(np.diff(row)) + 1
                for r, part in zip(row[np.r_[0, cut]] if len(row) else (), np.split(f, cut)):
                    feats[r] = part.astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["h"], pa.array([x.tobytes() for x in feats], pa.binary())], names=["h", "f"])

    one = rows.mapInArrow(run, "h long, f binary").dropDuplicates(["h"]).toArrow().sort_by("h")  # in one order on any cluster
    parts = [np.frombuffer(r, np.int32) for r in one["f"].to_pylist()]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return np.repeat(np.arange(len(parts)), sizes), np.concatenate(parts) if parts else np.zeros(0, np.int32), len(parts)


def _spread(rows: np.ndarray, feats: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The sample less near copies of its own documents, whose shared words would pass for evidence many times over."""
    if not n or not len(feats):
        return rows, feats, n
    begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    at = rows[begin]
    keep = np.ones(n, bool)
    for band in range(6):
        sig = [np.minimum.reduceat(mix(feats.astype(np.uint64) + np.uint64((band * 3 + k + 1) << 32)), begin) for k in range(3)]
        key = combine(combine(sig[0], sig[1]), sig[2])
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(key), bool)
        again[first] = False
        keep[at[again]] = False
    to = np.cumsum(keep) - 1
    k = keep[rows]
    return to[rows[k]], feats[k], int(keep.sum())


def nnpu_fit(pos: tuple[np.ndarray, np.ndarray, int], unl: tuple[np.ndarray, np.ndarray, int], prior: float, classifiers: int = 3, steps: int = 600, rate: float = 3.0, decay: float = 1e-4, min_z: float = 4.0, seed: int = 5) -> ToxicityModel:
    """Classifiers from (row, feature, rows) of positive and unlabelled documents.

    Words are left out whose share of documents doesn't differ between the two samples by ``min_z`` standard
    errors: they carry no evidence, and in long texts their noise adds up. Near copies within a sample count once.
    Each classifier sees a bootstrap sample.
    """
    pos, unl = _spread(*pos), _spread(*unl)
    size = 1 << BITS
    n_p, n_u = max(pos[2], 1), max(unl[2], 1)
    c_p, c_u = np.bincount(pos[1], minlength=size), np.bincount(unl[1], minlength=size)
    pool = (c_p + c_u) / (n_p + n_u)
    z = (c_p / n_p - c_u / n_u) / np.sqrt(np.maximum(pool * (1 - pool), 1e-12) * (1 / n_p + 1 / n_u))
    kept = np.flatnonzero((np.abs(z) >= min_z) & (c_p + c_u >= 5))
    to = np.full(size, -1)
    to[kept] = np.arange(len(kept))
    weights, bias = np.zeros((classifiers, size), np.float32), np.zeros(classifiers)
    rng = np.random.default_rng(seed)
    data = [(r[(k := to[f] >= 0)], to[f][k], n) for r, f, n in (pos, unl)]
    for c in range(classifiers):
        boot = [np.bincount(rng.integers(0, n, n), minlength=n).astype(float) if n else np.zeros(0) for _, _, n in data]
        w, b, gw2, gb2 = np.zeros(len(kept)), 0.0, np.full(len(kept), 1e-8), 1e-8
        if not pos[2] or not unl[2]:
            bias[c] = -1.0
            continue
        for _ in range(steps):
            score = [b + np.bincount(r, w[f], minlength=n) for r, f, n in data]
            sig = [1 / (1 + np.exp(-np.clip(s, -30, 30))) for s in score]
            soft = [np.logaddexp(0, s) for s in score]  # loss as a negative; as a positive: soft - score
            share = [x / x.sum() for x in boot]
            hidden = share[1] @ soft[1] - prior * (share[0] @ soft[0])
            g = [prior * share[0] * (sig[0] - 1), np.zeros(unl[2])]
            sign = 1.0 if hidden >= 0 else -1.0  # below zero: step back up, out of the overfit
            g[0] = (g[0] if sign > 0 else 0) - sign * prior * share[0] * sig[0]
            g[1] = sign * share[1] * sig[1]
            dw = sum(np.bincount(f, gr[r], minlength=len(kept)) for (r, f, _), gr in zip(data, g)) + decay * w
            db = sum(float(x.sum()) for x in g)
            gw2 += dw * dw
            gb2 += db * db
            w -= rate * 0.1 * dw / np.sqrt(gw2)
            b -= rate * 0.1 * db / np.sqrt(gb2)
        weights[c, kept], bias[c] = w, b
    return ToxicityModel(weights, bias, prior)


def fit_toxicity(docs: DataFrame, labels: DataFrame, prior: float | None = None, max_positive: int = 6_000, max_unlabelled: int = 12_000, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> ToxicityModel:
    """A model from ``docs`` and the rows of ``labels`` with ``toxic`` = 1; other labels only set the default ``prior``.

    The sample is bounded: ``max_positive`` confirmed and ``max_unlabelled`` documents of any kind, chosen by hash. ``prior``:
    share of toxic documents in ``docs``; None: their share among the labelled rows, at least 0.001 and at most
    0.5. Null ids match nothing; null labels count as unlabelled; null texts have no words. Without a positive or without an
    unlabelled document the model rejects nothing.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(toxic_col).alias("toxic")).filter("id is not null and toxic is not null")
    if prior is None:
        share = marks.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
        prior = min(0.5, max(0.001, share or 0.001))
    lean = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # of the confirmed ids only those of the least hashes, so that a broadcast of them is bounded
    toxic = marks.filter("toxic = 1").select("id").distinct().join(lean.select("id").distinct(), "id", "left_semi")
    toxic = written(toxic.select("id", F.xxhash64("id").alias("k")).orderBy("k", "id").limit(max_positive).select("id"), "confirmed")
    pos = _collected(_sample(lean.join(F.broadcast(toxic), "id", "left_semi"), max_positive))
    unl = _collected(_sample(lean, max_unlabelled))  # of all documents: the prior is a share of these
    return nnpu_fit(pos, unl, prior)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, text_col: str = "text", prefix: str = "toxic") -> DataFrame:
    """``docs`` with ``toxic_score`` (mean logit of the classifiers, float64) and ``toxic_flag`` (score > 0).

    Null and empty texts have no words: their score is the bias alone. Repeated rows get equal scores. Input columns of
    the output names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = without(docs, f"{prefix}_score", f"{prefix}_flag")
    schema = T.StructType([*docs.schema.fields, T.StructField(f"{prefix}_score", T.DoubleType()), T.StructField(f"{prefix}_flag", T.BooleanType())])
    mean = model.weights.mean(0).astype(np.float64)
    at = np.flatnonzero(mean)
    shared = spark.sparkContext.broadcast((at, mean[at], float(model.bias.mean())))  # at most 2**BITS weights

    def run(batches):
        at, w, b = shared.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        for batch in batches:
            s = np.full(len(batch), b)
            for row, f in _features(batch[text_col]):
                s += np.bincount(row, dense[f], minlength=len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array(s > 0)], schema=batch.schema.append(pa.field(f"{prefix}_score", pa.float64())).append(pa.field(f"{prefix}_flag", pa.bool_())))

    return docs.mapInArrow(run, schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score and flag of every document; see :func:`fit_toxicity` and :func:`toxicity_scores` for nulls, empty texts and repeated rows."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels)
    return toxicity_scores(docs.select("doc_id", "text"), model).select("doc_id", F.round("toxic_score", 6).alias("toxic_score"), "toxic_flag")
