"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; every other text of the learning rows
is unlabelled, its label unread. A linear score over hashed features is fitted
with the logistic loss on the class-prior-corrected risk

    R = prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]),

taking a step back along the second part whenever it falls below zero, so the
classifier can't win by overfitting the positives. The class prior is the rate
of toxic rows among all labelled learning rows, counted on Spark.

Features: presence of each word (lower case, outer punctuation stripped) and of
each longer word's first letters, in ``2 ** BITS`` buckets. The fit runs in
numpy on the driver on bounded samples, at most ``positives`` and ``unlabelled``
rows (those with the smallest hash of their id, so runs agree); scoring reads
every whole text.

Cases: null, empty and white texts have no features and get the score of the
intercept. Repeated rows score alike. Ids without a label are unlabelled; with
no positive row at all every score is 0. Null ids are never learned from. Other
columns are not read by ``fit`` and pass through ``keep_clean``.
"""

from __future__ import annotations

import functools
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cache

BITS = 20
PREFIX = 5
CACHE = 24 << 20              # bytes of hashed words per worker
THRESHOLD = 0.7
LEAST_CONTRAST = 0.4


@functools.cache
def _cache() -> Cache:
    return Cache(CACHE)


def feature_ids(text: str | None) -> np.ndarray:
    """Buckets of the distinct words of a text and of their first letters."""
    cache, out = _cache(), set()
    for word in set((text or "").lower().split()):
        got = cache.get(word)
        if got is None:
            core = word.strip(string.punctuation)
            got = (zlib.crc32(core.encode()) >> (32 - BITS),
                   zlib.crc32(b"^" + core[:PREFIX].encode()) >> (32 - BITS) if len(core) > PREFIX else -1)
            cache.keep(word, got, len(word) + 130)
        out.update(got)
    out.discard(-1)
    return np.fromiter(out, np.int32, len(out))


def _rows(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists])
    return np.repeat(np.arange(len(lists)), sizes), np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int64)


def contrast(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, errors: float = 2.0) -> np.ndarray:
    """How much more common a bucket surely is among positives than among
    unlabelled texts: the log ratio less ``errors`` standard errors, 0 if that is
    below ``LEAST_CONTRAST`` of the most it can be, log(1 / prior). It scales the
    bucket's feature."""
    dim = 1 << BITS
    p = np.bincount(_rows(positive)[1], minlength=dim) + 0.5
    u = np.bincount(_rows(unlabelled)[1], minlength=dim) + 0.5
    sure = np.log(p / len(positive)) - np.log(u / len(unlabelled)) - errors * np.sqrt(1 / p + 1 / u)
    return np.where(sure > LEAST_CONTRAST * -np.log(min(max(prior, 1e-6), 0.99)), sure, 0.0)


def nnpu_fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 60,
             batches: int = 8, rate: float = 0.02, decay: float = 1e-4, beta: float = 0.0, seed: int = 7) -> np.ndarray:
    """Weights of the buckets, the intercept last (Adam on the non-negative risk, logistic loss)."""
    dim = 1 << BITS
    if not positive or not unlabelled:
        return np.concatenate([np.zeros(dim), [-np.inf]])
    scale = contrast(positive, unlabelled, prior)
    # Buckets without contrast stay at zero; only the others are numbered and fitted.
    active = np.flatnonzero(scale)
    number = np.full(dim, -1, np.int64)
    number[active] = np.arange(len(active))
    positive, unlabelled = ([number[x][number[x] >= 0] for x in part] for part in (positive, unlabelled))
    whole, dim, scale = dim, len(active), scale[active]
    w = np.concatenate([np.ones(dim), [-2.0]])
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    rng = np.random.default_rng(seed)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for _ in range(epochs):
        deal_p = np.array_split(rng.permutation(len(positive)), batches)
        deal_u = np.array_split(rng.permutation(len(unlabelled)), batches)
        for ip, iu in zip(deal_p, deal_u):
            if not len(ip) or not len(iu):
                continue
            (rp, fp), (ru, fu) = _rows([positive[i] for i in ip]), _rows([unlabelled[i] for i in iu])
            zp = np.bincount(rp, (w[:dim] * scale)[fp], len(ip)) + w[dim]
            zu = np.bincount(ru, (w[:dim] * scale)[fu], len(iu)) + w[dim]
            sp, su = sigmoid(zp), sigmoid(zu)
            # Slopes of log(1 + exp(z)) and log(1 + exp(-z)).
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if negative < -beta:  # step back along the negative part alone
                gp, gu = prior * sp / len(ip), -su / len(iu)
            else:
                gp, gu = (prior * (sp - 1) - prior * sp) / len(ip), su / len(iu)
            g = (np.bincount(fp, gp[rp], dim + 1) + np.bincount(fu, gu[ru], dim + 1)).astype(float)
            g[:dim] *= scale
            g[dim] = gp.sum() + gu.sum()
            g[:dim] += decay * w[:dim]
            step += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    out = np.zeros(whole + 1)
    out[active] = w[:dim] * scale
    out[-1] = w[dim]
    return out


def margins(rows: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    i, f = _rows(rows)
    return np.bincount(i, w[f], len(rows)) + w[-1]


def calibrate(w: np.ndarray, rows: list[np.ndarray], toxic: np.ndarray, at: float = THRESHOLD) -> np.ndarray:
    """Shift the intercept so that the cut with the best F1 on labelled rows kept
    out of the fit scores ``at``; among equal cuts the middle of the widest gap."""
    if not toxic.any() or toxic.all() or not np.isfinite(w[-1]):
        return w
    z = margins(rows, w)
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(toxic[order])
    n = np.arange(1, len(z) + 1)
    f1 = 2 * hits / (n + toxic.sum())
    sorted_z = z[order]
    gap = np.append(sorted_z[:-1] - sorted_z[1:], 1.0)
    best = max(range(len(z)), key=lambda i: (round(f1[i], 9) if gap[i] > 0 else -1.0, gap[i]))
    out = w.copy()
    out[-1] += np.log(at / (1 - at)) - (sorted_z[best] - gap[best] / 2)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, positives: int = 4_000, unlabelled: int = 16_000, kept_out: int = 6_000) -> np.ndarray:
    """Weights learned from the rows that are not held out.

    A quarter of the learning rows (by hash) is kept out of the risk and only
    calibrates the cut. The samples are bounded; the prior counts all labels.
    """
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    learn = docs.select("doc_id", "text").where("doc_id is not null").where(~held_out(F.col("doc_id")))
    order = F.xxhash64(F.col("doc_id"))
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibration")), F.lit(4)) == 0
    rates = (marks.where("_id is not null and _toxic is not null").where(~held_out(F.col("_id")))
             .agg(F.avg((F.col("_toxic") == 1).cast("double"))).first()[0])
    known = learn.join(marks.where("_toxic is not null"), learn["doc_id"] == marks["_id"]).select("doc_id", "text", "_toxic")

    @F.pandas_udf("binary")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        _cache().alone()
        for batch in batches:
            yield pd.Series([feature_ids(t).tobytes() for t in batch], dtype=object)

    def sample(rows: DataFrame, n: int, *more: str) -> pd.DataFrame:
        # Ids are drawn on narrow rows first, so texts of the sample alone are read again.
        # The n smallest hashes lie below this cut but for a vanishing chance; it keeps the sort small.
        ids = rows.select("doc_id").distinct()
        part = min(1.0, 4 * n / max(1, ids.count()))
        if part < 1:
            ids = ids.where(order <= F.lit(int(-(2 ** 63) + part * 2 ** 64)))
        ids = ids.orderBy(order, "doc_id").limit(n)
        # An id that repeats gives one row, its least text, so the bounds hold for rows too.
        drawn = rows.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *more)).alias("x"))
        return drawn.select(features("x.text").alias("f"), *[F.col(f"x.{c}") for c in more]).toPandas()

    arrays = lambda pdf: [np.frombuffer(f, np.int32) for f in pdf["f"]]
    p = sample(known.where("_toxic = 1").where(~share), positives)
    u = sample(learn.where(~share), unlabelled)
    c = sample(known.where(share), kept_out, "_toxic")
    w = nnpu_fit(arrays(p), arrays(u), float(rates or 0.0))
    return calibrate(w, arrays(c), (c["_toxic"] == 1).to_numpy()).astype(np.float32)


def score(text: Column, w: np.ndarray) -> Column:
    """The score of a text column; the weights go to the workers in a broadcast."""
    from pyspark.sql import SparkSession
    shared = SparkSession.active().sparkContext.broadcast(w)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = shared.value
        _cache().alone()
        for batch in batches:
            yield pd.Series([score_text(t, weights) for t in batch], dtype="float64")

    return run(text)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns."""
    w = fit(docs, labels)
    return docs.where(score(docs["text"], w) < threshold)


def score_text(text: str | None, w: np.ndarray) -> float:
    z = float(w[feature_ids(text)].sum() + w[-1])
    return float(1 / (1 + np.exp(-np.clip(z, -700, 700)))) if np.isfinite(z) else 0.0
