"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text becomes the counts of its letter 1- to 3-grams (lower case, other
characters are one blank between words) in ``2 ** BITS`` hashed buckets, with
1 + log damping, times the inverse document frequency, at unit length. Every
language has several centroids, found by spherical k-means over a bounded
sample of its learning rows; a text goes to the language of the centroid with
the greatest cosine. Texts whose best cosine is below ``reject`` are marked
``rejected``: they are far from all that was learned.

Document frequencies count every learning row on Spark. The sample, at most
``per_lang`` rows of a language with the smallest hash of their id, bounds each
language's group; the model, ``clusters`` vectors a language, is broadcast.

Cases: null texts and texts without a letter are ``und`` with score 0. Texts of
any length are read whole, in pieces of ``PIECE`` characters. Rows without a
language or an id are not learned from. Repeated rows count as often as they
stand. With nothing to learn every text is ``und``. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BITS = 13
DIM = 1 << BITS
PIECE = 1 << 20
UND = "und"


@functools.cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Bucket counts of the 1- to 3-grams of a text."""
    out = np.zeros(DIM, np.int64)
    tail = ""
    for at in range(0, len(text), PIECE):
        part = text[at:at + PIECE].lower()
        c = np.frombuffer((tail or " ").encode("utf-32-le", "surrogatepass") + part.encode("utf-32-le", "surrogatepass") + b" \0\0\0" * (at + PIECE >= len(text)), "<u4")
        c = np.where(_letters()[c], c, np.uint32(32))
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
        c = c[keep]
        old = min(2, len(tail)) if tail else 0  # grams inside the carried characters are counted already
        h = c.astype(np.uint32) * np.uint32(0x9E3779B1)
        for n in range(1, 4):
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[n - 1:] * np.uint32(0xC2B2AE3D)
            start = max(0, old - n + 1)
            out += np.bincount(((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS))[start:], minlength=DIM)
        tail = "".join(map(chr, c[-2:].tolist()))
    return out


def vectors(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of rows of counts."""
    x = np.where(rows > 0, 1 + np.log(np.maximum(rows, 1)), 0).astype(np.float32) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k unit centroids; the first near the mean, each next the row farthest from those so far."""
    mean = x.mean(axis=0)
    chosen = [int(np.argmax(x @ mean))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)) and near.min() < 0.999:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen].copy()
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T, axis=1)
        new = np.stack([x[nearest == j].sum(axis=0) if (nearest == j).any() else centres[j] for j in range(len(centres))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class Model:
    def __init__(self, idf: np.ndarray, names: list[str], centres: np.ndarray):
        self.idf, self.names, self.centres = idf, names, centres

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        got, scores = [UND] * len(texts), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if has_letter(t)] if self.names else []
        for at in range(0, len(rows), 256):
            part = rows[at:at + 256]
            near = vectors(np.stack([counts(texts[i]) for i in part]), self.idf) @ self.centres.T
            best = near.argmax(axis=1)
            for i, j, s in zip(part, best.tolist(), near.max(axis=1).tolist()):
                got[i], scores[i] = self.names[j], min(1.0, max(0.0, s))
        return got, scores


def fit(docs: DataFrame, clusters: int = 4, per_lang: int = 600) -> Model:
    learn = docs.select("doc_id", "text", "lang").where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for t in batch["text"]:
                df += counts(t) > 0
                n += 1
        yield pd.DataFrame({"bucket": np.append(np.flatnonzero(df), -1), "n": np.append(df[df > 0], n)})

    found = (learn.select("text").mapInPandas(frequencies, "bucket int, n long")
             .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas())
    df = np.zeros(DIM)
    inside = found[found["bucket"] >= 0]
    df[inside["bucket"].to_numpy()] = inside["n"]
    total = float(found.loc[found["bucket"] < 0, "n"].sum())
    idf = (np.log((1 + total) / (1 + df)) + 0.1).astype(np.float32)

    # Ids are ranked on narrow rows; only the sample's texts are joined to them.
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # A common language is ranked in salted parts first, so no task sees all of its ids.
    salted = W.partitionBy("lang", "_salt").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (learn.select("doc_id", "lang").distinct().withColumn("_salt", F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(64)))
           .withColumn("_rank", F.row_number().over(salted)).where(F.col("_rank") <= per_lang)
           .withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_lang).select("doc_id", "lang"))

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [t for t in pdf.sort_values("doc_id")["text"] if has_letter(t)]
        if not texts:
            return pd.DataFrame({"lang": [], "centre": []})
        x = vectors(np.stack([counts(t) for t in texts]), idf)
        centres = spherical_kmeans(x, clusters)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centre": [c.tobytes() for c in centres]})

    # At most per_lang ids a language: a bounded broadcast. An id that repeats gives one row.
    model = (learn.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").dropDuplicates(["doc_id", "lang"]).groupBy("lang")
             .applyInPandas(centroids, "lang string, centre binary").toPandas().sort_values(["lang", "centre"]))
    centres = np.stack([np.frombuffer(c, np.float32) for c in model["centre"]]) if len(model) else np.zeros((0, DIM), np.float32)
    return Model(idf, model["lang"].tolist(), centres)


def predict(docs: DataFrame, model: Model, reject: float = 0.1) -> DataFrame:
    """doc_id, lang_pred, score, rejected."""
    shared = SparkSession.active().sparkContext.broadcast((model.idf, model.names, model.centres))

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Model(*shared.value)
        for batch in batches:
            got, scores = m.predict(batch.tolist())
            yield pd.DataFrame({"lang_pred": got, "score": scores})

    return docs.select("doc_id", run("text").alias("_got")).select(
        "doc_id", "_got.lang_pred", "_got.score", (F.col("_got.score") < reject).alias("rejected"))
