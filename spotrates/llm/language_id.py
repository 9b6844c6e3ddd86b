"""Language identification by the nearest centroid.

A text is a vector of its byte n-grams (one to three bytes of the lower-cased
text, hashed), weighted by log(1 + count) times inverse document frequency and
normalised. Every language has several centroids, found by spherical k-means on
a sample of its texts; the language of the centroid with the largest cosine is
predicted. A text further away than ``REJECT`` of its centroid's own training
texts is marked as rejected.

The sample holds about ``TRAIN_DOCS`` documents of each language, chosen by hash
outside the held-out quarter. Inverse document frequencies are counted over all
documents outside that quarter that have a language and a letter.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
documents with a null lang aren't learned from; equal cosines go to the first
centroid by language and number; repeated rows get equal results; without
anything to learn from every text is ``und``; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder_of_crc, staged, table

BITS = 13
SIZE = 1 << BITS
CENTROIDS, ROUNDS = 4, 12
TRAIN_DOCS = 800
REJECT = 0.005
FEW_LANGUAGES = 10_000
ROWS = 512            # texts turned into vectors at a time

letter = re.compile(r"[^\W\d_]").search
_BLANK = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def counts(text: str) -> np.ndarray:
    data = np.frombuffer(b" " + text.lower().encode().translate(_BLANK) + b" ", np.uint8).astype(np.uint32)
    two = data[:-1] << 8 | data[1:]
    three = (two[:-1] << 8 | data[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    two = two * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
    found = np.bincount(three, minlength=SIZE) + np.bincount(two, minlength=SIZE)
    found[:256] += np.bincount(data, minlength=256)
    return found


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(found.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_k_means(x: np.ndarray, k: int = CENTROIDS):
    """(centroids, cosine of every row to its own). Starts from the mean and
    then from the row that is furthest from all centroids so far."""
    mean = x.mean(axis=0)
    c = [mean / max(np.linalg.norm(mean), 1e-12)]
    while len(c) < min(k, len(x)):
        c.append(x[np.argmin((x @ np.array(c).T).max(axis=1))])
    c = np.array(c)
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.array([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    near = x @ c.T
    own = np.argmax(near, axis=1)
    return c, own, near[np.arange(len(x)), own]


def document_counts(known: DataFrame) -> np.ndarray:
    """Documents of ``known`` that hold each place; at the end, all documents with a letter.
    Every task adds up its own, so it sends at most SIZE + 1 rows."""
    def add_up(batches):
        found = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py()
                if letter(text):
                    found[:SIZE] += counts(text) > 0
                    found[SIZE] += 1
        places = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(found[places], pa.int64())],
                                         names=["place", "n"])

    out = np.zeros(SIZE + 1)
    for r in known.select("text").mapInArrow(add_up, "place long, n long").groupBy("place").agg(
            F.sum("n").alias("n")).collect():   # at most SIZE + 1 rows
        out[r["place"]] = r["n"]
    return out


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS):
    """Model from ``docs(doc_id, text, lang)``, or None if there is nothing to learn from."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder_of_crc(F.col("doc_id"), 4) != 2))
    span = 1_000_000
    # One row per language; the share that gives about train_docs of each.
    share = known.groupBy("lang").count().select(
        "lang", F.when(F.col("count") <= train_docs, span).otherwise(F.lit(span) * train_docs / F.col("count")).alias("share"))
    if share.count() <= FEW_LANGUAGES:   # a checked size; else an ordinary join
        share = F.broadcast(share)
    chosen = known.join(share, "lang").filter(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(span)) < F.col("share"))

    def sparse(batches):
        for batch in batches:
            rows = [(lang, counts(t)) for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist())
                    if letter(t)]
            places = [np.flatnonzero(v).astype(np.int32) for _, v in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang for lang, _ in rows], pa.string()), pa.array(places, pa.list_(pa.int32())),
                 pa.array([v[p].astype(np.int32) for (_, v), p in zip(rows, places)], pa.list_(pa.int32()))],
                names=["lang", "place", "n"])

    sample = staged(chosen.select("lang", "text").mapInArrow(sparse, "lang string, place array<int>, n array<int>"),
                    "language-sample")
    if sample.isEmpty():
        return None
    found = document_counts(known)
    idf = np.log((1 + found[SIZE]) / (1 + found[:SIZE])).astype(np.float32) + np.float32(1)

    def learn(pdf):
        pdf = pdf.iloc[sorted(range(len(pdf)), key=lambda i: (pdf["place"].iloc[i].tobytes(), pdf["n"].iloc[i].tobytes()))]
        found = np.zeros((len(pdf), SIZE), np.float32)
        for i, (p, n) in enumerate(zip(pdf["place"], pdf["n"])):
            found[i, p] = n
        c, own, near = spherical_k_means(vectors(found, idf))
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(c), "number": range(len(c)), "centroid": list(c),
                             "radius": [float(np.quantile(near[own == i], REJECT)) if (own == i).any() else 1.0
                                        for i in range(len(c))]})

    rows = sample.groupBy("lang").applyInPandas(
        learn, "lang string, number int, centroid array<float>, radius double").orderBy("lang", "number").collect()
    return {"lang": [r["lang"] for r in rows], "idf": idf, "radius": np.array([r["radius"] for r in rows]),
            "centroid": np.array([r["centroid"] for r in rows], np.float32)}


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang_pred, score (cosine), rejected of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lang, score, far = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            use = [i for i, t in enumerate(texts) if t and letter(t)] if model else []
            for at in range(0, len(use), ROWS):
                part = use[at: at + ROWS]
                near = vectors(np.array([counts(texts[i]) for i in part]), model["idf"]) @ model["centroid"].T
                for i, c, s in zip(part, np.argmax(near, axis=1), near.max(axis=1)):
                    lang[i], score[i], far[i] = model["lang"][c], min(max(float(s), 0.0), 1.0), s < model["radius"][c]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.round(score, 6)), pa.array(far)],
                names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean")


def op9_nearest_centroid_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs))
    return found.select("doc_id", (remainder_of_crc(F.col("doc_id"), 4) == 2).alias("held_out"),
                        "lang_pred", "score", "rejected")
