"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters and digits, lower-cased; a chain is a segment of at
most ``SEGMENT`` neighbouring tokens of a text. States: clean and toxic. A
token's potentials come from hashed features (the word, its first and its last
five characters); a 2 x 2 matrix links neighbours.

Learning (labels of whole documents -> labelled tokens):

1. A bounded sample of labelled documents is taken by hash, for each label: all
   toxic ones up to half of ``TRAIN_DOCS``, clean ones for the rest.
2. A word's toxic documents are counted by the different contexts (two
   neighbours) of its first occurrences, or by kinds of document (smallest hash of
   word pairs) if these are fewer, so copies and near copies of one text add
   little. A word is evidence if its smoothed log-odds are at least
   ``LEAST_LOG_RATIO`` and its log likelihood ratio, against toxic documents by
   chance, is at least ``SURENESS`` more than the log of the sample's size: few
   labels ask for fewer documents. If no word is, the ones with the largest ratio
   are. Their tokens in toxic documents are labelled toxic, all other tokens clean.
3. The field is fitted by gradient ascent on its conditional likelihood over at
   most about ``TRAIN_SEGMENTS`` segments, in one task; forward-backward gives the gradient.
4. A logistic curve from a document's marginals to its label is fitted on the
   sampled documents, weighted to the labels' shares before sampling.

Scoring runs forward-backward over all segments of the whole text; tokens with a
marginal of at least one half are the offending spans (code points, end
exclusive), and the largest marginal together with the expected number of toxic
tokens gives the document's score.

Defined cases: null or empty texts get the score of a text without any toxic
token and no spans; a null label is no label; a document with several labels is
toxic if one says so; without labels of both kinds,
or any word in a toxic document, every score is 0; repeated
rows get equal scores; ties don't matter, as no order is used; extra columns are
kept by ``with_toxicity``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder_of_crc, staged, table
from .words import slices

SEGMENT = 64
BITS = 18
TRAIN_DOCS, TRAIN_SEGMENTS = 10_000, 20_000
LEAST_LOG_RATIO, SURENESS, LEXICON = 2.0, 1.0, 2000
ROUNDS, STEP, RIDGE = 120, 0.5, 1e-4
THRESHOLD = 0.3
CACHE_WORDS = 200_000
BLOCK = 4096         # segments that are passed through at a time
CHARS = 4_000_000    # of text, turned into tokens at a time

tokens_in = re.compile(r"[^\W_]+").findall
token_spans = re.compile(r"[^\W_]+").finditer

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                  T.StructField("probability", T.DoubleType())]))


def features(word: str) -> tuple[int, int, int]:
    word, mask = word.lower(), (1 << BITS) - 1
    return tuple(xxhash.xxh64_intdigest(kind + part) & mask
                 for kind, part in (("w ", word), ("p ", word[:5]), ("s ", word[-5:])))


class Emissions(dict):
    """token -> its potential, remembered for at most ``CACHE_WORDS`` tokens."""

    def __init__(self, weights, bias):
        self.weights, self.bias = weights, bias

    def __missing__(self, token):
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[token] = float(self.bias + sum(self.weights[f] for f in features(token)))
        return value


def forward_backward(potential, inside, links):
    """Marginals of the toxic state.

    potential: segments x tokens; inside: which of them are tokens; links: the
    2 x 2 log potentials of neighbours. Also returns the expected counts of the
    four transitions.
    """
    n, length = potential.shape
    u = np.exp(np.clip(potential, -30, 30))
    a = np.exp(links)
    alpha = np.zeros((length, 2, n))
    beta = np.ones((length, 2, n))
    f0, f1 = np.full(n, 0.5), 0.5 * u[:, 0]
    for t in range(length):
        if t:
            g0, g1 = f0 * a[0, 0] + f1 * a[1, 0], (f0 * a[0, 1] + f1 * a[1, 1]) * u[:, t]
            f0, f1 = np.where(inside[:, t], g0, f0), np.where(inside[:, t], g1, f1)
        total = f0 + f1
        f0, f1 = f0 / total, f1 / total
        alpha[t, 0], alpha[t, 1] = f0, f1
    expected = np.zeros((2, 2))
    b0, b1 = np.ones(n), np.ones(n)
    for t in range(length - 1, 0, -1):
        on = inside[:, t]
        w0, w1 = b0, b1 * u[:, t]
        cells = [[alpha[t - 1, i] * a[i, j] * (w0, w1)[j] for j in (0, 1)] for i in (0, 1)]
        total = cells[0][0] + cells[0][1] + cells[1][0] + cells[1][1]
        for i in (0, 1):
            for j in (0, 1):
                expected[i, j] += (cells[i][j] / total)[on].sum()
        c0, c1 = a[0, 0] * w0 + a[0, 1] * w1, a[1, 0] * w0 + a[1, 1] * w1
        s = c0 + c1
        b0, b1 = np.where(on, c0 / s, b0), np.where(on, c1 / s, b1)
        beta[t - 1, 0], beta[t - 1, 1] = b0, b1
    toxic = alpha[:, 1] * beta[:, 1]
    return (toxic / (alpha[:, 0] * beta[:, 0] + toxic)).T * inside, expected


def segments(sizes):
    """Segment numbers of tokens of texts with these sizes: (text of each
    segment, row and column of each token)."""
    count = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(sizes)), count)
    first = np.cumsum(count) - count
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return owner, np.repeat(first, sizes) + place // SEGMENT, place % SEGMENT


def fit_field(ids, labels, sizes):
    """ids: three features of every token; labels of the tokens; tokens of each segment."""
    n = len(sizes)
    inside = np.arange(SEGMENT) < sizes[:, None]
    label = np.zeros((n, SEGMENT))
    label[inside] = labels
    weights, bias, links = np.zeros(1 << BITS), -4.0, np.zeros((2, 2))
    pair = inside[:, 1:]
    seen = np.array([[((label[:, :-1] == i) & (label[:, 1:] == j) & pair).sum() for j in (0, 1)] for i in (0, 1)], float)
    scale_w, scale_b, scale_l = np.full(1 << BITS, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    potential, marginal = np.zeros((n, SEGMENT)), np.zeros((n, SEGMENT))
    for _ in range(ROUNDS):
        potential[inside] = bias + weights[ids[:, 0]] + weights[ids[:, 1]] + weights[ids[:, 2]]
        expected = np.zeros((2, 2))
        for i in range(0, n, BLOCK):
            s = slice(i, i + BLOCK)
            marginal[s], counts = forward_backward(potential[s], inside[s], links)
            expected += counts
        error = labels - marginal[inside]
        g = sum(np.bincount(ids[:, k], error, 1 << BITS) for k in range(3)) - RIDGE * n * weights
        scale_w += g * g
        weights += STEP * g / np.sqrt(scale_w)
        gb = error.sum()
        scale_b += gb * gb
        bias += STEP * gb / np.sqrt(scale_b)
        gl = seen - expected - RIDGE * n * links
        scale_l += gl * gl
        links += STEP * gl / np.sqrt(scale_l)
    return weights.astype(np.float32), float(bias), links


def marginals(texts, model, emissions):
    """Per text the number of its tokens; the marginals of all tokens."""
    parts = [_marginals(texts[i:j], model, emissions) for i, j in slices(texts, CHARS)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _marginals(texts, model, emissions):
    lists = [tokens_in(t) if t else [] for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    owner, row, column = segments(sizes)
    potential = np.zeros((len(owner), SEGMENT))
    inside = np.zeros(potential.shape, bool)
    inside[row, column] = True
    potential[row, column] = np.fromiter((emissions[w] for x in lists for w in x), float, int(sizes.sum()))
    out = np.empty(int(sizes.sum()))
    starts = np.searchsorted(row, np.arange(0, len(owner) + BLOCK, BLOCK))
    for i in range(0, len(owner), BLOCK):
        s = slice(starts[i // BLOCK], starts[i // BLOCK + 1])
        m, _ = forward_backward(potential[i: i + BLOCK], inside[i: i + BLOCK], model["links"])
        out[s] = m[row[s] - i, column[s]]
    return sizes, out


def evidence(sizes, marginal):
    """Per text: log-odds of its largest marginal and log of 1 + expected toxic tokens."""
    largest, total = np.full(len(sizes), 1e-6), np.zeros(len(sizes))
    some = np.flatnonzero(sizes)
    if len(some):
        first = (np.cumsum(sizes) - sizes)[some]
        largest[some] = np.maximum.reduceat(marginal, first)
        total[some] = np.add.reduceat(np.where(marginal >= 0.05, marginal, 0.0), first)
    largest = np.clip(largest, 1e-6, 1 - 1e-6)
    return np.column_stack([np.log(largest / (1 - largest)), np.log1p(total), np.ones(len(sizes))])


def fit_curve(x, y, weight):
    """Logistic regression of weighted rows by Newton steps, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * w)
    return w


def _texts(batch):
    return batch.column("text").to_pylist()


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS):
    """Model of bounded size from the labelled documents outside the held-out quarter."""
    known = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
             .filter(remainder_of_crc(F.col("doc_id"), 4) != 2))
    every = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    most = {1: train_docs // 2, 0: train_docs - min(every.get(1, 0), train_docs // 2)}
    bound = {m: 1_000_000 if n <= most[m] else 1_000_000 * most[m] // n for m, n in every.items()}
    chance = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.lit(1_000_000))
    known = known.filter(chance < F.when(F.col("toxic") == 1, bound.get(1, 0)).otherwise(bound.get(0, 0)))
    # ``known`` now has about ``train_docs`` ids at most: sent to the texts, which stay where they are.
    sample = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
                    .select("text", "toxic"), "toxicity-sample")
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return None

    def occurrences(batches):
        for batch in batches:
            words, contexts, kinds, clean = [], [], [], {}
            for text, toxic in zip(_texts(batch), batch.column("toxic").to_pylist()):
                found = tokens_in(text.lower()) if text else []
                if toxic:
                    first = {}
                    for a, w, b in zip(["", *found[:-1]], found, [*found[1:], ""]):
                        first.setdefault(w, f"{a} {b}")
                    words += first
                    contexts += [xxhash.xxh64_intdigest(x) >> 1 for x in first.values()]
                    pairs = {f"{a} {b}" for a, b in zip(found, found[1:])} or first
                    kinds += [min((xxhash.xxh64_intdigest(x, seed=1) >> 1 for x in pairs), default=0)] * len(first)
                else:
                    for w in set(found):
                        clean[w] = clean.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(words + list(clean), pa.string()),
                 pa.array(contexts + [None] * len(clean), pa.int64()),
                 pa.array(kinds + [None] * len(clean), pa.int64()),
                 pa.array([0] * len(words) + list(clean.values()), pa.int64())],
                names=["word", "context", "kind", "clean"])

    total = size[0] + size[1]
    toxic, clean = F.col("contexts"), F.col("clean")
    ratio = F.log((toxic + 0.5) / (size[1] + 1)) - F.log((clean + 0.5) / (size[0] + 1))
    gain = (toxic * F.log(toxic * total / ((toxic + clean) * size[1]))
            + F.when(clean > 0, clean * F.log(clean * total / ((toxic + clean) * size[0]))).otherwise(0.0))
    words = (
        sample.mapInArrow(occurrences, "word string, context long, kind long, clean long").groupBy("word")
        .agg(F.least(F.countDistinct("context"), F.countDistinct("kind")).alias("contexts"), F.sum("clean").alias("clean"))
        .filter(toxic > 0).select("word", ratio.alias("ratio"), gain.alias("gain"))
        .withColumn("sure", (F.col("ratio") >= LEAST_LOG_RATIO) & (F.col("gain") >= SURENESS + math.log(total)))
        .orderBy(F.desc("sure"), F.desc("ratio"), "word").limit(LEXICON).collect())
    lexicon = {r["word"] for r in words if r["sure"] or not words[0]["sure"] and r["ratio"] == words[0]["ratio"]}

    def labelled(batches):
        for batch in batches:
            x, y, key = [], [], []
            for text, toxic in zip(_texts(batch), batch.column("toxic").to_pylist()):
                found = tokens_in(text.lower()) if text else []
                for i in range(0, len(found), SEGMENT):
                    part = found[i: i + SEGMENT]
                    marks = [int(toxic and w in lexicon) for w in part]
                    x.append([f for w in part for f in features(w)])
                    y.append(marks)
                    key.append(xxhash.xxh64_intdigest(" ".join(part)) >> 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.list_(pa.int32())), pa.array(y, pa.list_(pa.int8())),
                 pa.array([int(any(m)) for m in y], pa.int8()), pa.array(key, pa.int64())],
                names=["x", "y", "marked", "key"])

    rows = staged(sample.mapInArrow(labelled, "x array<int>, y array<tinyint>, marked tinyint, key long")
                  .dropDuplicates(["key"]), "toxicity-segments")
    count = {r["marked"]: r["count"] for r in rows.groupBy("marked").count().collect()}
    half, span = TRAIN_SEGMENTS // 2, 1_000_000
    if 1 not in count:
        return None
    share = {m: span if count.get(m, 0) <= half else span * half // count[m] for m in (0, 1)}
    chosen = rows.filter(F.pmod("key", F.lit(span)) < F.when(F.col("marked") == 1, share[1]).otherwise(share[0]))

    def train(batches):
        """The bounded sample's field, in one task; only its weights come back."""
        parts = [(k, x, y) for batch in batches for k, x, y in zip(
            batch.column("key").to_pylist(), (v.values.to_numpy() for v in batch.column("x")), (v.values.to_numpy() for v in batch.column("y")))]
        parts.sort(key=lambda p: p[0])
        weights, bias, links = fit_field(np.concatenate([x for _, x, _ in parts]).reshape(-1, 3),
                                         np.concatenate([y for _, _, y in parts]).astype(float), np.array([len(y) for _, _, y in parts]))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias]), pa.array([links.tobytes()], pa.binary())],
                                         names=["weights", "bias", "links"])

    fitted = chosen.select("key", "x", "y").coalesce(1).mapInArrow(train, "weights binary, bias double, links binary").first()
    model = {"weights": np.frombuffer(fitted["weights"], np.float32), "bias": fitted["bias"],
             "links": np.frombuffer(fitted["links"]).reshape(2, 2)}
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def seen(batches):
        emissions = Emissions(shared.value["weights"], shared.value["bias"])
        for batch in batches:
            e = evidence(*marginals(_texts(batch), shared.value, emissions))
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), batch.column("toxic")],
                                             names=["a", "b", "toxic"])

    points = sample.mapInArrow(seen, "a double, b double, toxic int").toArrow().sort_by([("a", "ascending"), ("b", "ascending"), ("toxic", "ascending")])
    shared.destroy()
    x = np.column_stack([points["a"].to_numpy(), points["b"].to_numpy(), np.ones(len(points))])
    y = points["toxic"].to_numpy().astype(float)
    drawn = {m: every[m] / size[m] for m in (0, 1)}
    weight = np.where(y == 1, drawn[1], drawn[0])
    return model | {"curve": fit_curve(x, y, weight * len(y) / weight.sum())}


def with_toxicity(docs: DataFrame, model, score: str, spans: str) -> DataFrame:
    """``docs`` with a score column and a column of offending spans."""
    if model is None:
        return docs.withColumn(score, F.lit(0.0)).withColumn(spans, F.array().cast(SPANS))
    fields = list(docs.schema.fields)
    schema = T.StructType([*fields, T.StructField(score, T.DoubleType()), T.StructField(spans, SPANS)])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches):
        model = shared.value
        emissions = Emissions(model["weights"], model["bias"])
        for batch in batches:
            texts = _texts(batch)
            sizes, m = marginals(texts, model, emissions)
            scores = 1 / (1 + np.exp(-np.clip(evidence(sizes, m) @ model["curve"], -30, 30)))
            found = [[] for _ in texts]
            first = np.cumsum(sizes) - sizes
            hot = np.flatnonzero(m >= 0.5)
            owners = np.searchsorted(first, hot, side="right") - 1
            for t in np.unique(owners).tolist():
                wanted = {int(i - first[t]): float(m[i]) for i in hot[owners == t]}
                found[t] = [{"start": s.start(), "end": s.end(), "probability": round(wanted[k], 6)}
                            for k, s in enumerate(token_spans(texts[t])) if k in wanted]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in fields), pa.array(np.round(scores, 6)), pa.array(found, kind)],
                names=[*(f.name for f in fields), score, spans])

    return docs.mapInArrow(run, schema)


def op4_toxicity_crf(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = with_toxicity(docs, model, "score", "toxic_spans")
    return scored.select(
        "doc_id", (remainder_of_crc(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "toxic_spans")
