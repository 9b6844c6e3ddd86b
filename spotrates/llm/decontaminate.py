"""Benchmark decontamination: BM25 over the test items, queried with every passage.

The test items form an inverted index with BM25 weights. Every training text is
cut into overlapping passages of words; each passage is a query and all items
that score at least ``SCORE_SHARE`` of the score they give themselves are
retrieved, then confirmed by their word overlap.

Pruning by upper bounds: of each item the heaviest terms are essential, so many
that the remaining ones alone reach only a share of its threshold. Only passages
that hold an essential term are looked at. First the block maxima of ``BLOCK``
neighbouring items are added up per passage; items are scored only in blocks
whose bound reaches the least threshold of the block, and scored in full only if
their own bound reaches their threshold. Many passages are worked off at a time
by array operations, so bounds are summed per block instead of moving a pivot
through cursors one passage at a time; the bounds skipped by are those of WAND
with block maxima, and nothing that reaches its threshold is skipped.

A passage is twice as long as the longest item and starts at every half, so an
item that a text holds lies whole in one passage. Confirmation: at least
``OVERLAP`` of the 5-word shingles of the item's question and of its answer
occur in the passage. Where items come as one text, the last fifth of its words
is the answer.

Number of items, document frequencies, mean and greatest length are counted over
all items in Spark. The items themselves are worked off in blocks of a bounded
number of words, one after the other, so scores don't depend on the blocks and
only one block's index is held at a time.

Words are runs of letters and digits, lower-cased, so markup glued to words
doesn't hide a leak. Defined cases: null or empty texts and items match nothing;
a part of an item with fewer than 5 words is one shingle; an item row repeated
with id and words counts once; different items under one id are reported once,
with the best score; repeated documents each get their own
list; extra columns are kept; an empty table on either side gives no leaks.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, table
from .words import slices

K1, B = 1.2, 0.75
SCORE_SHARE, OVERLAP, SHINGLE = 0.5, 0.8, 5
ANSWER_SHARE = 0.2
REST_SHARE = 0.6           # of an item's threshold that its non-essential terms may reach
LEAST_PASSAGE = 64
BLOCK = 16                 # items that share a block maximum
ITEM_WORDS = 500_000       # words of items in one broadcast index, about
CHARS = 4_000_000          # of text, cut into passages at a time

LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()),
                     T.StructField("question_overlap", T.DoubleType()),
                     T.StructField("answer_overlap", T.DoubleType())])

words_in = re.compile(r"[^\W_]+").findall


def shingles(ids, k: int = SHINGLE):
    ids = tuple(ids)
    if len(ids) < k:
        return {ids} if ids else set()
    return {ids[i: i + k] for i in range(len(ids) - k + 1)}


def held(part, ids) -> float:
    """Share of ``part``'s shingles that the words ``ids`` hold."""
    k = min(SHINGLE, min(map(len, part), default=SHINGLE))
    return len(part & shingles(ids, k)) / len(part) if part else 1.0


class Postings:
    """key -> weights, as arrays by word."""

    def __init__(self, rows, n_words):
        rows = sorted(rows)
        self.key = np.array([r[1] for r in rows], np.int64)
        self.weight = np.array([r[2] for r in rows], np.float64)
        self.first = np.searchsorted(np.array([r[0] for r in rows], np.int64), np.arange(n_words + 1))

    def sums(self, passage, word, keys):
        """Sum of weights by (passage, key), as passage * keys + key."""
        first = self.first[word]
        size = self.first[word + 1] - first
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)
        both = np.repeat(passage, size) * keys + self.key[at]
        pairs, inverse = np.unique(both, return_inverse=True)
        return pairs, np.bincount(inverse, self.weight[at], len(pairs))


class Statistics(NamedTuple):
    """Of all items with words; ``df`` at least of the words of the block in hand."""
    items: int
    words: int
    longest: int
    df: dict


def statistics(items) -> Statistics:
    sizes = [len(q) + len(a) for _, q, a in items if q or a]
    return Statistics(len(sizes), sum(sizes), max(sizes, default=0),
                      Counter(w for _, q, a in items for w in {*q, *a}))


class ItemIndex:
    """Inverted index of test items, given as (item_id, question words, answer words).

    ``over`` are the statistics of all items; without it, those of the given ones.
    """

    def __init__(self, items, over: Statistics | None = None):
        over = over or statistics(items)
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        self.items = []
        for item_id, question, answer in items:
            q = [number(w, len(self.vocabulary)) for w in question]
            a = [number(w, len(self.vocabulary)) for w in answer]
            if q or a:
                self.items.append((item_id, q + a, shingles(q), shingles(a)))
        n, v = len(self.items), len(self.vocabulary)
        mean = over.words / max(over.items, 1)
        df = np.array([over.df[w] for w in self.vocabulary], float)
        idf = np.log(1 + (over.items - df + 0.5) / (df + 0.5))
        self.weights, self.threshold, rest, essential = [], np.zeros(n), np.zeros(n), []
        for i, (_, ids, _, _) in enumerate(self.items):
            tf = np.bincount(ids, minlength=0)
            w = {t: idf[t] * tf[t] * (K1 + 1) / (tf[t] + K1 * (1 - B + B * len(ids) / mean)) for t in set(ids)}
            left = math.fsum(w.values())
            self.threshold[i] = SCORE_SHARE * left
            for t in sorted(w, key=lambda t: (-w[t], t)):
                essential.append((t, i, w[t]))
                left -= w[t]
                if left < REST_SHARE * self.threshold[i]:
                    break
            rest[i] = max(left, 0)
            self.weights.append(w)
        self.rest = rest
        self.is_essential = np.zeros(v + 1, bool)
        self.is_essential[[t for t, _, _ in essential]] = True
        self.by_item = Postings(essential, v)
        highest = defaultdict(float)
        for t, i, w in essential:
            highest[t, i // BLOCK] = max(highest[t, i // BLOCK], w)
        self.by_block = Postings([(t, b, w) for (t, b), w in highest.items()], v)
        blocks = -(-n // BLOCK)
        self.blocks = max(blocks, 1)
        self.block_rest = np.array([rest[b * BLOCK: (b + 1) * BLOCK].max() for b in range(blocks)])
        self.block_threshold = np.array([self.threshold[b * BLOCK: (b + 1) * BLOCK].min() for b in range(blocks)])
        self.step = max(LEAST_PASSAGE // 2, over.longest)

    def leaks(self, texts):
        """For every text, its leaked items as {item_id: (score, question, answer)}."""
        found = [{} for _ in texts]
        get, none = self.vocabulary.get, len(self.vocabulary)
        lists = [words_in(t.lower()) if t else [] for t in texts]
        size = np.array([len(x) for x in lists], np.int64)
        ids = np.fromiter(map(get, chain.from_iterable(lists), repeat(none)), np.int64, int(size.sum()))
        del lists
        start = np.cumsum(size) - size                       # of each text among all words
        steps = size // self.step + 2                        # passages -1 .. of each text
        base = np.cumsum(steps) - steps
        at = np.flatnonzero(self.is_essential[ids])
        if not len(at):
            return found
        text = np.searchsorted(start, at, side="right") - 1
        half = base[text] + (at - start[text]) // self.step  # passage p covers halves p-1 and p
        pair = np.unique(np.concatenate([half, half + 1]) * none + np.tile(ids[at], 2))
        passage, word = pair // none, pair % none
        pairs, bound = self.by_block.sums(passage, word, self.blocks)
        block = pairs % self.blocks
        pairs = pairs[bound + self.block_rest[block] + 1e-9 >= self.block_threshold[block]]
        hot = np.unique(pairs // self.blocks)
        use = np.isin(passage, hot)
        n = len(self.items)
        both, bound = self.by_item.sums(passage[use], word[use], n)
        item = both % n
        keep = (bound + self.rest[item] + 1e-9 >= self.threshold[item]) & np.isin(
            both // n * self.blocks + item // BLOCK, pairs)
        for p, i in zip((both[keep] // n).tolist(), item[keep].tolist()):
            t = int(np.searchsorted(base, p, side="right")) - 1
            low = max(0, (p - int(base[t]) - 1) * self.step)
            high = min(int(size[t]), (p - int(base[t]) + 1) * self.step)
            words = ids[start[t] + low: start[t] + high].tolist()
            item_id, _, question, answer = self.items[i]
            w = self.weights[i]
            score = math.fsum(w.get(x, 0.0) for x in set(words))
            if score + 1e-9 < self.threshold[i]:
                continue
            overlap = held(question, words), held(answer, words)
            if min(overlap) >= OVERLAP:
                found[t][item_id] = max(found[t].get(item_id, (0.0, 0.0, 0.0)), (round(score, 6), *overlap))
        return found


def split_item(text: str | None):
    """(question words, answer words) of an item that is one text."""
    words = words_in((text or "").lower())
    cut = len(words) - max(1, round(len(words) * ANSWER_SHARE)) if len(words) > 1 else len(words)
    return words[:cut], words[cut:]


def item_words(items: DataFrame) -> DataFrame:
    """item_id, question and answer as words; distinct rows that hold a word."""
    names = ["question", "answer"] if "question" in items.columns else ["text"]
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), *[F.col(c).cast("string").alias(c) for c in names])

    def run(batches):
        for batch in batches:
            if len(names) == 1:
                split = [split_item(t) for t in batch.column("text").to_pylist()]
            else:
                split = [tuple(words_in((t or "").lower()) for t in pair)
                         for pair in zip(*(batch.column(c).to_pylist() for c in names))]
            words = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([q for q, _ in split], words),
                                              pa.array([a for _, a in split], words)], names=["item_id", "question", "answer"])

    return rows.mapInArrow(run, "item_id long, question array<string>, answer array<string>") \
        .filter("size(question) + size(answer) > 0").distinct()


def indexes(items: DataFrame):
    """The number of blocks, and a function that gives the index of one of them.

    ``items`` has item_id and either text or question and answer.
    """
    rows = staged(item_words(items), "item-words")
    size = F.size("question") + F.size("answer")
    n, words, longest = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0)),
                                 F.coalesce(F.max(size), F.lit(0))).first()
    blocks = max(1, -(-words // ITEM_WORDS))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(blocks)).cast("int"))
    held_in = rows.select("block", F.explode(F.array_distinct(F.concat("question", "answer"))).alias("word")) \
        .groupBy("block", "word").agg(F.count(F.lit(1)).alias("items"))
    if blocks > 1:
        rows = staged(rows, "item-blocks", "block")
        held_in = staged(held_in, "item-block-words")
        of = held_in.groupBy("word").agg(F.sum("items").alias("items"))
        held_in = staged(held_in.select("block", "word").join(of, "word"), "item-frequencies", "block")

    def load(block: int) -> ItemIndex:
        own = [(r.item_id, r.question, r.answer) for r in rows.filter(F.col("block") == block).collect()]
        df = {r.word: r["items"] for r in held_in.filter(F.col("block") == block).collect()}
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))
        return ItemIndex(own, Statistics(n, words, longest, df))

    return blocks, load


def found_in(index, texts):
    return [f for i, j in slices(texts, CHARS) for f in index.value.leaks(texts[i:j])]


def in_order(found):
    return sorted(found.items(), key=lambda x: (x[0] is not None, x[0] or 0))


def with_leaks(docs: DataFrame, items: DataFrame, name: str) -> DataFrame:
    """``docs`` with one more column ``name``: the array of leaked items.

    ``items`` has item_id and either text or question and answer. Of several
    blocks, each one's result is written before the next index is built.
    """
    fields = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(LEAK))])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()),
                               ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))
    blocks, load = indexes(items)
    out = docs
    for block in range(blocks):
        index = docs.sparkSession.sparkContext.broadcast(load(block))

        def run(batches, index=index, first=not block):
            for batch in batches:
                rows = [[dict(zip(LEAK.names, (i, *v))) for i, v in in_order(f)]
                        for f in found_in(index, batch.column("text").to_pylist())]
                if not first:
                    rows = [merged(a or [], b) for a, b in zip(batch.column(name).to_pylist(), rows)]
                columns = [batch.column(c) for c in fields]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], names=[*fields, name])

        out = out.mapInArrow(run, schema)
        if blocks > 1:
            out = staged(out, "with-leaks")
            index.destroy()
    return out


def merged(a, b):
    """Two lists of leaks as one, each id with its best score."""
    best = {}
    for x in chain(a, b):
        values = tuple(x[c] for c in LEAK.names[1:])
        best[x["item_id"]] = max(best.get(x["item_id"], values), values)
    return [dict(zip(LEAK.names, (i, *v))) for i, v in in_order(best)]


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap."""
    found = with_leaks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, "leaks")
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op8_bm25_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
