import math
import sys
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest

from spotrates.llm import context_tree as C
from spotrates.llm.common import table


def coded(word):
    data = b" " * C.DEPTH + word + (b"" if word == C.END else b" ")
    for i in range(C.DEPTH, len(data)):
        for k in range(8):
            yield data[i - C.DEPTH:i], (1 << k) | (data[i] >> (8 - k)), data[i] >> (7 - k) & 1


def tokens(text):
    return (text or "").encode().lower().split() + [C.END]


class Reference:
    """Context-tree weighting by plain recursion."""

    def __init__(self, texts):
        self.n = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for text in texts:
            for w in tokens(text):
                for context, node, bit in coded(w):
                    for d in range(C.DEPTH + 1):
                        own = (node, context[C.DEPTH - d:])
                        self.n[own][bit] += 1
                        if d < C.DEPTH:
                            self.children[own].add((node, context[C.DEPTH - d - 1:]))
        self.known = {}

    def own(self, key):
        a, b = self.n[key]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def mixed(self, key):
        if key not in self.known:
            own = self.own(key)
            if len(key[1]) < C.DEPTH:
                own = np.logaddexp(own, sum(self.mixed(c) for c in self.children[key])) - math.log(2)
            self.known[key] = own
        return self.known[key]

    def one(self, node, context, d=0):
        key = (node, context[C.DEPTH - d:])
        if key not in self.n:
            return 0.5
        a, b = self.n[key]
        here = (b + .5) / (a + b + 1)
        if d == C.DEPTH or (node, context[C.DEPTH - d - 1:]) not in self.n:
            return here
        w = math.exp(self.own(key) - math.log(2) - self.mixed(key))
        return w * here + (1 - w) * self.one(node, context, d + 1)

    def score(self, text):
        total = 0.0
        for w in tokens(text):
            for context, node, bit in coded(w):
                p = self.one(node, context)
                total += math.log10(p if bit else 1 - p)
        return total


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS word", "1 AS chunk")
    got = sorted(C.score(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.score))
    train = [t for i, t in rows if not held_out(i)]
    model = Reference(train)
    count = defaultdict(int)
    for t in train:
        for w in tokens(t):
            count[w] += 1
    n, v = sum(count.values()), len(count)
    want = sorted(((i, held_out(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n,
                    sum(math.log10((count.get(w, 0) + .5) / (n + .5 * (v + 1))) for w in tokens(t)), model.score(t))
                   for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[6]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9)
        assert g.score == pytest.approx(w[6], rel=1e-9)


ROWS = [(i, t) for i, t in enumerate(
    ["the cat sat on the mat", "The cat", "a dog, a dog", "", None, "été à l'école", "zzz unseen wörds", "x" * 50,
     "the then there these them", "cat cats catalog"] * 2)] + [(None, "the null"), (3, "twice"), (3, "twice")]


def test_equals_plain_recursion(spark):
    check(spark, ROWS)


def test_small_chunks_blocks_and_groups_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BYTES", 40)
    monkeypatch.setattr(C, "BLOCK_WORDS", 6)
    monkeypatch.setattr(C, "GROUP_GRAMS", 15)
    check(spark, ROWS)


def test_nothing_to_learn_from_and_empty(spark):
    only = next(i for i in range(100) if held_out(i))
    check(spark, [(only, "some words")])
    assert C.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 100.5, 1e7])
    assert C.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-11)


def test_probabilities_sum_to_one():
    gram = np.arange(256, dtype=np.int64) | (0x202020746865 << 8)
    counts = np.zeros(256)
    counts[[101, 32, 110]] = [5, 2, 9]
    levels, _, _ = C.weigh_up(gram, counts, 0)
    state = C.step_down(levels[0][1], levels[0][2], levels[0][4], 0.0, 1.0, 0.5)
    lp = C.code_lengths(gram, counts, levels[0][0], *state, 0)
    assert (10 ** lp).sum() == pytest.approx(1.0)


def test_code_length_of_held_out_texts(spark):
    """Far below an order-0 model of their bytes (4.2 bits) and near the word
    model, which doesn't spell the words it has never seen."""
    got = C.op7_context_tree_lm(spark, "/root/testdata/sf0.01")
    held = got.filter("held_out").selectExpr("sum(score) AS score", "sum(base_score) AS base",
                                             "avg(bits_per_byte) AS bits", "count(*) AS n").first()
    assert held.n > 100 and held.bits < 2.6 and held.score > 1.12 * held.base
    assert got.count() == table(spark, "/root/testdata/sf0.01", "documents").count()


def check_running(spark, rows, monkeypatch):
    """Scores against plain recursion over the running bytes of whole texts."""
    monkeypatch.setattr(sys.modules[__name__], "tokens", lambda text: [stream_of(text)])
    monkeypatch.setattr(sys.modules[__name__], "coded", coded_stream)
    model = Reference([t for i, t in rows if not held_out(i)])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.score) for r in C.score(df, running=True).collect())
    want = sorted((i is not None, i or 0, model.score(t)) for i, t in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-9)


def stream_of(text):
    return b" ".join((text or "").encode().lower().split() + [C.END])


def coded_stream(data):
    data = b" " * C.DEPTH + data
    for i in range(C.DEPTH, len(data)):
        for k in range(8):
            yield data[i - C.DEPTH:i], (1 << k) | (data[i] >> (8 - k)), data[i] >> (7 - k) & 1


def test_running_contexts_equal_plain_recursion(spark, monkeypatch):
    check_running(spark, ROWS, monkeypatch)


def test_running_contexts_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BYTES", 40)
    monkeypatch.setattr(C, "BLOCK_WORDS", 1)
    monkeypatch.setattr(C, "GROUP_GRAMS", 15)
    monkeypatch.setattr(C, "BUCKETS", 7)
    check_running(spark, ROWS, monkeypatch)


def test_order_of_words_counts(spark, tmp_path):
    """Context crosses a word's start: shuffled words are less likely than the order learned."""
    train = [i for i in range(60) if not held_out(i)]
    test = [i for i in range(60, 120) if held_out(i)][:2]
    rows = [(i, "the cat sat on the mat") for i in train] + list(zip(test, ["the cat sat on the mat", "mat the on sat cat the"]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in C.op7_context_tree_lm(spark, str(tmp_path)).collect()}
    assert found[test[0]].base_score == pytest.approx(found[test[1]].base_score)
    assert found[test[0]].score > found[test[1]].score + 1


def test_grams_of_a_hot_pair_of_bytes_are_spread(spark, monkeypatch):
    """All contexts end with the same two bytes: no group holds much more than its share."""
    seen = []

    def staged(df, name):
        out = df.localCheckpoint()
        seen.extend([out] if name == "grams" else [])
        return out

    monkeypatch.setattr(C, "staged", staged)
    monkeypatch.setattr(C, "GROUP_GRAMS", 500)
    grams = [(a << 32 | b << 24 | 0x7468 << 8 | 0x65, 1.0) for a in range(40) for b in range(100)]
    got = C.gram_code_lengths(spark.createDataFrame(grams, "gram long, count double"))
    assert got.count() == len(grams)
    assert max(r["count"] for r in seen[0].groupBy("part").count().collect()) < 3 * C.GROUP_GRAMS


def test_a_block_of_text_takes_little_memory():
    """Working arrays are bounded by a block and the grams found, not by the text (33 MB; 77 MB before)."""
    random = np.random.default_rng(7)
    words = [bytes(random.integers(97, 123, 6).astype(np.uint8)) for _ in range(500)] + [C.END]
    texts = [np.append(random.integers(0, 500, 400), 500).astype(np.int32) for _ in range(1500)]
    tracemalloc.start()
    gram, count = C.distinct_grams(texts, C.coded(b" ".join(words), True), True, np.ones(len(texts), bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count.sum() == sum(7 * 400 + 1 for _ in texts)
    assert peak < 50e6


def test_words_and_numbers_come_back():
    words, between = C.coded(b" ".join([b"a", "é".encode(), C.END]), False)
    assert [bytes(w.as_py())[:-between] for w in words] == [b"a", "é".encode(), C.END]
    for kind, numbers in ((C.IDS, [0, 70_000]), (C.COUNTS, [2 ** 32 - 1, 0]), (C.NUMBERS, [2 ** 55, 3]), (C.REALS, [-0.1, 1e9])):
        assert C.unpacked(C.packed(np.array(numbers), kind), kind).tolist() == numbers
