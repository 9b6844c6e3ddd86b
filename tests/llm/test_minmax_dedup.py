import random

import numpy as np

from spotrates.llm import minmax_dedup as M
from spotrates.llm.common import table
from spotrates.llm.components import connected_components
from spotrates.llm.words import shingle_set, word_hashes


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def brute_force(rows, k):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b:
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    parent[max(find(x), find(y))] = min(find(x), find(y))
    smallest = {}
    for x, (i, _) in enumerate(sets):
        smallest[find(x)] = min(smallest.get(find(x), i), i)
    return sorted((i, len(s), smallest[find(x)], i == smallest[find(x)]) for x, (i, s) in enumerate(sets))


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert got(M.op6_minmax_near_duplicates(spark, sf)) == brute_force(rows, 2)


def test_chains_and_copies_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choice(vocab) for _ in range(60)]
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((1000 - i, " ".join(words)))
        if i % 40 == 39:
            base = words
    rows += [(5000 + i, rows[0][1].upper()) for i in range(30)]
    rows += [(1, "One"), (2, "one\t"), (3, ""), (4, None), (5, "one two"), (6, "É é"), (7, "é é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (2, 5):
        assert got(M.near_duplicates(df, k)) == brute_force(rows, k)


def test_null_ids_repeats_clashes_and_empty(spark):
    rows = [(None, "a b c d", 1), (7, "a b c d", 1), (7, "a b c d", 1), (None, "only null here", 2), (9, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls int")
    out = sorted(((r.doc_id, r.component_id, r.kept) for r in M.near_duplicates(df, 2).collect()), key=str)
    assert out == sorted([(None, 7, False), (7, 7, True), (7, 7, True), (None, None, True), (9, 9, True)], key=str)
    assert M.near_duplicates(df.limit(0), 2).collect() == []


def test_signature_values_agree_as_often_as_the_sets():
    rng = random.Random(1)
    common = [str(rng.random()) for _ in range(160)]
    texts = [" ".join(common + [str(rng.random()) for _ in range(40)]).encode() for _ in (0, 1)]
    a, b = (shingle_set(h, 1) for h in word_hashes(texts))
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((M.signature(a) == M.signature(b)).mean() - exact) < 0.1


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(links).collect()}
    assert set(roots[i] for i in range(41)) == {0} and roots[101] == 100
