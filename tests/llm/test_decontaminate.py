import math
import random
import re
from collections import Counter

import pytest

from spotrates.llm import decontaminate as D
from spotrates.llm.common import table


def brute_force(docs, items):
    """(doc, item) -> score: BM25 of every passage against every item, from the formulas alone."""
    split = sorted({(i, tuple(q), tuple(a)) for i, q, a in ((i, *D.split_item(t)) for i, t in items) if q or a})
    n, mean = len(split), sum(len(q + a) for _, q, a in split) / max(len(split), 1)
    df = Counter(w for _, q, a in split for w in set(q + a))
    step = max(D.LEAST_PASSAGE // 2, max((len(q + a) for _, q, a in split), default=0))

    def weight(word, words):
        tf, idf = words.count(word), math.log(1 + (n - df[word] + 0.5) / (df[word] + 0.5))
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))

    def share(part, passage):
        k = min(5, len(part))
        grams = lambda x: {tuple(x[i: i + k]) for i in range(len(x) - k + 1)}
        return len(grams(part) & grams(passage)) / len(grams(part)) if part else 1.0

    weights = [{w: weight(w, q + a) for w in set(q + a)} for _, q, a in split]
    out = {}
    for doc, text in docs:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        for at in range(-step, len(words), step):
            part = words[max(0, at): at + 2 * step]
            for (item, q, a), w in zip(split, weights):
                score = sum(w.get(x, 0) for x in set(part))
                if score + 1e-9 >= 0.5 * sum(w.values()) and share(q, part) >= 0.8 and share(a, part) >= 0.8:
                    out[doc, item] = max(out.get((doc, item), 0), score)
    return out


def scores(df):
    return {(r.doc_id, r.item_id): r.score for r in df.collect()}


def pairs(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    got = scores(D.op8_bm25_decontamination(spark, sf))
    assert got == pytest.approx(brute_force(docs, items), abs=1e-5)
    plain = {(d, i) for d, t in docs for i, x in items if x in (t or "")}
    assert plain <= set(got)


def test_planted_leaks_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randint(12, 60))) for i in range(70)]
    clean = [(i, text(rng.randint(0, 400))) for i in range(60)]
    leaked = [(1000 + i, f"{text(rng.randint(0, 300))} {t.upper()} {text(rng.randint(0, 300))}") for i, t in items]
    marked = [(2000, "### ".join(items[3][1].split())), (2001, None), (2002, "")]
    docs = spark.createDataFrame(clean + leaked + marked, "doc_id long, text string").selectExpr("*", "text AS leaks")
    got = scores(D.leaks(docs, spark.createDataFrame(items, "item_id long, text string")))
    assert {(1000 + i, i) for i, _ in items} | {(2000, 3)} <= set(got)
    assert got == pytest.approx(brute_force(clean + leaked + marked, items), abs=1e-5)
    assert not [d for d, _ in got if d < 1000]


def test_half_an_item_is_no_leak_and_blocks_agree(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(f"q{rng.randrange(500)}" for _ in range(40))) for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(t.split()[:20])) for i, t in items] +
                                 [(100 + i, t) for i, t in items], "doc_id long, text string")
    table_ = spark.createDataFrame(items, "item_id long, text string")
    whole = D.leaks(docs, table_).orderBy("doc_id").collect()
    assert {(r.doc_id, r.item_id) for r in whole} == {(100 + i, i) for i in range(30)}
    for words in (300, 700):
        monkeypatch.setattr(D, "ITEM_WORDS", words)
        assert D.leaks(docs, table_).orderBy("doc_id").collect() == whole


def test_repeated_items_over_blocks(spark, monkeypatch):
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    first, other = words(30), words(30)
    items = [(1, first)] * 3 + [(1, other), (2, first)] + [(i, words(30)) for i in range(3, 12)]
    docs = [(1, f"{first} {words(200)} {other}"), (1, other), (2, words(90)), (3, first)]
    table_ = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "ITEM_WORDS", 60)
    got = sorted((r.doc_id, r.item_id, r.score) for r in D.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), table_).collect())
    want = brute_force([(10, docs[0][1]), (11, docs[1][1]), (3, first)], items)
    want = sorted((1 if d > 9 else d, i, s) for (d, i), s in want.items())
    assert [x[:2] for x in got] == [x[:2] for x in want] == [(1, 1), (1, 1), (1, 2), (3, 1), (3, 2)]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-5)


def test_question_and_answer_columns_nulls_and_empty(spark):
    items = spark.createDataFrame([(1, "what is the tallest peak of all", "the peak is called so"), (2, None, None),
                                   (None, "null ids are items too here", "yes they are")],
                                  "item_id long, question string, answer string")
    docs = spark.createDataFrame([(5, "x what is the tallest peak of all the peak is called so y"),
                                  (6, "what is the tallest peak of all"),
                                  (7, "null ids are items too here yes they are")], "doc_id long, text string")
    assert pairs(D.leaks(docs, items)) == {(5, 1), (7, None)}
    assert pairs(D.leaks(docs, items.limit(0))) == set()
    assert pairs(D.leaks(docs.limit(0), items)) == set()
