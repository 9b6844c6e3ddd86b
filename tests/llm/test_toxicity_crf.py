import itertools
import zlib

import numpy as np
import pytest

from spotrates.llm import toxicity_crf as X
from spotrates.llm.common import table

SF = "/root/testdata/sf0.1"


def enumerate_marginals(potential, links):
    n = len(potential)
    total, toxic, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for states in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(p * s for p, s in zip(potential, states)) + sum(links[a, b] for a, b in zip(states, states[1:])))
        total += w
        toxic += w * np.array(states)
        for a, b in zip(states, states[1:]):
            pairs[a, b] += w
    return toxic / total, pairs / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    potential = rng.normal(size=(3, 6))
    inside = np.arange(6) < np.array([[6], [3], [1]])
    links = rng.normal(size=(2, 2))
    got, expected = X.forward_backward(potential * inside, inside, links)
    total = np.zeros((2, 2))
    for i, n in enumerate((6, 3, 1)):
        m, pairs = enumerate_marginals(potential[i, :n], links)
        assert got[i, :n] == pytest.approx(m)
        total += pairs
    assert expected == pytest.approx(total)


def test_held_out_accuracy_and_offsets(spark):
    got = X.op4_toxicity_crf(spark, SF).toPandas()
    assert len(got) == table(spark, SF, "documents").count()
    labels = table(spark, SF, "labels").toPandas().drop_duplicates("doc_id")
    both = got[got.held_out].merge(labels, on="doc_id")
    hit = (both.predicted == 1) & (both.toxic == 1)
    assert hit.sum() / (both.predicted == 1).sum() > 0.95
    assert hit.sum() / (both.toxic == 1).sum() > 0.85
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    words = {texts[r.doc_id][s.start:s.end].lower() for r in got.itertuples() for s in r.toxic_spans}
    assert words and all(w.isalpha() for w in words)


def test_edge_rows(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "idiot " * 30000), (None, "fine"), (-1, None)],
                                  "doc_id long, text string")
    labels = table(spark, SF, "labels").unionByName(
        spark.createDataFrame([(None, 1, 1), (-2, None, None)], "doc_id long, quality int, toxic int"))
    model = X.fit(docs, labels, train_docs=1500)
    got = X.with_toxicity(extra.selectExpr("*", "'x' AS score"), model, "score_", "spans").collect()
    assert [r.score for r in got] == ["x"] * 5
    by = {r.doc_id: r for r in got}
    assert by[-1].score_ == by[-2].score_ < 0.3 and by[-3].score_ > 0.5 and len(by[-3].spans) == 30000
    assert X.with_toxicity(extra.limit(0), model, "s", "p").collect() == []
    assert X.fit(docs, labels.limit(0)) is None
    assert {r.s for r in X.with_toxicity(extra, None, "s", "p").collect()} == {0.0}


def test_few_labels_are_learned_from(spark):
    """Nine toxic training documents at the smallest scale, and a single one."""
    sf = "/root/testdata/sf0.001"
    got = X.op4_toxicity_crf(spark, sf).toPandas()
    both = got.merge(table(spark, sf, "labels").toPandas().drop_duplicates("doc_id"), on="doc_id")
    hit = (both.predicted == 1) & (both.toxic == 1)
    assert hit.sum() >= 0.5 * (both.toxic == 1).sum() and hit.sum() >= 0.8 * (both.predicted == 1).sum()
    docs = spark.createDataFrame([(1, "you idiot"), (3, "you there"), (4, "hello there")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i in (1, 3, 4))
    score = {r.doc_id: r.s for r in X.with_toxicity(docs, X.fit(docs, labels), "s", "p").collect()}
    assert score[1] > max(score[3], score[4])


def test_other_languages_with_few_toxic_documents(spark):
    """A language with four toxic documents beside one with many."""
    def text(i, word, common):
        return " ".join(f"{common}{(i * 7 + j * j) % 31}" for j in range(20)) + f" {common}a{i} {word} {common}b{i} fin"
    rows = [(i, text(i, "idiot" if i < 40 else "thing", "en")) for i in range(200)]
    rows += [(i, text(i, "cr\u00e9tin" if i < 306 else "chose", "fr")) for i in range(300, 340)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 40 or 300 <= i < 306)) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = X.fit(docs, labels)
    new = spark.createDataFrame([(1, text(900, "cr\u00e9tin", "fr")), (2, text(901, "chose", "fr")), (3, text(902, "idiot", "en"))],
                                "doc_id long, text string")
    score = {r.doc_id: r.s for r in X.with_toxicity(new, model, "s", "p").collect()}
    assert score[1] >= X.THRESHOLD > score[2] and score[3] >= X.THRESHOLD
