import zlib

import numpy as np

from spotrates.llm import language_id as L
from spotrates.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = L.op9_nearest_centroid_language(spark, SF).toPandas()
    docs = table(spark, SF, "documents").select("doc_id", "lang").toPandas()
    assert len(got) == len(docs)
    both = got[got.held_out].merge(docs, on="doc_id")
    assert (both.lang_pred == both.lang).mean() > 0.95
    assert got.score.between(0, 1).all()
    assert got.rejected.mean() < 0.05


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(i, t, lang) for i in range(40) for t, lang in (("the cat and the dog", "en"), ("der hund und die katze", "de"))]
        + [(100, None, "en"), (101, "", "en"), (102, "12 !!", "de"), (103, "une phrase", None), (None, "the and", "en"),
           (104, "THE DOG AND " * 20000, None)], "doc_id long, text string, lang string").selectExpr("*", "lang AS lang_pred")
    model = L.fit(docs)
    got = {r.doc_id: r for r in L.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[102].score == 0
    assert got[104].lang_pred == got[None].lang_pred == "en" and got[103].lang_pred in ("en", "de")
    assert L.predict(docs.limit(0), model).collect() == []
    assert {r.lang_pred for r in L.predict(docs, L.fit(docs.limit(0))).collect()} == {"und"}


def test_frequencies_are_counted_over_all_training_rows(spark):
    rows = [(i, t, "en") for i in range(300) for t in ("the cat", "", None, "12")] + [(300, "Ωμέγα", "el")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    texts = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2 and t and L.letter(t)]
    want = np.sum([L.counts(t) > 0 for t in texts], axis=0)
    got = L.fit(docs, 5)["idf"]
    assert np.allclose(got, np.log((1 + len(texts)) / (1 + want)) + 1)


def test_rejection_by_distance(spark):
    docs = table(spark, SF, "documents")
    model = L.fit(docs, 200)
    far = spark.createDataFrame([(1, "ΑΒΓΔ ΕΖΗΘ ΙΚΛΜ " * 50)], "doc_id long, text string")
    assert L.predict(far, model).first().rejected


def test_k_means_finds_separate_clusters():
    rng = np.random.default_rng(0)
    x = np.abs(np.concatenate([rng.normal(e, 0.02, (20, 3)) for e in np.eye(3)]))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, own, near = L.spherical_k_means(x, 3)
    assert sorted(np.bincount(own)) == [20, 20, 20] and near.min() > 0.98
