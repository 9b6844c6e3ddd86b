import corpus_pipeline as P
from spotrates.llm import decontaminate, minmax_dedup, pii
from spotrates.llm.common import staged, table

SF = "/root/testdata/sf0.01"


def by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_every_stage_against_its_input(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    results = []
    for name, stage in P.STAGES:
        docs = staged(stage(spark, docs, SF), name)
        results.append(docs)
    assert all(r.columns == columns for r in results[:-1])
    source, clean, single, unleaked, hidden, packed = by_id(table(spark, SF, "documents")), *map(by_id, results[:4]), results[4]

    bad = {"trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "scum", "loser", "moron"}
    toxic = {i for i, t in source.items() if bad & set("".join(c if c.isalnum() else " " for c in t.lower()).split())}
    rejected = set(source) - set(clean)   # the other languages have toxic words of their own
    assert toxic <= rejected and len(rejected - toxic) <= 0.05 * len(source)
    truth = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    assert sum(truth.get(i) == 0 for i in rejected) <= 0.02 * len(source)

    groups = {r.doc_id: r.component_id for r in minmax_dedup.near_duplicates(results[0]).collect()}
    assert set(single) == set(groups.values()) and all(single[i] == clean[i] for i in single)

    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    leaked = {i for i, t in single.items() if any(x in t for x in items)}
    gone = set(single) - set(unleaked)
    assert leaked <= gone
    assert {r.doc_id for r in decontaminate.leaks(results[1], table(spark, SF, "benchmark")).collect()} == gone

    assert set(hidden) == set(unleaked)
    after = {r.doc_id: r for r in pii.digest(results[3]).collect()}
    assert all(after[i].n_email + after[i].n_ip + after[i].n_card + after[i].n_phone == 0 for i in hidden)
    before = {r.doc_id: r.spans for r in pii.digest(results[2]).collect()}
    assert all(hidden[i] == unleaked[i] for i in hidden if not before[i])
    assert all(r.n_chars == len(r.text) for r in results[3].collect())

    sizes = {}
    for r in packed.collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {i: len(t.encode()) + 1 for i, t in hidden.items()}


def test_edge_rows_pass(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a few clean words here", "en", "s", 1),
            (2, "a few clean words here", "en", "s", 1), (3, "A few clean words HERE", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .selectExpr("*", "1 AS toxicity", "2 AS leaks", "3 AS found")
    for name, stage in P.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), name)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "2", "None"]
    assert P.STAGES[-1][1](spark, docs, SF).count() == 4
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_near_duplicates_are_decided_row_by_row(spark):
    text = "one two three four five six seven eight nine ten"
    other = "some quite different text that has no copy at all here"
    third = "a third text of its own that shares no words with them"
    lone = "four rows without any id hold this very same long text"
    rows = [(1, text), (None, text.upper()), (None, other), (None, third), (None, ""), (None, None),
            (None, lone), (None, lone), (None, lone.title()), (None, lone),
            (2, text), (2, "the second text of the id two is not a copy"), (3, "z"), (3, "z"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' AS cls")
    got = P.STAGES[1][1](spark, docs, SF)
    assert got.columns == docs.columns
    found = sorted((str(r.doc_id), (r.text or "").lower()) for r in got.collect())
    assert found == sorted([("1", text), ("None", other), ("None", third), ("None", ""), ("None", ""), ("None", lone),
                            ("2", "the second text of the id two is not a copy"), ("2", ""), ("3", "z"), ("3", "z")])
    one_id = [(5, " ".join(f"w{i}" for i in range(200))), (5, " ".join(f"w{i}" for i in range(199)))]
    assert P.STAGES[1][1](spark, spark.createDataFrame(one_id, "doc_id long, text string"), SF).count() == 1
