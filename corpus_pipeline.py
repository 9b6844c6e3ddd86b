"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps,
with the same columns; the last one gives the packing. ``run`` writes every
stage's result as Parquet into the shared folder and rereads it, so a lost
executor costs at most a stage's own tasks.

Documents are lost only to a decision: rejected as toxic, a near duplicate of a
kept one (word shingles of five, similarity 0.8), or holding a benchmark item.
Personal data is replaced in the text (and ``n_chars`` counted anew). Null or
empty texts pass all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotrates.llm import decontaminate, minmax_dedup, packing, pii, toxicity_crf
from spotrates.llm.common import staged, table


def unused(name: str, docs: DataFrame) -> str:
    while name in docs.columns:
        name += "_"
    return name


def keep_clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity_crf.fit(docs, table(spark, sf_dir, "labels"))
    score, spans = unused("toxicity", docs), unused("toxic_spans", docs)
    return toxicity_crf.with_toxicity(docs, model, score, spans) \
        .filter(F.col(score) < toxicity_crf.THRESHOLD).select(*docs.columns)


def keep_one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decided for each row by its id and shingle set. A group keeps the rows of
    one document: its smallest id, with one shingle set; without any id, one row."""
    known = F.col("cls").isNull() | F.col("doc_id").eqNullSafe(F.col("component")) & (F.col("cls") == F.col("keeper"))
    rows = staged(minmax_dedup.placed_rows(docs).select("doc_id", "cls", known.alias("kept")), "kept-rows")
    ids = rows.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("of")) \
        .agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("all")).filter(~F.col("all"))
    own = docs["doc_id"].cast("long")
    out = docs.filter(own.isNotNull()).join(ids, own == ids["of"], "left_anti")
    key = unused("cls", docs)
    kept = rows.filter("kept AND cls IS NOT NULL").select(F.col("doc_id").alias("of"), F.col("cls").alias("kept_cls")).distinct()
    mixed = ids.filter("some").select("of")
    if not mixed.isEmpty():      # ids with several texts, not all of them kept
        part = minmax_dedup.with_class(docs.join(mixed, own == mixed["of"], "left_semi"), key)
        same = (part["doc_id"].cast("long") == kept["of"]) & (part[key] == kept["kept_cls"])
        out = out.unionByName(part.join(kept, same, "left_semi").drop(key)).unionByName(part.filter(part[key].isNull()).drop(key))
    if not rows.filter(F.col("doc_id").isNull()).isEmpty():
        part = minmax_dedup.with_class(docs.filter(own.isNull()), key)
        row = F.struct(*docs.columns)
        single = part.join(kept.filter(F.col("of").isNull()), F.col(key) == F.col("kept_cls"), "left_semi") \
            .groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
        out = out.unionByName(single).unionByName(part.filter(F.col(key).isNull()).drop(key))
    return out


def keep_unleaked(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = unused("leaks", docs)
    return decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"), leaks) \
        .filter(F.size(leaks) == 0).select(*docs.columns)


def hide_personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redacted(docs)
    if "n_chars" in out.columns:
        kind = dict(out.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.char_length("text").cast(kind))
    return out


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", keep_clean),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", keep_unleaked),
    ("personal_data", hide_personal_data),
    ("packing", pack_sequences),
]

# The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
