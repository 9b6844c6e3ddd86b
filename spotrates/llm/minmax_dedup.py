"""Near duplicates by min-max hashing.

Every permutation gives two signature values, its minimum and its maximum over
the shingle set, so ``2 * PERMUTATIONS`` values cost half the hash evaluations.
Both kinds agree with probability equal to the Jaccard similarity; bands of
``ROWS`` values collide with probability s**ROWS. With 56 bands of 7 a pair at
similarity 0.8 shares no band with probability 2e-6, at 0.82 with 1e-7.

Steps: texts with equal shingle sets form one class; classes that share a band
are candidates; links are confirmed on the full sets.

* Every class is compared with the centre of each of its bands, the class with
  the most neighbours: a text and m copies of it cost m comparisons, not m * m.
* Classes x and y that share a centre c but not its component are compared by how
  they differ from c. With D(z) the symmetric difference of z and c, x and y are
  linked only if D(x) and D(y) share more than
  ``(|D(y)| + K * (|c| - |y|)) / 2`` elements, where K = (1 - s) / (1 + s) and x is
  not linked to c. So it is enough to look up x's differences among that many
  less one left out of y's, its rarest ones (fewer still once x's own distance is
  known); only pairs that meet there are confirmed. Nothing is lost by this step.

Defined cases: null or empty text (or one without words) has no shingles, is
linked with nothing and kept; a null doc_id gets the smallest id of its group
(null if there is none); repeated rows share their component, and rows with the
same doc_id are one document; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, table
from .components import connected_components
from .words import mixed, shingle_set, word_hashes

PERMUTATIONS, ROWS = 196, 7
VALUES = 2 * PERMUTATIONS
BANDS = VALUES // ROWS
THRESHOLD = 80         # percent
CHUNK = 1024           # shingles hashed at a time

_rng = np.random.Generator(np.random.PCG64(20240611))
_MASKS = _rng.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)
_FACTORS = _rng.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of all permutations, then their maxima."""
    low = high = None
    for i in range(0, len(shingles), CHUNK):
        v = shingles[i: i + CHUNK, None] ^ _MASKS
        v *= _FACTORS
        a, b = v.min(axis=0), v.max(axis=0)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.concatenate([low, high])


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, ROWS)
    key = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for j in range(ROWS):
        key = mixed(key * np.uint64(0xC2B2AE3D27D4EB4F) + rows[:, j])
    return key


def class_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _binary(column: pa.Array) -> list:
    return column.cast(pa.binary()).to_pylist()


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), cls (key of the set, null if empty), bands."""

    def run(batches):
        for batch in batches:
            n, cls, bands = [], [], []
            for h in word_hashes(_binary(batch.column("text"))):
                s = shingle_set(h, k)
                n.append(len(s))
                cls.append(class_key(s) if len(s) else None)
                bands.append(band_keys(signature(s)).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "cls", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, cls binary, bands array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """cls, shingles of every document that has any."""

    def run(batches):
        for batch in batches:
            sets = [s for s in (shingle_set(h, k) for h in word_hashes(_binary(batch.column("text")))) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([class_key(s) for s in sets], pa.binary()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["cls", "shingles"])

    return docs.select("text").mapInArrow(run, "cls binary, shingles array<long>")


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return (pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b"))


def similarity(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with the sizes of their full sets, intersection and union."""
    both = F.size(F.array_intersect("sa", "sb"))
    return with_sets(pairs, sets).select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"),
                                         both.alias("i"), (F.size("sa") + F.size("sb") - both).alias("u"))


def undecided(star: DataFrame, roots: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of different components that share a centre and may be links."""
    k = (100 - threshold) / (100 + threshold)
    of = lambda c: roots.select(F.col("cls").alias(c), F.col("root").alias(f"root_{c}"))
    placed = staged(
        star.join(of("a"), "a", "left").join(of("b"), "b", "left")
        .withColumn("root_a", F.coalesce("root_a", "a")).withColumn("root_b", F.coalesce("root_b", "b"))
        .select("a", "b", "na", "nb", "root_b", (F.col("root_a") != F.col("root_b")).alias("outside")), "placed")
    busy = placed.groupBy("a").agg(F.count("*").alias("m"), F.count_if("outside").alias("out")) \
        .filter((F.col("m") > 1) & (F.col("out") > 0)).select("a")
    apart = staged(
        with_sets(placed.join(busy, "a", "left_semi"), sets)
        .withColumn("apart", F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")))
        .select("a", "b", "nb", "root_b", "outside", F.size("apart").alias("d"),
                ((F.size("apart") + k * (F.col("na") - F.col("nb"))) / 2).alias("shared"), "apart"), "apart")
    each = apart.select("a", "b", "nb", "root_b", "d", "shared", "outside", F.explode("apart").alias("e"))
    count = each.groupBy("a", "e").agg(F.count("*").alias("often"))
    rarest = Window.partitionBy("a", "b").orderBy("often", "e")
    y = each.join(count.filter(F.col("often") > 1), ["a", "e"], "left") \
        .withColumn("often", F.coalesce("often", F.lit(1))) \
        .withColumn("place", F.row_number().over(rarest)) \
        .filter((F.col("place") <= F.col("d") - F.floor(F.col("shared") - 1e-9)) & (F.col("often") > 1)) \
        .select("a", "e", "place", F.col("b").alias("y"), F.col("nb").alias("ny"), F.col("root_b").alias("root_y"),
                F.col("d").alias("dy"))
    x = each.filter("outside").select("a", "e", F.col("b").alias("x"), "nb", "root_b", "d")
    least = (F.col("d") + F.col("dy") - k * (F.col("nb") + F.col("ny"))) / 2   # that this pair must share
    met = x.join(y, ["a", "e"]).filter(
        (F.col("root_b") != F.col("root_y")) & (F.col("place") <= F.col("dy") + 1 - F.ceil(least - 1e-9))
        & (F.least("nb", "ny") * 100 >= F.greatest("nb", "ny") * threshold)
        & (F.abs(F.col("d") - F.col("dy")) <= k * (F.col("nb") + F.col("ny")) + 1e-9))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def with_class(docs: DataFrame, column: str, k: int = 5) -> DataFrame:
    """``docs`` with the key of its text's shingle set, null if it has none."""
    fields = list(docs.schema.fields)

    def run(batches):
        for batch in batches:
            sets = [shingle_set(h, k) for h in word_hashes(_binary(batch.column("text")))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in fields),
                 pa.array([class_key(s) if len(s) else None for s in sets], pa.binary())],
                names=[*(f.name for f in fields), column])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(column, T.BinaryType())]))


def placed_rows(docs: DataFrame, k: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n, cls, component (smallest id of the group), keeper: the class
    that stands for the group, by its smallest id, then its key."""
    link = F.col("i") * 100 >= F.col("u") * threshold
    sketch = staged(sketches(docs, k), "sketches")
    classes = sketch.filter(F.col("cls").isNotNull()).groupBy("cls").agg(
        F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = staged(classes, "classes")
    shared = classes.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("size")) \
        .filter(F.col("size") > 1)
    members = staged(classes.select("cls", "n", F.explode("bands").alias("band")).join(shared, "band"), "members")

    degree = members.groupBy("cls").agg(F.sum("size").alias("degree"))
    centres = members.select("band", "cls").join(degree, "cls").groupBy("band").agg(
        F.max(F.struct("degree", "cls"))["cls"].alias("centre"))
    members = staged(members.join(centres, "band").select("band", "cls", "n", "centre"), "centred")

    needed = sketch.select("doc_id", "cls").join(members.select("cls").distinct(), "cls") \
        .groupBy("cls").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(needed, texts["doc_id"].eqNullSafe(needed["doc_id"]), "left_semi")
    sets = staged(shingle_sets(texts, k).dropDuplicates(["cls"]), "sets")

    star = members.filter(F.col("cls") != F.col("centre")).select(
        F.col("centre").alias("a"), F.col("cls").alias("b")).distinct()
    star = staged(similarity(star, sets), "star")
    links = star.filter(link).select("a", "b")
    roots = connected_components(links).withColumnRenamed("node", "cls")

    pairs = undecided(star, roots, sets, threshold)
    more = staged(similarity(pairs, sets).filter(link).select("a", "b"), "more-links")
    roots = connected_components(links.unionByName(more))

    grouped = classes.select("cls", "first_id").join(roots.withColumnRenamed("node", "cls"), "cls", "left") \
        .withColumn("root", F.coalesce("root", "cls"))
    smallest = grouped.groupBy("root").agg(
        F.min("first_id").alias("component"),
        F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "cls"))["cls"].alias("keeper"))
    of_class = grouped.join(smallest, "root").select("cls", "component", "keeper")
    return sketch.select("doc_id", "n", "cls").join(of_class, "cls", "left")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; see the module's text."""
    out = placed_rows(docs, k, threshold)
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def op6_minmax_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)
