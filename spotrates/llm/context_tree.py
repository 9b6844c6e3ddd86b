"""Language-model scores by context-tree weighting.

A text is a sequence of tokens (words, then one end); a word is coded as its
bytes and a closing space, the end as a line feed. Every byte is decomposed into
eight binary decisions; the context of a decision is the bits before it and the
last ``DEPTH`` bytes of the running text, across words (spaces before its first
byte). In every tree of contexts the block probability of a node is the equal
mixture of its Krichevsky-Trofimov estimate and the product of its children's.
The trees are learned from the counts of all training texts and then stay fixed:
a decision's probability mixes the estimates of all depths of its path with their
posterior weights, down to the deepest context that the training texts contain.
``score(docs, running=False)`` is the model of single tokens: contexts end at
the token's start, so a text's score does not depend on the order of its words.

Texts have many positions but few distinct words and (context, byte) grams:

1. Chunks of texts become sequences of local word numbers, a chunk dictionary of
   words and one of grams, each dealt into buckets, with counts in training texts.
   Numbers travel as bytes, in batches of bounded size; a task holds a chunk's
   numbers, its dictionaries and the grams of one block, not those of all its texts.
2. Buckets are added up: the count of every word, and every distinct gram's.
3. Grams are grouped by their last ``TOP`` context bytes; the trees below are
   weighted inside a group, the levels above by joins; the way down gives
   every gram its code length.
4. Buckets hand every chunk the counts and code lengths of its own dictionaries,
   and the chunk, whose texts are read again from their word numbers, adds them up.

Defined cases: null or empty text has the end token only; repeated rows
count as often as they occur; a null doc_id counts as empty text for the split;
without training texts every estimate is uniform (one half for each decision);
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder_of_crc, staged, table
from .words import words_of

DEPTH = 6
TOP = 3                      # depth from which on trees are weighted inside a group: contexts of two bytes are few and hot
SPACE, END = 0x20, b"\n"
CHUNK_BYTES = 48 << 20       # of text, about; at least one document, less than twice that besides
DOCUMENT_BYTES = 100         # that a document counts besides its text
BLOCK_WORDS = 80_000         # of running text worked on at a time, at eight bytes each
PENDING_GRAMS = 800_000      # distinct grams of blocks that wait to be added up
BATCH_ENTRIES = 500_000      # of texts or dictionaries in one Arrow batch
BUCKETS = 509                # of words and of grams
WORDS, GRAMS = 0, 1          # kinds of dictionaries
GROUP_GRAMS = 200_000        # grams in one group, about
IDS, COUNTS, NUMBERS, REALS = "<i4", "<u4", "<i8", "<f8"   # a chunk has less than 2 ** 32 bytes, so no more of one gram

_LN2, _LNPI = math.log(2), math.log(math.pi)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 8; x > 0."""
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) \
        + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - np.log(shift)


def estimate(n0, n1):
    """Log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - _LNPI


def weighted(n0, n1, children):
    """(log weighted probability, weight of the node's own estimate)."""
    own = estimate(n0, n1)
    total = np.logaddexp(own, children) - _LN2
    return total, np.exp(own - _LN2 - total)


def decisions(grams):
    """The eight (context and bits before, bit) of every gram ``context << 8 | byte``."""
    byte, context = grams & 255, grams >> 8
    k = np.arange(8)
    node = (1 << k) | (byte[:, None] >> (8 - k))
    return (context[:, None] << 8) | node, (byte[:, None] >> (7 - k)) & 1


def shorter(key, depth):
    """The key of the same decision in the context of ``depth`` bytes."""
    return ((key >> 8) & ((1 << (8 * depth)) - 1)) << 8 | (key & 255)


def weigh_up(grams, counts, top):
    """Tables of depths ``top`` .. DEPTH: key, n0, n1, log probability, weight, parent's place."""
    key, bit = decisions(grams)
    keys, place = np.unique(key, return_inverse=True)
    place = place.reshape(key.shape)
    c = np.repeat(counts.astype(float), 8)
    b = bit.ravel()
    n1 = np.bincount(place.ravel(), c * b, len(keys))
    n0 = np.bincount(place.ravel(), c * (1 - b), len(keys))
    levels = {DEPTH: [keys, n0, n1, estimate(n0, n1), np.ones(len(keys)), None]}
    for d in range(DEPTH - 1, top - 1, -1):
        low = levels[d + 1]
        keys, up = np.unique(shorter(low[0], d), return_inverse=True)
        low[5] = up
        n0, n1, children = (np.bincount(up, low[i], len(keys)) for i in (1, 2, 3))
        total, weight = weighted(n0, n1, children)
        levels[d] = [keys, n0, n1, total, weight, None]
    return levels, place, bit


def step_down(n0, n1, weight, mixed, rest, stop):
    """From the parent's (mixed, rest, stop) to the node's; ``stop`` is the
    probability of a one if the path ended there."""
    own = (n1 + 0.5) / (n0 + n1 + 1)
    seen = n0 + n1 > 0
    here = mixed + rest * own
    return mixed + rest * weight * own, rest * (1 - weight), np.where(seen, here, stop)


def code_lengths(grams, counts, top_keys, mixed, rest, stop, top):
    """log10 probability of every gram, given the state at depth ``top``."""
    levels, place, bit = weigh_up(grams, counts, top)
    at = np.searchsorted(top_keys, levels[top][0])
    mixed, rest, stop = mixed[at], rest[at], stop[at]
    for d in range(top + 1, DEPTH + 1):
        _, n0, n1, _, weight, up = levels[d]
        mixed, rest, stop = step_down(n0, n1, weight, mixed[up], rest[up], stop[up])
    p = stop[place]
    return np.log10(np.where(bit == 1, p, 1 - p)).sum(axis=1)


def byte_grams(pieces):
    """(gram of every coded byte, coded bytes of each piece); a piece begins with the
    ``DEPTH`` bytes before its first coded one."""
    size = np.array([len(p) for p in pieces], np.int64)
    data = b"".join(pieces) + bytes(8)
    # Eight bytes from every position on, of which the first seven are the gram.
    gram = np.ndarray((len(data) - 8,), ">i8", data, strides=(1,)).astype(np.int64)
    gram >>= 8
    gram &= (1 << 8 * (DEPTH + 1)) - 1
    whole = np.ones(len(gram), bool)           # not across the end of a piece
    whole[(np.cumsum(size)[:, None] - np.arange(1, DEPTH + 1)).ravel()] = False
    return gram[whole], size - DEPTH


def coded(words, running):
    """The words (joined by a space), each with the spaces up to the next one; no Python object for each."""
    between = b" " * (1 if running else DEPTH + 1)
    words += b" "
    ends = np.flatnonzero(np.frombuffer(words, np.uint8) == SPACE)
    offsets = np.append(0, np.cumsum(np.diff(ends, prepend=-1) - 1 + len(between)))
    data = words.replace(b" ", between)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), len(between)


def blocks(texts, words):
    """(places of texts, their pieces) of about BLOCK_WORDS words at a time; ``words`` are coded."""
    most = 8 * BLOCK_WORDS
    words, between = words
    places, pieces, size = [], [], 0
    for k, ids in enumerate(texts):
        found = words.take(pa.array(ids))
        end = int(np.frombuffer(found.buffers()[1], np.int64)[len(ids)])
        data = b" " * DEPTH + memoryview(found.buffers()[2])[:end - between]
        for at in range(0, len(data) - DEPTH, most):
            places.append(k)
            pieces.append(data[at: at + most + DEPTH])
            size += len(pieces[-1])
            if size >= most:
                yield np.array(places), pieces
                places, pieces, size = [], [], 0
    if pieces:
        yield np.array(places), pieces


def is_padding(gram):
    """A coded space follows a word's byte; one after a space only sets words apart."""
    return gram & 0xFFFF == SPACE << 8 | SPACE


def added_up(grams, counts, kind=NUMBERS):
    """Sorted distinct grams of lists without repeats, and the sum of their counts."""
    gram = np.concatenate(grams)
    gram.sort()                                # much faster than hashing
    gram = gram[np.append(True, gram[1:] != gram[:-1])] if len(gram) else gram
    total = np.zeros(len(gram), kind)
    for g, n in zip(grams, counts):
        for i in range(0, len(g) if n is not None else 0, PENDING_GRAMS):
            j = i + PENDING_GRAMS
            total[np.searchsorted(gram, g[i:j])] += n[i:j]
    return gram, total


def distinct_grams(texts, words, running, train=None):
    """Sorted distinct grams of the texts, and their counts in those of ``train``; ``words`` are coded."""
    grams, counts, size = [], [], 0
    for places, pieces in blocks(texts, words):
        gram, own = byte_grams(pieces)
        use = np.repeat(np.zeros(len(own), bool) if train is None else train[places], own)
        for g, counted in ((gram[use], True), (gram[~use], False)):
            g, n = np.unique(g if running else g[~is_padding(g)], return_counts=True)
            grams.append(g)
            counts.append(n.astype(COUNTS) if counted else None)
            size += len(g)
        if size > PENDING_GRAMS and len(grams) > 3:
            gram, n = added_up(grams, counts, COUNTS)
            grams, counts, size = [gram], [n if train is not None else None], 0
    return added_up(grams, counts, COUNTS)


def packed(numbers: np.ndarray, kind: str) -> bytes:
    """Bytes of equal weight lie side by side: sorted or small numbers compress well like that."""
    return numbers.astype(kind).view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def unpacked(data, kind: str) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def chunks(docs: DataFrame, running: bool) -> DataFrame:
    """Rows of two kinds. Texts: chunk, doc_id, held_out, data (packed ids of its words in order, the end too).
    Dictionaries: chunk, kind, bucket, data (words, or packed grams), packed counts in training texts;
    a word's id is its place in the chunk's buckets of words, one after the other."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                      (remainder_of_crc(F.col("doc_id"), 5) == 1).alias("held_out"))
    schema = "chunk long, doc_id long, held_out boolean, kind int, bucket int, data binary, counts binary"
    shape = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("kind", pa.int32()),
                       ("bucket", pa.int32()), ("data", pa.binary()), ("counts", pa.binary())])

    def rows(**columns):
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in shape], schema=shape)

    def dealt(number, kind, bucket, pack, counts):
        """The dictionary, which is in the order of its buckets, as a row for each."""
        ends = np.searchsorted(bucket, np.arange(BUCKETS + 1)).tolist()
        own = [(b, range(i, j)) for b, (i, j) in enumerate(zip(ends[:-1], ends[1:])) if j > i]
        for begin, end in slices_of([r for _, r in own]):
            some = own[begin:end]
            yield rows(chunk=[number] * len(some), kind=[kind] * len(some), bucket=[b for b, _ in some],
                       data=[pack(r.start, r.stop) for _, r in some],
                       counts=[packed(counts[r.start:r.stop], COUNTS) for _, r in some])

    def closed(number, doc_ids, held, texts, local):
        words = list(local)
        local.clear()
        pa.default_memory_pool().release_unused()      # of the batches read
        bucket = np.array([zlib.crc32(w) % BUCKETS for w in words], np.int32)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        train = ~np.array(held)
        count = np.zeros(len(words), np.int64)
        for t, use in zip(texts, train):
            if use:
                np.add.at(count, t, 1)
        for i, j in slices_of(texts):
            yield rows(chunk=[number] * (j - i), doc_id=doc_ids[i:j], held_out=held[i:j],
                       data=[packed(rank[t], IDS) for t in texts[i:j]])
        in_order = [words[i] for i in order.tolist()]
        yield from dealt(number, WORDS, bucket[order], lambda i, j: b" ".join(in_order[i:j]), count[order])
        words = coded(b" ".join(words), running)
        del in_order, bucket, rank
        gram, count = distinct_grams(texts, words, running, train)
        texts.clear()
        del words
        order = np.argsort(gram % BUCKETS, kind="stable")
        gram, count = gram[order], count[order]
        del order
        yield from dealt(number, GRAMS, gram % BUCKETS, lambda i, j: packed(gram[i:j], NUMBERS), count)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        doc_ids, held, texts, local, size = [], [], [], {}, 0
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            for doc_id, text, out in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(),
                                         batch.column("held_out").to_pylist()):
                words = words_of(text)
                words.append(END)
                doc_ids.append(doc_id)
                held.append(out)
                texts.append(np.array([local.setdefault(w, len(local)) for w in words], np.int32))
                size += len(text or b"") + DOCUMENT_BYTES
                if size >= 2 * CHUNK_BYTES:
                    yield from closed(number, doc_ids, held, texts, local)
                    number += 1
                    doc_ids, held, texts, local, size = [], [], [], {}, 0
        if texts:
            yield from closed(number, doc_ids, held, texts, local)

    # Every chunk has its own dictionaries: small splits are read together, as long as all cores have work.
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return own.coalesce(max(cores, -(-size // CHUNK_BYTES))).mapInArrow(run, schema)


def slices_of(texts):
    """(begin, end) of neighbouring texts, or parts of a dictionary, with about BATCH_ENTRIES words together."""
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= BATCH_ENTRIES or i + 1 == len(texts):
            yield begin, i + 1
            begin, total = i + 1, 0


def gram_code_lengths(grams: DataFrame) -> DataFrame:
    """``grams(gram, count)`` -> gram, lp (log10 of its probability in its context)."""
    spark = grams.sparkSession
    n = grams.count()
    groups = max(1, -(-n // GROUP_GRAMS))
    group = lambda context: F.pmod(F.xxhash64(context), F.lit(groups))
    grouped = staged(grams.withColumn("part", group(F.shiftright("gram", 8).bitwiseAND((1 << 8 * TOP) - 1))), "grams")

    def up(_, t):
        keys, n0, n1, total, weight, _ = weigh_up(t["gram"].to_numpy(), t["count"].to_numpy(), TOP)[0][TOP]
        return pa.table({"key": keys, "n0": n0, "n1": n1, "lw": total, "weight": weight})

    def weighing(frames):
        for f in frames:
            f["lw"], f["weight"] = weighted(f["n0"].to_numpy(), f["n1"].to_numpy(), f["lw"].to_numpy())
            yield f

    shape = "key long, n0 double, n1 double, lw double, weight double"
    levels = {TOP: staged(grouped.groupBy("part").applyInArrow(lambda k, t: up(k, t), shape), "tree")}
    for d in range(TOP - 1, -1, -1):
        mask = (1 << (8 * d)) - 1
        parent = F.shiftleft(F.shiftright("key", 8).bitwiseAND(mask), 8).bitwiseOR(F.col("key").bitwiseAND(255))
        levels[d] = staged(levels[d + 1].groupBy(parent.alias("key")).agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("lw"), F.lit(0.0).alias("weight"))
            .mapInPandas(weighing, shape), "tree")

    def down(frames):
        for f in frames:
            m, r, s = step_down(*(f[c].to_numpy() for c in ("n0", "n1", "weight", "mixed", "rest", "stop")))
            yield pd.DataFrame({"key": f["key"], "mixed": m, "rest": r, "stop": s})

    state = "key long, mixed double, rest double, stop double"
    at = levels[0].select("*", F.lit(0.0).alias("mixed"), F.lit(1.0).alias("rest"), F.lit(0.5).alias("stop")) \
        .mapInPandas(down, state)
    for d in range(1, TOP + 1):
        mask = (1 << (8 * (d - 1))) - 1
        parent = F.shiftleft(F.shiftright("key", 8).bitwiseAND(mask), 8).bitwiseOR(F.col("key").bitwiseAND(255))
        at = levels[d].withColumn("parent", parent).join(at.withColumnRenamed("key", "parent"), "parent") \
            .mapInPandas(down, state)
    top = staged(at.withColumn("part", group(F.shiftright("key", 8))), "tree-state")

    def lengths(left, right):
        gram = left["gram"].to_numpy()
        right = right.sort_by("key")
        lp = code_lengths(gram, left["count"].to_numpy(), *(right[c].to_numpy() for c in ("key", "mixed", "rest", "stop")), TOP)
        return pa.table({"gram": gram, "lp": lp})

    return grouped.groupBy("part").cogroup(top.groupBy("part")).applyInArrow(lengths, "gram long, lp double")


HANDED = "chunk long, kind int, bucket int, data binary, n long, v long"


def handed(blobs, kind, values, **totals):
    """Rows for the chunks: the values of every dictionary's entries."""
    n = len(blobs)
    return pa.table({"chunk": blobs["chunk"].cast(pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "bucket": blobs["bucket"],
                     "data": pa.array([packed(v, REALS) for v in values], pa.binary()),
                     **{c: pa.array([totals.get(c)] + [0] * (n - 1) if c in totals else [None] * n, pa.int64()) for c in "nv"}})


def word_counts(blobs: DataFrame) -> DataFrame:
    """Counts over all training texts for every chunk's words; n and v (tokens and
    distinct words of training texts) add up over the rows."""
    def count(t):
        total: dict = {}
        lists = [d.split(b" ") for d in t["data"].to_pylist()]
        for words, counts in zip(lists, t["counts"]):
            for w, c in zip(words, unpacked(counts.as_buffer(), COUNTS).tolist()):
                total[w] = total.get(w, 0) + c
        all_ = total.values()
        return handed(t, WORDS, [np.array([total[w] for w in words]) for words in lists], n=sum(all_), v=sum(c > 0 for c in all_))

    return blobs.groupBy("bucket").applyInArrow(count, HANDED)


def running_code_lengths(blobs: DataFrame) -> DataFrame:
    """The code lengths of every chunk's grams."""
    def add(t):
        gram, count = added_up(*([unpacked(d.as_buffer(), kind) for d in t[c]] for c, kind in (("data", NUMBERS), ("counts", COUNTS))))
        return pa.table({"gram": gram, "count": count.astype(float)})

    distinct = staged(blobs.groupBy("bucket").applyInArrow(add, "gram long, count double"), "lm-grams")
    lengths = gram_code_lengths(distinct).withColumn("of", F.pmod("gram", F.lit(BUCKETS)).cast("int"))

    def hand(left, right):
        right = right.sort_by("gram")
        gram, lp = right["gram"].to_numpy(), right["lp"].to_numpy()
        return handed(left, GRAMS, (lp[np.searchsorted(gram, unpacked(d.as_buffer(), NUMBERS))] for d in left["data"]))

    return blobs.select("chunk", "bucket", "data").groupBy("bucket").cogroup(lengths.groupBy("of")).applyInArrow(hand, HANDED)


def parts(t, kind):
    """Data of the dictionaries of a kind, in the order of the buckets."""
    rows = zip(t["kind"].to_pylist(), t["bucket"].to_pylist(), t["data"])
    return [d for _, d in sorted(((b, d.as_buffer()) for k, b, d in rows if k == kind), key=lambda x: x[0])]


class Texts:
    """Word numbers of texts, in the rows of ``data`` that ``own`` marks, unpacked when they are read."""

    def __init__(self, data, own):
        self.data, self.own = data, pa.array(own)
        self.rows = np.flatnonzero(own).tolist()
        self.size = pc.binary_length(data).to_numpy()[own].astype(np.int64) // np.dtype(IDS).itemsize

    def __len__(self):
        return len(self.rows)

    def __iter__(self):
        return (unpacked(self.data[i].as_buffer(), IDS) for i in self.rows)

    def batches(self):
        """(where each text begins, their numbers in a row), about BATCH_ENTRIES at a time."""
        texts = iter(self)
        for i, j in slices_of([range(n) for n in self.size.tolist()]):
            size = self.size[i:j]
            yield np.cumsum(size) - size, np.concatenate([next(texts) for _ in size])


def score(docs: DataFrame, running: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    both = staged(chunks(docs, running), "lm-chunks")
    blobs = lambda kind: both.filter(F.col("kind") == kind).select("chunk", "bucket", "data", "counts")
    counts = staged(word_counts(blobs(WORDS)), "lm-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n, scale = total["n"], total["n"] + 0.5 * (total["v"] + 1)
    values = counts.unionByName(running_code_lengths(blobs(GRAMS))).select(F.col("chunk").alias("of"), "kind", "bucket", "data")
    own = both.filter(F.col("kind").isNull() | (F.col("kind") == WORDS)).select("chunk", "doc_id", "held_out", "kind", "bucket", "data")

    def add_up(left, right):
        words = coded(b" ".join(parts(left, WORDS)), running)
        count, lp = (np.concatenate([unpacked(d, REALS) for d in parts(right, k)]) for k in (WORDS, GRAMS))
        texts = Texts(left["data"], pc.is_null(left["kind"]).to_numpy())
        gram = distinct_grams(texts, words, running)[0]
        length = np.empty(len(gram))
        length[np.argsort(gram % BUCKETS, kind="stable")] = lp
        del lp
        total = np.zeros(len(texts))
        for places, pieces in blocks(texts, words):
            g, size = byte_grams(pieces)
            g, at = np.unique(g, return_inverse=True)
            place = np.minimum(np.searchsorted(gram, g), len(gram) - 1)
            found = np.where(gram[place] == g, length[place], 0.0)         # padding is not found
            np.add.at(total, places, np.add.reduceat(found[at], np.cumsum(size) - size))
        of_word = (count > 0).astype(np.int64), np.log10((count + 0.5) / scale), pc.binary_length(words[0]).to_numpy() - words[1] + 1
        known, base, size = (np.concatenate(x) for x in zip(*(
            [np.add.reduceat(x[at], first) for x in of_word] for first, at in texts.batches())))
        return pa.table({
            "doc_id": left["doc_id"].filter(texts.own), "held_out": left["held_out"].filter(texts.own), "n_tokens": texts.size, "n_known": known,
            "train_tokens": np.full(len(texts), n, np.int64), "base_score": base, "score": total,
            "bits_per_byte": -total / math.log10(2) / np.maximum(size - 1, 1)})

    return own.groupBy("chunk").cogroup(values.groupBy("of")).applyInArrow(
        add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                "base_score double, score double, bits_per_byte double")


def op7_context_tree_lm(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), running=True)
