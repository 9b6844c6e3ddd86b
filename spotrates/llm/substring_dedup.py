"""Exact removal of repeated word passages by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document. The minimiser of a
window is the least hash among its ``PART``-word parts; consecutive windows that
share it travel as ONE string (a super-k-mer) to the bucket of that minimiser,
instead of 13 times as many words window by window. Equal windows have equal
minimisers, so each bucket holds every occurrence of its windows and sorts them;
equal hashes are settled by the words themselves, so counting is exact.

Which document keeps a window. The smallest ``doc_id`` that holds a window owns
it; everyone else loses the words it covers. A bucket therefore tells only
OWNERS: for each distinct super-k-mer one message, to the smallest document that
holds it, saying which of its windows it owns. A document that is not told of a
super-k-mer owns none of its windows. Messages go by document, so a passage in
a third of all documents is one string per task on the way in and one message
on the way back.

Hot minimisers (one part shared by very many different super-k-mers) would fill a
bucket. A sketch of counters, whose number grows with the text, finds every
minimiser that occurs over ``HOT`` times (it may name others too); super-k-mers of
these are cut into single windows, each dealt by its own hash. Both forms give
the same result.

Rows between stages are packed: one compressed block per task slice and bucket.
Nothing goes to the driver but sizes and the sketch's hot bits.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A null or empty text
has no words and keeps the empty text. Rows of one ``doc_id`` are never smaller than
each other: they keep what the id owns. A row without an id is neither smaller nor
larger than others: it keeps all words and takes none. Very long texts are one
row's memory. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .words import mixed

WINDOW, PART = 13, 3
RUN = 16                   # windows a super-k-mer may have at most: one bit each
CHARS = 2_000_000          # of text, cut at a time
FLUSH = 6_000_000          # of text, packed at a time
BUCKET_CHARS = 3_000_000   # of text a bucket (its super-k-mers have about three times as much)
TASK_CHARS = 16_000_000    # of text a task, which takes its buckets one by one
HOT = 100_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_K = [np.uint64(k) for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def pack(*parts) -> bytes:
    parts = [np.ascontiguousarray(p).tobytes() if isinstance(p, np.ndarray) else bytes(p) for p in parts]
    sizes = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(sizes + b"".join(parts))


def unpack(block: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = 8 + 8 * count + np.cumsum(np.frombuffer(raw, np.int64, count, 8))
    return [raw[a:b] for a, b in zip([8 + 8 * count, *ends[:-1].tolist()], ends.tolist())]


_known: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n of ``base``, kept for the next lines of this task."""
    if len(_known.get(base, ())) <= n:
        out = np.full(max(n, CHARS) + 1, base, np.uint64)
        out[0] = 1
        _known[base] = np.cumprod(out, out=out)
    return _known[base][: n + 1]


class Lines:
    """Words and windows of lines: ``text`` is words joined by one space, each
    line ended by one newline."""

    def __init__(self, text: bytes, window: int = WINDOW):
        self.text = text
        c = np.frombuffer(text, np.uint8)
        self.end = np.flatnonzero((c == 32) | (c == 10))
        self.start = np.concatenate([[0], self.end[:-1] + 1]) if len(self.end) else self.end
        last = c[self.end] == 10
        self.line = np.cumsum(last) - last
        self.n_words = np.bincount(self.line) if len(self.line) else np.zeros(0, np.int64)
        self._inverse = _powers(_INVERSE, len(c))
        self._sums = np.zeros(len(c) + 1, np.uint64)
        part = c.astype(np.uint64)
        part += np.uint64(1)
        part *= _powers(_BASE, len(c))[:-1]
        np.cumsum(part, out=self._sums[1:])
        n = max(len(self.start) - window + 1, 0)
        self.first = np.flatnonzero(self.line[:n] == self.line[window - 1: window - 1 + n])   # first words of windows
        self.window = window

    def hashes(self, start, end):
        return mixed((self._sums[end] - self._sums[start]) * self._inverse[start])

    def window_hashes(self):
        return self.hashes(self.start[self.first], self.end[self.first + self.window - 1])

    def minimisers(self, part: int = PART):
        """The least hash of the ``part``-word parts of every window."""
        words = self.hashes(self.start, self.end)
        n = len(words) - part + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        low = np.zeros(n, np.uint64)
        for i in range(part):
            low = mixed(low * _K[2] + words[i: i + n] * _K[i % 2])
        span, have = self.window - part + 1, 1
        while have < span:
            step = min(have, span - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        return low[self.first]


class SuperKmers:
    """Runs of consecutive windows of one line with one minimiser; windows of hot
    minimisers are runs of their own. ``windows[begin:end]`` of run i are its."""

    def __init__(self, lines: Lines, hot: np.ndarray, part: int = PART):
        key = lines.minimisers(part)
        self.lines, first, n = lines, lines.first, len(lines.first)
        alone = hot[key % np.uint64(len(hot))] if n else np.zeros(0, bool)
        if alone.any():
            key[alone] = lines.window_hashes()[alone]
        new = np.ones(n, bool)
        new[1:] = (key[1:] != key[:-1]) | (first[1:] != first[:-1] + 1) | alone[1:]
        head = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        new |= (np.arange(n) - head[run]) % RUN == 0 if n else False
        self.begin = np.flatnonzero(new)
        self.size = np.diff(np.append(self.begin, n))
        self.key = key[self.begin]
        self.line = lines.line[first[self.begin]]
        self.from_char = lines.start[first[self.begin]]
        self.to_char = lines.end[first[self.begin] + self.size + lines.window - 2] if n else self.from_char

    def strings(self, order=None) -> list[bytes]:
        a, b = (self.from_char, self.to_char) if order is None else (self.from_char[order], self.to_char[order])
        text = self.lines.text
        return [text[i:j] for i, j in zip(a.tolist(), b.tolist())]


def digest(s: bytes) -> int:
    return xxhash.xxh3_64_intdigest(s)


def normal(text: bytes | None) -> bytes:
    return b" ".join(text.split()) if text else b""


def _blocks(batches, chars: int):
    """(ids, texts) of about ``chars`` characters; texts are normal forms."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        ids = batch.column("doc_id").to_pylist()
        sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
        i = 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + chars, side="right")) - 1)
            yield ids[i:j], [normal(t.as_py()) for t in texts[i:j]]
            i = j


def _with_words(ids, texts):
    return [(i, t) for i, t in zip(ids, texts) if t and i is not None]


def _split(owner: np.ndarray):
    """Stable order by owner and (owner, begin, end) of every group."""
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[order])) + 1
    edges = [0, *cuts.tolist(), len(order)] if len(order) else [0]
    return order, [(int(owner[order[a]]), a, b) for a, b in zip(edges, edges[1:])]


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(x) >> np.uint64(20)) % np.uint64(buckets)


def hot_minimisers(texts: DataFrame, chars: int, hot: int, part: int, window: int) -> np.ndarray:
    """Bits by ``minimiser % width``: set where a counter is over ``hot``."""
    width = 1 << max(12, int(8 * chars / 30 / hot + 1).bit_length())

    def count(batches):
        total = np.zeros(width, np.int64)
        for ids, found in _blocks(batches, CHARS):
            rows = _with_words(ids, found)
            if rows:
                runs = SuperKmers(Lines(b"\n".join(t for _, t in rows) + b"\n", window), np.zeros(1, bool), part)
                total += np.bincount((runs.key % np.uint64(width)).astype(np.int64), minlength=width)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["counter", "n"])

    rows = texts.mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")) \
        .filter(F.col("n") > hot).select("counter").toArrow()
    bits = np.zeros(width, bool)
    bits[rows["counter"].to_numpy()] = True
    return bits


def owned_windows(lines: list[bytes], docs: np.ndarray, window: int = WINDOW):
    """Of distinct super-k-mers and the smallest document of each: bits of the
    windows that this document owns, by sorting all windows."""
    at = Lines(b"\n".join(lines) + b"\n", window)
    h = at.window_hashes()
    line = at.line[at.first]
    owner = docs[line]
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[order][1:] == h[order][:-1]
    again = order[same[1:] | same[:-1]]                  # windows whose hash occurs twice or more
    text, a, b = at.text, at.start[at.first[again]], at.end[at.first[again] + window - 1]
    words = [text[i:j] for i, j in zip(a.tolist(), b.tolist())]
    least: dict[bytes, int] = {}
    for w, d in zip(words, owner[again].tolist()):
        if d < least.get(w, d + 1):
            least[w] = d
    smallest = owner.copy()
    smallest[again] = np.fromiter((least[w] for w in words), np.int64, len(words))
    begin = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    bit = np.arange(len(line)) - np.repeat(begin, np.diff(np.append(begin, len(line))))
    return np.bitwise_or.reduceat(np.where(smallest == owner, 1 << bit, 0), begin)


def without_repeats(docs: DataFrame, window: int = WINDOW, part: int = PART, hot: int = HOT,
                    bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``, one row per document; ``kept`` is its
    remaining words, joined by one space."""
    if not part <= window:
        raise ValueError("a part cannot be longer than its window")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, chars // bucket_chars + 1)
    tasks = min(buckets, max(8, chars // TASK_CHARS + 1))
    share = docs.sparkSession.sparkContext.broadcast(hot_minimisers(texts, chars, hot, part, window))

    def to_buckets(batches):
        def flush(keys_of, ids_of, strings):
            keys, owners = np.concatenate(keys_of), np.concatenate(ids_of)
            order, groups = _split(_bucket(keys, buckets).astype(np.int64))
            order = order.tolist()
            where, blocks = [], []
            for bucket, a, b in groups:
                least: dict[bytes, int] = {}             # a passage repeated here travels once
                for i in order[a:b]:
                    s, d = strings[i], int(owners[i])
                    if d < least.get(s, d + 1):
                        least[s] = d
                where.append(bucket)
                blocks.append(pack(np.fromiter(least.values(), np.int64, len(least)), b"\n".join(least)))
            return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(blocks, pa.binary())],
                                              names=["bucket", "block"])

        keys_of, ids_of, strings, size = [], [], [], 0
        for ids, found in _blocks(batches, CHARS):
            rows = _with_words(ids, found)
            if not rows:
                continue
            runs = SuperKmers(Lines(b"\n".join(t for _, t in rows) + b"\n", window), share.value, part)
            keys_of.append(runs.key)
            ids_of.append(np.array([i for i, _ in rows], np.int64)[runs.line])
            strings += runs.strings()
            size += len(runs.lines.text)
            if size >= FLUSH:
                yield flush(keys_of, ids_of, strings)
                keys_of, ids_of, strings, size = [], [], [], 0
        if keys_of:
            yield flush(keys_of, ids_of, strings)

    def tell_owners(batches):
        def told(blocks):
            least: dict[bytes, int] = {}
            for owners, strings in map(unpack, blocks):
                for s, d in zip(strings.split(b"\n") if strings else [], np.frombuffer(owners, np.int64).tolist()):
                    if d < least.get(s, d + 1):
                        least[s] = d
            lines = list(least)
            docs = np.fromiter(least.values(), np.int64, len(lines))
            bits = owned_windows(lines, docs, window) if lines else np.zeros(0, np.int64)
            some = np.flatnonzero(bits)
            names = np.fromiter((digest(lines[i]) for i in some.tolist()), np.uint64, len(some))
            docs, bits = docs[some], bits[some].astype(np.uint16)
            order, groups = _split(_bucket(docs.view(np.uint64), buckets).astype(np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array([g for g, _, _ in groups], pa.int32()), pa.array([0] * len(groups), pa.int32()),
                 pa.array([pack(docs[o], names[o], bits[o]) for o in (order[a:b] for _, a, b in groups)], pa.binary())],
                names=["bucket", "kind", "block"])

        bucket, blocks = None, []
        for batch in batches:
            for b, block in zip(batch.column("bucket").to_pylist(), (v.as_py() for v in batch.column("block"))):
                if b != bucket and blocks:
                    yield told(blocks)
                    blocks = []
                bucket = b
                blocks.append(block)
        if blocks:
            yield told(blocks)

    def by_document(batches):
        for ids, found in _blocks(batches, FLUSH):
            place = np.array([i if i is not None else digest(t) >> 1 for i, t in zip(ids, found)], np.int64)
            order, groups = _split(_bucket(place.view(np.uint64), buckets).astype(np.int64))
            known = np.array([i is not None for i in ids])
            blocks = [pack(place[o], known[o], b"\n".join(found[i] for i in o.tolist())) for o in
                      (order[a:b] for _, a, b in groups)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _, _ in groups], pa.int32()), pa.array([1] * len(groups), pa.int32()),
                 pa.array(blocks, pa.binary())], names=["bucket", "kind", "block"])

    def remove(batches):
        def kept(block, owns):
            ids, known, text = unpack(block)
            ids, known = np.frombuffer(ids, np.int64).tolist(), np.frombuffer(known, bool).tolist()
            texts = text.split(b"\n")
            n_words = [t.count(b" ") + 1 if t else 0 for t in texts]
            n_removed, out = [0] * len(texts), list(texts)
            rows = [i for i, t in enumerate(texts) if t and known[i]]
            if rows:
                lines = Lines(b"\n".join(texts[i] for i in rows) + b"\n", window)
                runs = SuperKmers(lines, share.value, part)
                line = runs.line.tolist()
                bits = np.fromiter((owns.get((ids[rows[l]], digest(s)), 0) for l, s in zip(line, runs.strings())),
                                   np.int64, len(line))
                place = np.arange(len(lines.first)) - np.repeat(runs.begin, runs.size)
                lost = lines.first[(np.repeat(bits, runs.size) >> place) & 1 == 0]
                cover = np.zeros(len(lines.start) + window + 1, np.int64)
                np.add.at(cover, lost, 1)
                np.add.at(cover, lost + window, -1)
                gone = np.cumsum(cover)[: len(lines.start)] > 0
                begin = np.cumsum(lines.n_words) - lines.n_words
                count = np.add.reduceat(gone.astype(np.int64), begin)
                for k in np.flatnonzero(count).tolist():
                    keep = ~gone[begin[k]: begin[k] + lines.n_words[k]]
                    out[rows[k]] = b" ".join(w for w, stays in zip(texts[rows[k]].split(b" "), keep.tolist()) if stays)
                    n_removed[rows[k]] = int(count[k])
            return pa.RecordBatch.from_arrays(
                [pa.array([i if k else None for i, k in zip(ids, known)], pa.int64()), pa.array(n_words, pa.int64()),
                 pa.array(n_removed, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"])

        bucket, owns = None, {}
        for batch in batches:
            for b, kind, block in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind")), (v.as_py() for v in batch.column("block"))):
                if b != bucket:
                    bucket, owns = b, {}
                if kind:
                    yield kept(block, owns)
                else:
                    docs, names, bits = unpack(block)
                    owns.update(zip(zip(np.frombuffer(docs, np.int64).tolist(), np.frombuffer(names, np.uint64).tolist()),
                                    np.frombuffer(bits, np.uint16).tolist()))

    kind_of_row = "bucket int, kind int, block binary"
    told = texts.mapInArrow(to_buckets, "bucket int, block binary").repartition(tasks, "bucket") \
        .sortWithinPartitions("bucket").mapInArrow(tell_owners, kind_of_row)
    return told.unionByName(texts.mapInArrow(by_document, kind_of_row)).repartition(tasks, "bucket") \
        .sortWithinPartitions("bucket", "kind").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


def op11_super_kmer_dedup(spark, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + {WINDOW - 1}], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d)),
own AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(p, p + {WINDOW})))) AS g
  FROM win JOIN own USING (k) WHERE m < doc_id GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(g, i), false)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)"""
