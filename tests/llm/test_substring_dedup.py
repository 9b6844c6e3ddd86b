import random
import re

import numpy as np
import pytest

from spotrates.llm import substring_dedup as S


def brute(rows, window=13):
    """rows (doc_id, text): every window against every document."""
    owner = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for p in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[p:p + window])
                owner[k] = min(owner.get(k, i), i)
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and owner[tuple(w[p:p + window])] < i:
                gone |= set(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def corpus(seed, n=120):
    r = random.Random(seed)
    words = ["the", "of", "a", "x", "Été", "zebra", "rights", "all", "under", "9", " nb sp"]
    line = " ".join(r.choice(words) for _ in range(30))
    rows = []
    for i in range(n):
        parts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40)))]
        if r.random() < 0.4:
            parts.append(line)
        if r.random() < 0.2:
            parts.append("a " * r.randint(1, 60))
        if rows and r.random() < 0.3:
            parts.append(r.choice(rows)[1] or "")
        r.shuffle(parts)
        rows.append((i * 7 % n, r.choice(["  ", "\n", " \t"]).join(parts)))
    return rows


EDGES = [(5, None), (6, ""), (7, " \n\t "), (None, "null " * 20), (None, "null " * 20), (-3, "n " * 13), (4, "n " * 13), (4, "n " * 14),
         (9, "one two three"), (9, "q " * 12), (10, "q " * 12), (11, "one two three"), (2**40, "w%d " * 3000), (12, "w%d " * 3000),
         (13, " ".join("abcdefghijklmnop")), (14, "a b c d e f g h i j k l m")]


@pytest.mark.parametrize("hot", [100_000, 2])
def test_equals_brute_force(spark, hot):
    rows = corpus(1) + [(1000 + (i or 0) if i is not None and i < 100 else i, t) for i, t in EDGES]
    rows = rows + rows[:3]
    df = spark.createDataFrame([(i, t, 1, "x", b"") for i, t in rows],
                               "doc_id long, text string, bucket int, kept string, block binary").repartition(5)
    got = sorted((tuple(r) for r in S.without_repeats(df, hot=hot, bucket_chars=2000).collect()), key=str)
    assert got == brute(rows)


def test_other_windows(spark):
    rows = corpus(2, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in S.without_repeats(df, window=4, part=4).collect()), key=str)
    assert got == brute(rows, 4)


def test_windows_travel_together():
    text = " ".join(f"w{i}" for i in range(2000)).encode() + b"\n"
    lines = S.Lines(text)
    runs = S.SuperKmers(lines, np.zeros(16, bool))
    assert runs.size.sum() == 1988 and runs.size.max() <= 13 - S.PART + 1 and len(runs.size) < 1988 / 4
    alone = S.SuperKmers(lines, np.ones(16, bool))
    assert (alone.size == 1).all() and len(alone.size) == 1988


def test_unpack_and_equal_hashes(monkeypatch):
    assert S.unpack(S.pack(b"", np.arange(3), b"x\ny")) == [b"", np.arange(3).tobytes(), b"x\ny"]
    monkeypatch.setattr(S.Lines, "window_hashes", lambda self: np.zeros(len(self.first), np.uint64))   # all collide
    lines = [b" ".join(b"abcdefghijklmn"[i:i + 1] for i in range(14)), b"b c d e f g h i j k l m n"]
    assert S.owned_windows(lines, np.array([4, 9])).tolist() == [3, 0]
    assert S.owned_windows(lines, np.array([9, 4])).tolist() == [1, 1]


def test_empty_table(spark):
    assert S.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
