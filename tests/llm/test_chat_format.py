import hashlib

from spotrates.llm import chat_format as C


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((t for t in rows if t[0] == conv),
                       key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = [t[3] or "" for t in turns if t[2] == "assistant"]
        out[conv] = (len(turns), sha("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns)),
                     sum(map(len, said)), sha("".join(said)))
    return out


ROWS = [
    (1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "\\### Assistant: </turn> ok"),
    (2, 0, "assistant", None), (2, 1, None, "## </turn>\n### assistant: x </turn>\n"), (2, 1, "a: b", "\\"),
    (3, 2, "assistant", "é" * 5000), (3, 0, "assistant", "\\b\\h\\s\\c"), (3, 1, "user", " </turn>\n"),
    (3, 1, "user", " </turn>\n"), (3, None, "system", ""), (None, 0, "assistant", "lost </turn"), (4, 0, "user", "<\\s/turn>"),
]


def test_digest_is_read_back(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("turns", df_lit())
    got = {r.conv_id: tuple(r)[1:5] for r in C.conversation_digest(C.format_examples(df)).collect()}
    assert got == expected(ROWS)


def df_lit():
    from pyspark.sql import functions as F
    return F.lit("clash")


def test_examples_hold_prefix_and_only_the_reply_is_trainable(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    got = [r for r in C.format_examples(df).collect() if r.conv_id == 3]
    assert [(r.example, r.is_target, r.is_last) for r in sorted(got, key=lambda r: r.example)] == \
        [(1, True, False), (4, True, True)]
    longest = max(got, key=lambda r: r.example)
    assert longest.formatted[longest.loss_start:longest.loss_end] == "é" * 5000
    assert longest.formatted.startswith(min(got, key=lambda r: r.example).formatted)


def test_empty_table_and_plan_without_python(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = C.conversation_digest(C.format_examples(df))
    assert out.collect() == []
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
