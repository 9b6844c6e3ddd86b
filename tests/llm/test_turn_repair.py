import hashlib
import random
import re
import zlib
from heapq import heappop, heappush

from pyspark.sql import functions as F

from spotrates.llm import turn_repair as T
from spotrates.llm.common import table

SHAPE = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """rows (role, text, flaw): search over whole edit sequences, by cost and then audit."""
    def step(state, role):                    # state: kept initials, shortened
        shown = (state + role)[-3:] if len(state) > 2 else state + role
        ok = {"": "su", "s": "u", "u": "a", "a": "u"}[state[-1:]]
        return shown if role in ok and role else None
    heap, seen = [(0, "", 0, "", [])], set()
    while heap:
        cost, audit, i, state, out = heappop(heap)
        if i == len(rows) and (state == "" or state.endswith("a")):
            return cost, audit, out
        if (i, state[-1:]) in seen:
            continue
        seen.add((i, state[-1:]))
        moves = []
        if i < len(rows):
            role, text, flaw = rows[i]
            moves.append((3, "D", 1, "", None))
            if flaw not in ("blank", "duplicate"):
                late = int(flaw == "truncated")
                moves.append((late, "K", 1, role[:1], (role, text)))
                moves += [(2 + late, "R", 1, x[0], (x, text)) for x in ("user", "assistant")]
        moves += [(2, "I", 0, x[0], (x, "")) for x in ("user", "assistant")]
        for w, letter, ahead, initial, turn in moves:
            to = step(state, initial) if turn else state
            if to is not None:
                heappush(heap, (cost + w, audit + letter, i + ahead, to, out + [turn] if turn else out))


def expected(table_rows, damage=True):
    out, convs = {}, {}
    for conv, turn, role, text in table_rows:
        convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            flaw = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((role, text, flaw))
            if flaw:
                count[flaw] += 1
        turns = [t for t, _, _ in rows if t is not None]
        initials = [r[:1] for _, r, _ in rows]
        cost, audit, left = cheapest(judged)
        assert SHAPE.match("".join(r[:1] for r, _ in left))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count.values(),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())
    return out


def result(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select(T.OUTPUT).collect()}


def plain(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def test_whole_tables(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = table(spark, f"/root/testdata/{sf}", "conversations")
        got = T.op13_turn_repair(spark, f"/root/testdata/{sf}")
        assert got.columns == T.OUTPUT and result(got) == expected(plain(rows))


def random_rows(seed, convs, longest):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]
    texts = ["Yes.", "No", "Well?", "", " \n", None, " ", "ok! ", "é…", "x" * 3000 + "."]
    return [(c, r.choice([t, t, t, t + 2, None]), r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"{t} said.")
            for c in convs for t in range(r.randint(0, longest))]


def test_edges_and_long_conversations(spark):
    rows = random_rows(1, [*range(60), None, -5], 9) + random_rows(2, [100], 900) + random_rows(3, [101, 102], 300)
    rows += [(200, 0, "assistant", "b."), (200, 0, "assistant", "b."), (201, None, None, None), (202, 5, "user", "a.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") \
        .withColumn("row", F.lit(1)).withColumn("kind", F.lit(0)).withColumn("cost", F.lit("x")).repartition(3)
    assert result(T.repair_digest(df.na.fill(" ", ["role", "text"]))) == expected(rows, damage=False)
    damaged = expected(rows)
    got = result(T.repair_digest(T.damaged(df)))
    assert got == {c: v for c, v in damaged.items() if c in got} and all(v[-2] == "" for c, v in damaged.items() if c not in got)


def test_conversation_without_rows_left(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "a."), (None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert result(T.op13_turn_repair(spark, str(tmp_path))) == expected(rows)
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert result(T.op13_turn_repair(spark, f"{tmp_path}/none")) == {}


def test_prices_are_shortest_costs():
    r = random.Random(5)
    for _ in range(200):
        classes = "".join(r.choice("xsuaoSUAOuaua") for _ in range(r.randint(0, 70)))
        between = T.costs_between(classes)
        k = r.randint(0, len(classes))
        a, b = T.costs_between(classes[:k]), T.costs_between(classes[k:])
        assert between == [min(min(a[4 * p + m] + b[4 * m + q] for m in range(4)), T.NO_WAY) for p in range(4) for q in range(4)]
