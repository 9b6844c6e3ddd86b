"""Repair of conversation structure by an auction shortest-path algorithm.

A conversation's rows should read ``(s?(ua)+)?`` by role initials. The lattice has a
node (rows seen, last role kept: none, s, u, a); its arcs are the edits, with integer
costs: Keep 0, Rerole to user or assistant 2, Delete 3 (the only one for a blank or
duplicate row), Insert an empty turn 2, and 1 more for a truncated row that stays.

Auction. Every node has a price; a path grows from the origin. Its last node i looks
for the arc (i, j) of least cost + price(j): if that exceeds price(i), the price rises
to it and the path contracts by one node, otherwise the path extends to j. Prices
start at the sum of every later row's least cost, so that price(i) <= cost + price(j)
holds on all arcs, and rises keep it. When the path reaches the sink the prices are
optimal duals: the arcs with equality (tight) that lead on to the sink form exactly
the cheapest edits, and taking the ASCII-least tight arc at each node gives the
ASCII-least audit. Every cycle costs 4, so paths never close.

Scale. Rows are sorted once, globally, and numbered; blocks of ``BLOCK`` rows in that
order are solved apart, so a conversation may be of any length and a hot one spreads
over all tasks. A conversation inside a block is finished there. Of one that is cut,
each segment gives its 4 x 4 table of costs between border states; a pass from the
end turns these into border prices, all segments are then traced side by side for
every entry state, and a pass from the start picks the trace and hashes. Only that
last pass, which streams with constant memory, is sequential for one conversation,
as its hash is. Duplicates are found by one aggregate (first row of each role and
text), told back by row number.

Defined results: null ids, turns, roles and texts count as one space where text is
needed; null ids form one conversation, null turns come first; equal turns go by role,
then text. Repeated rows are duplicates. Empty tables give no rows; a conversation
that lost all rows gives zeros and the empty audit. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table

BLOCK_BITS = 8             # rows of a block: 2 ** 8
PIECE = 32                 # rows of a lattice that one auction solves
NO_WAY = 1 << 60
ROLES = {"u": "user", "a": "assistant"}
_NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_SHOWN = re.compile(r"[^\x20\x09-\x0D]")
OUTPUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def fault(text: str, seen: bool) -> str:
    """b(lank), d(uplicate), t(runcated) or empty: the first that holds."""
    end = len(text)
    while end and not _SHOWN.match(text[end - 1]):
        end -= 1
    return "b" if not end else "d" if seen else "" if text[end - 1] in ".!?" else "t"


def row_class(role: str, flaw: str) -> str:
    """x: must go; else the role's initial (o: other), upper case if truncated."""
    if flaw in ("b", "d"):
        return "x"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if flaw else initial


def _arcs(classes: str, exits):
    """Arcs (letter, next node, cost) of every node; the sink is the last node."""
    n = len(classes)
    sink = 4 * (n + 1)
    arcs = []
    for i in range(n + 1):
        c = classes[i] if i < n else ""
        for q in range(4):
            out = []
            if i == n and exits[q] < NO_WAY:
                out.append(("", sink, exits[q]))
            if c:
                out.append(("D", 4 * (i + 1) + q, 3))
                late = int(c.isupper())
                kept = _NEXT.get(c.lower(), (None,) * 4)[q]
                if kept is not None:
                    out.append(("K", 4 * (i + 1) + kept, late))
            for role in "ua":
                to = _NEXT[role][q]
                if to is not None:
                    out.append(("I", 4 * i + to, 2))
                    if c and c != "x":
                        out.append(("R", 4 * (i + 1) + to, 2 + late))
            arcs.append(out)
    arcs.append([])
    return arcs, sink


def _leading(arcs, sink):
    """Nodes from which the sink can be reached."""
    into = [[] for _ in arcs]
    for i, out in enumerate(arcs):
        for _, j, _ in out:
            into[j].append(i)
    found, open_ = [False] * len(arcs), [sink]
    found[sink] = True
    while open_:
        for i in into[open_.pop()]:
            if not found[i]:
                found[i] = True
                open_.append(i)
    return found


@lru_cache(maxsize=50_000)
def auction(classes: str, exits: tuple, origins: tuple):
    """For each origin state (cost, audit, exit state), or None without a way."""
    arcs, sink = _arcs(classes, exits)
    ways = _leading(arcs, sink)
    arcs = [[a for a in out if ways[a[1]]] if ways[i] else [] for i, out in enumerate(arcs)]
    least = [3 if c == "x" else 2 if c == "o" else int(c.isupper()) + 2 * (c == "O") for c in classes]
    price, rest = [0] * (sink + 1), min(exits)
    for i in range(len(classes), -1, -1):
        rest += least[i] if i < len(classes) else 0
        price[4 * i: 4 * i + 4] = [rest] * 4
    for origin in origins:
        if not ways[origin]:
            continue
        path = [origin]
        while path[-1] != sink:
            i = path[-1]
            best, to = min((cost + price[j], j) for _, j, cost in arcs[i])
            if price[i] < best:
                price[i] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
    tight = [[a for a in out if price[i] == a[2] + price[a[1]]] for i, out in enumerate(arcs)]
    ways = _leading(tight, sink)
    tight = [sorted(a for a in out if ways[a[1]]) for out in tight]
    results = []
    for origin in origins:
        if not ways[origin]:
            results.append(None)
            continue
        node, audit = origin, []
        while True:
            letter, to, _ = tight[node][0]
            if to == sink:
                break
            audit.append(letter)
            node = to
        results.append((price[origin], "".join(audit), node % 4))
    return tuple(results)


def solved(classes: str, exits: tuple, origins: tuple):
    """``auction`` piece by piece: from the last piece's border prices to the first's."""
    pieces = [classes[i: i + PIECE] for i in range(0, len(classes), PIECE)] or [""]
    chain = []
    for k in range(len(pieces) - 1, -1, -1):
        base = min(exits)
        if base >= NO_WAY:
            return (None,) * len(origins)
        ask = (0, 1, 2, 3) if k else origins
        answer = auction(pieces[k], tuple(min(e - base, NO_WAY) if e < NO_WAY else NO_WAY for e in exits), ask)
        chain.append(dict(zip(ask, answer)))
        exits = tuple(base + r[0] if (r := chain[-1].get(q)) else NO_WAY for q in range(4))
    out = []
    for origin in origins:
        state, audit = origin, []
        for answer in reversed(chain):
            if answer[state] is None:
                break
            _, letters, state = answer[state]
            audit.append(letters)
        else:
            out.append((exits[origin], "".join(audit), state))
            continue
        out.append(None)
    return tuple(out)


def costs_between(classes: str) -> list[int]:
    """Cost from each entry state to each exit state (row by row)."""
    table = [[NO_WAY] * 4 for _ in range(4)]
    for q in range(4):
        exits = tuple(0 if x == q else NO_WAY for x in range(4))
        for p, r in enumerate(solved(classes, exits, (0, 1, 2, 3))):
            if r:
                table[p][q] = r[0]
    return [c for row in table for c in row]


END = (0, NO_WAY, NO_WAY, 0)


def turns_after(roles, texts, audit: str, state: int):
    """The repaired turns (role, text) that an audit makes of rows."""
    i, out = 0, []
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        if letter == "K":
            role, text = roles[i], texts[i]
            state = _NEXT[role[0]][state]
        else:
            state = 3 if state == 2 else 2
            role, text = "assistant" if state == 3 else "user", texts[i] if letter == "R" else ""
        i += letter != "I"
        out.append((role, text))
    return out


def _text(c) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """The damage that this operator's query inflicts, by hash of conversation and turn."""
    kind = F.pmod(F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")), F.lit(20))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       _text("role").alias("role"), _text("text").alias("text"), kind.alias("kind")) \
        .filter("kind != 0").select(
            "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")) \
        .drop("copy")


_STATS = ("blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, "
          "first_initial string, last_initial string")
_SEGMENT = ("conv_id long, segment long, cut boolean, classes string, roles array<string>, texts array<string>, "
            "between array<long>, " + _STATS)
_SOLVED = ("conv_id long, segment long, roles array<string>, texts array<string>, costs array<long>, "
           "audits array<string>, exits array<int>, " + _STATS)
_STAT_NAMES = [s.split()[0] for s in _STATS.split(", ")]


def _arrow(schema: str):
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()),
             "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in schema.split(", "))])


def segments(rows: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` without null roles and texts -> conversations,
    cut at block borders, with their faults; ``segment`` numbers them in order."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    numbered = staged(rows.select("conv_id", "turn", "role", "text").orderBy(*order)
                      .withColumn("row", F.monotonically_increasing_id()), "turns-in-order")
    block = F.shiftright("row", BLOCK_BITS).alias("block")
    first = numbered.groupBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256).alias("h")) \
        .agg(F.min("row").alias("row")).select("row", block)
    schema = _arrow(_SEGMENT)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        firsts = set(right["row"].to_pylist())
        rows = sorted(zip(*(left[c].to_pylist() for c in ("row", "conv_id", "turn", "role", "text"))))
        out = []
        i = 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][1] == rows[i][1]:
                j += 1
            part = rows[i:j]
            flaws = [fault(r[4], r[0] not in firsts) for r in part]
            classes = "".join(row_class(r[3], f) for r, f in zip(part, flaws))
            initials = [r[3][:1] for r in part]
            turns = [r[2] for r in part if r[2] is not None]
            edge = i == 0 or j == len(rows)
            out.append((part[0][1], part[0][0], edge, classes, [r[3] for r in part], [r[4] for r in part],
                        costs_between(classes) if edge else None, flaws.count("b"), flaws.count("d"), flaws.count("t"),
                        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), len(set(turns)),
                        min(turns, default=None), max(turns, default=None), initials[0], initials[-1]))
            i = j
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else
                                    [pa.array([], t) for t in schema.types], schema=schema)

    return staged(numbered.withColumn("block", block).groupBy("block").cogroup(first.groupBy("block"))
                  .applyInArrow(cut, _SEGMENT), "turn-segments")


def border_prices(cut: DataFrame) -> DataFrame:
    """``(segment, prices)``: least cost from each state at a segment's end to the conversation's."""
    def run(batches):
        now, exits = (), END
        for batch in batches:
            names, prices = [], []
            for conv, segment, between in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "between"))):
                if (conv,) != now:
                    now, exits = (conv,), END
                names.append(segment)
                prices.append(exits)
                exits = tuple(min(min(between[4 * p + q] + exits[q] for q in range(4)), NO_WAY) for p in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(prices, pa.list_(pa.int64()))],
                                             names=["segment", "prices"])

    return cut.select("conv_id", "segment", "between").repartition("conv_id") \
        .sortWithinPartitions("conv_id", F.desc("segment")).mapInArrow(run, "segment long, prices array<long>")


def traced(parts: DataFrame) -> DataFrame:
    """Segments with ``prices`` -> cost to the end, audit and exit state, for each entry state."""
    keep = ["conv_id", "segment", "roles", "texts"]

    def run(batches):
        for batch in batches:
            costs, audits, exits = [], [], []
            for classes, prices, edge in zip(*(batch.column(c).to_pylist() for c in ("classes", "prices", "cut"))):
                found = solved(classes, tuple(prices), (0, 1, 2, 3) if edge else (0,))
                costs.append([r and r[0] for r in found])
                audits.append([r and r[1] for r in found])
                exits.append([r and r[2] for r in found])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string())),
                 pa.array(exits, pa.list_(pa.int32())), *(batch.column(c) for c in _STAT_NAMES)], schema=_arrow(_SOLVED))

    return parts.mapInArrow(run, _SOLVED)


def repaired(rows: DataFrame):
    """``(whole, cut)``: solved conversations, and the solved segments of those that a
    block border touches. ``turns_after`` makes the repaired turns of either."""
    parts = segments(rows)
    ends = F.array(*[F.lit(x).cast("long") for x in END])
    cut = parts.filter("cut")
    return traced(parts.filter("NOT cut").withColumn("prices", ends)), traced(cut.join(border_prices(cut), "segment"))


def digest(solved_segments: DataFrame) -> DataFrame:
    """One row per conversation; its segments must follow each other in order."""
    def run(batches):
        now = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now is None or now["conv_id"] != r["conv_id"]:
                    if now is not None:
                        out.append(finished(now))
                    now = {"conv_id": r["conv_id"], "state": 0, "cost": r["costs"][0], "audit": [], "hash": hashlib.sha256(), "any": False,
                           "last": None, "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    now[c] += r[c]
                now["illegal"] += now["last"] is not None and now["last"] + r["first_initial"] not in ("su", "ua", "au")
                now["last"] = r["last_initial"]
                if r["low"] is not None:
                    now["turns"] -= now["high"] == r["low"]
                    now["low"] = r["low"] if now["low"] is None else now["low"]
                    now["high"] = r["high"]
                audit = r["audits"][now["state"]]
                for role, text in turns_after(r["roles"], r["texts"], audit, now["state"]):
                    now["hash"].update((("\n" if now["any"] else "") + f"{role}:{text}").encode())
                    now["any"] = True
                now["audit"].append(audit)
                now["state"] = r["exits"][now["state"]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=OUTPUT)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(finished(now), kinds)], names=OUTPUT)

    def finished(now):
        gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
        return (now["conv_id"], gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"],
                "".join(now["audit"]), now["hash"].hexdigest())

    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return solved_segments.mapInArrow(run, ", ".join(f"{c} {'string' if k == pa.string() else 'long'}" for c, k in zip(OUTPUT, kinds)))


def repair_digest(rows: DataFrame) -> DataFrame:
    whole, cut = repaired(rows)
    return digest(whole).unionByName(digest(cut.repartition("conv_id").sortWithinPartitions("conv_id", "segment")))


def op13_turn_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    done = repair_digest(damaged(rows)).withColumnRenamed("conv_id", "of")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    nothing = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return every.join(done, F.col("conv_id").eqNullSafe(F.col("of")), "left") \
        .select("conv_id", *[F.coalesce(c, nothing.get(c, F.lit(0).cast("long"))).alias(c) for c in OUTPUT[1:]])
