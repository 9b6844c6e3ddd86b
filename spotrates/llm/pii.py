"""Personal data by weak supervision, in DataFrame and SQL functions only.

1. Patterns propose candidates: the four base kinds (email, ip, card, phone;
   leftmost and non-overlapping per kind) and tokens of letters and digits that
   may be secrets. Possessive quantifiers keep every pattern linear.
2. Four labelers vote on each candidate (+ personal, - not, 0 no opinion): a
   strict pattern or checksum, a gazetteer (top-level domains, country codes,
   issuer digits, reserved networks, key prefixes), a cue word in the
   ``CONTEXT`` characters before it, and the shape of the token.
3. Expectation-maximisation over the counted vote patterns (at most
   ``len(KINDS) * 3**4`` rows) estimates every labeler's reliability and the
   posterior of each pattern.
4. A logistic classifier over span features is trained on these posteriors, from
   one row per feature combination (a bounded number); it is applied as an
   expression.

Base matches that pass their check always are spans and those that fail it never
are (they serve the labelers as counterexamples); a secret becomes a span if the
classifier says so and it overlaps no base span. Positions are
code points, end exclusive.

Defined cases: null text counts as empty; empty text has no spans and the hash
of the empty string; spans are ordered by start, then kind as listed in
``KINDS``; repeated rows get equal results; without candidates nothing is added;
other columns are ignored (``redacted`` keeps them); an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
CONTEXT = 32
STEP = 256     # matches whose positions are added up in one array

# Fixed by the definition of the base kinds; \G lets a match start right after another.
_LOCAL, _TOKEN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9_+/-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": rf"(?<!{_TOKEN})(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z]){_TOKEN}{{8,}}+",
}
NEEDS = {"email": "@", "phone": "+"}   # without this character there is no match

# Words, prefixes and numbers that the gazetteer and context labelers know.
CUES = {
    "email": "mail|contact|write|correo|courriel|kontakt",
    "ip": "ip|host|server|address|adresse|login",
    "card": "card|visa|pay|credit|tarjeta|carte|karte",
    "phone": "phone|tel|call|fax|mobil|dial",
    "secret": "password|passwd|pwd|token|secret|key|bearer|auth",
}
TOP_DOMAINS = "com|net|org|edu|gov|io|info|biz|eu|de|fr|es|it|uk|ch|at|us|ca"
RESERVED = r"^(?:0|10|127|255|22[4-9]|23\d|192\.168|169\.254)\."
SECRET_PREFIX = "^(?:AKIA|ASIA|ghp_|gho_|sk_|pk_|sk-|xox|eyJ|AIza|glpat)"

LABELERS = 4
MAX_ROUNDS = 200


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    v = f"cast(substring({d}, length({d}) - i + 1, 1) as int)"
    return (f"aggregate(transform(sequence(1, length({d})), i -> CASE WHEN i % 2 = 1 THEN {v} "
            f"WHEN {v} > 4 THEN 2 * {v} - 9 ELSE 2 * {v} END), 0, (s, x) -> s + x) % 10 = 0")


def _passes(kind: str, m: str) -> str:
    """Whether a match of the base kind counts."""
    d = _digits(m)
    return {
        "email": "true",
        "ip": f"forall(split({m}, '[.]'), p -> length(trim(LEADING '0' FROM p)) < 4 "
              f"AND coalesce(try_cast(trim(LEADING '0' FROM p) AS int), 0) < 256)",
        "card": f"CASE WHEN length({d}) BETWEEN 12 AND 19 THEN {_luhn(d)} ELSE false END",
        "phone": f"length({d}) BETWEEN 9 AND 15",
        "secret": "false",
    }[kind]


def _votes(kind: str, m: str, before: str) -> list[str]:
    """Four SQL expressions of -1, 0 or 1."""
    def of(yes, no="false"):
        return f"CASE WHEN {yes} THEN 1 WHEN {no} THEN -1 ELSE 0 END"

    d = _digits(m)
    strict = {k: of(_passes(k, m), f"NOT ({_passes(k, m)})") for k in BASE}
    strict["secret"] = of(f"{m} RLIKE '^(?:[0-9a-f]{{16,}}|[A-Z0-9]{{20}})$' OR ({m} RLIKE '[a-z]' AND {m} RLIKE '[A-Z]' "
                          f"AND {m} RLIKE '[0-9]' AND length({m}) >= 20)", f"length({m}) < 12")
    gazetteer = {
        "email": of(f"{m} RLIKE '(?i)[.](?:{TOP_DOMAINS})$'"),
        "ip": of("false", f"{m} RLIKE r'{RESERVED}'"),
        "card": of(f"substring({d}, 1, 1) IN ('3', '4', '5', '6')", f"substring({d}, 1, 1) NOT IN ('3', '4', '5', '6')"),
        "phone": of(f"{m} RLIKE '^[+](?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])'"),
        "secret": of(f"{m} RLIKE '{SECRET_PREFIX}'"),
    }
    shape = {
        "email": of(f"length({m}) BETWEEN 6 AND 254", f"length({m}) > 254"),
        "ip": of(f"length({m}) <= 15", f"length({m}) > 15"),
        "card": of(f"length({d}) BETWEEN 13 AND 19", f"length({d}) < 12 OR length({d}) > 19"),
        "phone": of(f"length({d}) BETWEEN 9 AND 15", f"length({d}) < 9 OR length({d}) > 15"),
        "secret": of(f"length({_digits(m)}) BETWEEN 0.15 * length({m}) AND 0.85 * length({m}) AND length({m}) >= 16",
                     f"length({m}) < 10"),
    }
    context = of(f"{before} RLIKE '(?i)(?:{CUES[kind]})'")
    return [strict[kind], gazetteer[kind], context, shape[kind]]


def _found(kind: str, text: str) -> str:
    """SQL array of the matches of one kind, with positions and the text before."""
    p = PATTERNS[kind].replace("\\", "\\\\")
    nothing = "array()"
    # transform(array(x), v -> ...)[0] names a value; STEP matches at a time keep
    # the growing arrays short.
    kept = "array<struct<start: int, end: int, m: string, before: string>>"
    step = (f"(a, x) -> named_struct('at', a.at + char_length(x.g) + char_length(x.m), 'out', concat(a.out, array("
            f"named_struct('start', a.at + char_length(x.g), 'end', a.at + char_length(x.g) + char_length(x.m), "
            f"'m', x.m, 'before', right(x.g, {CONTEXT})))))")
    some = f"aggregate(slice(z, b * {STEP} + 1, {STEP}), named_struct('at', w.at, 'out', cast(array() AS {kept})), {step})"
    walk = (f"transform(array(regexp_extract_all({text}, '{p}', 0)), h -> "
            f"transform(array(zip_with(slice(split({text}, '{p}', -1), 1, size(h)), h, "
            f"(g, m) -> named_struct('g', g, 'm', m))), z -> "
            f"aggregate(sequence(0, size(z) div {STEP}), named_struct('at', 0, 'out', cast(array() AS array<{kept}>)), "
            f"(w, b) -> transform(array({some}), r -> named_struct('at', r.at, 'out', concat(w.out, array(r.out))))[0], "
            f"w -> flatten(w.out)))[0])[0]")
    needed = f"contains({text}, '{NEEDS[kind]}')" if kind in NEEDS else f"{text} RLIKE '[0-9]'"
    if kind == "phone":
        needed += f" AND {text} RLIKE '[0-9]'"
    out = ("transform(f, c -> named_struct('start', c.start, 'kind', {k}, 'end', c.end, 'base', {ok}, "
           "'votes', concat({votes}), 'shape', {shape}))").format(
        k=KINDS.index(kind), ok=_passes(kind, "c.m"),
        votes=", ".join(f"substring('-0+', 2 + {v}, 1)" for v in _votes(kind, "c.m", "c.before")),
        shape=_shape("c.m", "c.before"))
    return f"CASE WHEN {needed} THEN {out.replace('transform(f,', f'transform({walk},', 1)} ELSE {nothing} END"


def _shape(m: str, before: str) -> str:
    """Span features as one short string: length, share of digits, letters, what stands before."""
    return (f"concat(cast(least(length({m}) div 4, 7) AS string), "
            f"cast(least(length({_digits(m)}) * 4 div length({m}), 4) AS string), "
            f"CASE WHEN {m} RLIKE '[A-Z]' THEN 'U' ELSE '-' END, CASE WHEN {m} RLIKE '[a-z]' THEN 'l' ELSE '-' END, "
            f"CASE WHEN {m} RLIKE '^[0-9a-f]+$' THEN 'x' WHEN {m} RLIKE '[^A-Za-z0-9]' THEN 's' ELSE '-' END, "
            f"CASE WHEN {before} RLIKE '[=:][\"\\' ]*$' THEN '=' WHEN {before} RLIKE '\\\\s$' THEN ' ' ELSE '.' END)")


FOUND_TYPE = "array<struct<start: int, kind: int, end: int, base: boolean, votes: string, shape: string>>"


def candidates(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with one more column: the candidates of ``text``."""
    plain = f"coalesce(`{text}`, '')"
    arrays = ", ".join(f"cast({_found(k, plain)} AS {FOUND_TYPE})" for k in KINDS)
    return docs.withColumn(name, F.expr(f"concat({arrays})"))


def reliabilities(counts):
    """Expectation-maximisation over {(kind, votes): count} ->
    {(kind, votes): posterior}. Labelers are independent given the truth."""
    rows = sorted(counts)
    n = np.array([counts[r] for r in rows], float)
    vote = np.array([["-0+".index(v) for v in votes] for _, votes in rows])
    kind = np.array([k for k, _ in rows])
    score = (vote - 1).sum(axis=1)
    post = np.where(score > 0, 0.9, np.where(score < 0, 0.1, 0.5))
    for _ in range(MAX_ROUNDS):
        tables = np.empty((2, LABELERS, 3))
        for y, w in enumerate((n * (1 - post), n * post)):
            for j in range(LABELERS):
                tables[y, j] = np.bincount(vote[:, j], w, 3) + 1
            tables[y] /= tables[y].sum(axis=1, keepdims=True)
        odds = np.empty(len(rows))
        for k in set(kind.tolist()):
            own = kind == k
            share = ((n * post)[own].sum() + 1) / (n[own].sum() + 2)
            odds[own] = np.log(share / (1 - share))
        for j in range(LABELERS):
            odds += np.log(tables[1, j, vote[:, j]] / tables[0, j, vote[:, j]])
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-6:
            break
    return dict(zip(rows, post.tolist()))


def _features(kind: int, shape: str) -> list[str]:
    return ["all", f"k{kind}", *(f"{i}{kind}{c}" for i, c in enumerate(shape))]


def classifier(rows):
    """Logistic weights by feature from (kind, shape, count, sum of posteriors)."""
    names = sorted({f for k, s, _, _ in rows for f in _features(k, s)})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, (k, s, _, _) in enumerate(rows):
        x[i, [place[f] for f in _features(k, s)]] = 1
    n, y = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows], float)
    w = np.zeros(len(names))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(names))
        step = np.linalg.solve(h, x.T @ (y - n * p) - 0.5 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(names, w.tolist()))


def fit(found: DataFrame, name: str):
    """Weights of the span classifier from the candidates of all texts."""
    each = found.select(F.explode(name).alias("c")).select("c.kind", "c.votes", "c.shape")
    counts = staged(each.groupBy("kind", "votes", "shape").count(), "pii-votes")
    patterns = {(r["kind"], r["votes"]): r["n"] for r in
                counts.groupBy("kind", "votes").agg(F.sum("count").alias("n")).collect()}
    if not patterns:
        return {}
    post = reliabilities(patterns)
    value = F.create_map(*[F.lit(x) for (k, v), p in sorted(post.items()) for x in (f"{k}{v}", p)])
    key = F.concat(F.col("kind").cast("string"), "votes")
    shapes = counts.groupBy("kind", "shape").agg(
        F.sum("count").alias("n"), F.sum(F.col("count") * value[key]).alias("y")).orderBy("kind", "shape").collect()
    return classifier([(r["kind"], r["shape"], r["n"], r["y"]) for r in shapes])


def spans(name: str, weights) -> Column:
    """Sorted array of (start, kind, end, base) from a column of candidates."""
    c = F.col(name)
    pick = lambda x: F.struct(x["start"], x["kind"], x["end"], x["base"])
    base = F.transform(F.filter(c, lambda x: x["base"]), pick)
    if not weights:
        return F.array_sort(base)
    table_ = F.create_map(*[F.lit(v) for item in sorted(weights.items()) for v in item])
    weight = lambda key: F.coalesce(F.try_element_at(table_, key), F.lit(0.0))

    def odds(x):
        kind = x["kind"].cast("string")
        total = weight(F.lit("all")) + weight(F.concat(F.lit("k"), kind))
        for i in range(6):
            total = total + weight(F.concat(F.lit(str(i)), kind, F.substring(x["shape"], i + 1, 1)))
        return total

    secret = KINDS.index("secret")
    more = F.filter(c, lambda x: (x["kind"] == secret) & (odds(x) > 0) & ~F.exists(
        base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return F.array_sort(F.concat(base, F.transform(more, pick)))


def _listed(array: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(array, lambda s: F.concat_ws(
        ":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, hash of the base spans, all spans."""
    found = staged(candidates(docs.select("doc_id", "text"), "text", "found").select("doc_id", "found"), "pii-candidates")
    out = found.select("doc_id", spans("found", fit(found, "found")).alias("s"))
    base = F.filter("s", lambda x: x["base"])

    def how_many(kind: int) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")

    return out.select(
        "doc_id", *(how_many(i).alias(f"n_{k}") for i, k in enumerate(BASE)),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("s")).alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets;
    of overlapping spans the first names the replacement. Null stays null."""
    name = "found"
    while name in docs.columns:
        name += "_"
    weights = fit(candidates(docs.select(text), text, name).select(name), name)
    kind = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, s):
        hit = s["start"] >= a["at"]
        cut = F.array(F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.get(kind, s["kind"]))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"),
                        F.when(hit, F.concat(a["out"], cut)).otherwise(a["out"]).alias("out"))

    def finish(a):
        rest = F.substring(F.col(text), a["at"] + 1, F.char_length(F.col(text)))
        return F.concat(F.array_join(a["out"], ""), rest)

    found = candidates(docs, text, name).withColumn(name, spans(name, weights))
    new = F.when(F.size(name) > 0, F.aggregate(name, start, step, finish)).otherwise(F.col(text))
    return found.withColumn(text, F.when(F.col(text).isNotNull(), new)).drop(name).select(*docs.columns)


def op3_weak_supervision_pii(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
