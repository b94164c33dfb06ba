"""Operator 1: personal data by weak supervision, in DataFrame functions alone.

Candidates are the base patterns' matches (e-mail, IP, card, phone), valid or
not, and tokens that look like credentials and overlap no valid one. Five labelers vote on each, for,
against or not at all: the base check, the shape, a gazetteer of prefixes and
key words, the context before it, and the variety of its characters.
Expectation-maximisation over the counts of vote patterns (3 ** 5 at most)
estimates how reliable each labeler is. A logistic span classifier is then
trained on the resulting posteriors over surface features, from counts of
feature patterns, and judges the candidates that the base check didn't settle.
Valid base matches are always spans.

Positions are code points, end exclusive. Null and empty text: no spans.
Repeated rows are judged each. Without candidates the classifier rejects all.
An empty table gives no rows. All patterns are possessive and start at run
boundaries, so long runs of digits or letters take linear time and no deep
recursion. Positions are running sums by blocks, so a text with very many
matches takes time in proportion to them, too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwalk.llm.common import staged

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: The base patterns, written so that a match starts only where a leftmost one can.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]{0,40}[0-9])(?=[0-9_+/-]{0,40}[A-Za-z])[A-Za-z0-9_+/-]{16,}+",
}
#: What every text with a match holds, be it valid or not; cheaper than the pattern.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "secret": r"[A-Za-z0-9_+/-]{16}"}
# Prefixes of issued keys, and words that stand before personal data.
KEY_PREFIXES = r"^(?:AKIA|ASIA|ghp_|gho_|glpat-|sk_live_|sk-|xox[abp]-|AIza|eyJ)"
KEY_WORDS = r"(?i)(?:passw(?:or)?d|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|credential|bearer)\W{0,4}$"
CONTEXT_WORDS = r"(?i)(?:tel|phone|call|fax|mail|contact|card|visa|address|login|user|key|token|pass\w{0,4}|=|:)\W{0,4}$"
LABELERS = ("base", "shape", "gazetteer", "context", "variety")
FEATURES = ("kind", "length", "digits", "mixed", "cue")
THRESHOLD = 0.5


#: Elements of a block of a running value.
BLOCK = 128


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, zero: int, op, levels: int = 1) -> Column:
    """For each of an array of ints: op over all before it.

    A block grows its array element by element, at a cost of its square;
    blocks' totals are run through likewise. So costs are in proportion to the
    array, and to a small share of the square of its blocks.
    """
    def plain(some: Column) -> Column:
        empty = F.expr(f"cast(named_struct('at', {zero}, 'out', array()) as struct<at:int,out:array<int>>)")
        return F.aggregate(some, empty, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    if not levels:
        return plain(values)

    def blocked(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / F.lit(BLOCK)).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))

        def joined(blocks: Column) -> Column:
            totals = F.transform(blocks, lambda some: F.aggregate(some, F.lit(zero), op))
            inner = F.zip_with(blocks, _running(totals, zero, op, levels - 1), lambda some, before: F.transform(plain(some), lambda x: op(x, before)))
            return F.flatten(inner)

        return F.when(F.size(v) <= BLOCK, plain(v)).otherwise(_let(cut, joined))

    return _let(values, blocked)


def _add(a: Column, b: Column) -> Column:
    return a + b


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


#: Characters before a match that labelers look at.
CONTEXT = 24


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, s, before>> of a pattern's matches: what stands between them gives the positions.

    before: what stands before a match, back to the start of the match before it, CONTEXT characters at most.
    """
    def placed(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        before = F.transform(gaps, lambda gap, i: F.right(F.concat(F.when(i > 0, F.right(F.get(hits, i - 1), F.lit(CONTEXT))).otherwise(""), F.right(gap, F.lit(CONTEXT))), F.lit(CONTEXT)))
        pairs = F.arrays_zip(hits.alias("s"), F.transform(gaps, F.length).alias("gap"), before.alias("before"))

        def spans(some: Column) -> Column:
            size = F.transform(some, lambda x: x["gap"] + F.length(x["s"]))
            return F.zip_with(some, _running(size, 0, _add), lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + F.length(x["s"])).alias("end"), x["s"].alias("s"), x["before"].alias("before")))

        return _let(pairs, spans)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits fulfils the check sum: from the right, each second digit doubled."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / F.lit(5)).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 2) | ((F.length(p) == 3) & (p <= "255")))
    n = F.length(_digits(s))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(s))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(False)


def _validator(kind: str):
    return lambda x: _valid(kind, x["s"])


def _sign(plus: Column, minus: Column) -> Column:
    return F.when(plus, 1).when(minus, -1).otherwise(0)


def _described(kind: str, x: Column) -> Column:
    """A candidate with its votes and features."""
    s, before = x["s"], x["before"]
    valid = _valid(kind, s)
    digits = F.length(_digits(s))
    size = F.length(s)
    distinct = F.size(F.array_distinct(F.split(s, "")))
    cue = F.rlike(before, F.lit(KEY_WORDS))
    base = F.lit(0) if kind == "secret" else F.when(valid, 1).otherwise(-1)
    if kind == "secret":
        shape = _sign(F.rlike(s, F.lit(r"^(?:[0-9a-f]{16,}|[A-Z0-9]{16,})$")), F.rlike(s, F.lit(r"[a-z]{8}|[-_/+]{2}")))
    else:
        shape = _sign(digits >= 8, digits < 4) if kind != "email" else _sign(F.rlike(s, F.lit(r"\.[A-Za-z]{2,}$")), F.rlike(s, F.lit(r"\.[0-9-]+$")))
    gazetteer = _sign(cue | F.rlike(s, F.lit(KEY_PREFIXES)), F.lit(False))
    context = _sign(F.rlike(before, F.lit(CONTEXT_WORDS)), F.rlike(before, F.lit(r"[0-9]\W{0,2}$")))
    variety = _sign(distinct * 10 >= F.least(size, F.lit(20)) * 4, distinct <= 3)
    return F.struct(
        F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), valid.alias("valid"),
        *(v.cast("int").alias(n) for n, v in zip(LABELERS, (base, shape, gazetteer, context, variety), strict=True)),
        F.least(F.floor(size / F.lit(8)).cast("int"), F.lit(6)).alias("length"), F.floor(F.lit(4) * digits / size).cast("int").alias("digits"),
        (F.rlike(s, F.lit("[a-z]")).cast("int") + 2 * F.rlike(s, F.lit("[A-Z]")).cast("int")).alias("mixed"), (cue.cast("int") + 2 * F.rlike(s, F.lit(KEY_PREFIXES)).cast("int")).alias("cue"),
    )


def _describer(kind: str):
    return lambda x: _described(kind, x)


def _apart(some: Column, others: Column) -> Column:
    """Those of `some` that overlap none of `others`, both with start and end; `some` don't overlap each other.

    In the order of the one's end and the other's start: an overlap is there
    if what starts before the one's end reaches beyond its start.
    """
    event = lambda at, flag, end, x: F.struct(at.alias("at"), F.lit(flag).alias("flag"), end.alias("end"), x.alias("x"))
    mixed = F.array_sort(F.concat(F.transform(some, lambda x: event(x["end"], 0, F.lit(0), x)), F.transform(others, lambda y: event(y["start"], 1, y["end"], y))))

    def kept(events: Column) -> Column:
        reach = _running(F.transform(events, lambda e: e["end"]), 0, _larger)
        free = F.zip_with(events, reach, lambda e, r: F.when((e["flag"] == 0) & (r <= e["x"]["start"]), e["x"]))
        return F.filter(free, lambda x: x.isNotNull())

    return _let(mixed, kept)


def candidates(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep`, and cands: all candidates by kind as listed, then start."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.expr("cast(array() as array<struct<start:int,end:int,s:string,before:string>>)")
    out = docs.select(*(F.col(c).alias(f"keep_{c}") for c in keep), text.alias("body"))
    for kind in KINDS:
        out = out.withColumn(f"raw_{kind}", F.when(F.rlike("body", F.lit(HINTS[kind])), _found(F.col("body"), PATTERNS[kind])).otherwise(none))
    other = F.concat(*(F.filter(f"raw_{k}", _validator(k)) for k in BASE_KINDS))
    out = out.withColumn("raw_secret", F.when(F.size("raw_secret") > 0, _apart(F.col("raw_secret"), other)).otherwise(none))
    found = [F.transform(f"raw_{k}", _describer(k)) for k in KINDS]
    return out.select(*(F.col(f"keep_{c}").alias(c) for c in keep), F.concat(*found).alias("cands"))


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each vote pattern, reliabilities[class, labeler, vote + 1]) by expectation-maximisation."""
    posterior = 1 / (1 + np.exp(-votes.sum(axis=1).astype(float)))
    reliability = np.full((2, votes.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        for vote in (-1, 0, 1):
            reliability[:, :, vote + 1] = weight @ (votes == vote) + 1
        reliability /= reliability.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        log = np.log(prior)[:, None] + sum(np.log(reliability[:, k, :])[:, votes[:, k] + 1] for k in range(votes.shape[1]))
        posterior = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return posterior, reliability


def fit_classifier(rows: list[tuple], posterior: np.ndarray, counts: np.ndarray, steps: int = 400) -> dict[tuple[str, object], float]:
    """Weights of (feature, value) and of ("", "") for the intercept: ridge logistic regression on soft labels."""
    names = sorted({(f, r[k]) for r in rows for k, f in enumerate(FEATURES)}, key=str)
    x = np.array([[1.0] + [float(r[FEATURES.index(f)] == v) for f, v in names] for r in rows])
    w = np.zeros(x.shape[1])
    scale = counts / max(1, counts.sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (scale * (p - posterior)) + 1e-4 * w
        hessian = (x * (scale * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip([("", ""), *names], w.tolist(), strict=True))


def learn(found: DataFrame) -> dict[tuple[str, object], float]:
    """The span classifier from all candidates; the driver gets counts of patterns, whose number is bounded."""
    each = found.select(F.explode("cands").alias("c")).select("c.*")
    rows = each.groupBy(*LABELERS, *FEATURES).agg(F.count("*").alias("n")).orderBy(*LABELERS, *FEATURES).collect()
    if not rows:
        return {("", ""): -30.0}
    votes = np.array([[r[c] for c in LABELERS] for r in rows])
    counts = np.array([r.n for r in rows], float)
    pattern, place = np.unique(votes, axis=0, return_inverse=True)
    posterior, _ = estimate(pattern, np.bincount(place.ravel(), counts))
    return fit_classifier([tuple(r[f] for f in FEATURES) for r in rows], posterior[place.ravel()], counts)


def _chosen(weights: dict, c: Column) -> Column:
    """Whether the classifier takes a candidate."""
    score = F.lit(weights[("", "")])
    for feature in FEATURES:
        pairs = [(v, w) for (f, v), w in weights.items() if f == feature]
        if pairs:
            term = F.lit(0.0)
            for value, weight in pairs:
                term = F.when(c[feature] == F.lit(value), F.lit(weight)).otherwise(term)
            score = score + term
    return score >= float(np.log(THRESHOLD / (1 - THRESHOLD)))


def spans_of(found: DataFrame, weights: dict) -> DataFrame:
    """found with spans, array<struct<kind, start, end, base>>: valid base matches and what the classifier adds."""
    taken = F.filter("cands", lambda c: c["valid"] | _chosen(weights, c))
    return found.withColumn("spans", F.transform(taken, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["valid"].alias("base")))).drop("cands")


def find_personal_data(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` and spans of each document. Candidates are written once and read by learner and judge."""
    found = staged(candidates(docs, keep, text_col), "pii-candidates")
    return spans_of(found, learn(found))


def _only(kind: str):
    return lambda k: F.when(k == kind, k)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, _only(k)))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; overlapping spans become one gap after the other."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def rewritten(some: Column, part) -> Column:
        def joined(at: Column) -> Column:
            out = F.zip_with(some, at, lambda s, a: F.when(s["end"] > a, F.concat(part(a, F.greatest(s["start"], a)), F.lit("["), s["kind"], F.lit("]"))).otherwise(""))
            last = F.greatest(F.element_at(at, -1), F.element_at(some, -1)["end"])
            return F.concat(F.array_join(out, ""), part(last, F.length(text)))

        return _let(_running(F.transform(some, lambda s: s["end"]), 0, _larger), joined)

    def by_place(some: Column) -> Column:
        return rewritten(some, lambda a, b: F.substr(text, a + 1, b - a))

    def by_characters(some: Column) -> Column:
        # A place in a text is found by counting from its start; in an array it isn't.
        return _let(F.split(text, ""), lambda letters: rewritten(some, lambda a, b: F.array_join(F.slice(letters, a + 1, b - a), "")))

    return _let(order, lambda some: F.when(F.size(some) == 0, text).when(F.size(some) <= BLOCK, by_place(some)).otherwise(by_characters(some)))
