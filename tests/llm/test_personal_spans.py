"""Texts with very many matches, and the spans that the classifier adds."""

import random
import re
import time

from pyspark.sql import functions as F

from driftwalk.llm import pii

SCHEMA = "doc_id long, text string"


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


def naive_redacted(text, spans):
    out, at = "", 0
    for start, end, kind in sorted(spans):
        if end > at:
            out, at = out + text[at : max(start, at)] + f"[{kind}]", max(at, end)
    return out + text[at:]


def test_many_matches_take_linear_time(spark):
    """60,000 addresses and keys in a text: positions and redaction as by brute force."""
    rng, parts = random.Random(1), []
    for k in range(20_000):
        parts += [f"u{k}@h{k % 7}.org", f"10.{k % 256}.0.{k % 200}", f'token = "{rng.getrandbits(160):040x}" é']
    texts = [" ".join(parts[: 3 * n]) for n in (100, 20_000)]
    took = []
    for text in texts:
        found = pii.find_personal_data(documents(spark, [text]), ["text"])
        began = time.time()
        row = found.select("spans", pii.redacted(F.col("text"), F.col("spans")).alias("clean")).first()
        took.append(time.time() - began)
        spans = [(s.start, s.end, s.kind) for s in row.spans]
        for kind, pattern in (("email", r"u[0-9]+@h[0-9]\.org"), ("ip", r"10\.[0-9]+\.0\.[0-9]+")):
            assert [(s, e) for s, e, k in spans if k == kind] == [m.span() for m in re.finditer(pattern, text)]
        assert row.clean == naive_redacted(text, spans)
    assert took[1] < 60


def test_overlapping_spans_are_redacted_once(spark):
    text = "".join(random.Random(2).choice("abé ") for _ in range(3000))
    rng = random.Random(3)
    for n in (5, 400):
        spans = [(s, s + rng.randint(1, 30), "ip") for s in rng.sample(range(2900), n)]
        df = spark.createDataFrame([(text, [("ip", s, e, True) for s, e, _ in spans])], "text string, spans array<struct<kind:string,start:int,end:int,base:boolean>>")
        assert df.select(pii.redacted(F.col("text"), F.col("spans"))).first()[0] == naive_redacted(text, spans)


def test_apart_keeps_what_overlaps_nothing(spark):
    rng = random.Random(4)
    for _ in range(12):
        edges = sorted(rng.sample(range(400), 40))
        some = list(zip(edges[::2], edges[1::2], strict=True))
        others = [(s, s + rng.randint(1, 12)) for s in rng.sample(range(400), 15)]
        df = spark.createDataFrame([(some, others)], "a array<struct<start:int,end:int>>, b array<struct<start:int,end:int>>")
        got = [tuple(x) for x in df.select(pii._apart(F.col("a"), F.col("b"))).first()[0]]
        assert got == [(s, e) for s, e in some if not any(y < e and s < z for y, z in others)]


def test_added_spans_precision_and_recall(spark):
    """Keys after key words are found; words, numbers, paths and names of about their length are left alone."""
    rng, texts, planted = random.Random(5), [], []
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    decoys = [lambda: word(18), lambda: f"{word(6)}-{word(7)}-{word(5)}2", lambda: f"{word(5)}/{word(8)}/{word(6)}_{rng.randrange(9)}", lambda: f"{word(12)}_{word(9)}_v{rng.randrange(9)}"]
    for k in range(400):
        secret = f"{rng.getrandbits(160):040x}" if k % 2 else "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        lead = rng.choice(['token = "', "api_key: ", "password=", "secret ", "access-key = "])
        clean = " ".join(rng.choice(decoys)() for _ in range(3))
        texts.append(f"{word(5)} {clean} {word(4)}" if k % 4 == 0 else f"{word(5)} {clean} {lead}{secret} {word(4)}")
        planted.append(None if k % 4 == 0 else secret)
    rows = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "secret"] for r in pii.find_personal_data(documents(spark, texts), ["doc_id"]).collect()}
    found = sum(planted[k] in rows[k] for k in rows if planted[k])
    added = sum(map(len, rows.values()))
    assert found / sum(p is not None for p in planted) > 0.95 and found / added > 0.9
