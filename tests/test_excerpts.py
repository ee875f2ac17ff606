"""Excerpts and extraction payloads folded within the row, against the same by hand."""

import hashlib
import random

from pyspark.sql import functions as F

from tarnlake.operators import excerpt as E


def joined(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def by_hand(text, keywords, budget):
    text = text or ""
    if len(text) <= budget:
        return text
    must, at = [(0, min(E.HEAD, len(text)))], 0
    for line in text.split("\n"):
        if line.startswith("#"):
            must.append((at, at + len(line)))
        at += len(line) + 1
    must, spans = joined(must), []
    words = {k.strip() for k in keywords if k and k.strip()}
    for k in words:
        at, n = text.find(k), 0
        while at >= 0 and n < E.MATCHES:
            spans.append((max(0, at - E.RADIUS), min(len(text), at + len(k) + E.RADIUS)))
            at, n = text.find(k, at + len(k)), n + 1
    used, taken = sum(b - a + len(E.OMITTED) for a, b in must), list(must)
    for a, b in sorted(joined(spans), key=lambda s: (-sum(k in text[s[0] : s[1]] for k in words), s[0])):
        if used + b - a + len(E.OMITTED) <= budget:
            taken.append((a, b))
            used += b - a + len(E.OMITTED)
    out, end = "", 0
    for a, b in joined(taken):
        out += (E.OMITTED if a > end else "") + text[a:b]
        end = b
    return (out + (E.OMITTED if end < len(text) else ""))[:budget]


KEYWORDS = ["요금", "fee (%)", "fee", " a.b ", "", None]


def texts():
    rng = random.Random(3)
    filler = lambda n: "".join(rng.choice("xyz 가나\n") for _ in range(n))
    out = [None, "", "short fee", "#" * 3000, "fee" * 1000, "😀" * 1600 + "요금" + "😀" * 1600]
    for _ in range(60):
        parts = [filler(rng.randrange(0, 1500))]
        for _ in range(rng.randrange(8)):
            parts += [rng.choice(["fee", "요금", "fee (%)", "a.b", "aXb", "\n# head " + filler(20).replace("\n", " ") + "\n", "\n####### deep\n"]), filler(rng.choice([5, 200, 650, 900]))]
        out.append("".join(parts))
    return out


def test_excerpts_by_hand(spark):
    rows = [(i, t, b) for i, t in enumerate(texts()) for b in (0, 40, 700, 1500, 4000)]
    keyed = E.excerpts(spark.createDataFrame(rows, "id int, text string, most int"), KEYWORDS, "most").collect()
    assert {(r.id, r.most): r.excerpt for r in keyed} == {(i, b): by_hand(t, KEYWORDS, b) for i, t, b in rows}
    assert {(r.id): r.excerpt for r in E.excerpts(spark.createDataFrame(rows[:5], "id int, text string, most int"), [], 10).collect()} == {0: ""}


def test_payload(spark):
    long = "fee " * 4000
    pages = [("c1", "u1", "ok", long), ("c1", "u2", "ok", long + "!"), ("c1", "u3", "fetch_failed", long), ("c2", "u4", "fetch_failed", "x"), ("c3", "u5", "ok", None), ("c4", "u6", "ok", long)] + [("c5", f"v{i}", "ok", long) for i in range(10)]
    features = [("c1", "f2"), ("c1", "f1"), ("c1", "f1"), ("c4", "f1")]
    got = E.extraction_payload(spark.createDataFrame(pages, "candidate string, url string, fetch_status string, text string"), spark.createDataFrame(features, "candidate string, feature_id string"), KEYWORDS).collect()
    assert {r.url for r in got} == {"u1", "u2", "u5", "u6", *[f"v{i}" for i in range(10)]}
    assert {r.candidate: (r.n_pages, r.budget) for r in got} == {"c1": (2, 6000), "c3": (1, 6000), "c4": (1, 6000), "c5": (10, 3000)}
    assert all(r.excerpt == by_hand(dict((p[1], p[3]) for p in pages)[r.url], KEYWORDS, r.budget) for r in got)
    assert {r.candidate: r.features for r in got} == {"c1": ["f1", "f2"], "c3": [], "c4": ["f1"], "c5": []}
    key = {r.candidate: r.payload_key for r in got}
    lines = sorted(f"{r.url} {hashlib.sha256(r.excerpt.encode()).hexdigest()}" for r in got if r.candidate == "c1")
    assert key["c1"] == hashlib.sha256("\n".join(["c1", "f1,f2", *lines]).encode()).hexdigest() and len(set(key.values())) == 4
