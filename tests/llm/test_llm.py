"""Training-data operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnlake.llm import brown, hnsw, lines, packing, pieces, pii, quality, queries, simhash, trees, urls, weighted
from tarnlake.llm._shared import connected_components, cut

DOCS = "doc_id long, text string, score double, lang string, source string, n_chars long, statistics int, bucket int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1.0, "en", "s", 0, 1, 2) for i, t in rows], DOCS)


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def prose(rng, n, words=400):
    vocabulary = [f"w{i}" for i in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def mixed(spark):
    """Texts of every awkward kind."""
    rng = random.Random(4)
    long = prose(rng, 12_000)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    near = [base[0] + " extra", base[0].replace("w1", "w2", 1), base[5] + " x y"]
    return [*enumerate([*base, *near, None, "", " \n\t ", long, long, "한국어 텍스트 😀 é", base[3], base[3]]), (3, base[3]), (None, base[7]), (None, None)]


def test_components(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    extra = [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(120)] + [(5000, 5000), (None, 4), (7, None), (2000, 2001), (2000, 2001)]
    edges = path + star + extra
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == components({x for e in real for x in e}, real)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(float)
    f = trees.fit(x[:2000], y[:2000])
    assert ((f.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9

    def walk(row):
        total = f.base
        for node in f.roots:
            while f.left[node] != node:
                node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
            total += f.value[node]
        return total

    assert np.allclose([walk(r) for r in x[:50]], f.margin(x[:50]))
    assert trees.fit(np.zeros((0, 6)), np.zeros(0)).probability(x[:2]).tolist() == [0.5, 0.5]


def test_quality_held_out(spark):
    got = queries.op1_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    assert (held["held_out"] == held["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    good, bad = held[held["quality"] == 1]["score"].to_numpy(), held[held["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95 and (got["predicted"] == (got["score"] >= 0.5)).all()


def test_quality_edges(spark, mixed):
    d, none = docs(spark, mixed), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(d, none).collect()
    assert len(got) == len(mixed) and {r["score"] for r in got} == {0.5}
    assert quality.classify(d.limit(0), none).count() == 0
    assert quality.keep_good(d, none).columns == d.columns and quality.keep_good(d, none).count() == len(mixed)


def piece_edges(p, word):
    """(start, end, ids, score) of all pieces of a word, from the vocabulary alone."""
    out = [(a, b, (p.score[word[a:b]][0],), p.score[word[a:b]][1]) for a in range(len(word)) for b in range(a + 1, len(word) + 1) if word[a:b] in p.score]
    lone = [(a, c.encode()) for a, c in enumerate(word) if c not in p.score]
    return out + [(a, a + 1, tuple(p.byte[x] for x in raw), p.byte_score * len(raw)) for a, raw in lone]


def test_pieces_n_best():
    p = pieces.loaded(queries.tokenizer_path("piece_bpe_32k.model"))

    def brute(word):
        into, paths = piece_edges(p, word), {0: [((), 0)]}
        for end in range(1, len(word) + 1):
            paths[end] = [(ids + piece, s + own) for a, b, piece, own in into if b == end for ids, s in paths[a]]
        return sorted(paths[len(word)], key=lambda x: -x[1])

    for word in ("▁the", "▁hello", "▁naïve", "▁a😀b", "▁▁▁x", "▁ingen", "▁end."):
        want, got = brute(word), p.segment(word)
        assert [s for s, _ in got] == [s for _, s in want[: p.best]] and all((ids, s) in want for s, ids in got) and len(set(got)) == len(got)
    text = "the eau naïve 😀  two\nlines "
    words = re.findall("▁*[^▁\n]+|\n|▁+", "▁" + text.replace(" ", "▁"))
    every = sorted((sum(c) for c in itertools.product(*[[s for s, _ in p.segment(w)] for w in words])), reverse=True)
    ((good, found),) = p.encode([text])
    assert good and [s for s, _ in found] == every[: p.best]
    assert all(p.decode(ids.tolist()) == text for _, ids in found)


def test_pieces_best_is_viterbi_over_the_text():
    """The best segmentation of whole texts against a plain pass over all of the text's pieces."""
    rng = random.Random(3)
    p = pieces.Pieces(queries.tokenizer_path("piece_bpe_32k.model"), limit=50)
    texts = ["", " ", "the end", "a  b\n\n c\t", "x\x00y", "▁odd", " lead", "trail ", "\n", "é😀한", "a" * 70 + " b" * 3, *("".join(rng.choice("ab ▁\n.é\x00😀") for _ in range(40)) for _ in range(200))]
    for text, (good, found) in zip(texts, p.encode(texts), strict=True):
        mark = "▁" + text.replace(" ", "▁") if text else ""
        best = [0] + [-(1 << 62)] * len(mark)
        for a, b, _, s in sorted(piece_edges(p, mark)):
            best[b] = max(best[b], best[a] + s)
        assert found[0][0] == best[-1] and all(x[0] >= y[0] for x, y in zip(found, found[1:], strict=False))
        assert good == all(p.decode(ids.tolist()) == text for _, ids in found) and good == ("▁" not in text), text
        assert len({ids.tobytes() for _, ids in found}) == len(found)


def test_pieces_keep_common_words_whole():
    """Agreement with the library's merges, which know no scores: common words whole, most words alike."""
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    p, library = pieces.loaded(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for w in ("the", "and", "world", "people", "between", "government"):
        assert p.segment("▁" + w)[0][1] == tuple(library.encode(w)) and len(library.encode(w)) == 1
    whole = [x[1:] for x in p.score if re.fullmatch("▁[a-z]{3,}", x)]
    same = np.mean([p.segment("▁" + w)[0][1] == tuple(library.encode(w)) for w in whole])
    assert same > 0.97, same


def test_pieces_long_words_in_linear_memory():
    import tracemalloc

    p = pieces.loaded(queries.tokenizer_path("piece_bpe_32k.model"))
    peaks = []
    for n in (10_000, 20_000):
        tracemalloc.start()
        assert len(p.segment("ab" * (n // 2))) == p.best
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2.6 * peaks[0]


def test_pieces_frames(spark, mixed):
    model, d = queries.tokenizer_path("piece_bpe_32k.model"), docs(spark, mixed)
    got = pieces.summary(d, model).collect()
    assert len(got) == len(mixed) and all(r["round_trip"] for r in got)
    back = pieces.decode(pieces.encode(d, model, 2), model).where("rank = 0").select("text").collect()
    assert Counter(r["text"] for r in back) == Counter(t or "" for _, t in mixed)
    assert pieces.summary(d.limit(0), model).count() == 0


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, mixed):
    d = docs(spark, mixed)
    got = simhash.near_duplicates(d).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, f"{slow_fingerprint(t):016x}") for i, t in mixed)
    prints = {f"{slow_fingerprint(t):016x}" for _, t in mixed}
    near = [(a, b) for a, b in itertools.combinations(sorted(prints), 2) if bin(int(a, 16) ^ int(b, 16)).count("1") <= 4]
    group = components(prints, near)
    lowest = {}
    for i, t in mixed:
        k = group[f"{slow_fingerprint(t):016x}"]
        if i is not None:
            lowest[k] = min(lowest.get(k, i), i)
    assert all(r["component_id"] == lowest.get(group[r["fingerprint"]]) for r in got)
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {*lowest.values(), None}
    assert simhash.near_duplicates(d.limit(0)).count() == 0


@pytest.mark.parametrize("embed", [True, False])
def test_simhash_links_whole_and_split(spark, embed, monkeypatch):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    points = {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 300)}
    for _ in range(900):
        x = centre
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            x ^= 1 << int(b)
        points.add(simhash.signed(x & ((1 << 64) - 1)))
    points = sorted(points)
    arr = np.array(points, dtype=np.int64).view(np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 4, 1))
    want = components(range(len(points)), zip(a.tolist(), b.tolist(), strict=True))
    df = cut(spark.createDataFrame([(p,) for p in points], "point long"))
    for chunk in (1024, 40):
        monkeypatch.setattr(simhash.cells, "__defaults__", (chunk,))
        edges = simhash.linked(df, len(points), 4, embed).distinct().collect()
        at = {p: i for i, p in enumerate(points)}
        assert components(range(len(points)), [(at[r["src"]], at[r["dst"]]) for r in edges]) == want
        assert all(bin((r["src"] ^ r["dst"]) & ((1 << 64) - 1)).count("1") <= 4 for r in edges)


def slow_base(text):
    out = []
    for kind, rx in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(rx, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out)


def test_pii(spark, mixed):
    rng = random.Random(2)
    texts = ["".join(rng.choice(alphabet) for _ in range(70)) for alphabet in ("a@.1 -+()2é", "1234567890. -", "ab.@@c") for _ in range(1500)]
    for t in texts + ["mail a.b@c.de, 10.0.0.256 1.2.3.4 4111 1111 1111 1111 +1 (555) 123-4567"]:
        assert sorted(pii.base_spans(t)) == slow_base(t)
    d = docs(spark, [*mixed, (900, 'x token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" y john at example dot com, a@b.cd')])
    got = {r["doc_id"]: r for r in pii.find_personal_data(d).collect()}
    assert got[900]["n_email"] == 1 and "secret:11:51" in got[900]["spans"] and "email_spelt:" in got[900]["spans"] and got[900]["base_spans"].startswith("email:")
    red = {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}
    assert red[900] == 'x token = "[SECRET]" y [EMAIL_SPELT], [EMAIL]' and red[60] is not None
    assert pii.find_personal_data(d).count() == len(mixed) + 1 and pii.redact(d.limit(0)).count() == 0


def test_pii_model():
    forest, cuts = pii.model()
    x, y, kinds = pii._examples(np.random.default_rng(99), 2000)
    p = forest.probability(x)
    taken = p >= np.array([cuts[k] for k in kinds])
    assert y[taken].mean() > 0.97 and taken[y == 1].mean() > 0.95


def test_packing_plan():
    rng = random.Random(1)
    for _ in range(200):
        cap = rng.choice([8, 10, 20])
        items = Counter(rng.randint(1, cap) for _ in range(rng.randint(1, 60)))
        fixed, left = packing.reduce_by_dominance(dict(items), cap)
        made = fixed + packing.best_fit(left, cap)
        total = Counter()
        for content, n in made:
            assert n > 0 and sum(content) <= cap
            for x in content:
                total[x] += n
        assert total == items
        assert sum(n for _, n in made) <= sum(n for _, n in packing.best_fit(dict(items), cap))


def least_bins(items, cap):
    """Smallest number of bins, by trying each number."""
    items = sorted(items, reverse=True)

    def fits(i, rooms):
        if i == len(items):
            return True
        return any(fits(i + 1, tuple(sorted((*rooms[:k], r - items[i], *rooms[k + 1 :])))) for k, r in enumerate(rooms) if r >= items[i] and r not in rooms[:k])

    n = -(-sum(items) // cap)
    while not fits(0, (cap,) * n):
        n += 1
    return n


def test_dominance_is_safe():
    rng = random.Random(5)
    for _ in range(150):
        cap = rng.choice([7, 10, 13])
        items = [rng.randint(1, cap) for _ in range(rng.randint(1, 9))]
        fixed, left = packing.reduce_by_dominance(dict(Counter(items)), cap)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (least_bins(rest, cap) if rest else 0) == least_bins(items, cap)


def test_dominance_leaves_what_three_fill_better():
    counts = {10: 1, 7: 2, 4: 1, 3: 3}
    fixed, left = packing.reduce_by_dominance(counts, 19)
    assert ((10, 7), 1) not in fixed
    assert sum(n for _, n in fixed) + least_bins([x for x, n in left.items() for _ in range(n)], 19) == 2


def test_dominance_is_safe_with_many_small_items():
    rng = random.Random(15)
    for _ in range(1500):
        cap = rng.randint(6, 24)
        items = [rng.randint(1, rng.choice([cap, cap // 2])) for _ in range(rng.randint(1, 12))]
        fixed, left = packing.reduce_by_dominance(dict(Counter(items)), cap)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert Counter(rest) + Counter(x for content, n in fixed for x in content for _ in range(n)) == Counter(items)
        assert sum(n for _, n in fixed) + (least_bins(rest, cap) if rest else 0) == least_bins(items, cap), (cap, items)


def test_packing(spark, mixed):
    path, d = queries.tokenizer_path("word_bpe_49k.json"), docs(spark, mixed)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    got = packing.pack(d, path, 512).toPandas()
    want = Counter()
    for i, text in mixed:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    as_id = [None if x != x else int(x) for x in got["doc_id"]]
    assert Counter(zip(as_id, got["piece"], got["start"], got["length"], got["ids_crc32"], strict=True)) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.concatenate([[0], np.cumsum(s["length"])[:-1]])).all() and s["length"].sum() <= 512
    whole = packing.sequences(d, path, 512).toPandas()
    assert sum(map(len, whole["ids"])) == got["length"].sum() and packing.pack(d.limit(0), path).count() == 0


def test_url_filter(spark):
    rules = [urls.Rule("block", "bad.com"), urls.Rule("allow", "ok.org", "/x")]
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://bad.com/a", None), (2, "https://mirror.net/a", link("http://bad.com/a")), (3, "http://www.mirror.net/a/#f", ""), (4, "https://ok.org/x/1", link("https://bad.com/z")),
        (5, "https://third.net", link("https://bad.com/z")), (6, None, None), (7, "nothing", ""), (8, "HTTPS://Sub.BAD.com?q", ""), (9, "https://notbad.com/", '<meta http-equiv="refresh" content="0; url=https://bad.com/q">'), (9, "https://free.net/", None),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, rule string")
    got = {(r["page_id"], r["host"]): (r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, rules).collect()}
    assert got == {
        (1, "bad.com"): ("/a", "bad.com/", "block"), (2, "mirror.net"): ("/a", None, "block"), (3, "www.mirror.net"): ("/a/", None, "block"), (4, "ok.org"): ("/x/1", "ok.org/x", "allow"), (5, "third.net"): ("", None, "allow"),
        (6, ""): ("", None, "allow"), (7, ""): ("", None, "allow"), (8, "sub.bad.com"): ("", None, "allow"), (9, "notbad.com"): ("/", None, "block"), (9, "free.net"): ("/", None, "allow"),
    }
    assert urls.judge(df.limit(0), rules).count() == 0


def test_url_filter_matches_its_sql(spark):
    """The query's SQL on pages that declare links: chains, rings, refreshes, plain forms and rules on both sides."""
    import duckdb

    rng = random.Random(11)
    hosts = ["a.example.org", "www.example.org", "b.org", "c.com", "www.c.com:80", "D.net", "e.net", "e.net:443"]
    url = lambda: f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/es/1', '/en/12', '/fr/x', '/de/y', '/de/', '/z', '/z/'])}{rng.choice(['', '', '?q=1', '?utm_source=x', '?q=1&ref=b#f', '#f'])}"
    rows = []
    for i in range(150):
        link = rng.choice(['<link rel="canonical" href="{}">', "<LINK href='{}' rel=canonical />", '<meta http-equiv="refresh" content="0; url={}">', "<p>{}</p>", "no markup {}"])
        rows.append((i, url(), link.format(rng.choice([url(), url(), "/relative"]))))
    rows += [(200, None, None), (201, "nothing", "<p>"), (202, rows[0][1], None), (203, rows[1][1], rows[1][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, urls.judge(df, queries.RULES).select("page_id", "host", "path", "rule", "verdict").collect()))
    con = duckdb.connect()
    frame = df.toPandas()
    con.register("pages", frame)
    want = sorted(con.execute(queries.oracle_sql()["op6_url_filter"]).fetchall())
    assert got == want and len({r[4] for r in got if r[3] is None}) == 2


def test_edit_distance():
    rng = random.Random(7)
    for _ in range(400):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _step(row, x, b, i)
        assert lines.edit_distance(a, b) == row[-1]
        assert (lines.edit_distance(a, b, 2) <= 2) == (row[-1] <= 2)
        if a and b:
            for least in (0.5, 0.8):
                want = row[-1] <= (1 - least) * max(len(a), len(b)) + 1e-9
                assert lines.similar(a, b, least) == lines.similar(np.array([ord(x) for x in a]), np.array([ord(x) for x in b]), least) == want


def _step(row, x, b, i):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def test_line_dedup(spark, mixed):
    rng = random.Random(9)
    page = [prose(rng, 30) for _ in range(12)]
    rows = [*mixed, (100, "\n".join(page[:4])), (101, "\n".join([page[0].upper() + "  ", "short line", page[5]])), (102, "short line\n" + page[1] + " more"), (103, page[2]), (103, page[2])]
    d = docs(spark, rows)
    got = lines.drop_duplicate_lines(d)
    assert got.columns == [*d.columns, "n_lines", "n_dropped"]
    seen = []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            clean = lines.normalised(line)
            if len(clean.split()) >= 5:
                seen.append((i if i is not None else -(1 << 63), xh(t), k, clean))
    texts = sorted({s[3] for s in seen})
    near = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if lines.similar(texts[a].split(), texts[b].split())]
    group = components(range(len(texts)), near)
    places = {}
    for i, h, k, clean in seen:
        places.setdefault(group[texts.index(clean)], set()).add((i, h, k))
    gone = {p for ps in places.values() if len(ps) > 1 for p in ps if p != min(ps)}
    want = Counter()
    for i, t in rows:
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i if i is not None else -(1 << 63), xh(t), k) not in gone)
        want[i, kept] += 1
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want
    assert any(kept == "" for _, kept in want) and lines.drop_duplicate_lines(d.limit(0)).count() == 0


def xh(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return 42 if text is None else h - (1 << 64) if h >> 63 else h


def test_line_groups_split(spark, monkeypatch):
    rng = random.Random(3)
    base = prose(rng, 60).split()
    rows = []
    for i in range(120):
        words = base.copy()
        words[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(words)))
    whole = lines.duplicate_lines(docs(spark, rows)).collect()
    monkeypatch.setattr(lines, "CHUNK_LINES", 10)
    split = lines.duplicate_lines(docs(spark, rows)).collect()
    assert sorted(r["doc"] for r in whole) == sorted(r["doc"] for r in split) and len(whole) > 60


def test_line_dedup_misses_no_similar_pair(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for n in (5, 6, 9, 10, 14, 15, 20, 40, 90, 160, 300, 700):
        for _ in range(6):
            words = [rng.choice("abcdefgh") if rng.random() < 0.3 else f"w{rng.randrange(3000)}" for _ in range(n)]
            rows.append(" ".join(words))
            for edits in {1, n // 10, n // 5, n // 5 + 1}:
                other = words.copy()
                for _ in range(edits):
                    at = rng.randrange(len(other))
                    other[at : at + 1] = rng.choice([[f"x{rng.randrange(10**6)}"], [], [other[at], f"x{rng.randrange(10**6)}"]])
                rows.append(" ".join(other))
    rows = sorted({x for x in rows if x.count(" ") >= 4})
    split = [x.split() for x in rows]
    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if lines.similar(split[a], split[b])]
    assert len(near) > 100
    want = sorted(i for i, first in components(range(len(rows)), near).items() if i != first)
    for chunk in (lines.CHUNK_LINES, 8):
        monkeypatch.setattr(lines, "CHUNK_LINES", chunk)
        monkeypatch.setattr(lines, "SAMPLED", 16 if chunk > 8 else 1)
        monkeypatch.setattr(lines, "HELD", 1_000_000 if chunk > 8 else 300)
        monkeypatch.setattr(lines, "BLOCK_ROWS", 250_000 if chunk > 8 else 500)
        monkeypatch.setattr(lines, "MOST_PAIRS", 40 if chunk == 8 else 1_000_000)
        assert sorted(r["doc"] for r in lines.duplicate_lines(docs(spark, enumerate(rows))).collect()) == want


def test_pipeline_drops_documents_of_similar_shingles(spark):
    import corpus_pipeline

    rng = random.Random(21)
    texts = ["", "one two", "one two", "one two three"]
    for n in (5, 8, 30, 80, 200, 900):
        for _ in range(4):
            words = [f"w{rng.randrange(4000)}" for _ in range(n)]
            texts.append(" ".join(words))
            for edits in {1, n // 60 + 1, n // 40 + 1}:
                other = words.copy()
                for _ in range(edits):
                    other[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
                texts.append(" ".join(other))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    near = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    prints = [slow_fingerprint(x) for x in texts]
    assert sum((prints[a] ^ prints[b]).bit_count() > 4 for a, b in near) > 10
    want = {i for i, first in components(range(len(sets)), near).items() if i == first}
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = stage(spark, docs(spark, [*enumerate(texts), (4, texts[4])]), "")
    assert got.columns == docs(spark, []).columns and Counter(r["doc_id"] for r in got.collect()) == Counter(want)


def test_pipeline_keeps_other_texts_of_an_id(spark):
    import corpus_pipeline

    rng = random.Random(5)
    one, two = prose(rng, 40), prose(rng, 40)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = stage(spark, docs(spark, [(1, one), (2, one), (2, two), (2, two), (3, two)]), "")
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(1, one), (2, two)])


def test_words_are_hashed_alike():
    """The words of a batch, split in Arrow, against Python's splitting; equal words have equal hashes, others none."""
    import pyarrow as pa

    texts = [None, "", " ", "a b", "  b\ta\x0b\x0cA \n\nÉ b  c\r\n한 a", "x" * 300 + " x", "b a"]
    for least in (1, 2):
        distinct, code, n, row, number = lines.line_words(pa.array(texts), least)
        hashes = distinct[code]
        want = [(i, k, line.split()) for i, t in enumerate(texts) if t for k, line in enumerate(t.lower().encode().split(b"\n")) if len(line.split()) >= least]
        assert [(i, k, len(w)) for i, k, w in want] == list(zip(row.tolist(), number.tolist(), n.tolist(), strict=True))
        named = dict(zip(hashes.tolist(), [w for _, _, ws in want for w in ws], strict=True))
        assert len(set(named.values())) == len(named) and [named[h] for h in hashes.tolist()] == [w for _, _, ws in want for w in ws]
    runs = lines.runs_of(pa.array([None, "", "a b c", "A B C", "a b c d e f a b c d e f", "x y z"]), 5)
    assert [len(r) for r in runs] == [0, 0, 1, 1, 6, 1] and runs[2] == runs[3] and runs[2] != runs[5]


def test_line_prefixes_meet():
    """The prefixes of two lines of the least similarity share a word, whatever the order's ranks."""
    rng = random.Random(30)
    for _ in range(300):
        n = rng.randint(5, 60)
        a = [rng.randrange(1, 1 << 20) * (1 << 40) + rng.randrange(3) for _ in range(n)]
        a += a[: rng.randint(0, 3)]
        b = a.copy()
        for _ in range(int(0.2 * len(a) + 1e-9)):
            b[rng.randrange(len(b))] = rng.randrange(1, 1 << 62)
        some = np.array(sorted({*rng.sample(a, 3), *rng.sample(b, 2)}), np.uint64)
        usual = some, np.array(rng.sample(range(1, len(some) + 1), len(some)))
        words = np.array(a + b, np.uint64)
        token, item = lines._prefixes(*np.unique(words, return_inverse=True), np.array([len(a), len(b)]), usual, 0.8)
        assert set(token[item == 0].tolist()) & set(token[item == 1].tolist())


def test_line_sketches_never_refuse_similar_lines():
    rng = np.random.default_rng(8)
    rows = []
    for n in (5, 30, 60, 130, 260, 700):
        a = rng.integers(1, 1 << 62, n, dtype=np.uint64)
        b = a.copy()
        b[rng.choice(n, int(0.2 * n + 1e-9), replace=False)] = rng.integers(1, 1 << 62, int(0.2 * n + 1e-9), dtype=np.uint64)
        rows += [a, b, a[: -(-4 * n // 5)], rng.integers(1, 1 << 62, n, dtype=np.uint64)]
    n = np.array(list(map(len, rows)))
    widths = lines._folded(lines._sketches(np.concatenate(rows), np.repeat(np.arange(len(n)), n), n), len(n))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(n)), np.arange(len(n))))
    may = lines._may_match(i, j, n, widths, 0.8)
    for x, y, ok in zip(i.tolist(), j.tolist(), may.tolist(), strict=True):
        assert ok or not lines.similar(rows[x].tolist(), rows[y].tolist())
    assert (~may[(i // 4 == j // 4) & (i % 4 == 3) & (j % 4 == 0)]).sum() >= 4


def test_clashing_columns_pass_through(spark):
    rng = random.Random(6)
    line = prose(rng, 12)
    names = ["doc", "text_hash", "gone", "no_id", "_doc", "_text", "_nth", "lines", "id"]
    d = spark.createDataFrame([(1, line + "\nx", *range(9), 5), (2, "y\n" + line, *range(9, 18), 6)], "doc_id long, text string, " + ", ".join(f"{c} long" for c in names) + ", n_lines long")
    got = sorted(lines.drop_duplicate_lines(d).collect())
    assert [[r[c] for c in names] for r in got] == [list(range(9)), list(range(9, 18))] and [r["text"] for r in got] == [line + "\nx", "y"] and [r["n_lines"] for r in got] == [2, 2]
    d = d.withColumn("text", F.when(F.col("doc_id") == 1, "other words").otherwise(F.col("text")))
    for keep in (lines.drop_similar_documents, simhash.drop_near_duplicates):
        out = keep(d)
        assert out.columns == d.columns and [[r[c] for c in names] for r in sorted(out.collect())] == [list(range(9)), list(range(9, 18))]


def test_exchange_clustering():
    rng = np.random.default_rng(1)
    truth = np.arange(40) % 4
    counts = rng.poisson(np.where((truth[:, None] + 1) % 4 == truth[None, :], 30, 0.3))
    grown = np.zeros((41, 41))
    grown[:40, :40] = counts
    where = brown.exchange(grown, 40, 4, sweeps=20)
    assert all(len(set(where[:40][truth == k])) == 1 for k in range(4))


def test_place_is_the_best_exchange():
    """Each unit's class is the one that the likelihood of the class bigrams gains most by, all classes tried."""
    rng = np.random.default_rng(4)
    classes, size = 5, 7
    table = rng.integers(0, 60, (size, size)).astype(float)
    rows = sorted({(u, int(rng.integers(0, 2)), int(rng.integers(0, size))) for u in range(40) for _ in range(12)})
    n = rng.integers(1, 30, len(rows))
    unit, side, near = np.array(rows).T
    got = dict(zip(*(x.tolist() for x in brown.place(unit, side, near, n, table, classes)), strict=True))

    def likelihood(t):
        f = lambda x: sum(v * np.log(v) for v in x.ravel() if v > 0)
        return f(t) - f(t.sum(axis=1)[:classes]) - f(t.sum(axis=0)[:classes])

    for u in range(40):
        gains = []
        for k in range(classes):
            t = table.copy()
            for i in np.flatnonzero(unit == u):
                t[(k, near[i]) if side[i] == 0 else (near[i], k)] += n[i]
            row, col = t.sum(axis=1), t.sum(axis=0)
            mine_after = n[(unit == u) & (side == 0)].sum()
            mine_before = n[(unit == u) & (side == 1)].sum()
            base_row, base_col = table.sum(axis=1), table.sum(axis=0)
            base_row[k] += mine_after
            base_col[k] += mine_before
            g = lambda x: sum(v * np.log(v) for v in x[:classes] if v > 0)
            f = lambda x: sum(v * np.log(v) for v in x.ravel() if v > 0)
            gains.append(f(t) - g(base_row) - g(base_col))
        assert gains[got[u]] >= max(gains) - 1e-6


@pytest.mark.parametrize("common", [brown.COMMON, 30])
def test_brown(spark, mixed, common, monkeypatch):
    monkeypatch.setattr(brown, "COMMON", common)
    monkeypatch.setattr(brown, "CORE", min(common, 25))
    monkeypatch.setattr(brown, "CLASSES", 6)
    monkeypatch.setattr(brown, "HELD", 500)
    monkeypatch.setattr(brown, "PLACED", 200)
    d = docs(spark, mixed)
    fitted = []
    real = brown.fit
    monkeypatch.setattr(brown, "fit", lambda *a: fitted.append(real(*a)) or fitted[0])
    monkeypatch.setattr(brown.math, "isqrt", lambda n: 1)
    got = brown.score_held_out(d).collect()
    fold = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7
    train = [brown.words_of(t) for i, t in mixed if fold(i) != 2]
    count = Counter(w for x in train for w in x)
    n, v, ends = sum(count.values()) + len(train), len(count) + 1, len(train)
    m = fitted[0]
    number = {w: i for i, w in enumerate(m.words)}
    assert len(number) == min(common, len(count)) and min(count[w] for w in number) >= max((count[w] for w in count if w not in number), default=0)
    kind = lambda w: int(m.kind[number.get(w, len(number) + brown.ending(w))])
    end = int(m.kind[-1])
    # transitions and class sizes from the texts alone
    size = end + 1
    pairs, members = np.zeros((size, size)), np.zeros(size)
    for x in train:
        path = [end, *map(kind, x), end]
        for a, b in zip(path, path[1:], strict=False):
            pairs[a, b] += 1
    for w in count:
        members[kind(w)] += 1
    members[end] = 1
    step = np.log10((pairs + brown.SMOOTHING) / (pairs.sum(axis=1, keepdims=True) + brown.SMOOTHING * size))
    mass = pairs.sum(axis=0) + members + 1
    assert len({kind(w) for w in count}) > 3
    want = Counter()
    for i, t in mixed:
        words = brown.words_of(t)
        base = sum(np.log10((count[w] + 1) / (n + v + 1)) for w in words) + np.log10((ends + 1) / (n + v + 1))
        path = [end, *map(kind, words), end]
        own = sum(step[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(np.log10((count[w] + 1) / mass[kind(w)]) for w in words) + np.log10((ends + 1) / mass[end])
        want[i, fold(i) == 2, len(words) + 1, sum(count[w] > 0 for w in words) + 1, n, round(base, 5), round(own, 5)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in got) == want
    monkeypatch.setattr(brown, "fit", real)
    assert brown.score_held_out(d.limit(0)).count() == 0


def test_brown_without_training_texts(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = brown.score_held_out(docs(spark, [(held, "some words")])).collect()
    assert row["held_out"] and row["n_tokens"] == 3 and row["n_known"] == 0 and row["train_tokens"] == 0 and np.isfinite(row["score"])


def test_brown_endings(spark):
    words = ["a", "ab", "abc", "walking", "한국어", "é", "x" * 40]
    df = spark.createDataFrame([(w,) for w in words], "word string").select("word", brown.ending_of(F.col("word")).alias("e"))
    assert all(r["e"] == brown.ending(r["word"].encode()) for r in df.collect())


def test_brown_groups_words_of_like_neighbours(spark, monkeypatch):
    """Words that stand in the same places fall into the same classes, those outside the core too."""
    monkeypatch.setattr(brown, "CORE", 12)
    monkeypatch.setattr(brown, "CLASSES", 3)
    rng = random.Random(2)
    kinds = [[f"{c}{i}" for i in range(40)] for c in "abc"]
    weights = [1 / (i + 1) for i in range(40)]
    texts = [" ".join(rng.choices(kinds[k % 3], weights)[0] for k in range(60)) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = cut(brown.word_counts(d))
    words, n, *rest = brown.vocabulary(d, counts)
    m = brown.fit(cut(brown.numbered(d, words, F.lit(True))), counts, words, n, *rest)
    by_class: dict[int, Counter] = {}
    for i, w in enumerate(words):
        by_class.setdefault(int(m.kind[i]), Counter())[w[:1]] += 1
    assert sum(max(x.values()) for x in by_class.values()) > 0.95 * len(words) == 0.95 * 120
    assert np.allclose((10**m.transition).sum(axis=1), 1)
    mass = np.zeros(len(m.class_total))
    np.add.at(mass, m.kind[: len(words)], 10 ** m.log_count[: len(words)] / m.class_total[m.kind[: len(words)]])
    assert (mass < 1 + 1e-9).all() and mass.max() > 0.9


def test_weighted_fingerprints(spark, mixed):
    rows = [(i, t) for i, t in dict(mixed[:70]).items()]
    d = docs(spark, rows)
    got = {r["doc_id"]: r for r in weighted.edited_fingerprints(d).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    tf = lambda s: Counter(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), s)))
    off = []
    for k, (i, t) in enumerate(order):
        a, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(a) // 2
        edited = a[: len(a) - half] + nxt[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(a)
        x, y = tf(a), tf(edited)
        union = sum((x | y).values())
        off.append(got[i]["near_edited"] - (sum((x & y).values()) / union if union else 1.0))
    assert abs(np.mean(off)) < 0.05 and np.sqrt(np.mean(np.square(off))) < 0.15
    prints = {}
    for i, t in rows:
        prints.setdefault(" ".join((t or "").split()), set()).add(got[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert weighted.edited_fingerprints(d.limit(0)).count() == 0
    single = weighted.edited_fingerprints(d.limit(1)).first()
    assert single["near_next"] == 1.0 and weighted.edited_fingerprints(docs(spark, mixed)).count() == len(mixed)


def test_embedding_dedup(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([c + rng.normal(size=(25, 16)) * 0.12 for c in centres] + [rng.normal(size=(400, 16))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [None] + [1.0] * 15), (5004, [1.0]), (5005, [])]
    rows += bad + [(6000, rows[0][1]), (6001, rows[0][1]), (None, rows[1][1])]
    short = [(7000, [1.0, 2.0]), (7001, [2.0, 4.0]), (7002, [1.0, 2.0]), (7003, [-1.0, 2.0])]  # another length: links among themselves only
    rows += short
    df = spark.createDataFrame([(*r, 1, 7) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = hnsw.near_duplicates(df, shards=3).collect()
    assert len(got) == len(rows)
    good = [(i, v) for i, v in rows if i is not None and i not in dict(bad) and i < 7000]
    unit = np.array([v for _, v in good], dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    ids = [i for i, _ in good]
    found = {r["vec_id"]: r for r in got}
    true = {ids[a]: int(link[a].sum()) for a in range(len(ids))}
    again = {i for k, i in enumerate(ids) if float(unit[k] @ unit[1]) >= 0.95}  # these also link to the row without an id
    mine = {i: found[i]["n_links"] - (i in again) for i in ids}
    assert sum(mine.values()) >= 0.99 * sum(true.values()) and all(mine[i] <= true[i] for i in ids)
    want = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(link), strict=True)])
    assert np.mean([found[i]["component_id"] == want[i] for i in ids]) > 0.99
    assert all(found[i]["n_links"] == 0 and found[i]["component_id"] == i and found[i]["kept"] for i in dict(bad))
    assert [(found[i]["n_links"], found[i]["component_id"]) for i, _ in short] == [(2, 7000), (2, 7000), (2, 7000), (0, 7003)]
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_embedding_slices(spark, monkeypatch):
    """Several slices, written graphs in small rows and audits in small tiles give the same links."""
    rng = np.random.default_rng(16)
    x = rng.normal(size=(30, 8)).repeat(12, axis=0) + rng.normal(size=(360, 8)) * 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for name, value in (("SLICE_ROWS", 50), ("ROW_BYTES", 1000), ("TILE", 400), ("AUDITED", 40)):
        monkeypatch.setattr(hnsw, name, value)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hnsw.near_duplicates(df, shards=2).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    group = components(range(360), zip(*map(list, np.nonzero(link)), strict=True))
    assert np.mean([got[i] == (int(link[i].sum()), group[i]) for i in range(360)]) > 0.99 and all(got[i][0] <= link[i].sum() for i in range(360))


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    stages = {name: f for name, f in corpus_pipeline.STAGES}
    one = cut(stages["quality"](spark, d, sf))
    two = cut(stages["lines"](spark, one, sf))
    three = cut(stages["near_duplicates"](spark, two, sf))
    four = cut(stages["personal_data"](spark, three, sf))
    assert one.columns == two.columns == three.columns == four.columns == d.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = d.join(labels.where("quality = 1"), "doc_id", "left_semi")
    assert one.join(clean, "doc_id", "left_semi").count() >= 0.97 * clean.count()
    assert two.count() == one.count() and three.count() <= two.count() and four.count() == three.count()
    found = [pii.base_spans(r["text"] or "") for r in four.select("text").collect()]
    assert not any(found)
    run = corpus_pipeline.run(spark, sf)
    assert run.agg(F.count_distinct("doc_id")).first()[0] == four.count()
