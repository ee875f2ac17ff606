"""Scans of paged services: over landed responses against a walk page by page, and through the data source."""

import json
import random
import threading
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tarnlake.sources import paged, scans


def walk(rows, most):
    """Brute force: the pages of each query one after the other."""
    tries = defaultdict(list)
    for q, page, attempt, status, token, items in rows:
        if q is not None and page is not None and page >= 0:
            tries[q, page].append((status == 200, attempt, status, token or "", items or ""))
    got, states = [], {}
    for q in {q for q, _ in tries}:
        page, n_pages, n_items, why = 0, 0, 0, None
        while why is None:
            if (q, page) not in tries:
                why = "partial"
                break
            _, _, status, token, items = max(tries[q, page], key=lambda t: t[:3])
            if status != 200:
                why = {404: "missing", 429: "throttled", 403: "quota"}.get(status, "failed")
                break
            try:
                listed = json.loads(items)
            except ValueError:
                listed = []
            got += [(q, page, i, str(x)) for i, x in enumerate(listed)]
            n_pages, n_items = n_pages + bool(listed), n_items + len(listed)
            why = "exhausted" if not listed or not token else "limited" if most is not None and page + 1 >= most else None
            page += 1
        states[q] = (why, n_pages, n_items)
    return sorted(got), states


@pytest.mark.parametrize("most", [None, 1, 3])
def test_scans_against_a_walk(spark, most):
    draw = random.Random(most)
    rows = [(None, 0, 1, 200, "t", "[1]"), ("neg", -1, 1, 200, "t", "[1]"), ("late", 1, 1, 200, "", "[1]"), ("odd", 0, 1, 200, "t", "not json"), ("none", 0, 1, None, None, None)]
    for q in range(60):
        for page in range(draw.randrange(7)):
            for attempt in range(1, draw.randrange(1, 3) + 1):
                status = draw.choice([200] * 12 + [429, 403, 404, 500])
                items = "[" + ",".join(str(draw.randrange(9)) for _ in range(draw.randrange(1, 4))) + "]" if draw.random() < 0.9 else draw.choice(["[]", None])
                rows.append((f"q{q}", page, attempt, status, draw.choice(["t"] * 6 + ["", None]), items if status == 200 else None))
            if draw.random() < 0.1:
                rows = [r for r in rows if r[:2] != (f"q{q}", page)]
    frame = spark.createDataFrame(rows + rows[:5], scans.RESPONSE)
    want, states = walk(rows, most)
    assert sorted(tuple(r) for r in scans.scanned(frame, most).collect()) == want
    assert {r["query"]: (r["ended"], r["n_pages"], r["n_items"]) for r in scans.scan_states(frame, most).collect()} == states
    assert {s[0] for s in states.values()} >= {"partial", "throttled", "exhausted" if most is None else "limited"}
    empty = frame.where("false")
    assert scans.scanned(empty, most).count() == 0 and scans.scan_states(empty, most).count() == 0


def test_discovery(spark):
    def page(*videos):
        return json.dumps([{"video_id": v, "channel_id": "ch", "title": "t", "published_at": at} for v, at in videos])

    responses = spark.createDataFrame([("a", 0, 1, 200, "t", page(("v1", "2025"), ("v2", "2025"), ("v1", "2020"), (None, "2025"))), ("a", 1, 1, 429, None, None), ("b", 0, 1, 403, None, None), ("c", 0, 1, 500, None, None), ("own", 0, 1, 200, "", page(("v1", "2025")))], scans.RESPONSE)
    stats = spark.createDataFrame([("v1", 5000, 1, 50), ("v1", 100, 1, 50), ("v2", 5000, 1, 1)], "video_id string, views long, likes long, comments long")
    targets = spark.createDataFrame([("c0", "a"), ("c0", "a"), ("c1", "b"), ("c2", "c"), ("own", "own"), ("c3", ""), ("c4", "never")], "candidate string, query string")
    found = scans.found_videos(responses, stats)
    assert sorted((r["query"], r["video_id"], r["views"]) for r in found.collect()) == [("a", "v1", 5000), ("a", "v2", 5000), ("own", "v1", 5000)]
    assert [(r["candidate"], r["video_id"], r["url"]) for r in scans.discovered_videos(targets, found, "2024").collect()] == [("c0", "v1", "https://www.youtube.com/watch?v=v1")]
    steps = scans.discovery_steps(targets, scans.scan_states(responses)).collect()
    assert sorted(tuple(r) for r in steps) == [("c0", "completed", "throttled"), ("c1", "quota_skip", "quota"), ("c2", "skipped", "failed"), ("c4", "skipped", "not asked")]


@pytest.fixture
def service():
    """A service of pages: 'many' has four by number, 'tokens' three by token, 'busy' refuses each first request, 'shut' all; asked lists the requests."""
    asked, lock = [], threading.Lock()

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            _, query, page = self.path.split("/")
            with lock:
                asked.append((query, page))
                again = asked.count((query, page)) > 1
            if query == "shut" or (query == "busy" and not again):
                self.send_response(429)
                self.send_header("Retry-After", "soon" if query == "shut" else "0")
                self.end_headers()
                return
            if query == "gone":
                self.send_error(404)
                return
            if query == "tokens":
                at = {"": 0, "x": 1, "y": 2}[page]
                body = {"items": [at], "next": ["x", "y", None][at]}
            else:
                body = {"items": [int(page)] if int(page) < 4 else []}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def opened(reader, url, queries, **options):
    return reader.format("paged_json").option("url", url).option("queries", json.dumps(queries)).option("wait", "0.01").options(**options).load()


def test_source_asks_for_what_filters_leave(spark, service):
    base, asked = service
    paged.register(spark)
    df = opened(spark.read, base + "/{query}/{page}", ["many", "busy", "gone"])
    rows = lambda d: sorted((r["query"], r["page"], r["item"]) for r in d.collect())
    assert rows(df) == [(q, i, str(i)) for q in ("busy", "many") for i in range(4)]
    asked.clear()
    assert rows(df.where((F.col("query") == "many") & (F.col("page") < 2))) == [("many", 0, "0"), ("many", 1, "1")]
    assert sorted(asked) == [("many", "0"), ("many", "1")]
    asked.clear()
    assert rows(df.where(F.col("query").isin("many", "gone") & (F.col("page") <= 0) & (F.col("item") == "7"))) == []
    assert sorted(asked) == [("gone", "0"), ("many", "0")]
    assert rows(opened(spark.read, base + "/{query}/{token}", ["tokens"], next="next")) == [("tokens", 0, "0"), ("tokens", 1, "1"), ("tokens", 2, "2")]
    with pytest.raises(Exception, match="429"):
        opened(spark.read, base + "/{query}/{page}", ["shut"]).collect()


def test_stream_takes_up_where_it_ended(spark, service, tmp_path):
    base, asked = service
    paged.register(spark)

    def run(pages):
        df = opened(spark.readStream, base + "/{query}/{page}", ["many", "busy"], pages=str(pages))
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r["query"], r["page"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run(2) == [(q, i) for q in ("busy", "many") for i in range(2)]
    asked.clear()
    assert run(2) == [(q, i) for q in ("busy", "many") for i in range(2)] and not asked
    assert run(6) == [(q, i) for q in ("busy", "many") for i in range(4)]
    assert {p for q, p in asked if q == "many"} == {"2", "3", "4"}
    with pytest.raises(Exception, match="lowered"):
        run(3)
