"""The API source against a server of our own on this machine, and parties from its records."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import enrich
from quillgraph.sources.api import JsonApi, JsonApiReader


class Server(BaseHTTPRequestHandler):
    seen: list = []
    busy: Counter = Counter()

    def log_message(self, *_):
        pass

    def answer(self, asked):
        type(self).seen.append((self.path, asked))
        page, cycle = int(asked.get("page", 1)), asked.get("cycle")
        if "/award/" in self.path:
            return {"obligated_amount": 70 + len(self.path)}
        rows = [{"id": f"a{page}-{i}", "cycle": str(2020 + i % 2), "amount": None if i == 3 else i} for i in range(4)] if page <= 5 else []
        return {"results": [r for r in rows if cycle is None or r["cycle"] == str(cycle)]}

    def send(self, asked):
        if "busy" in self.path and not self.busy[self.path]:
            self.busy[self.path] += 1
            self.send_response(429)
            self.send_header("Retry-After", "0")
            self.end_headers()
            type(self).seen.append((self.path, "429"))
            return
        body = json.dumps(self.answer(asked)).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        self.send({k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()})

    def do_POST(self):
        self.send(json.loads(self.rfile.read(int(self.headers["Content-Length"]))) | {"post": True})


@pytest.fixture(scope="module")
def base(spark):
    spark.dataSource.register(JsonApi)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.fixture(autouse=True)
def fresh():
    Server.seen.clear()
    Server.busy.clear()


def load(spark, base, path, **options):
    return spark.read.format("json_api").options(url=base + path, pages="8", pages_per_task="2", filters="cycle", **options).load()


def test_filters_go_upstream(spark, base):
    rows = load(spark, base, "/list").filter("cycle = '2021' AND page > 1").collect()
    assert len(rows) == 8 and {r["cycle"] for r in rows} == {"2021"} and {json.loads(r["row"])["cycle"] for r in rows} == {"2021"}
    assert Server.seen and all(asked["cycle"] == "2021" for _, asked in Server.seen)


def test_bodies_and_details(spark, base):
    rows = load(spark, base, "/search", body='{"kind": ["A"]}', detail=base + "/award/{id}", detail_key="id", detail_need="amount", detail_take="total_obligation, obligated_amount").collect()
    assert len(rows) == 20 and all(json.loads(r["row"])["amount"] is not None for r in rows)
    posts = [asked for path, asked in Server.seen if path == "/search"]
    assert all(a["post"] and a["kind"] == ["A"] for a in posts) and sorted(a["page"] for a in posts) == [1, 2, 3, 4, 5, 6, 7]
    assert sum(path.startswith("/award/") for path, _ in Server.seen) == 5


def test_the_budget_holds_over_all_tasks_and_tries(spark, base):
    rows = load(spark, base, "/busy/{page}", budget="6").collect()
    assert len(Server.seen) <= 6 and Counter(asked == "429" for _, asked in Server.seen)[True] >= 2
    assert {r["page"] for r in rows if r["status"] == "over_budget"} and all(r["row"] is None for r in rows if r["status"] == "over_budget")
    shares = [p.share for p in JsonApiReader({"url": "u", "pages": "25", "budget": "7"}).partitions()]
    assert shares == [3, 2, 2]


def test_parties_in_two_hops(spark):
    a = spark.createDataFrame([("k1", "fec.committee", "C1"), ("k1", "fec.disbursement.recipient", "C0"), ("k2", "fec.committee", "C2"), ("k3", "fec.committee", "C3"), ("k3", "party", "m"), ("k4", "fec.committee", "C4"),
                               ("k5", "fec.committee", "C4"), ("k6", "fec.disbursement.recipient", "H1"), ("k7", "fec.disbursement.recipient", "unknown-1"), ("k8", "fec.committee", "C8"), ("k9", "party", "C8"), ("p", "fec.committee", "C9")],
                              "canonical_id string, source_system string, source_id string").withColumn("surface_name", F.lit(""))
    c = spark.createDataFrame([("C0", "REP", None), ("C1", "DEM", None), ("C2", None, ["H7", "H1", "S1"]), ("C4", " ", ["H7", "H8", "H1"]), ("C8", "REP", None), ("C9", "LIB", ["S1"])], "fec_id string, party string, candidate_ids array<string>")
    h = spark.createDataFrame([("H1", "dem"), ("H7", "GRE"), ("S1", "REP")], "fec_id string, party string")
    new = enrich.party_aliases(a, c, h)
    assert {(r["canonical_id"], r["source_id"], r["surface_name"]) for r in new.collect()} == {("k1", "C0", "Republican"), ("k2", "C2", "Democratic"), ("k6", "H1", "Democratic"), ("p", "C9", "Republican")}
    assert enrich.party_aliases(a.unionByName(new.select(*a.columns)), c, h).count() == 0
