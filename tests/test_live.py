"""Fetching from a host on this machine."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from verdictflow.sources import live


class Host(BaseHTTPRequestHandler):
    def do_GET(self):
        status = {"/there": 200, "/spent": 403}.get(self.path, 404)
        self.send_response(status)
        self.send_header("X-RateLimit-Remaining", "0" if status == 403 else "9")
        self.end_headers()
        if status == 200:
            self.wfile.write((self.headers.get("Authorization") or "nobody").encode())

    def log_message(self, *args):
        pass


@pytest.fixture()
def address():
    server = HTTPServer(("127.0.0.1", 0), Host)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_answers_of_a_host(address):
    fetch = live.http(timeout=5)
    assert fetch(f"{address}/there") == live.Answer(200, "nobody")
    assert live.http(token="t")(f"{address}/there").body == "Bearer t"
    assert fetch(f"{address}/gone") == live.Answer(404)
    assert fetch(f"{address}/spent") == live.Answer(403, error=live.RATE_LIMITED)
    assert fetch("http://127.0.0.1:9/none").status is None


def test_each_address_is_asked_once(spark, address):
    asked = spark.createDataFrame([("a", f"{address}/there"), ("a", f"{address}/there"), ("b", f"{address}/gone")], "key string, address string")
    got = live.ask(asked, live.http(timeout=5), tasks=2, pause=0).collect()
    assert sorted((r.key, r.status) for r in got) == [("a", 200), ("b", 404)]
    assert live.ask(asked.limit(0), live.http(), pause=0).count() == 0
