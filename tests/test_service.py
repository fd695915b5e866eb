import json
import threading
import urllib.error
import urllib.request
from datetime import datetime, timezone

import pytest

from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from logloom.config import ChatOptions, EmbeddingOptions, IngestOptions, LogSource, Options
from logloom.operators import embed, remote
from logloom.operators.chat import read_frames
from logloom.service import ChatRequest, Service, load_options

AT = datetime(2026, 6, 1, tzinfo=timezone.utc)


def test_options():
    o = load_options('{"sources": [{"id": "a", "path": "/x"}], "ingest": {"chunk_tokens": 99, "rules": [{"name": "r", "pattern": "(?<a>x)"}], "noise_patterns": ["z"]}, "search": {"top_k": 3}}')
    assert o.sources[0].id == "a" and o.ingest.chunk_tokens == 99 and o.ingest.overlap_tokens == 64 and o.ingest.rules[0].name == "r" and o.search.top_k == 3
    with pytest.raises(ValueError):
        load_options('{"other": {}}')
    with pytest.raises(TypeError):
        load_options('{"search": {"nope": 1}}')


def test_requests():
    r = ChatRequest.from_json('{"Question": "q", "top_k": 2, "filter": {"severity": "warn", "from_utc": "2026-05-01T00:00:00", "to_utc": "2026-05-02T00:00:00+02:00", "x": 1}}')
    assert r.top_k == 2 and r.filter.severity == "warn" and r.filter.from_utc.tzinfo and r.filter.to_utc.utcoffset().seconds == 7200
    for bad in ("{}", '{"question": " "}', "[]", "{", b""):
        with pytest.raises(ValueError):
            ChatRequest.from_json(bad)


def test_ingest_and_chat_over_http(spark, tmp_path):
    (tmp_path / "a.log").write_text('{"message":"payment timeout","level":"error","timestamp":"2026-05-30T10:00:00Z"}\n2026-05-30 10:00:01 INFO login ok\n2026-05-30 10:00:02 start Retry! Thread: 5\n')
    options = Options(sources=(LogSource("pay", str(tmp_path / "a.log")),), ingest=IngestOptions(checkpoint_file=str(tmp_path / "o.json")))
    server = Service(spark, options, str(tmp_path / "t"), clock=lambda: AT).serve(port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def post(path, body=b""):
        with urllib.request.urlopen(urllib.request.Request(base + path, data=body, method="POST"), timeout=120) as r:
            return r.read().decode()

    try:
        assert json.load(urllib.request.urlopen(base + "/health")) == {"status": "ok"}
        counts = json.loads(post("/ingest"))
        assert counts["raw_logs_read"] == 3 and counts["vectors_upserted"] == 2 and counts["completed_at_utc"].startswith("2026-06-01")
        events = list(read_frames([post("/chat", b'{"question": "payment timeout", "session_id": "s", "top_k": 1}')]))
        assert [e["type"] for e in events] == ["meta", "token", "final"] and "payment timeout" in events[-1]["content"] and events[-1]["metadata"]["citations"][0]["severity"] == "ERROR"
        none = list(read_frames([post("/chat", b'{"question": "x", "filter": {"severity": "fatal"}}')]))
        assert none[-1]["content"].startswith("No matching logs")
        for path, body, status in (("/chat", b"{}", 400), ("/nope", b"", 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                post(path, body)
            assert e.value.code == status
    finally:
        server.shutdown()


def test_servers_that_embed_and_answer(spark):
    """A server of one's own: vectors of the texts' lengths, an answer that repeats the last line of the prompt's context."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body))
            if self.path == "/api/embed":
                out = json.dumps({"embeddings": [[float(len(t)), 1.0] for t in body["input"] if t != "lost"]})
            else:
                out = "\n".join(json.dumps({"response": t}) for t in ("one", "", " two")) + "\n\n"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out.encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}/"
    try:
        factory = remote.embedder(EmbeddingOptions(url=url, model="m"))
        df = spark.createDataFrame([(k, "x" * k) for k in range(50)], "id int, text string")
        got = embed.embed(df, factory=factory, batch_size=4, in_flight=3, at_once=10).collect()
        assert all(r["vector"] == [float(r["id"]), 1.0] for r in got) and all(b["model"] == "m" and len(b["input"]) <= 4 for _, b in seen)
        with pytest.raises(ValueError, match="vectors for"):
            factory()(["lost", "x"])
        assert factory()([]) == []
        answer = remote.generator(ChatOptions(url=url, model="g"))
        assert list(answer("why?", "the entries", "[USER] before")) == ["one", " two"]
        prompt = seen[-1][1]["prompt"]
        assert seen[-1][0] == "/api/generate" and prompt.index("[USER] before") < prompt.index("the entries") < prompt.index("why?")
    finally:
        server.shutdown()
        server.server_close()
    with pytest.raises(OSError):
        factory()(["x"])
    assert remote.embedder(EmbeddingOptions()) is None and remote.generator(ChatOptions()) is None


def test_distance_and_collection():
    assert load_options('{"store": {"collection": "c", "distance": "cosine"}, "embedding": {"url": "http://x", "model": "m"}}').store.collection == "c"
    with pytest.raises(ValueError):
        load_options('{"store": {"distance": "Dot"}}')
