"""Ingest, chat and health in one object, and the same over HTTP."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.config import ChatOptions, EmbeddingOptions, IngestOptions, LogSource, Options, RegexRule, SchedulerOptions, SearchOptions, StoreOptions
from logloom.operators import chat, remote
from logloom.operators.embed import Embedder, embed_one
from logloom.operators.search import QueryFilter, retrieve, with_defaults
from logloom.sources.store import PointStore
from logloom.streaming.ingest import Scheduler, health, point_store, respond, run_ingest

log = logging.getLogger(__name__)


def load_options(text: str) -> Options:
    """Options from JSON with sections named as in Options; what isn't given keeps its default. Unknown names raise."""
    given = json.loads(text)
    sections = {"ingest": IngestOptions, "scheduler": SchedulerOptions, "embedding": EmbeddingOptions, "store": StoreOptions, "search": SearchOptions, "chat": ChatOptions}
    if unknown := set(given) - {"sources", *sections}:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    out = Options(sources=tuple(LogSource(**s) for s in given.get("sources", ())))
    for name, kind in sections.items():
        values = dict(given.get(name, {}))
        if "rules" in values:
            values["rules"] = tuple(RegexRule(**r) for r in values["rules"])
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}
        out = replace(out, **{name: kind(**values)})
    return out


@dataclass(frozen=True)
class ChatRequest:
    question: str
    session_id: str | None = None
    top_k: int | None = None
    filter: QueryFilter = QueryFilter()

    @classmethod
    def from_json(cls, text: str | bytes) -> ChatRequest:
        """ValueError if it is no JSON object or the question is blank. Times without a zone are UTC."""
        body = json.loads(text or "{}")
        if not isinstance(body, dict):
            raise ValueError("the request is no JSON object")
        body = {k.lower(): v for k, v in body.items()}
        question = body.get("question")
        if not isinstance(question, str) or not question.strip():
            raise ValueError("question is required")
        known = {f.name for f in fields(QueryFilter)}
        values = {k: v for k, v in (body.get("filter") or {}).items() if k in known and v is not None}
        for k in ("from_utc", "to_utc"):
            if k in values:
                at = datetime.fromisoformat(values[k])
                values[k] = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        return cls(question, body.get("session_id"), body.get("top_k"), QueryFilter(**values))


class Service:
    """One store, its sources and its sessions. ``store``: a table, or the folder below which the configured collection lies. Embedder and
    generator are those given, else those of the configured servers, else the built-in ones."""

    def __init__(self, spark: SparkSession, options: Options, store: PointStore | str, sessions: chat.Sessions | None = None, factory: Callable[[], Embedder] | None = None, generate: chat.Generator | None = None, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        self.spark, self.options, self.clock = spark, options, clock
        self.factory = factory or remote.embedder(options.embedding)
        self.generate = generate or remote.generator(options.chat) or chat.extractive
        self.store = point_store(spark, os.path.join(store, options.store.collection)) if isinstance(store, str) else store
        self.sessions = sessions or chat.Sessions(options.chat)

    def ingest(self) -> tuple[int, dict]:
        """Status and counts of one run."""
        return respond(lambda: run_ingest(self.spark, self.store, self.options, self.clock(), self.factory))

    def schedule(self) -> Scheduler:
        """A schedule of ingest runs, after each of which the store is maintained apart; call start on it."""

        def run() -> None:
            status, counts = self.ingest()
            log.log(logging.INFO if status == 200 else logging.ERROR, "ingest: %s", counts)

        return Scheduler(run, self.options, self.store.maintain)

    def retrieve(self, request: ChatRequest) -> DataFrame:
        vector = embed_one(request.question, self.factory, self.options.embedding.dims)
        found = retrieve(self.store.read(), request.question, vector, request.top_k, request.filter, self.options.search)
        return with_defaults(found, F.lit(self.clock()))

    def chat(self, request: ChatRequest) -> Iterator[chat.Event]:
        return chat.chat(request.question, lambda _: self.retrieve(request), self.sessions, request.session_id, self.generate, self.options.chat)

    def serve(self, host: str = "127.0.0.1", port: int = 5000) -> ThreadingHTTPServer:
        """A server for GET /health, POST /ingest and POST /chat (server-sent events); call serve_forever on it."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _json(self, status: int, body: dict) -> None:
                data = json.dumps(body, default=lambda x: x.isoformat()).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_GET(self) -> None:
                self._json(*((200, health()) if self.path == "/health" else (404, {"error": "not found"})))

            def do_POST(self) -> None:
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                if self.path == "/ingest":
                    self._json(*service.ingest())
                elif self.path == "/chat":
                    try:
                        request = ChatRequest.from_json(body)
                    except ValueError as e:
                        self._json(400, {"error": str(e)})
                        return
                    self.send_response(200)
                    self.send_header("Content-Type", "text/event-stream")
                    self.send_header("Cache-Control", "no-cache")
                    self.end_headers()
                    for frame in chat.frames(service.chat(request)):
                        self.wfile.write(frame.encode())
                        self.wfile.flush()
                else:
                    self._json(404, {"error": "not found"})

            def log_message(self, form: str, *args) -> None:
                log.info(form, *args)

        return ThreadingHTTPServer((host, port), Handler)
