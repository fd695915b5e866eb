"""Embedder and generator over HTTP, for servers that embed lists of texts and stream answers line by line as JSON."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator, Sequence

from logloom.config import ChatOptions, EmbeddingOptions
from logloom.operators.chat import Generator, build_prompt
from logloom.operators.embed import Embedder


def _post(url: str, body: dict, seconds: float):
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    return urllib.request.urlopen(request, timeout=seconds)


class HttpEmbedder:
    """Vectors of one batch of texts in one call. A server that can't be reached raises OSError, an answer without a vector for each
    text ValueError. Calls may be made at the same time."""

    def __init__(self, url: str, model: str, seconds: float = 60.0):
        self.url, self.model, self.seconds = url.rstrip("/") + "/api/embed", model, seconds

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        if not texts:
            return []
        with _post(self.url, {"model": self.model, "input": list(texts)}, self.seconds) as answer:
            vectors = json.load(answer).get("embeddings") or []
        if len(vectors) != len(texts) or not all(vectors):
            raise ValueError(f"{self.model} gave {sum(map(bool, vectors))} vectors for {len(texts)} texts")
        return vectors


def embedder(options: EmbeddingOptions) -> Callable[[], Embedder] | None:
    """A factory for the configured server; None without one, which stands for the built-in embedder."""
    url, model = options.url, options.model
    return (lambda: HttpEmbedder(url, model)) if url else None


def generator(options: ChatOptions, seconds: float = 300.0) -> Generator | None:
    """Answers of the configured server to the prompt of a question, token by token; None without one."""
    if not options.url:
        return None

    def generate(question: str, context_text: str, history: str) -> Iterator[str]:
        body = {"model": options.model, "prompt": build_prompt(question, context_text, history, options), "stream": True}
        with _post(options.url.rstrip("/") + "/api/generate", body, seconds) as lines:
            for line in lines:
                if line.strip() and (token := json.loads(line).get("response")):
                    yield token

    return generate
