"""From retrieved chunks to an answer: context, citations, history, prompt, events."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.config import ChatOptions
from logloom.functions.text import iso

# What stands for an empty context and for an answer without matches.
NO_CONTEXT = "No matching logs found."
NO_MATCH = "No matching logs were found for the current question and filters."
STORE_ERROR, STORE_TEXT = "vector_store_unavailable", "No answer now: the table of logs doesn't respond."
MODEL_ERROR, MODEL_TEXT = "llm_unavailable", "No answer now: the model doesn't respond."


def _joined(lines: Column, sep: str) -> Column:
    """One text of all rows in order of ``rank``."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("rank"), lines.alias("line"))))
    return F.array_join(F.transform(ordered, lambda x: x["line"]), sep)


def context(found: DataFrame) -> DataFrame:
    """One row with ``context``: header, text and a blank line for each chunk in order of ``rank``; k rows in, one out."""
    head = F.concat(F.lit("["), "rank", F.lit("] ts="), iso(F.col("timestamp_utc")), F.lit(" severity="), "severity", F.lit(" service="), "service_name", F.lit(" trace="), "trace_id", F.lit(" source="), "source_id", F.lit("/"), "source_type")
    block = F.concat(head, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    made = _joined(block, "\n")
    return found.agg(F.when(F.count("*") > 0, made).otherwise(NO_CONTEXT).alias("context"))


def citations(found: DataFrame) -> DataFrame:
    """id, timestamp, severity, service_name, trace_id, source_id of each cited chunk."""
    return found.select(F.col("rank").alias("id"), iso(F.col("timestamp_utc")).alias("timestamp"), "severity", "service_name", "trace_id", "source_id")


def shape(answer: str, cited: list[dict]) -> str:
    """The answer with a list of its citations, if there are any."""
    if not cited:
        return answer.strip()
    lines = [f"- [{c['id']}] `{c['timestamp']}` `{c['severity']}` `{c['service_name']}` trace `{c['trace_id']}`" for c in cited]
    return f"{answer.strip()}\n\n### Cited log chunks\n" + "\n".join(lines)


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each session, by ``seq``."""
    order = W.partitionBy("session_id").orderBy(F.desc("seq"))
    return messages.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def kept_messages(messages: DataFrame, options: ChatOptions = ChatOptions()) -> DataFrame:
    """What a session keeps: four times the messages that enter a prompt, 4 at least."""
    return last_messages(messages, max(4, 4 * options.history_messages))


def prompt_history(messages: DataFrame, n: int = 8) -> DataFrame:
    """session_id, history: the last n messages as ``[ROLE] content`` lines."""
    line = F.concat(F.lit("["), F.upper("role"), F.lit("] "), F.coalesce("content", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return last_messages(messages, n).groupBy("session_id").agg(F.trim(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("history"))


def build_prompt(question: str, context_text: str, history: str = "", options: ChatOptions = ChatOptions()) -> str:
    """Preamble, history if any, context, question, closing instructions."""
    past = ["Conversation history:", history, ""] if history.strip() else []
    rules = ["Keep it short, and name the times of the entries you rely on.", "If these entries don't settle the question, say what is missing."]
    return "\n".join([options.system_prompt, *past, "Entries found:", context_text, "", "Question:", question, "", *rules, ""])


#: (question, context, history) to answer tokens.
Generator = Callable[[str, str, str], Iterable[str]]


def extractive(question: str, context_text: str, history: str) -> Iterator[str]:
    """The offline generator: the first line of the text of the first three chunks."""
    lines = context_text.split("\n")
    picked = [b for a, b in zip(lines, lines[1:]) if a.startswith("[") and "] ts=" in a][:3]
    for k, line in enumerate(picked):
        yield ("\n" if k else "") + line


@dataclass(frozen=True)
class Event:
    type: str
    content: str | None
    metadata: dict | None

    def frame(self) -> str:
        """As one server-sent event."""
        return "data: " + json.dumps({"type": self.type, "content": self.content, "metadata": self.metadata}, ensure_ascii=False) + "\n\n"


def read_frames(chunks: Iterable[str]) -> Iterator[dict]:
    """Events of a stream of frames, cut anywhere; what isn't a data frame is skipped."""
    rest = ""
    for chunk in chunks:
        rest = (rest + chunk).replace("\r\n", "\n")
        *whole, rest = rest.split("\n\n")
        for frame in whole:
            if frame.startswith("data:"):
                yield json.loads(frame[5:].strip())


class Sessions:
    """Messages by session, bounded; optionally kept in a folder, a file a session, that is read again after a restart."""

    def __init__(self, options: ChatOptions = ChatOptions(), path: str | None = None):
        self.limit, self.path = max(4, 4 * options.history_messages), path
        self._messages: dict[str, list[tuple[str, str, str]]] = {}

    def _file(self, session_id: str) -> str:
        return os.path.join(self.path, hashlib.sha256(session_id.encode("utf-8", "replace")).hexdigest() + ".json")

    def _own(self, session_id: str) -> list[tuple[str, str, str]]:
        if self.path and session_id not in self._messages:
            try:
                with open(self._file(session_id), encoding="utf-8") as f:
                    self._messages[session_id] = [tuple(m) for m in json.load(f)]
            except (OSError, ValueError):
                pass
        return self._messages.get(session_id, [])

    @staticmethod
    def resolve(session_id: str | None) -> str:
        return session_id.strip() if session_id and session_id.strip() else uuid.uuid4().hex

    def history(self, session_id: str) -> list[tuple[str, str, str]]:
        return list(self._own(session_id))

    def append(self, session_id: str, role: str, content: str, now: datetime | None = None) -> None:
        own = [*self._own(session_id), (role, content, (now or datetime.now(timezone.utc)).isoformat())][-self.limit :]
        self._messages[session_id] = own
        if self.path:
            os.makedirs(self.path, exist_ok=True)
            file = self._file(session_id)
            with open(file + ".tmp", "w", encoding="utf-8") as f:
                json.dump(own, f)
            os.replace(file + ".tmp", file)


def history_text(history: list[tuple[str, str, str]], n: int) -> str:
    return "\n".join(f"[{role.upper()}] {content}" for role, content, _ in history[-n:]).strip() if n > 0 else ""


def chat(question: str, retrieve: Callable[[str], DataFrame], sessions: Sessions, session_id: str | None = None, generate: Generator = extractive, options: ChatOptions = ChatOptions()) -> Iterator[Event]:
    """The events of one question: meta, tokens, final.

    ``retrieve`` gives the chunks as retrieve() does. History is read before the question is added, and written only
    when there is an answer. A blank question raises ValueError.
    """
    if not question or not question.strip():
        raise ValueError("the question is blank")
    return _events(question, retrieve, sessions, sessions.resolve(session_id), generate, options)


def _events(question, retrieve, sessions, session, generate, options) -> Iterator[Event]:
    past = sessions.history(session)
    try:
        found = retrieve(question)
        cited = [r.asDict() for r in citations(found).orderBy("id").collect()]  # k rows
        text = context(found).first()["context"]
    except Exception:
        yield Event("meta", None, {"session_id": session, "chunk_count": 0, "error": STORE_ERROR})
        yield Event("final", STORE_TEXT, {"session_id": session, "citations": [], "error": STORE_ERROR})
        return
    yield Event("meta", None, {"session_id": session, "chunk_count": len(cited)})
    if not cited:
        sessions.append(session, "user", question)
        sessions.append(session, "assistant", NO_MATCH)
        yield Event("final", NO_MATCH, {"session_id": session, "citations": []})
        return
    answer = ""
    try:
        for token in generate(question, text, history_text(past, options.history_messages)):
            if token:
                answer += token
                yield Event("token", token, None)
    except Exception:
        yield Event("final", MODEL_TEXT, {"session_id": session, "citations": [], "error": MODEL_ERROR})
        return
    final = shape(answer, cited)
    sessions.append(session, "user", question)
    sessions.append(session, "assistant", final)
    yield Event("final", final, {"session_id": session, "citations": cited})


def frames(events: Iterable[Event]) -> Iterator[str]:
    """Events as frames; if they break off, one final frame says so."""
    try:
        for event in events:
            yield event.frame()
    except Exception as e:
        yield Event("final", "Chat failed unexpectedly.", {"error": "chat_dependency_failure", "detail": str(e)}).frame()
