"""Options with their defaults. All are plain values, so a job can be described and tested without a session."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class LogSource:
    """One configured source. ``type`` is trimmed and lower-cased; only ``file`` is known."""

    id: str
    path: str
    source_type: str = "app"
    type: str = "file"


@dataclass(frozen=True)
class RegexRule:
    name: str
    pattern: str


# The shipped layout rule and the patterns of noise.
SYSLOG_RULE = RegexRule(
    "syslog-like",
    r"^(?<timestamp>\w+\s+\d+\s+\d{2}:\d{2}:\d{2})\s+\S+\s+(?<service_name>[\w-]+)(?:\[(?<Correlation_ID>[^\]]+)\])?:\s+(?<severity>[A-Z]+)\s+(?<message>.*)$",
)
NOISE = (
    r"\{\"PayloadSenderV2\"\}\s+Cancellation requested",
    r"Elastic\.Apm\.Metrics\.MetricSet",
    r"No type was specified for the decimal property",
    r"SqlServerObjectsInstaller",
    r"Processing denomination \d+ on thread \d+",
    r"start Retry! Thread:",
    r"end Retry! Thread:",
)


@dataclass(frozen=True)
class IngestOptions:
    #: Texts that are handed to the embedder before their vectors are handed on.
    processing_batch_size: int = 256
    drop_noise: bool = True
    noise_patterns: tuple[str, ...] = NOISE
    use_checkpoints: bool = True
    checkpoint_file: str = "data/ingestion-checkpoints.json"
    rules: tuple[RegexRule, ...] = (SYSLOG_RULE,)
    chunk_tokens: int = 512
    overlap_tokens: int = 64
    retention_days: int = 30


@dataclass(frozen=True)
class SchedulerOptions:
    daily_batch: bool = True
    polling: bool = False
    run_on_start: bool = False
    batch_hours: int = 24
    poll_seconds: int = 30


@dataclass(frozen=True)
class EmbeddingOptions:
    batch_size: int = 16
    #: Batches in flight at a time in each partition, for a server.
    parallel_batches: int = 4
    dims: int = 768
    #: The server that embeds; without one the built-in embedder does.
    url: str | None = None
    model: str = "nomic-embed-text"


@dataclass(frozen=True)
class StoreOptions:
    #: The folder of the table below the store's.
    collection: str = "log_chunks"
    #: Only cosine is known.
    distance: str = "Cosine"

    def __post_init__(self) -> None:
        if self.distance.strip().lower() != "cosine":
            raise ValueError(f"unknown distance {self.distance!r}")


@dataclass(frozen=True)
class SearchOptions:
    top_k: int = 8
    rerank: bool = True
    over_fetch: int = 3
    similarity_weight: float = 0.85
    overlap_weight: float = 0.15


@dataclass(frozen=True)
class ChatOptions:
    history_messages: int = 8
    #: The server that answers; without one the built-in generator quotes the chunks.
    url: str | None = None
    model: str = "llama3.2"
    system_prompt: str = "You answer questions about logs. Answer only from the log context given. Quote entries with their timestamps. Say so if no log matches."


@dataclass(frozen=True)
class Options:
    sources: tuple[LogSource, ...] = ()
    ingest: IngestOptions = field(default_factory=IngestOptions)
    scheduler: SchedulerOptions = field(default_factory=SchedulerOptions)
    embedding: EmbeddingOptions = field(default_factory=EmbeddingOptions)
    store: StoreOptions = field(default_factory=StoreOptions)
    search: SearchOptions = field(default_factory=SearchOptions)
    chat: ChatOptions = field(default_factory=ChatOptions)
