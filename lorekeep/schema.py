"""Table schemas, defaults and fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field

KINDS = ("decision", "learning", "instruction", "reference")
DEFAULT_KIND = "learning"

ENTRIES = "id string, created_at string, kind string, supersedes array<string>, tags array<string>, body string"
CHUNKS = "chunk_id string, entry_id string, chunk_index int, kind string, tags array<string>, text string"
SPAN_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
SPAN = (
    "traceId string, spanId string, parentSpanId string, name string, startTimeUnixNano string, endTimeUnixNano string, "
    f"attributes array<struct<key:string,value:{SPAN_VALUE}>>, status struct<code:string,message:string>"
)
TESTSET = (
    "schema_version int, query_id string, query string, reference_answer string, reference_contexts array<string>, "
    "source_entry_ids array<string>, query_type string, "
    "ragas_metadata struct<persona_name:string,query_style:string,query_length:string,match_methods:array<string>>"
)


@dataclass(frozen=True)
class Chunking:
    max_tokens: int = 512
    overlap_tokens: int = 64
    min_tokens: int = 32


@dataclass(frozen=True)
class Search:
    rrf_k: int = 30
    dedup_threshold: float = 0.85
    reranker_candidates: int = 50
    default_limit: int = 5


@dataclass(frozen=True)
class Config:
    data_dir: str = ".lorekeep"
    chunking: Chunking = field(default_factory=Chunking)
    search: Search = field(default_factory=Search)

    def checked(self) -> Config:
        c, s = self.chunking, self.search
        if c.overlap_tokens >= c.max_tokens:
            raise ValueError("overlap_tokens must be less than max_tokens")
        if c.min_tokens > c.max_tokens:
            raise ValueError("min_tokens must not be greater than max_tokens")
        if not 0 <= s.dedup_threshold <= 1:
            raise ValueError("dedup_threshold must be between 0 and 1")
        if s.rrf_k <= 0:
            raise ValueError("rrf_k must be positive")
        return self
