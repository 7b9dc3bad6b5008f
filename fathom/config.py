"""Engine parameters: defaults, environment overrides and their checks."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from typing import ClassVar
from urllib.parse import urlsplit

#: Directories and generated files that a vault scan leaves out.
EXCLUDED_DIRS = (".obsidian", ".omc", ".git", ".venv", "__pycache__", "00-INBOX")
GENERATED_FILES, GENERATED_PREFIX = ("graph_report.md", "graph.json"), ".graphify"
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1")


def _threshold(value: str) -> float | None:
    return float(value) if value else None


def _env(name: str, default, kind=str):
    return field(default_factory=lambda: kind(os.environ.get(name, default)), metadata={"env": name})


@dataclass(frozen=True)
class EngineConfig:
    """The numbers are fixed values that rankings depend on. Without a relevance threshold the embedder's own holds;
    THRESHOLD is for embedders that have none. provider: "builtin", or "server" for a model server at base_url.
    vector_search: "exact", or "ann" for the approximate index beside the store."""

    vault_path: str = _env("VAULT_PATH", "vault")
    store_path: str = _env("STORE_PATH", "store")
    graph_path: str = _env("GRAPH_PATH", "graph")
    embedding_model: str = _env("EMBEDDING_MODEL", "bge-m3")
    generation_model: str = _env("GENERATION_MODEL", "qwen2.5:14b")
    base_url: str = _env("OLLAMA_BASE_URL", "http://127.0.0.1:11434")
    chunk_size: int = _env("CHUNK_SIZE", 1000, int)
    chunk_overlap: int = _env("CHUNK_OVERLAP", 100, int)
    rrf_k: int = 60
    dense_weight: float = _env("DENSE_WEIGHT", 1.0, float)
    bm25_weight: float = _env("BM25_WEIGHT", 0.7, float)
    graph_weight: float = _env("GRAPH_WEIGHT", 0.0, float)
    summary_weight: float = _env("SUMMARY_WEIGHT", 0.3, float)
    graph_hops: int = _env("GRAPH_HOPS", 2, int)
    graph_seed_notes: int = _env("GRAPH_SEED_NOTES", 5, int)
    relevance_threshold: float | None = _env("RELEVANCE_THRESHOLD", "", _threshold)
    provider: str = _env("MODEL_PROVIDER", "builtin")
    tokenizer: str = _env("TOKENIZER", "whitespace")
    vector_search: str = _env("VECTOR_SEARCH", "exact")
    wiki_dir: str = _env("WIKI_DIR", "04-WIKI")

    THRESHOLD: ClassVar[float] = 0.48

    def __post_init__(self) -> None:
        if urlsplit(self.base_url).hostname not in LOCAL_HOSTS:
            raise ValueError(f"only local model endpoints are allowed, not {self.base_url}")
        if self.provider not in ("builtin", "server"):
            raise ValueError(f"no provider {self.provider}")
        if self.vector_search not in ("exact", "ann"):
            raise ValueError(f"no vector search {self.vector_search}")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be smaller than chunk_size")

    @classmethod
    def environment(cls) -> dict[str, str]:
        """Field name to the environment variable that overrides it."""
        return {f.name: f.metadata["env"] for f in fields(cls) if "env" in f.metadata}

    @staticmethod
    def candidate_k(k: int) -> int:
        return max(3 * k, 20)

    @staticmethod
    def clamp_k(k: int, low: int = 1, high: int = 50) -> int:
        return max(low, min(k, high))
