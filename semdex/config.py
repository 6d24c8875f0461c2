"""Layered configuration: call options over the project's file over the user's file over defaults."""

from __future__ import annotations

import dataclasses
import os
import shutil
import tomllib
import warnings
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

PROJECT_DIR = ".semdex"


@dataclass
class Embedding:
    endpoint: str = "http://localhost:7997/embeddings"
    model: str = "mxbai-embed-large-v1"
    api_key: str | None = None
    batch_size: int = 32
    timeout_seconds: int = 30
    max_retries: int = 3


@dataclass
class Chunking:
    max_chunk_tokens: int = 512
    overlap_tokens: int = 50
    max_file_size_mb: int = 10
    use_syntax: bool = True
    languages: list[str] = field(default_factory=lambda: ["rust", "python", "javascript", "typescript", "go"])
    # Kept so that files with the key load and show it; a file without syntax chunks is always split as text.
    fallback_to_tokens: bool = True
    rescue_oversized: bool = False
    # A vocabulary file that counts tokens, on a path that all executors see; empty: white-space tokens.
    tokenizer: str = ""

    def __post_init__(self) -> None:
        if not 0 <= self.overlap_tokens < self.max_chunk_tokens:
            raise ValueError("overlap_tokens must be at least 0 and less than max_chunk_tokens")


@dataclass
class Indexing:
    skip_binary: bool = True
    follow_symlinks: bool = False
    # The default ignore patterns.
    ignore_patterns: list[str] = field(
        default_factory=lambda: [".git/", ".semdex/", "node_modules/", "target/", "__pycache__/", "*.pyc", ".venv/", "venv/", ".DS_Store"]
    )


@dataclass
class Query:
    default_limit: int = 10
    min_similarity: float = 0.5
    output_format: str = "context"
    auto_index: bool = False


@dataclass
class Display:
    """Kept so that files with these keys load and show them; output has no colours, and scores are always shown."""

    show_similarity_scores: bool = True
    color_output: bool = True


@dataclass
class Reranker:
    enabled: bool = False
    endpoint: str = "http://localhost:7995/rerank"
    model: str = "bge-reranker-large"
    api_key: str | None = None
    top_n: int = 50


@dataclass
class Config:
    embedding: Embedding = field(default_factory=Embedding)
    chunking: Chunking = field(default_factory=Chunking)
    indexing: Indexing = field(default_factory=Indexing)
    query: Query = field(default_factory=Query)
    display: Display = field(default_factory=Display)
    reranker: Reranker = field(default_factory=Reranker)

    def to_dict(self) -> dict[str, dict[str, Any]]:
        return dataclasses.asdict(self)


def deep_merge(base: dict, over: dict) -> dict:
    """Tables merge key by key; any other value, arrays too, replaces what was there."""
    out = dict(base)
    for key, value in over.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def from_dict(values: dict) -> Config:
    """Unknown keys are passed over and missing ones take their defaults."""
    sections = {}
    for f in dataclasses.fields(Config):
        known = {x.name for x in dataclasses.fields(f.default_factory)}
        given = values.get(f.name, {})
        if not isinstance(given, dict):
            raise ValueError(f"section {f.name} is not a table")
        sections[f.name] = f.default_factory(**{k: v for k, v in given.items() if k in known})
    return Config(**sections)


def global_path(env: dict[str, str] | None = None) -> Path | None:
    """The user's file: under XDG_CONFIG_HOME if that is set and not empty, else under HOME/.config."""
    env = os.environ if env is None else env
    if env.get("XDG_CONFIG_HOME"):
        return Path(env["XDG_CONFIG_HOME"], "semdex", "config.toml")
    return Path(env["HOME"], ".config", "semdex", "config.toml") if env.get("HOME") else None


def adopt_legacy(new: Path, legacy: Path) -> Path:
    """Copy an older user file to the new place once; the path to read from, the old one if copying fails."""
    if new.exists() or not legacy.exists():
        return new
    try:
        new.parent.mkdir(parents=True, exist_ok=True)
        shutil.copyfile(legacy, new)
    except OSError as e:
        warnings.warn(f"could not copy {legacy} to {new}: {e}", stacklevel=2)
        return legacy
    return new


def load_global(path: Path | None) -> Config:
    """Absent: defaults. Malformed: an error."""
    if path is None or not path.exists():
        return Config()
    return from_dict(tomllib.loads(path.read_text("utf-8")))


def load_global_or_default(path: Path | None) -> Config:
    try:
        return load_global(path)
    except (OSError, ValueError, TypeError) as e:
        warnings.warn(f"ignoring {path}: {e}", stacklevel=2)
        return Config()


def overlay(base: Config, project_file: Path) -> Config:
    """base with the project's file over it; a malformed file warns and leaves base."""
    if not project_file.exists():
        return base
    try:
        return from_dict(deep_merge(base.to_dict(), tomllib.loads(project_file.read_text("utf-8"))))
    except (OSError, ValueError, TypeError) as e:
        warnings.warn(f"ignoring {project_file}: {e}", stacklevel=2)
        return base


def load_for_index(root: str | Path, user_file: Path | None = None) -> Config:
    return overlay(load_global_or_default(user_file or global_path()), Path(root, PROJECT_DIR, "config.toml"))
