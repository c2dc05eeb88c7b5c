"""Settings with a fixed precedence: environment, a .env file, a JSON file, defaults; each with its kind and its limits."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path


def _setting(default, section: str, name: str | None = None, low: int | None = None, high: int | None = None):
    return field(default=default, metadata={"section": section, "name": name, "low": low, "high": high})


@dataclass(frozen=True)
class Settings:
    """The documented defaults, limits, and the sections and names of the JSON file."""

    chunk_size: int = _setting(1200, "chunking", low=1)
    chunk_overlap: int = _setting(150, "chunking", low=0)
    chunk_maximum: int = _setting(2000, "chunking", "maximum_chunk_size", low=1)
    retrieval_top_k: int = _setting(6, "retrieval", "top_k", low=1)
    vector_k: int = _setting(12, "retrieval", low=1)
    graph_k: int = _setting(12, "retrieval", low=1)
    max_hops: int = _setting(2, "retrieval", low=1, high=4)
    token_budget: int = _setting(6000, "retrieval", low=512)
    context_budget: int = _setting(24000, "stage4", "context_token_budget", low=512)
    symbol_search_limit: int = _setting(20, "stage4", low=1)
    max_symbols: int = _setting(80, "stage4", "max_context_symbols", low=1)
    concurrency: int = _setting(1, "runtime", low=1, high=32)
    timeout_seconds: int = _setting(120, "runtime", low=1)
    transient_max_attempts: int = _setting(2, "runtime", low=1, high=2)
    collection_prefix: str = _setting("chunks", "chroma")
    log_level: str = _setting("INFO", "application")
    retain_referenced_snapshots: bool = _setting(True, "stage4")
    framework_allowed_roots: tuple[str, ...] = _setting((".",), "stage4")

    def __post_init__(self):
        for f in fields(self):
            value, low, high = getattr(self, f.name), f.metadata["low"], f.metadata["high"]
            if (low is not None and value < low) or (high is not None and value > high):
                raise ValueError(f"{f.name} is {value}; {low} to {high or 'any'} is allowed")
        if not self.chunk_overlap < self.chunk_maximum:
            raise ValueError("chunk_overlap must be less than chunk_maximum")


TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def as_kind(value: object, like: object) -> object:
    """A value of the file or the environment as the kind of a default; what it can't be is an error."""
    if isinstance(like, bool):
        text = str(value).strip().lower()
        if text not in TRUE + FALSE:
            raise ValueError(f"no boolean: {value!r}")
        return text in TRUE
    if isinstance(like, int):
        return int(str(value))
    if isinstance(like, tuple):
        return tuple(map(str, value)) if isinstance(value, list) else tuple(x.strip() for x in str(value).split(",") if x.strip())
    return str(value)


def read_env_file(path: str) -> dict[str, str]:
    """Names and values of lines such as NAME=value; comments, other lines and quotes about a value go. A missing file is empty."""
    file = Path(path)
    lines = file.read_text(encoding="utf-8").splitlines() if file.exists() else []
    pairs = [line.partition("=") for line in map(str.strip, lines) if "=" in line and not line.startswith("#")]
    return {name.strip(): value.strip().strip("\"'") for name, _, value in pairs}


def load(path: str | None = None, env: Mapping[str, str] | None = None, prefix: str = "ATTESTRA_", env_file: str | None = None) -> Settings:
    """Settings of the environment (prefix and the name in capitals), then of the .env file, then of the JSON file, then defaults.

    The file has settings by name, or in sections by their names there. An unknown name at
    the top is an error, unless it is a section; sections may hold what isn't for this
    library. A blank value of the environment counts as unset.
    """
    env = {**(read_env_file(env_file) if env_file else {}), **(os.environ if env is None else env)}
    held = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    own = {f.name: f for f in fields(Settings)}
    if unknown := sorted(k for k, v in held.items() if k not in own and not isinstance(v, dict)):
        raise ValueError(f"unknown settings: {unknown}")
    values = {}
    for name, f in own.items():
        section = held.get(f.metadata["section"])
        inside = section.get(f.metadata["name"] or name) if isinstance(section, dict) else None
        given = env.get(prefix + name.upper(), "").strip() or held.get(name, inside)
        if given is not None and given != "":
            try:
                values[name] = as_kind(given, f.default)
            except ValueError as error:
                raise ValueError(f"{name}: {error}") from error
    return Settings(**values)
