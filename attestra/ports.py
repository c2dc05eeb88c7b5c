"""Models behind plain callables, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text batches to vectors; called in tasks.
Embedder = Callable[[list[str]], np.ndarray]


def hashed_embedding(dimension: int = 64) -> Embedder:
    """Counts of words in hashed places, scaled to length 1."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in text.lower().split():
                digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
                out[row, int.from_bytes(digest, "little") % dimension] += 1 if digest[-1] & 1 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    return embed


def requests(costs: list[int], most_items: int = 2048, most_cost: int = 300_000, most_each: int = 8192) -> list[tuple[int, int]]:
    """Ranges of items that fit a request each; an item beyond its own limit is an error."""
    out, start, spent = [], 0, 0
    for k, cost in enumerate(costs):
        if cost > most_each:
            raise ValueError(f"input {k} has {cost} tokens; {most_each} are allowed")
        if k > start and (k - start == most_items or spent + cost > most_cost):
            out.append((start, k))
            start, spent = k, 0
        spent += cost
    return [*out, (start, len(costs))] if costs else []


def ordered_vectors(response: list[tuple[int, list[float]]], expected: int, dimension: int | None = None) -> tuple[list[list[float]], int]:
    """Vectors of a response's (index, vector) items in the order of the inputs, and their dimension.

    An index that is no number of an input, or comes twice, a missing one, vectors of other
    dimensions than the first (or than ``dimension``) and values that are not finite are errors.
    """
    found: dict[int, list[float]] = {}
    for index, vector in response:
        if isinstance(index, bool) or not isinstance(index, int) or not 0 <= index < expected or index in found:
            raise ValueError(f"unusable index in an embedding response: {index!r}")
        if not vector or not np.isfinite(np.asarray(vector, dtype=float)).all() or len(vector) != (dimension := dimension or len(vector)):
            raise ValueError(f"unusable vector in an embedding response at {index}")
        found[index] = vector
    if len(found) != expected or dimension is None:
        raise ValueError(f"{len(found)} of {expected} vectors in an embedding response")
    return [found[k] for k in range(expected)], dimension


def embed_column(df: DataFrame, text_col: str, embedder: Embedder, out: str = "embedding", most_items: int = 2048, most_cost: int = 300_000, most_each: int | None = 8192) -> DataFrame:
    """``df`` with vectors, made batch by batch; wrong numbers or values that are not finite fail.

    A text costs a quarter of its characters, in tokens, and 1 at least. One beyond
    ``most_each`` fails, unless that is none (for providers without such a limit).
    """
    each = most_each or 2**31

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list = []
            for a, b in requests([max(1, len(t) // 4) for t in frame[text_col].fillna("")], most_items, most_cost, each):
                got = embedder(frame[text_col].fillna("").iloc[a:b].tolist())
                if len(got) != b - a or not np.isfinite(got).all():
                    raise ValueError("the embedding port gave other or unusable vectors")
                vectors += list(got)
            yield frame.assign(**{out: [v.tolist() for v in vectors]})

    return df.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` array<float>")


def lexical_score(query: Column, text: Column) -> Column:
    """Stand-in for a reranker: the share of the query's words that the text has."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\W+"))
    return F.size(F.array_intersect(words(query), words(text))) / F.greatest(F.size(words(query)), F.lit(1))


#: Named stand-ins; a name that is not here is an error, never another model.
EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hashed": hashed_embedding}


def embedder(name: str) -> Embedder:
    if name not in EMBEDDERS:
        raise KeyError(f"no embedding port named {name}")
    return EMBEDDERS[name]()


#: What an error that may pass has as its class's name, its code or its status.
TRANSIENT = {
    "name": {"APITimeoutError", "RateLimitError", "ServiceUnavailable", "SessionExpired", "TransientError", "OperationalError", "ConnectionError", "TimeoutError"},
    "code": {408, 500, 502, 503, 504},
    "status": {"DEADLINE_EXCEEDED", "INTERNAL", "UNAVAILABLE"},
}


def is_transient(error: BaseException) -> bool:
    """Whether the error has a value of ``TRANSIENT``, statuses in any case; messages say nothing."""
    said = {"name": type(error).__name__, "code": getattr(error, "code", None), "status": getattr(error, "status", None)}
    kinds = {"name": str, "code": int, "status": str}
    fold = lambda key, value: value.upper() if key == "status" else value
    return any(isinstance(value, kinds[key]) and fold(key, value) in TRANSIENT[key] for key, value in said.items())


def once_more(call: Callable[[], object], attempts: int = 2) -> object:
    """Retry, for errors that may pass only."""
    for k in range(attempts):
        try:
            return call()
        except Exception as error:
            if k + 1 == attempts or not is_transient(error):
                raise
    raise AssertionError
