"""Quality rules as a short-circuit cascade.

Each rule says whether it rejects a text. A rule's cost (seconds a text) and the texts it
rejects are measured on a sample, rows with the least hashes of all; the cascade then asks
first the rule with the most rejections per cost, next the one with the most among the
texts that the first leaves, and so on, and stops at the first that rejects. The order
changes only the time taken: the verdict is the same in any order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import documents_of, map_arrow

SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Rows on which rules are timed, the whole input if it has fewer. Only the order depends on them.
SAMPLE_ROWS = 400


class Text:
    """A text with what rules ask of it, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.data = self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.data) - len(self.data.translate(None, SPACES)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def word_ids(self) -> np.ndarray:
        ids: dict[bytes, int] = {}
        return np.array([ids.setdefault(w, len(ids)) for w in self.words], dtype=np.int64)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 5-word windows that the text has twice or more."""
        if len(self.words) <= WINDOW:
            return 0
        ids = self.word_ids
        key = ids[: len(ids) - WINDOW + 1]
        n_keys = int(ids.max()) + 1
        base = n_keys
        for k in range(1, WINDOW):
            if n_keys * base >= 2**63:
                key = np.unique(key, return_inverse=True)[1].astype(np.int64)
                n_keys = int(key.max()) + 1
            key = key * base + ids[k : len(ids) - WINDOW + 1 + k]
            n_keys *= base
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        if not same.any():
            return 0
        repeated = np.zeros(len(key), dtype=bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        edges = np.zeros(len(ids) + 1, dtype=np.int64)
        starts = np.flatnonzero(repeated)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + WINDOW, -1)
        return int((np.cumsum(edges)[:-1] > 0).sum())

    @cached_property
    def n_letters(self) -> int:
        return sum(map(str.isalpha, self.text))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def _upper(t: Text) -> bool:
    n_upper = sum(map(str.isupper, t.text))
    return n_upper > 20 and 100 * n_upper > 60 * t.n_letters


def _adjacent(t: Text) -> bool:
    ids = t.word_ids
    return len(ids) >= 20 and 100 * int((ids[1:] == ids[:-1]).sum()) > 35 * len(ids)


#: The base rules of the contract.
BASE_RULES = (
    Rule("few_words", lambda t: len(t.words) < 10),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 20 * len(t.words)),
)
#: Rules added to them; their thresholds are well beyond what prose, lists or short tables have.
OWN_RULES = (
    Rule("symbols", lambda t: 100 * t.n_symbols > 8 * t.word_chars),
    Rule("exclamation", lambda t: 2 * t.data.count(b"!") > len(t.words)),
    Rule("capitals", _upper),
    Rule("repeated_words", _adjacent),
    Rule("repeated_lines", lambda t: len(t.lines) >= 4 and 2 * t.n_dup_lines > len(t.lines)),
    Rule("word_length", lambda t: t.word_chars > 25 * len(t.words)),
)
RULES = BASE_RULES + OWN_RULES


@dataclass(frozen=True)
class Estimate:
    rule: str
    cost: float
    #: whether it rejects each text of the sample
    rejects: tuple[bool, ...]

    @property
    def selectivity(self) -> float:
        return sum(self.rejects) / max(1, len(self.rejects))


def estimate(texts: Sequence[str | None], rules: Sequence[Rule] = RULES) -> list[Estimate]:
    """Cost and rejections of each rule alone, features included."""
    out = []
    for rule in rules:
        began = time.perf_counter()
        rejects = tuple(bool(rule.rejects(Text(text))) for text in texts)
        out.append(Estimate(rule.name, max(time.perf_counter() - began, 1e-9) / max(1, len(texts)), rejects))
    return out


def ordered(rules: Sequence[Rule], estimates: Sequence[Estimate]) -> list[Rule]:
    """Again and again the rule with the most rejections per second among the texts left; ties, and rules that reject none, by cost and name."""
    by = {e.rule: e for e in estimates}
    left, out = set(range(max((len(e.rejects) for e in estimates), default=0))), []
    todo = list(rules)
    while todo:
        found = {r.name: {k for k in left if by[r.name].rejects[k]} for r in todo}
        best = min(todo, key=lambda r: (-len(found[r.name]) / by[r.name].cost, by[r.name].cost, r.name))
        out.append(best)
        left -= found[best.name]
        todo.remove(best)
    return out


def plan_cascade(df: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> list[Rule]:
    """Order ``rules`` by a sample of at most ``sample_rows`` whole texts, those with the least hashes; one task times them, and the driver gets a row a rule."""
    text = F.col(text_col).cast("string")
    sample = df.select(text.alias("text"), F.xxhash64(text, F.lit(6)).alias("h")).orderBy("h").limit(sample_rows).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [x for batch in batches for x in batch.column(0).to_pylist()]
        found = estimate(texts, rules)
        yield pa.RecordBatch.from_arrays([pa.array([e.rule for e in found]), pa.array([e.cost for e in found]), pa.array([list(e.rejects) for e in found], pa.list_(pa.bool_()))], names=["rule", "cost", "rejects"])

    rows = map_arrow(sample.repartition(1), "rule string, cost double, rejects array<boolean>", run).collect()
    found = [Estimate(r["rule"], r["cost"], tuple(r["rejects"])) for r in rows]
    return ordered(rules, found or [Estimate(r.name, 1.0, ()) for r in rules])


def first_rejection(text: Text, rules: Sequence[Rule]) -> str | None:
    return next((r.name for r in rules if r.rejects(text)), None)


def cascade(df: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that no rule rejects, with the columns of ``df``; a null text is empty."""
    rules, at = list(rules), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [first_rejection(Text(x), rules) is None for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(df, df.schema, run)


MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The base measures of each text, whether a base rule fails it, and the cascade's verdict over all rules.

    One row per input row, repeated ids included. A null or empty text has no words and
    fails ``few_words``. Whole texts are measured, however long; other columns play no part.
    """
    docs = documents_of(df, id_col, text_col)
    rules = plan_cascade(docs, RULES, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                t = Text(text)
                kept = first_rejection(t, rules) is None
                rows.append((len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, first_rejection(t, BASE_RULES) is not None, kept))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[x.split()[0] for x in MEASURES.split(", ")])

    return map_arrow(docs, MEASURES, run)


def keep_quality(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``cascade`` with all rules, in the order that a sample of ``df`` gives."""
    return cascade(df, plan_cascade(df, RULES, sample_rows, text_col), text_col)
