"""Language of texts, by words and spans.

A word is a run of letters of one script. Its script narrows the languages it can be in:
those that write a hundredth of their letters in it. Each of these scores the word by
trigrams of letters and by the word itself, and a Viterbi path over a text's words, which
pays a penalty to switch, labels its spans. A text's language is that of most letters.

What is learned are counts over all training texts: of hashed trigrams and words, of
letters by script and of texts, for each language. Tasks add them up before they are
shuffled. The model has languages times ``BUCKETS`` numbers, whatever the corpus's size.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.common import map_arrow

UNKNOWN = "und"
#: Ranges of code points by script. Letters outside them are of the script of number 0.
SCRIPTS = {
    "Latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "Armenian": ((0x530, 0x58F),),
    "Hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "Arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "Devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "Bengali": ((0x980, 0x9FF),),
    "Gurmukhi": ((0xA00, 0xA7F),),
    "Gujarati": ((0xA80, 0xAFF),),
    "Odia": ((0xB00, 0xB7F),),
    "Tamil": ((0xB80, 0xBFF),),
    "Telugu": ((0xC00, 0xC7F),),
    "Kannada": ((0xC80, 0xCFF),),
    "Malayalam": ((0xD00, 0xD7F),),
    "Sinhala": ((0xD80, 0xDFF),),
    "Thai": ((0xE00, 0xE7F),),
    "Lao": ((0xE80, 0xEFF),),
    "Tibetan": ((0xF00, 0xFFF),),
    "Myanmar": ((0x1000, 0x109F),),
    "Georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)),
    "Hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "Ethiopic": ((0x1200, 0x139F),),
    "Khmer": ((0x1780, 0x17FF),),
    "Mongolian": ((0x1800, 0x18AF),),
    "Kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "Han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
N_SCRIPTS = len(SCRIPTS) + 1
TRIGRAMS, WORDS = 1 << 16, 1 << 16
#: Trigrams, words, letters by script, texts: the counts of a language.
BUCKETS = TRIGRAMS + WORDS + N_SCRIPTS + 1
#: Share of a language's letters from which a script's words may be in it.
SCRIPT_SHARE = 0.01
#: Counts added to a bucket, in shares of the mean; a bucket that no language has says nothing.
SHRINK = 2.0
#: Nats that a path pays for a switch, and for a word in a language that its script excludes.
SWITCH, EXCLUDED = 12.0, 1000.0
#: Code points whose features are made at once.
PIECE = 1 << 19
#: Languages that a model may have; more are an error, as labels are then no languages.
MOST_LANGUAGES = 1_000


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its kind (0 no word, 1 letter, 2 mark) with its script above the two low bits, and its lower case, if that is one."""
    size = 0x110000
    kinds, lower = np.zeros(size, dtype=np.uint8), np.arange(size, dtype=np.int32)
    for code in range(size):
        char = chr(code)
        if char.isalpha():
            kinds[code] = 1
            small = char.lower()
            if len(small) == 1:
                lower[code] = ord(small)
        elif code > 0x2FF and unicodedata.category(char)[0] == "M":
            kinds[code] = 2
    scripts = np.zeros(size, dtype=np.uint8)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            scripts[first : last + 1] = number
    return kinds | (scripts << 2), lower


@dataclass(frozen=True)
class Words:
    """Words of a text piece: places of their first code points, numbers of code points, of letters, scripts, and the buckets of their trigrams and of themselves."""

    starts: np.ndarray
    sizes: np.ndarray
    letters: np.ndarray
    scripts: np.ndarray
    trigrams: np.ndarray
    buckets: np.ndarray


def words_of(codes: np.ndarray) -> Words:
    """The words of an array of code points."""
    kinds, lower = tables()
    kind = kinds[codes]
    script, kind = kind >> 2, kind & 3
    inside = kind > 0
    before = np.concatenate([[False], inside[:-1]])
    other = np.concatenate([[False], (script[1:] != script[:-1])])
    starts = np.flatnonzero(inside & (~before | (other & (kind == 1))))
    places = np.flatnonzero(inside)
    of_word = np.searchsorted(places, starts)
    sizes = np.diff(np.append(of_word, len(places)))
    if not len(starts):
        none = np.empty(0, dtype=np.int64)
        return Words(none, none, none, none, none, none)
    char = np.zeros(len(codes) + 2, dtype=np.uint64)
    char[1:-1][places] = lower[codes[places]]
    first = np.zeros(len(codes), dtype=bool)
    first[starts] = True
    last = np.zeros(len(codes), dtype=bool)
    last[places[of_word + sizes - 1]] = True
    left, right = np.where(first[places], 0, char[places]), np.where(last[places], 0, char[places + 2])
    trigrams = _mix(left * np.uint64(0x9E3779B97F4A7C15) + char[places + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + right * np.uint64(0x165667B19E3779F9), TRIGRAMS)
    # a word's hash is the sum of mixed trigrams by their places, so order counts
    at = (np.arange(len(places)) - np.repeat(of_word, sizes)).astype(np.uint64) + np.uint64(1)
    hashes = np.add.reduceat((char[places + 1] * np.uint64(0x9E3779B97F4A7C15) + at) * (at * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)), of_word)
    letters = np.add.reduceat((kind[places] == 1).astype(np.int64), of_word)
    return Words(starts, sizes, letters, script[starts], trigrams, _mix(hashes, WORDS))


def _mix(x: np.ndarray, buckets: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) & np.uint64(buckets - 1)).astype(np.int64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, text of each stretch, its place in that text): whole texts, parted by line breaks, about ``PIECE`` code points at a time.

    A longer text is cut where no word is, so words are the same wherever it is cut.
    """
    kinds, _ = tables()
    gathered: list[tuple[np.ndarray, int, int]] = []
    size = 0
    for number, text in enumerate(texts):
        codes = code_points(text)
        begin = 0
        while begin < len(codes) or (begin == 0 and not len(codes)):
            end = min(len(codes), begin + PIECE)
            if end < len(codes):
                gaps = np.flatnonzero(kinds[codes[begin:end]] & 3 == 0)
                if len(gaps):
                    end = begin + int(gaps[-1]) + 1
                else:  # one word as long as this: up to where it ends
                    more = np.flatnonzero(kinds[codes[end:]] & 3 == 0)
                    end = end + int(more[0]) + 1 if len(more) else len(codes)
            gathered.append((codes[begin:end], number, begin))
            size += end - begin
            begin = max(end, begin + 1)
            if size >= PIECE:
                yield _joined(gathered)
                gathered, size = [], 0
    if gathered:
        yield _joined(gathered)


def _joined(gathered: list[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches with a line break after each; of each code point its text and its place there."""
    gap = np.array([10], dtype=np.uint32)
    codes = np.concatenate([x for codes, _, _ in gathered for x in (codes, gap)])
    sizes = np.array([len(codes) + 1 for codes, _, _ in gathered])
    ends = np.cumsum(sizes)
    place = np.arange(len(codes)) - np.repeat(ends - sizes - np.array([b for _, _, b in gathered]), sizes)
    return codes, np.repeat(np.array([n for _, n, _ in gathered]), sizes), place


@dataclass(frozen=True)
class Model:
    """Languages in order, scores of the buckets of trigrams and words (bucket, language), which scripts each language is written in, and log priors."""

    languages: tuple[str, ...]
    scores: np.ndarray
    allowed: np.ndarray
    priors: np.ndarray

    @staticmethod
    def of(languages: tuple[str, ...], counts: np.ndarray) -> Model:
        """From counts (language, bucket): log of a bucket's frequency in a language by its mean frequency, shrunk to 0."""
        letters = counts[:, TRIGRAMS + WORDS : TRIGRAMS + WORDS + N_SCRIPTS]
        scores = np.empty((TRIGRAMS + WORDS, len(languages)), dtype=np.float32)
        for low, high in ((0, TRIGRAMS), (TRIGRAMS, TRIGRAMS + WORDS)):
            own = counts[:, low:high].astype(np.float64)
            totals = np.maximum(own.sum(axis=1, keepdims=True), 1)
            even = own / totals * totals.mean()
            mean = even.mean(axis=0)
            scores[low:high] = (np.log(even + SHRINK) - np.log(mean + SHRINK)).T
        allowed = (letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=1, keepdims=True), 1)) & (letters > 0)
        return Model(languages, scores, allowed.T.copy(), np.log((counts[:, -1] + 1) / (counts[:, -1] + 1).sum()))

    def of_words(self, words: Words) -> np.ndarray:
        """(word, language): the scores of words, with those of excluded languages far down; a word in a script of no language says nothing."""
        ends = np.cumsum(words.sizes)
        out = np.add.reduceat(self.scores[words.trigrams], ends - words.sizes, axis=0) + self.scores[TRIGRAMS + words.buckets]
        allowed = self.allowed[words.scripts]
        return np.where(allowed, out, out - EXCLUDED) * allowed.any(axis=1, keepdims=True)


def best_paths(scores: np.ndarray, sizes: np.ndarray, priors: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word: a Viterbi path for each text, whose words follow each other in ``scores``; all texts go on together, word by word.

    Staying wins over a switch that is as good, and the first language over others as good.
    """
    order = np.argsort(-sizes, kind="stable")
    begins = (np.cumsum(sizes) - sizes)[order]
    longest = int(sizes.max()) if len(sizes) else 0
    active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")  # texts with more than t words
    best = np.tile(priors, (len(sizes), 1))
    came, tops = np.zeros(scores.shape, dtype=bool), np.zeros(len(scores), dtype=np.int32)
    for t in range(longest):
        k = active[t]
        now, at = best[:k], begins[:k] + t
        if t:
            top = now.argmax(axis=1)
            jump = (now[np.arange(k), top] - switch)[:, None]
            came[at], tops[at] = jump > now, top
            now = np.maximum(now, jump)
        best[:k] = now + scores[at]
    state = best.argmax(axis=1)
    out = np.empty(len(scores), dtype=np.int32)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = begins[:k] + t
        out[at] = state[:k]
        state[:k] = np.where(came[at, state[:k]], tops[at], state[:k])
    return out


def id_part(column: Column, parts: int) -> Column:
    """crc32 of the id, as text, modulo ``parts``; null for a null id."""
    return (F.crc32(column.cast("string").cast("binary")) % parts).cast("int")


def learn(texts: DataFrame) -> Model:
    """A model of (text, lang); rows with a null in either say nothing.

    The driver sees the languages and the model, at most ``MOST_LANGUAGES`` x ``BUCKETS`` counts.
    """
    texts = texts.filter("text is not null and lang is not null")
    languages = tuple(sorted(r["lang"] for r in texts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return Model((), np.empty((TRIGRAMS + WORDS, 0), dtype=np.float32), np.empty((N_SCRIPTS, 0), dtype=bool), np.empty(0))
    number = {lang: k for k, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            own = [number[x] for x in batch.column(1).to_pylist()]
            of_language: dict[int, list[str]] = {}
            for k, text in zip(own, batch.column(0).to_pylist()):
                of_language.setdefault(k, []).append(text)
            for k, some in of_language.items():
                total = totals.setdefault(k, np.zeros(BUCKETS, dtype=np.int64))
                total[-1] += len(some)
                for codes, _, _ in pieces(some):
                    words = words_of(codes)
                    total[:TRIGRAMS] += np.bincount(words.trigrams, minlength=TRIGRAMS)
                    total[TRIGRAMS : TRIGRAMS + WORDS] += np.bincount(words.buckets, minlength=WORDS)
                    total[TRIGRAMS + WORDS : -1] += np.bincount(words.scripts, weights=words.letters, minlength=N_SCRIPTS).astype(np.int64)
        for k, total in totals.items():
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k * BUCKETS + found), pa.array(total[found])], names=["at", "n"])

    counts = np.zeros(len(languages) * BUCKETS, dtype=np.int64)
    summed = map_arrow(texts.select("text", "lang"), "at long, n long", run).groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts[summed.column("at").to_numpy()] = summed.column("n").to_numpy()
    return Model.of(languages, counts.reshape(len(languages), BUCKETS))


def _labelled(texts: list[str], model: Model, switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all words of some texts in order: text, place, size, letters, language, and whether anything is known of it."""
    parts = []
    for codes, of, place in pieces(texts):
        words = words_of(codes)
        if len(words.starts):
            parts.append((of[words.starts], place[words.starts], words.sizes, words.letters, model.of_words(words)))
    if not parts:
        return (np.empty(0, dtype=np.int64),) * 6
    of, place, sizes, letters, scores = (np.concatenate(x) for x in zip(*parts))
    known = (np.abs(scores) > 1e-6).any(axis=1)
    path = best_paths(scores, np.bincount(of, minlength=len(texts)), model.priors, switch)
    return of, place, sizes, letters, path, known


def detect(df: DataFrame, model: Model, switch: float = SWITCH, text_col: str = "text") -> DataFrame:
    """All columns of ``df``, then lang_pred, score and n_spans (columns of these names are replaced).

    ``lang_pred`` is the language of most letters on the best path (ties: the first in order),
    ``score`` their share of all letters; it is 0 if nothing is known of any word, where priors
    decide. A text that is null or has no letter, and any text if no language was learned, is
    ``und`` with score 0 and no span. Whole texts are read, however long.
    """
    kept = [x for x in df.columns if x not in ("lang_pred", "score", "n_spans")]
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_spans", T.LongType())]
    source = df.select(*(df[x] for x in kept), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text to label"))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        n_languages = len(model.languages)
        for batch in batches:
            n, texts = batch.num_rows, batch.column(batch.num_columns - 1).to_pylist()
            found = np.zeros((n, max(1, n_languages)))
            spans, sure = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            if n_languages:
                of, _, _, letters, path, known = _labelled(texts, model, switch)
                found = np.bincount(of * n_languages + path, weights=letters, minlength=n * n_languages).reshape(n, n_languages)
                sure = np.bincount(of, weights=known, minlength=n)
                new = np.ones(len(of), dtype=bool)
                new[1:] = (of[1:] != of[:-1]) | (path[1:] != path[:-1])
                spans = np.bincount(of[new], minlength=n).astype(np.int64)
            total, best = found.sum(axis=1), found.argmax(axis=1)
            labels = [model.languages[k] if some else UNKNOWN for k, some in zip(best.tolist(), (total > 0).tolist())]
            score = np.where((total > 0) & (sure > 0), found.max(axis=1) / np.maximum(total, 1), 0.0)
            columns = [*batch.columns[:-1], pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score", "n_spans"])

    return map_arrow(source, T.StructType([*(df.schema[x] for x in kept), *fields]), run)


def spans(df: DataFrame, model: Model, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, span (from 0), start, end (code points), n_words, lang: the stretches of a language of each text that has a letter, in order."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            of, place, sizes, _, path, _ = _labelled(batch.column(1).to_pylist(), model, switch) if model.languages else (np.empty(0, dtype=np.int64),) * 6
            new = np.ones(len(of), dtype=bool)
            new[1:] = (of[1:] != of[:-1]) | (path[1:] != path[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(of)) - 1 if len(first) else first
            of_span = of[first]
            rank = np.arange(len(first)) - np.searchsorted(of_span, of_span)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of_span)), pa.array(rank, pa.int32()), pa.array(place[first]), pa.array(place[last] + sizes[last]), pa.array(last - first + 1), pa.array([model.languages[k] for k in path[first].tolist()], pa.string())],
                names=["doc_id", "span", "start", "end", "n_words", "lang"],
            )

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_arrow(docs, "doc_id long, span int, start long, end long, n_words long, lang string", run)


def languages(df: DataFrame, held_part: int = 2, parts: int = 4, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans for each row, with a model learned from the rows that are not held out.

    Rows whose crc32 of the id, as text, leaves ``held_part`` modulo ``parts`` are held out; a
    null id is not. Repeated rows count as often as they occur and stay apart. Only text and
    lang of the rows learned from are used, and only text in a prediction. A language none of
    whose texts has a letter can't be told from a text, yet counts as learned.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    docs = docs.withColumn("held_out", F.coalesce(id_part(F.col("doc_id"), parts) == held_part, F.lit(False)))
    model = learn(docs.filter(~F.col("held_out")).select("text", "lang"))
    return detect(docs.select("doc_id", "held_out", "text"), model, switch).select("doc_id", "held_out", "lang_pred", "score", "n_spans")
