"""License scans by a positional rare-token index.

Templates are word sequences. The index holds the postings (template, position) of all
their words. Document frequencies of these words, over all documents, give their IDF.
A template is looked for in a file that has all words of its mandatory key phrases. The
file's licence words are then looked up from the highest IDF on, until each template has
two that are of its key phrases. Each occurrence of such a word proposes places where the
template would begin; the places that both words propose are the intersection by relative
position. There the key phrases are verified word by word, and the IDF-weighted share of
the template's words found in order is its score. A long notice may have a few words more
or fewer than its template, ``SLACK`` before any of its words; a phrase may not.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import documents_of, map_arrow

#: Lower-cases A-Z; what is neither a digit, a letter a-z nor beyond ASCII separates words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


@dataclass(frozen=True)
class Template:
    """``key_phrases`` must stand at their places; at least ``share`` of the IDF weight must too."""

    label: str
    text: str
    key_phrases: tuple[str, ...] = ()
    share: float = 1.0
    base: bool = False
    words: tuple[bytes, ...] = field(init=False, default=())
    mandatory: frozenset[int] = field(init=False, default=frozenset())

    def __post_init__(self):
        words = tuple(words_of(self.text))
        must: set[int] = set()
        for phrase in self.key_phrases:
            p = tuple(words_of(phrase))
            places = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            if not places:
                raise ValueError(f"{self.label}: no place of {phrase!r}")
            must.update(range(places[0], places[0] + len(p)))
        object.__setattr__(self, "words", words)
        object.__setattr__(self, "mandatory", frozenset(must if self.key_phrases else range(len(words))))


#: The base phrases with their labels.
BASE_TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
)
#: Names of public licences.
NAME_TEMPLATES = (
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("cc-by", "creative commons attribution"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
)
#: Notices of public licences, their key phrases and the share of a notice that must be there.
NOTICE_TEMPLATES = (
    Template("mit", """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
        including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
        subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
        in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with
        the software or the use or other dealings in the software
        """, ("hereby granted free of charge to any person",), 0.08),
    Template("apache", """
        licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at
        http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license
        """, ("you may not use this file except in compliance with the license",), 0.3),
    Template("gpl", """
        this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license
        or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a
        particular purpose see the gnu general public license for more details
        """, ("gnu general public license as published by the free software foundation",), 0.3),
    Template("bsd", """
        redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above
        copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
        in the documentation and or other materials provided with the distribution
        """, ("source and binary forms with or without modification",), 0.25),
    Template("isc", """
        permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
        """, ("with or without fee is hereby granted",), 0.4),
    Template("zlib", """
        this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone
        to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
        """, ("including commercial applications and to alter it and redistribute it freely",), 0.3),
    Template("unlicense", """
        this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
        for any purpose commercial or non commercial and by any means
        """, ("free and unencumbered software released into the public domain",), 0.2),
)
OWN_TEMPLATES = NAME_TEMPLATES + NOTICE_TEMPLATES
#: Words that may be missing or added before any word of a notice.
SLACK = 3
TEMPLATES = BASE_TEMPLATES + OWN_TEMPLATES


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[dict[bytes, int], int]:
    """In how many documents each template word occurs, over all documents, and their number.

    Tasks send one row a word of the templates, so the driver gets as many rows as the
    templates have distinct words, however many documents there are.
    """
    vocabulary = frozenset(w for t in templates for w in t.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        n = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(vocabulary.intersection(words_of(text)))
                n += 1
        rows = [(b"", n), *counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.int64())], names=["word", "n"])

    rows = map_arrow(docs.select("text"), "word binary, n long", run).groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["word"]): r["n"] for r in rows}
    return found, found.pop(b"", 0)


class PositionalIndex:
    """Postings of template words, and their IDF."""

    def __init__(self, templates: tuple[Template, ...], frequencies: dict[bytes, int], n_docs: int):
        self.templates = templates
        self.idf = {w: math.log((n_docs + 1) / (frequencies.get(w, 0) + 1)) + 1 for t in templates for w in t.words}
        self.vocabulary = frozenset(self.idf)
        #: word -> (template, position)
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(templates):
            for p, w in enumerate(t.words):
                self.postings[w].append((k, p))
        self.key_words = [frozenset(t.words[p] for p in t.mandatory) for t in templates]

    def matches(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, first word's place, score) of all verified places, in order."""
        present = self.vocabulary.intersection(words)
        possible = [k for k, must in enumerate(self.key_words) if must <= present]
        if not possible:
            return []
        proposed: dict[int, list[set[int]]] = {k: [] for k in possible}
        open_ = set(possible)
        for word in sorted(present, key=lambda w: (-self.idf[w], w)):
            places: list[int] | None = None
            of: dict[int, list[int]] = {}
            for k, p in self.postings[word]:
                if k in open_ and p in self.templates[k].mandatory:
                    of.setdefault(k, []).append(p)
            for k, positions in of.items():
                if places is None:
                    places = [i for i, w in enumerate(words) if w == word]
                proposed[k].append({at - p for at in places for p in positions})
                if len(proposed[k]) == min(2, len(self.key_words[k])):
                    open_.discard(k)
            if not open_:
                break
        out = []
        for k, sides in proposed.items():
            t = self.templates[k]
            for start in sorted(set.intersection(*sides)):
                score = self._verify(t, words, start)
                if score is not None:
                    out.append((k, start, score))
        return out

    def _verify(self, t: Template, words: list[bytes], start: int) -> float | None:
        if any(not 0 <= start + p < len(words) or words[start + p] != t.words[p] for p in t.mandatory):
            return None
        if len(t.mandatory) == len(t.words):
            return 1.0
        found = self._in_order(t, words, start)
        score = sum(self.idf[t.words[p]] for p in found) / sum(self.idf[w] for w in t.words) if len(found) < len(t.words) else 1.0
        return score if score >= t.share else None

    @staticmethod
    def _in_order(t: Template, words: list[bytes], start: int) -> set[int]:
        """Positions of the template found from its key phrases on and back, each near where the one before was."""
        found = set(t.mandatory)
        for side in (range(max(t.mandatory) + 1, len(t.words)), range(min(t.mandatory) - 1, -1, -1)):
            shift = start
            for p in side:
                for d in sorted(range(-SLACK, SLACK + 1), key=abs):
                    if 0 <= shift + p + d < len(words) and words[shift + p + d] == t.words[p]:
                        found.add(p)
                        shift += d
                        break
        return found


COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,word:int,score:double>>"


def license_scan(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: words, places of base phrases, labels, the best score, all places.

    A null or empty text has no words, no places, empty labels and score 0. Whole texts are
    read, however long. Places past either end of a text count as words not found, so a cut
    notice may still be labelled if its key phrases are whole. Rows with the same id, or
    none, stay apart; other columns play no part.
    """
    docs = documents_of(df, id_col, text_col)
    index = PositionalIndex(templates, *document_frequencies(docs, templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = words_of(text)
                    found = index.matches(words)
                    base = [(templates[k].label, start) for k, start, _ in found if templates[k].base]
                    rows.append({
                        "doc_id": doc_id, "n_words": len(words), "n_base": len(base),
                        "first_word": min((s for _, s in base), default=None), "last_word": max((s for _, s in base), default=None),
                        "base_labels": ",".join(sorted({x for x, _ in base})), "labels": ",".join(sorted({templates[k].label for k, _, _ in found})),
                        "score": max((x for _, _, x in found), default=0.0),
                        "places": [{"label": templates[k].label, "word": start, "score": x} for k, start, x in found],
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=PLACES)

    return map_arrow(docs, COLUMNS, run)


PLACES = pa.schema([
    *((x, pa.int64()) for x in ("doc_id", "n_words", "n_base", "first_word", "last_word")),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("places", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int32()), ("score", pa.float64())]))),
])
