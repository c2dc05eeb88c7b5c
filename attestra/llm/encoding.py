"""Encoding with public tokenizer files, shared by token counts and token files.

A space or line break that follows a character other than white space always starts a
new match of the byte-level pre-tokenizer, so a text without runs of white space is its
stretches between such points, encoded one by one. Stretches repeat; a batch's distinct
ones are found by Arrow, and each Python worker keeps the ids of those it has met, up to
a fixed number of bytes. Any other text is encoded as a whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of stretches, with their ids, that a worker keeps before it sets them aside; it holds twice as many at most.
KEPT_BYTES = 24 << 20
#: Stretches encoded in one call.
BLOCK = 2_000
#: What a text that is cut into stretches has not: white space at an end, two in a row, or any but spaces and line breaks.
UNCUT = r"^[ \n]|[ \n]\z|[ \n][ \n]|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@lru_cache(maxsize=4)
def load_tokenizer(file: str):
    """A ``tokenizers`` tokenizer, from a path or the name of a public file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if os.sep not in file:
        import public_tokenizers

        file = public_tokenizers.path(file)
    return Tokenizer.from_file(file)


class Stretches:
    """Stretches by number, and the ids of each in one buffer. Names are Arrow strings, which take few bytes."""

    def __init__(self):
        self.names = pa.array([], pa.string())
        self.starts, self.counts, self.ids = (np.empty(0, dtype=t) for t in (np.int64, np.int64, np.uint32))

    @property
    def held(self) -> int:
        return self.names.nbytes + self.ids.nbytes + self.starts.nbytes + self.counts.nbytes

    def add(self, names: pa.StringArray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.names = pa.concat_arrays([self.names, names])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts, self.ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids])

    def find(self, names: pa.StringArray) -> np.ndarray:
        """Numbers of the names, -1 of those not here."""
        if not len(self.names):
            return np.full(len(names), -1, dtype=np.int64)
        return pc.index_in(names, value_set=self.names).fill_null(-1).to_numpy().astype(np.int64)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids one after another) of the stretches."""
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        return counts, self.ids[np.repeat(self.starts[numbers] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


class StretchEncoder:
    """Whole texts to their ids, by way of their stretches."""

    def __init__(self, file: str, kept: int = KEPT_BYTES):
        self.tokenizer, self.kept = load_tokenizer(file), kept
        #: A stretch's leading space is left out; what starts with a line break is named in full.
        self.known, self.older = Stretches(), Stretches()
        self.n_bytes = token_bytes(self.tokenizer) if _splits_at_spaces(self.tokenizer) else None

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids one after another); no text is null."""
        n = len(texts)
        cut = np.zeros(n, dtype=bool)
        if self.n_bytes is not None:
            cut = (pc.binary_length(texts).to_numpy() > 0) & ~pc.match_substring_regex(texts, UNCUT).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(cut)), "\n", " \n"), " ")
        words, sizes = lists.flatten().dictionary_encode(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        distinct, of_word = words.dictionary, words.indices.to_numpy().astype(np.int64)
        at = np.cumsum(sizes) - sizes
        # what a text begins with has no space before it, and is encoded by itself, as are texts that are not cut
        alone = texts.filter(pa.array(~cut)).to_pylist() + distinct.take(pa.array(of_word[at])).to_pylist()
        alone_counts, alone_ids = self._whole(alone)
        own = np.ones(len(of_word), dtype=bool)
        own[at] = False
        used = np.zeros(len(distinct), dtype=bool)
        used[of_word[own]] = True
        counts, ids = self._of_stretches(distinct.filter(pa.array(used)))
        table = Stretches()
        table.add(pa.array([], pa.string()), np.concatenate([counts, alone_counts]), np.concatenate([ids, alone_ids]))
        number = (np.cumsum(used) - 1)[of_word]
        n_alone = n - len(sizes)
        number[at] = len(counts) + n_alone + np.arange(len(sizes))
        # all texts in order: those that are not cut are one stretch
        items = np.ones(n, dtype=np.int64)
        items[cut] = sizes
        begin = np.cumsum(items) - items
        order = np.empty(int(items.sum()), dtype=np.int64)
        of_cut = np.repeat(cut, items)
        order[of_cut], order[~of_cut] = number, len(counts) + np.arange(n_alone)
        counts, ids = table.of(order)
        return np.add.reduceat(counts, begin) if n else counts, ids

    def _of_stretches(self, names: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        numbers = self.known.find(names)
        if len(names) and numbers.min() < 0:
            missing = names.filter(pa.array(numbers < 0))
            if self.known.held + 4 * missing.nbytes > self.kept and len(self.known.names):
                self.known, self.older, missing = Stretches(), self.known, names
            older = self.older.find(missing)
            if (older >= 0).any():
                self.known.add(missing.filter(pa.array(older >= 0)), *self.older.of(older[older >= 0]))
            self._learn(missing.filter(pa.array(older < 0)))
            numbers = self.known.find(names)
        return self.known.of(numbers)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._encode(texts)
        return np.array([len(x) for x in ids], dtype=np.int64), np.concatenate(ids) if ids else np.empty(0, dtype=np.uint32)

    def _learn(self, words: pa.StringArray) -> None:
        """Many stretches are encoded as one text, and the ids cut where their bytes end."""
        stretches = [w if w[:1] == "\n" else " " + w for w in words.to_pylist()]
        blocks = [stretches[at : at + BLOCK] for at in range(0, len(stretches), BLOCK)]
        counts, found = [], []
        for block, ids in zip(blocks, self._encode(["".join(b) for b in blocks])):
            ends, bounds = np.cumsum(self.n_bytes[ids]), np.cumsum([len(x.encode()) for x in block])
            cuts = np.searchsorted(ends, bounds)
            if ends[-1] == bounds[-1] and (ends[cuts] == bounds).all():
                n = np.diff(cuts + 1, prepend=0)
            else:  # a special token over several stretches, for one
                n, ids = self._whole(block)
            counts.append(n)
            found.append(ids)
        if blocks:
            self.known.add(words, np.concatenate(counts), np.concatenate(found))


def token_bytes(tokenizer) -> np.ndarray:
    """Bytes of text that each id of a byte-level vocabulary stands for."""
    added = tokenizer.get_added_tokens_decoder()
    out = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), dtype=np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = len(token.encode()) if i in added else len(token)
    return out


def _splits_at_spaces(tokenizer) -> bool:
    """Whether stretches can be encoded one by one: byte-level BPE with its own pattern, no normalizer, no added token with white space."""
    import json

    spec = json.loads(tokenizer.to_str())
    pre = spec["pre_tokenizer"] or {}
    bare = spec["normalizer"] is None and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    return bare and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")


@lru_cache(maxsize=4)
def encoder(file: str) -> StretchEncoder:
    """The worker's encoder."""
    return StretchEncoder(file)
