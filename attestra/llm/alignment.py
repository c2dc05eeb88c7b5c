"""Alignment of two tokenizers' tokens, text by text, and how often two ids meet in a corpus.

Both tokenizers spell the same bytes. A transducer reads their tokens in turn and holds the
dangling suffix: the side that leads and its bytes that the other has not spelled yet. The
other side reads next; a transition depends on the suffix and that token alone, so it is
remembered. Where nothing dangles, both ended at one offset, and the group of tokens since
the last such place is closed. A token that contradicts the suffix ends in a dead state:
the sides don't spell the same bytes, and the text has no alignment.

Neither tokenizer joins what a space or line break parts from a character before it, so
texts are read stretch by stretch; a batch's distinct stretches are found by Arrow, and a
worker keeps those that it has met, up to a fixed number of bytes. Texts with other white
space, or with a stretch that has no alignment, are read as a whole.

A text's distinct linked pairs are kept with it, in the shared folder. Their counts are
summed in each task before they are shuffled, and come back to the texts in blocks of a
fixed number of pairs, one after another, however many pairs there are.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import documents_of, map_arrow, materialize
from attestra.llm.encoding import UNCUT

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of stretches, with what is known of them, that a worker keeps before it starts anew; characters of stretches encoded in one call.
KEPT_BYTES, BLOCK_CHARS = 64 << 20, 1 << 14
#: Bytes of texts aligned at once, about.
SLICE_BYTES = 4 << 20
#: Transitions and suffixes remembered before a transducer forgets all.
KEPT_STATES = 1 << 20
#: Pairs with their counts that are sent to tasks at once, 17 bytes each.
BLOCK_PAIRS = 1 << 21
#: Distinct pairs that a task counts before it sends counts on.
COUNTED = 1 << 20
#: A text's pairs are in order, so their differences are short.
LISTS = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "compression": "zstd"}
DEAD = -1


class Transducer:
    """Reads tokens of sides A (0) and B (1), given as their bytes by id."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes], kept: int = KEPT_STATES):
        self.tokens, self.kept = (a_bytes, b_bytes), kept
        self.forget()

    def forget(self) -> None:
        """State 0: nothing dangles. Of the others: the side that leads, and its bytes beyond the other's."""
        self.suffixes: list[tuple[int, bytes]] = [(0, b"")]
        self.states: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.steps: tuple[dict[tuple[int, int], int], ...] = ({}, {})

    def step(self, state: int, side: int, token: int) -> int:
        """The state after ``side``, which doesn't lead, has read ``token``."""
        key = (state, token)
        after = self.steps[side].get(key)
        if after is None:
            after = self.steps[side][key] = self._state(side, self.suffixes[state][1], self.tokens[side][token])
        return after

    def _state(self, side: int, ahead: bytes, read: bytes) -> int:
        if ahead.startswith(read):
            suffix = (1 - side, ahead[len(read) :])
        elif read.startswith(ahead):
            suffix = (side, read[len(ahead) :])
        else:
            return DEAD
        if not suffix[1]:
            return 0
        if suffix not in self.states:
            self.states[suffix] = len(self.suffixes)
            self.suffixes.append(suffix)
        return self.states[suffix]

    def groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """(numbers of A tokens, of B tokens) read where each group closes; none if the sides don't spell the same bytes."""
        if len(self.suffixes) + len(self.steps[0]) + len(self.steps[1]) > self.kept:
            self.forget()
        leads, step_a, step_b = self.suffixes, self.steps[0], self.steps[1]
        i = j = state = 0
        n_a, n_b = len(a), len(b)
        ends_a, ends_b = [], []
        while i < n_a or j < n_b:
            if state == 0 or leads[state][0] == 1:  # A reads: nothing dangles, or B leads
                if i == n_a:
                    return None
                after = step_a.get((state, a[i]))
                state = self.step(state, 0, a[i]) if after is None else after
                i += 1
            else:
                if j == n_b:
                    return None
                after = step_b.get((state, b[j]))
                state = self.step(state, 1, b[j]) if after is None else after
                j += 1
            if state == 0:
                ends_a.append(i)
                ends_b.append(j)
            elif state == DEAD:
                return None
        return (ends_a, ends_b) if state == 0 else None


def _byte_alphabet() -> dict[str, int]:
    """Characters of a byte-level vocabulary to bytes: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Sides:
    """The two tokenizers: ids and their bytes. ``A`` reads a space and the text, ``B`` adds the space itself."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(_place(a_file))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=_place(b_file))
        alphabet, added = _byte_alphabet(), self.a.get_added_tokens_decoder()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = token.encode() if i in added else bytes(alphabet[c] for c in token)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.b_size = len(names)
        #: a space only begins a piece, and no piece holds a line break with others: then stretches can be read one by one
        self.parts = not any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p in names)
        self.transducer = Transducer(self.a_bytes, self.b_bytes)

    def whole(self, text: str) -> tuple[list[int], list[int], tuple[list[int], list[int]] | None]:
        """(ids of A, of B, where groups close) of a text; no groups if the ids don't spell a space and the text."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        return a, b, self.transducer.groups(a, b) if self.spells(a, " " + text) else None

    def spells(self, a: list[int], text: str) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == text.encode("utf-8", "surrogatepass")


def _place(file: str) -> str:
    if os.sep in file:
        return file
    import public_tokenizers

    return public_tokenizers.path(file)


class Aligned:
    """Aligned stretches by number: ids of A, of B, groups, links, the groups as text, and the linked pairs, one for each link.

    Number 0 has no alignment.
    """

    def __init__(self, b_size: int):
        self.b_size = b_size
        self.names = pa.array([""], pa.string())
        self.spelled = pa.array([""], pa.string())
        self.sizes = np.zeros((1, 4), dtype=np.int64)
        self.starts, self.pairs = np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int64)

    @property
    def held(self) -> int:
        return self.names.nbytes + self.spelled.nbytes + 40 * len(self.sizes) + 8 * len(self.pairs)

    def add(self, names: list[str], a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, cuts: np.ndarray) -> None:
        """Stretches whose ids follow each other in ``a`` and ``b``: groups end at ``ends_a`` and ``ends_b``, stretches at ``cuts`` of ``a``."""
        if not names:
            return
        of_a, of_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        last = np.searchsorted(ends_a, cuts) + 1  # groups up to each stretch's end
        links = of_a * of_b
        pairs = _ranges(np.zeros(len(links), dtype=np.int64), links)
        width = np.repeat(of_b, links)
        pairs = a[np.repeat(ends_a - of_a, links) + pairs // width] * self.b_size + b[np.repeat(ends_b - of_b, links) + pairs % width]
        n_links = np.diff(np.concatenate([[0], np.cumsum(links)])[last], prepend=0)
        sizes = np.stack([np.diff(cuts, prepend=0), np.diff(ends_b[last - 1], prepend=0), np.diff(last, prepend=0), n_links], axis=1)
        spell = lambda ids, ends: _joined(pa.array(ids).cast(pa.string()), ends, ",")
        groups = pc.binary_join_element_wise(spell(a, ends_a), spell(b, ends_b), "|")
        self.names = pa.concat_arrays([self.names, pa.array(names, pa.string())])
        self.spelled = pa.concat_arrays([self.spelled, _joined(groups, last, ";")])
        self.starts = np.concatenate([self.starts, len(self.pairs) + np.cumsum(n_links) - n_links])
        self.sizes, self.pairs = np.concatenate([self.sizes, sizes]), np.concatenate([self.pairs, pairs])

    def find(self, names: pa.StringArray) -> np.ndarray:
        """Numbers of the names, -1 of those not here; the name of number 0 is no stretch's."""
        return pc.index_in(names, value_set=self.names).fill_null(-1).to_numpy().astype(np.int64)


def _joined(parts: pa.StringArray, ends: np.ndarray, by: str) -> pa.StringArray:
    """Strings of parts up to each of the ends."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), parts), by)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... ``counts[0]`` of them, and so on."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class Gathered:
    """Aligned stretches, one after another, until they are added to a table at once."""

    def __init__(self):
        self.names, self.a, self.b, self.ends_a, self.ends_b, self.cuts = ([] for _ in range(6))

    def put(self, names: list[str], a: list[int], b: list[int], ends: tuple[list[int], list[int]], cuts: list[int]) -> None:
        n_a, n_b = len(self.a), len(self.b)
        self.names += names
        self.ends_a += [n_a + x for x in ends[0]]
        self.ends_b += [n_b + x for x in ends[1]]
        self.cuts += [n_a + x for x in cuts]
        self.a += a
        self.b += b

    def into(self, table: Aligned) -> None:
        table.add(self.names, *(np.array(x, dtype=np.int64) for x in (self.a, self.b, self.ends_a, self.ends_b, self.cuts)))


class Aligner:
    """Whole texts to their alignments, by way of their stretches."""

    def __init__(self, a_file: str, b_file: str, kept: int = KEPT_BYTES):
        self.sides, self.kept = Sides(a_file, b_file), kept
        self.known = Aligned(self.sides.b_size)

    def of_texts(self, texts: pa.StringArray) -> tuple[Aligned, np.ndarray, np.ndarray]:
        """(stretches, how many of them each text has, their numbers one after another); no text is null. A text without tokens has none."""
        n = len(texts)
        some = pc.binary_length(texts).to_numpy() > 0
        cut = some & ~pc.match_substring_regex(texts, UNCUT).to_numpy(zero_copy_only=False) & ~pc.match_substring(texts, SPACE).to_numpy(zero_copy_only=False) & self.sides.parts
        lists = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(cut)), "\n", " \n"), " ")
        words, sizes = lists.flatten().dictionary_encode(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        of_distinct = self._numbers(words.dictionary)
        numbers = of_distinct[words.indices.to_numpy().astype(np.int64)]
        # texts with a stretch that has no alignment are read as a whole, as are those that are not cut
        bad = np.add.reduceat(numbers == 0, np.cumsum(sizes) - sizes) > 0 if len(sizes) else np.zeros(0, dtype=bool)
        cut[np.flatnonzero(cut)[bad]] = False
        numbers, sizes = numbers[np.repeat(~bad, sizes)], sizes[~bad]
        alone = np.flatnonzero(some & ~cut)
        table, whole, found = Aligned(self.sides.b_size), Gathered(), []
        for text in texts.take(pa.array(alone)).to_pylist():
            a, b, ends = self.sides.whole(text)
            found.append(ends is not None)
            if ends is not None:
                whole.put([""], a, b, ends, [len(a)])
        whole.into(table)
        found = np.array(found, dtype=np.int64)
        items = np.zeros(n, dtype=np.int64)
        items[cut], items[alone] = sizes, 1
        of_cut = np.repeat(cut, items)
        order = np.empty(int(items.sum()), dtype=np.int64)
        order[of_cut] = numbers
        order[~of_cut] = np.where(found > 0, len(self.known.sizes) + np.cumsum(found), 0)
        return _both(self.known, table), items, order

    def _numbers(self, names: pa.StringArray) -> np.ndarray:
        numbers = self.known.find(names)
        if len(names) and numbers.min() < 0:
            missing = names.filter(pa.array(numbers < 0))
            if self.known.held > self.kept:
                self.known, missing = Aligned(self.sides.b_size), names
            self._learn(missing.to_pylist())
            numbers = self.known.find(names)
        return np.maximum(numbers, 0)  # what was not learned has no alignment

    def _learn(self, words: list[str]) -> None:
        found, block, size = Gathered(), [], 0
        for word in words:
            block.append(word)
            size += len(word) + 1
            if size >= BLOCK_CHARS:
                self._block(block, found)
                block, size = [], 0
        if block:
            self._block(block, found)
        found.into(self.known)

    def _block(self, block: list[str], found: Gathered) -> None:
        """Stretches encoded as one text and aligned at once, if tokens of both sides end where each of them does; else one by one."""
        said = [w if w[:1] == "\n" else " " + w for w in block]
        text, bounds = "".join(said), np.cumsum([len(w.encode()) for w in said])
        a, b = self._ids(text)
        cuts_a, cuts_b = _cuts(a, self.sides.a_bytes, bounds), _cuts(b, self.sides.b_bytes, bounds)
        if cuts_a is not None and cuts_b is not None and self.sides.spells(a, text) and (ends := self.sides.transducer.groups(a, b)) is not None:
            found.put(block, a, b, ends, cuts_a)
            return
        for word, text in zip(block, said):
            a, b = self._ids(text)
            ends = self.sides.transducer.groups(a, b)
            if ends is not None and self.sides.spells(a, text):
                found.put([word], a, b, ends, [len(a)])

    def _ids(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a text that begins with a space or line break, within a text."""
        a = self.sides.a.encode(text, add_special_tokens=False).ids
        return a, self.sides.b.encode(text[1:]) if text[:1] == " " else self.sides.b.encode(text)[1:]


def _cuts(ids: list[int], spelled: list[bytes], bounds: np.ndarray) -> list[int] | None:
    """Numbers of ids up to each of the bounds (bytes), if an id ends at each of them and the last one at the last."""
    ends = np.cumsum([len(spelled[i]) for i in ids])
    at = np.searchsorted(ends, bounds)
    return (at + 1).tolist() if len(ends) and ends[-1] == bounds[-1] and (ends[at] == bounds).all() else None


def _both(known: Aligned, alone: Aligned) -> Aligned:
    """Stretches of ``known``, then those of ``alone``."""
    if len(alone.sizes) == 1:
        return known
    both = Aligned(known.b_size)
    both.spelled, both.names = pa.concat_arrays([known.spelled, alone.spelled]), known.names
    both.sizes, both.pairs = np.concatenate([known.sizes, alone.sizes]), np.concatenate([known.pairs, alone.pairs])
    both.starts = np.concatenate([known.starts, len(known.pairs) + alone.starts])
    return both


@lru_cache(maxsize=2)
def aligner(a_file: str, b_file: str) -> Aligner:
    """The worker's aligner."""
    return Aligner(a_file, b_file)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a column's texts have about ``most`` bytes."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of stretches of ``values``, ``counts`` of them each, of which some may be empty."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=np.int64), np.cumsum(values, axis=0, dtype=np.int64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"


def aligned_rows(docs: DataFrame, a_file: str = BYTE_LEVEL, b_file: str = PIECES) -> DataFrame:
    """(doc_id, text) to numbers of tokens, groups and links, the groups' digest, and the distinct linked pairs (a * size of B + b) in order with their numbers of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = aligner(a_file, b_file)
        for batch in slices(batches, 1):
            table, items, order = reader.of_texts(batch.column(1))
            sizes = _sums(table.sizes[order], items)
            bounds = pa.array(np.concatenate([[0], np.cumsum(items)]), pa.int32())
            spelled = pc.binary_join(pa.ListArray.from_arrays(bounds, table.spelled.take(pa.array(order))), ";")
            digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in spelled.to_pylist()]
            pairs, links, ends = _distinct(table, items, order)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (pairs, links)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(sizes[:, k]) for k in range(4)), pa.array(digests, pa.string()), *lists], names=[x.split()[0] for x in ALIGNED.split(", ")])

    return map_arrow(docs, ALIGNED, run)


def _distinct(table: Aligned, items: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pairs of each text in order, their links, where each text's begin and at last end)."""
    text = np.repeat(np.arange(len(items)), items)
    # equal stretches of a text are one, with its number of times
    both, times = np.unique(text * len(table.sizes) + order, return_counts=True)
    text, stretch = np.divmod(both, len(table.sizes))
    counts = table.sizes[stretch, 3]
    text, links, pairs = np.repeat(text, counts), np.repeat(times, counts), table.pairs[_ranges(table.starts[stretch], counts)]
    by = np.lexsort((pairs, text))
    text, links, pairs = text[by], links[by], pairs[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (pairs[1:] != pairs[:-1])
    first = np.flatnonzero(new)
    summed = np.add.reduceat(links, first) if len(first) else links
    return pairs[first], summed, np.searchsorted(text[first], np.arange(len(items) + 1))


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """(pair, a, b, n, best): texts that hold each pair, and whether no pair of its A id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, waiting, size = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), [], 0
        for batch in batches:
            waiting.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
            size += len(waiting[-1])
            if size > COUNTED:
                pairs, counts = _counted(pairs, counts, waiting)
                waiting, size = [], 0
                if len(pairs) > COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])
                    pairs, counts = pairs[:0], counts[:0]
        pairs, counts = _counted(pairs, counts, waiting)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

    counted = materialize(map_arrow(rows.select("pairs"), "pair long, n long", run).groupBy("pair").agg(F.sum("n").alias("n")).select("pair", F.floor(F.col("pair") / b_size).cast("int").alias("a"), (F.col("pair") % b_size).cast("int").alias("b"), "n"))
    most = counted.groupBy("a").agg(F.max("n").alias("most"))
    return counted.join(most, "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _counted(pairs: np.ndarray, counts: np.ndarray, waiting: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    new = np.concatenate([pairs, *waiting]).astype(np.int64)
    of_pair, place = np.unique(new, return_inverse=True)
    return of_pair, np.bincount(place, weights=np.concatenate([counts, np.ones(len(new) - len(counts))]), minlength=len(of_pair)).astype(np.int64)


def _looked_up(rows: DataFrame, block: pa.Table) -> DataFrame:
    """(row, n_best, count_sum) of the pairs of one block of counts."""
    order = np.argsort(block.column("pair").to_numpy(), kind="stable")
    columns = [np.ascontiguousarray(block.column(x).to_numpy(zero_copy_only=False)[order]) for x in ("pair", "n", "best")]
    sent = rows.sparkSession.sparkContext.broadcast(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            pairs, links = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            counts = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            here = known[at] == pairs if len(known) else np.zeros(len(pairs), dtype=bool)
            got = np.stack([links * (best[at] & here), links * n[at] * here], axis=1) if len(known) else np.zeros((len(pairs), 2), dtype=np.int64)
            sums = _sums(got, counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["row", "n_best", "count_sum"])

    return map_arrow(rows.select("row", "pairs", "links"), "row long, n_best long, count_sum long", run)


def alignments(df: DataFrame, a_file: str = BYTE_LEVEL, b_file: str = PIECES, block_pairs: int = BLOCK_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row.

    A text that is null or empty, or whose tokens don't spell a space and the text on both
    sides, has zeros and an empty digest. Rows are documents: repeated ones count as often as
    they occur and stay apart, whatever their id. Texts are read whole, however long. Strings
    of special tokens are ordinary text. Other columns play no part.
    """
    docs = documents_of(df, id_col, text_col)
    rows = materialize(aligned_rows(docs, a_file, b_file).withColumn("row", F.monotonically_increasing_id()), **LISTS)
    pairs = materialize(pair_counts(rows, Sides(a_file, b_file).b_size))
    n_blocks = max(1, -(-pairs.count() // block_pairs))
    part = F.pmod(F.xxhash64("pair"), F.lit(n_blocks))
    parts = [materialize(_looked_up(rows, pairs.filter(part == k).select("pair", "n", "best").toArrow())) for k in range(n_blocks)]
    found = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("pairs", "links").join(found, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def groups(df: DataFrame, a_file: str = BYTE_LEVEL, b_file: str = PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and groups: array of (start, end, a_ids, b_ids) in order, offsets in bytes of a space and the text; empty for a text without alignment."""
    kind = "doc_id long, groups array<struct<start:long,end:long,a_ids:array<int>,b_ids:array<int>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = aligner(a_file, b_file).sides
        for batch in slices(batches, 1):
            out = []
            for text in batch.column(1).to_pylist():
                found, i, j, at = [], 0, 0, 0
                a, b, ends = sides.whole(text) if text else ([], [], None)
                for to_i, to_j in zip(*(ends or ((), ()))):
                    to = at + sum(len(sides.a_bytes[x]) for x in a[i:to_i])
                    found.append({"start": at, "end": to, "a_ids": a[i:to_i], "b_ids": b[j:to_j]})
                    i, j, at = to_i, to_j, to
                out.append(found)
            entry = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(entry))], names=["doc_id", "groups"])

    return map_arrow(documents_of(df, id_col, text_col), kind, run)
