"""SentencePiece encoding and decoding over a relational lattice.

No piece goes on after a word's end into the next white space, nor from a letter to a sign
if no piece has both, so a text is a row of words (white space first; of characters that
pieces can join) that are encoded one by one. Each distinct word is encoded once:
its substrings, up to the longest piece, are exploded and joined to the piece table; the
edges found are grouped by word; and a fold over them gives the word's pieces. For a unigram
model the fold is Viterbi, with higher-order functions: the path of the best sum of
scores. For a BPE model that path is not what the library gives, so there the fold merges,
the words of an Arrow batch at once: each step takes the best-scored edge that spans exactly
two of the current symbols, the leftmost of equals. What no piece covers falls back to bytes, or to the unknown piece.

The words' ids come back to the texts in two ways: those of the most frequent words are
sent to every task, up to a fixed number; those of other words are joined to the texts
that have them. What comes back is packed: ids as bytes, without the word if the ids tell
it, and texts compressed. A fold's state is the bits of a long, so words beyond ``FOLD_CHARS``
characters (a text without spaces is one) are merged with a heap instead, in time
proportional to their length.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import SharedDict, discard, documents_of, map_arrow, materialize
from attestra.llm.lm import frequent

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Words whose ids are sent to every task, the most frequent ones; at some 150 bytes each.
KNOWN_WORDS = 200_000
#: Words that a task counts before it sends their counts on.
COUNTED = 100_000
#: Rows of counts that go to the JVM at once.
SENT_ROWS = 10_000
#: How texts are compressed on their way to their words.
TEXT_CODEC = "zstd"
#: Characters of a word up to which it is folded; its boundaries are bits of a long.
FOLD_CHARS = 60
#: Bits of an edge's id (and of its score's rank), and of its start (and length).
ID_BITS, PLACE_BITS = 20, 6
#: Bits of an edge; those above tell the word of a batch.
EDGE_BITS = 2 * ID_BITS + 2 * PLACE_BITS
BPE, UNIGRAM = 2, 1


@dataclass(frozen=True)
class Pieces:
    """The piece table of a model, as the driver reads it; vocabularies are of fixed size."""

    kind: int
    rows: tuple[tuple[str, int, float], ...]
    first_byte: int | None
    unknown: int
    alone: str
    longest: int


@lru_cache(maxsize=4)
def load_pieces(file: str) -> Pieces:
    """From a path or the name of a public file. Models that normalize, or have user-defined pieces, are refused."""
    import os

    from sentencepiece import sentencepiece_model_pb2 as pb

    if os.sep not in file:
        import public_tokenizers

        file = public_tokenizers.path(file)
    model = pb.ModelProto()
    with open(file, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
        raise ValueError("only models without normalization are read")
    if any(p.type == 4 for p in model.pieces):
        raise ValueError("models with user-defined pieces are not read")
    rows = tuple((p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type in (1, 5))
    if any(SPACE in p.lstrip(SPACE) for p, _, _ in rows):
        raise ValueError("a piece goes on beyond a word")
    bytes_at = [i for i, p in enumerate(model.pieces) if p.type == 6]
    unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
    alone = "".join(c for c in "\n\r\t" if not any(c in p and len(p) > 1 for p, _, _ in rows))
    return Pieces(model.trainer_spec.model_type, rows, bytes_at[0] if len(bytes_at) == 256 else None, unknown, alone, max(len(p) for p, _, _ in rows))


def joined_characters(pieces: Pieces) -> list[str]:
    """Characters by group: no piece has characters of two groups, or another character than white space besides one that is in none."""
    groups: list[set[str]] = []
    for chars in {frozenset(p.lstrip(SPACE)) for p, _, _ in pieces.rows if len(p.lstrip(SPACE)) > 1}:
        met = [g for g in groups if g & chars]
        groups = [g for g in groups if not g & chars] + [set(chars).union(*met)]
    return sorted("".join(sorted(g)) for g in groups)


def word_pattern(pieces: Pieces) -> str:
    """White space and the run of characters after it that pieces can join, or the one character that none joins; or a control character that no longer piece has."""
    runs = [f"{SPACE}*[{re.escape(g)}]+" for g in joined_characters(pieces)]
    alone = [f"[{re.escape(pieces.alone)}]"] if pieces.alone else []
    return "|".join([*sorted(runs, key=len, reverse=True), *alone, f"{SPACE}*[^{SPACE}{re.escape(pieces.alone)}]", f"{SPACE}+"])


def distinct_words(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, n)."""
    pattern = word_pattern(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, find = Counter(), re.compile(pattern).findall
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(find(escaped(text)))
                if len(counts) > COUNTED:
                    yield from _counts(counts)
                    counts = Counter()
        yield from _counts(counts)

    return map_arrow(docs.select("text"), "word string, n long", run).groupBy("word").agg(F.sum("n").alias("n"))


def _counts(counts: Counter) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
    for at in range(0, whole.num_rows, SENT_ROWS):
        yield whole.slice(at, SENT_ROWS)


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, size, edges) with an edge for each substring that is a piece; words of ``FOLD_CHARS`` at most.

    An edge is (start, end, score, id), or for a BPE model one long, whose order is that of
    merges: the rank of the score, the best first; the start; the length; the id.
    """
    spark = words.sparkSession
    if pieces.kind == BPE:
        if len(pieces.rows) > 1 << ID_BITS or max(i for _, i, _ in pieces.rows) >= 1 << ID_BITS:
            raise ValueError(f"models of more than {1 << ID_BITS} pieces are not read")
        rank = {score: k for k, score in enumerate(sorted({score for _, _, score in pieces.rows}, reverse=True))}
        rows, schema = [(p, (rank[score] << ID_BITS + 2 * PLACE_BITS) + i) for p, i, score in pieces.rows], "piece string, code long"
        place = lambda x, bits: F.shiftleft(x.cast("long"), bits)
        edge = F.col("code") + place(F.col("start"), ID_BITS + PLACE_BITS) + place(F.col("end") - F.col("start"), ID_BITS)
        found = F.col("code").isNotNull()
    else:
        rows, schema, edge, found = list(pieces.rows), "piece string, id int, score double", F.struct("start", "end", "score", "id"), F.col("id").isNotNull()
    table = F.broadcast(spark.createDataFrame(rows, schema))
    size = F.length("word")
    # a word is little to read and much to fold, so partitions are not joined by their size
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = words.select("word").repartition(n_parts, "word").select("word", size.alias("size"), F.monotonically_increasing_id().alias("row"))
    starts = dealt.select("word", "size", "row", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
    ends = starts.select("word", "size", "row", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("size"), F.col("start") + pieces.longest))).alias("end"))
    joined = ends.withColumn("piece", F.expr("substring(word, start + 1, end - start)")).join(table, "piece", "left")
    # a word's first character stays, so that a word without an edge does
    kept = joined.filter(found | ((F.col("start") == 0) & (F.col("end") == 1)))
    # dealt by word before, so a word's edges are where the word was; in the order of ``row``, so they need little sorting
    return kept.groupBy("row", "word").agg(F.collect_list(F.when(found, edge)).alias("edges")).select("word", F.length("word").alias("size"), "edges")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often a lambda in ``body`` reads it; a column would be made again there each time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def merge_edges(edges: np.ndarray, of: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BPE merges of all words of a batch at once, by their edges (longs, each with its word's place ``of``).

    Each step takes of each word the first edge, in the order of merges, both of whose ends
    are boundaries, with one more between them. Boundaries are bits of a long, and only go,
    so an edge that lost an end, or has none between its ends, is not looked at again.
    Returns the boundaries left, and the ids of the edges from one to the next with their words, in order.
    """
    edges = np.sort((of.astype(np.int64) << EDGE_BITS) | edges)
    of, number = edges >> EDGE_BITS, edges & ((1 << ID_BITS) - 1)
    start, size = (edges >> ID_BITS + PLACE_BITS) & ((1 << PLACE_BITS) - 1), (edges >> ID_BITS) & ((1 << PLACE_BITS) - 1)
    bit = np.int64(1)
    ends, between = (bit << start) | (bit << start + size), (bit << start + size) - (bit << start + 1)
    mask = (bit << sizes.astype(np.int64) + 1) - 1
    left = np.flatnonzero(size > 1)
    while len(left):
        now = mask[of[left]]
        keep = ((now & ends[left]) == ends[left]) & ((now & between[left]) != 0)
        left, inner = left[keep], (now & between[left])[keep]
        can = left[(inner & (inner - 1)) == 0]
        first = can[np.diff(of[can], prepend=-1) != 0]
        mask[of[first]] &= ~between[first]
        if not len(first):
            break
    now = mask[of]
    chosen = np.flatnonzero(((now & ends) == ends) & ((now & between) == 0))
    chosen = chosen[np.lexsort((start[chosen], of[chosen]))]
    return mask, number[chosen], of[chosen]


def viterbi_fold(edges: Column, size: Column, unknown_score: float) -> Column:
    """Boundaries of the path with the best sum of scores; a character without a piece costs ``unknown_score``."""
    start = F.array(F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("back")))

    def step(best: Column, end: Column) -> Column:
        known = F.transform(F.filter(edges, lambda e: e["end"] == end), lambda e: F.struct((F.get(best, e["start"])["total"] + e["score"]).alias("total"), e["start"].alias("back")))
        skip = F.array(F.struct((F.get(best, end - 1)["total"] + F.lit(unknown_score)).alias("total"), (end - 1).alias("back")))
        single = F.exists(edges, lambda e: (e["end"] == end) & (e["start"] == end - 1))
        return F.concat(best, F.array(F.array_max(F.concat(known, F.when(single, F.slice(skip, 1, 0)).otherwise(skip)))))

    def traced(nodes: Column) -> Column:
        # from the end back: each boundary names the one before it
        trace = lambda bounds, _: F.when(F.element_at(bounds, 1) == 0, bounds).otherwise(F.concat(F.array(F.get(nodes, F.element_at(bounds, 1))["back"]), bounds))
        return F.aggregate(F.sequence(F.lit(1), size), F.array(size), trace)

    return let(F.aggregate(F.sequence(F.lit(1), size), start, step), traced)


def encode_words(words: DataFrame, pieces: Pieces, as_bytes: bool = False) -> DataFrame:
    """(word, ids) of distinct words; ``as_bytes``: the ids packed, in the pass that makes them."""
    if pieces.kind not in (BPE, UNIGRAM):
        raise ValueError("only unigram and BPE models are read")
    whole = words.select("word")
    held = lattice(whole.filter(F.length("word") <= FOLD_CHARS), pieces)
    long = whole.filter(F.length("word") > FOLD_CHARS).repartition("word")
    if pieces.kind == BPE:
        return merged_words(held.unionByName(long, allowMissingColumns=True), pieces, as_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = LongWords(pieces)
        for batch in batches:
            ids = [merger.ids(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    encoded = best_paths(held, pieces).unionByName(map_arrow(long, "word string, ids array<int>", run))
    return packed(encoded, pieces) if as_bytes else encoded


def merged_words(held: DataFrame, pieces: Pieces, as_bytes: bool = False) -> DataFrame:
    """(word, ids) of words with their edges; of words without any, which are too long for bits of a long, by a heap."""
    kind = np.dtype(id_type(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = LongWords(pieces)
        for batch in batches:
            words, edges = batch.column(0), batch.column(2)
            sizes = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            counts = edges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            mask, ids, of = merge_edges(edges.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(words)), counts), sizes)
            got = np.bincount(of, minlength=len(words))
            bounds = np.concatenate([[0], np.cumsum(got)])
            parts = [ids[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            # where some symbol has no edge, symbol by symbol
            for k in np.flatnonzero((got != np.bitwise_count(mask) - 1) | (sizes == 0)).tolist():
                word = words[k].as_py()
                parts[k] = np.array(merger.ids(word) if not sizes[k] else merger.ids_between(word, int(mask[k])), dtype=np.int64)
            ends, values = np.concatenate([[0], np.cumsum([len(x) for x in parts])]), np.concatenate([ids[:0], *parts])
            listed = _packed(ends, values, kind) if as_bytes else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([words, listed], names=["word", "ids"])

    return map_arrow(held.select("word", "size", "edges"), f"word string, ids {'binary' if as_bytes else 'array<int>'}", run)


def best_paths(held: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of the best path through a unigram model's edges."""
    size = F.col("size")
    bounds = viterbi_fold(F.col("edges"), size, min(s for _, _, s in pieces.rows) - 10.0)
    symbols = let(bounds, lambda b: F.transform(F.sequence(F.lit(1), F.size(b) - 1), lambda k: F.struct(F.get(b, k - 1).alias("a"), F.get(b, k).alias("b"))))

    def ids_of(s: Column) -> Column:
        found = F.filter("edges", lambda e: (e["start"] == s["a"]) & (e["end"] == s["b"]))
        if pieces.first_byte is None:
            other = F.array(F.lit(pieces.unknown))
        else:
            code = F.hex(F.encode(F.substring(F.col("word"), s["a"] + 1, s["b"] - s["a"]), "UTF-8"))
            pair = lambda k: F.conv(F.substring(code, 2 * k - 1, F.lit(2)), 16, 10).cast("int") + pieces.first_byte
            other = F.transform(F.sequence(F.lit(1), (F.length(code) / 2).cast("int")), pair)
        return F.when(F.size(found) > 0, F.transform(found, lambda e: e["id"])).otherwise(other)

    return held.select("word", F.flatten(F.transform(symbols, ids_of)).alias("ids"))


def id_type(pieces: Pieces) -> str:
    """What packed ids are, as numpy has it."""
    return "<u2" if len(piece_texts(pieces)) <= 1 << 16 else "<i4"


def packed(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) with the ids as bytes."""
    kind = np.dtype(id_type(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(ends, ids.flatten().to_numpy(), kind)], names=["word", "ids"])

    return map_arrow(encoded.select("word", "ids"), "word string, ids binary", run)


def _packed(ends: np.ndarray, ids: np.ndarray, kind: np.dtype) -> pa.Array:
    """Lists of ids, which end at ``ends``, as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * kind.itemsize).astype(np.int32)), pa.py_buffer(ids.astype(kind).tobytes())])


def _as_bytes(ids: bytes, kind: str) -> bytes:
    """Packed ids as those of 4 bytes that a text's are made of."""
    return np.frombuffer(ids, dtype=kind).astype("<i4").tobytes()


def piece_texts(pieces: Pieces, space: str = " ") -> list[bytes]:
    """What each id stands for when decoded; ``SPACE`` becomes ``space``."""
    n = max([i for _, i, _ in pieces.rows] + [pieces.unknown, (pieces.first_byte or 0) + 255]) + 1
    out = [b""] * n
    for p, i, _ in pieces.rows:
        out[i] = p.replace(SPACE, space).encode()
    if pieces.first_byte is not None:
        for b in range(256):
            out[pieces.first_byte + b] = bytes([b])
    out[pieces.unknown] = " ⁇ ".encode()
    return out


def spelled_ids(ids: np.ndarray, ends: np.ndarray, spelled: pa.Array) -> list[bytes]:
    """What the ids from each of ``ends`` to the next decode to, with the space that encoding puts first; ``spelled`` has what each id stands for."""
    if not len(ids):
        return [b""] * (len(ends) - 1)
    _, places, data = spelled.take(pa.array(ids)).buffers()
    cuts = np.frombuffer(places, dtype=np.int32)[ends].tolist()
    whole = data.to_pybytes() if data is not None else b""
    return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


def decode_ids(ids: list[int], texts: list[bytes]) -> str:
    """The text of the ids, without the space that encoding puts first."""
    data = b"".join([texts[i] for i in ids])
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


class LongWords:
    """Words beyond ``FOLD_CHARS``, one by one, with the results of the folds."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.scores, self.numbers = {p: score for p, _, score in pieces.rows}, {p: i for p, i, _ in pieces.rows}
        self.unknown_score = min(score for _, _, score in pieces.rows) - 10.0

    def ids(self, word: str) -> list[int]:
        parts = self.viterbi(word) if self.pieces.kind == UNIGRAM else self.merge(word)
        return [i for p in parts for i in self.of_piece(p)]

    def ids_between(self, word: str, mask: int) -> list[int]:
        """Ids of what lies from one boundary (a bit of ``mask``) to the next."""
        cuts = [k for k in range(len(word) + 1) if mask >> k & 1]
        return [i for a, b in zip(cuts, cuts[1:]) for i in self.of_piece(word[a:b])]

    def of_piece(self, piece: str) -> list[int]:
        if piece in self.numbers:
            return [self.numbers[piece]]
        first = self.pieces.first_byte
        return [self.pieces.unknown] if first is None else [first + b for b in piece.encode("utf-8", "surrogatepass")]

    def merge(self, word: str) -> list[str]:
        """The best edge over two neighbours is merged, the leftmost of equals, until there is none; an edge whose symbols have changed since is passed over."""
        scores, parts = self.scores, list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (joined := parts[i] + parts[j]) in scores:
                heapq.heappush(heap, (-scores[joined], i, joined))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if parts[i] else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j], after[i] = joined, "", after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def viterbi(self, word: str) -> list[str]:
        best = [(0.0, 0)] + [(float("-inf"), 0)] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.pieces.longest), end):
                piece = word[start:end]
                score = self.scores.get(piece, self.unknown_score if end - start == 1 else None)
                if score is not None:
                    best[end] = max(best[end], (best[start][0] + score, start))
        cuts = [len(word)]
        while cuts[-1]:
            cuts.append(best[cuts[-1]][1])
        return [word[a:b] for b, a in zip(cuts, cuts[1:])][::-1]


ENCODED = "doc_id long, n_pieces long, ids array<int>, round_trip boolean"


def escaped(text: str | None) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def rare_words(docs: DataFrame, known: SharedDict, pieces: Pieces) -> DataFrame:
    """(key, word) for each document's words that are not sent to every task, each once."""
    pattern = word_pattern(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, table = re.compile(pattern).findall, known.value
        for batch in batches:
            keys, words = batch.column(0).to_pylist(), []
            others = [set(find(escaped(text))).difference(table) for text in batch.column(1).to_pylist()]
            for x in others:
                words += x
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(keys, dtype=np.int32), [len(x) for x in others])), pa.array(words, pa.string())], names=["key", "word"])

    return map_arrow(docs.select("key", "text"), "key int, word string", run)


def compressed(docs: DataFrame) -> DataFrame:
    """doc_id, key, size, data: the text's bytes, and the text compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(TEXT_CODEC)
        for batch in batches:
            texts = [x.encode() for x in batch.column(2).to_pylist()]
            data = pa.array([codec.compress(x, asbytes=True) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(len, texts)), pa.int32()), data], names=["doc_id", "key", "size", "data"])

    return map_arrow(docs.select("doc_id", "key", "text"), "doc_id long, key int, size int, data binary", run)


def assemble(docs: DataFrame, known: SharedDict, pieces: Pieces) -> DataFrame:
    """Documents (doc_id, size, data: their text compressed, rare: the ids of their other words, with the word where ids don't tell it) to their ids, decoded again as a check."""
    pattern, texts, kind = word_pattern(pieces), piece_texts(pieces), id_type(pieces)
    whole = piece_texts(pieces, SPACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, table, codec = re.compile(pattern).findall, known.value, pa.Codec(TEXT_CODEC)
        spelled, spelled_whole = pa.array(texts, pa.binary()), pa.array(whole, pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                data, read = [], []
                rare = part.column(3)
                own, own_words = rare.flatten().flatten()
                ends = np.concatenate([[0], np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False))]) // np.dtype(kind).itemsize
                own_ids = np.frombuffer(b"".join(own.to_pylist()), dtype=kind).astype("<i4")
                flat, cuts = own_ids.tobytes(), (4 * ends).tolist()
                own_data = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
                own_words = [x.decode() for x in spelled_ids(own_ids, ends, spelled_whole)] if own_words.null_count else own_words.to_pylist()
                first = 0
                for size, held, n_own in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), rare.value_lengths().fill_null(0).to_pylist()):
                    text = codec.decompress(held, size, asbytes=True).decode()
                    words = find(escaped(text))
                    got = list(map(table.get, words))
                    if n_own:
                        others = dict(zip(own_words[first : first + n_own], own_data[first : first + n_own]))
                        got = [others[w] if x is None else x for w, x in zip(words, got)]
                    first += n_own
                    data.append(b"".join(got))
                    read.append(text)
                bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in data])])
                ids = np.frombuffer(b"".join(data), dtype="<i4")
                plain = [text.replace(SPACE, " ") for text in read]
                same = [got == f" {text}".encode() for got, text in zip(spelled_ids(ids, bounds, spelled), plain)]
                for k in np.flatnonzero(~np.array(same)).tolist():
                    same[k] = decode_ids(ids[bounds[k] : bounds[k + 1]].tolist(), texts) == plain[k]
                values = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids", "round_trip"])

    return map_arrow(docs.select("doc_id", "size", "data", "rare"), ENCODED, run)


def encode_documents(df: DataFrame, model: str = MODEL, known_words: int = KNOWN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids, round_trip (decoding the ids gives the text, U+2581 read as a space) for each row.

    Ids are the library's for the whole text, however long, whatever ``known_words`` is. A
    null or empty text has none. Rows with the same id, or none, stay apart. Other columns
    play no part.
    """
    pieces = load_pieces(model)
    # the key only brings words to texts; texts that share one get each other's words too, so few bits do
    docs = documents_of(df, id_col, text_col).withColumn("key", F.shiftright(F.xxhash64("doc_id", "text"), 32).cast("int"))
    counted = materialize(distinct_words(docs, pieces))
    encoded = materialize(encode_words(counted, pieces, as_bytes=True))
    top = encoded.join(frequent(counted, known_words, "n", "word").select("word"), "word", "left_semi")
    kind = id_type(pieces)
    rows = [(r["word"], _as_bytes(r["ids"], kind)) for r in top.toLocalIterator()]
    known = SharedDict.of(df.sparkSession, pa.array([w for w, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.binary()))
    # with bytes for what no piece covers, the ids tell the word
    told = pieces.first_byte is not None
    # a statement of its own, so that its shuffle files and the words' tables are gone when the texts are dealt
    pairs = materialize(rare_words(docs, known, pieces).join(encoded, "word").select("key", "ids", *([] if told else ["word"])), compression="zstd")
    for table in (counted, encoded):
        discard(table)
    # a set: equal rows send the same words, which are kept once; dealt first, as few pairs of a task share a key before
    dealt = pairs.repartition("key")
    word = F.lit(None).cast("string").alias("word") if told else F.col("word")
    rare = dealt.groupBy("key").agg(F.collect_set(F.struct("ids", word)).alias("rare"))
    return assemble(compressed(docs).join(rare, "key", "left"), known, pieces)
