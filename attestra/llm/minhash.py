"""Near-duplicate groups by circulant MinHash.

Two permutations of the 32-bit integers make all coordinates of a signature: the first
scatters a document's shingles, the second ranks them, shifted circularly by k for
coordinate k. Coordinates are banded; documents that share a band are candidates, and
each link is confirmed by the exact Jaccard similarity of the whole shingle sets.

Documents with equal sets are one representative from the start. In a bucket every
member is compared with its least one. Members of one component need no more
comparison. In a bucket that holds several components, members outside the largest are
compared, for some rounds, with a few members of it and of the others. In the end each one
still outside is compared with those members of other components that a prefix filter
leaves: shingles are ordered from the rarest on, and two sets that are similar enough share
one near enough to the front of both. A family whose members have the same text but for
changes of their own shares none there, so its pairs are never made. So each similar pair
in a bucket is either compared or already connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import documents_of, map_arrow, materialize
from attestra.llm.components import joined_components

#: 32 bands of 4: a pair at similarity 0.8 shares no band with probability (1 - 0.8**4)**32 < 5e-8.
BANDS, ROWS = 32, 4
PERCENT = 80
WORDS_KEPT = 1_000_000
#: Rounds in which members outside a bucket's largest component meet up to ``GUIDES`` other members, before the prefix filter.
GUIDED, GUIDES = 2, 4
#: Set sizes are classed by powers of this; a set looks for partners of one class at a time.
SIZE_CLASS = 1.1


class WordHashes(dict):
    """64-bit hashes of the words met so far; starts anew beyond ``WORDS_KEPT``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit integers: xor-shifts and odd multipliers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def shingle_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; shorter texts are one shingle."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter((hashes[w] for w in words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(size, len(words)), dtype=np.uint64)
    for k in range(min(size, len(words))):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """``n`` coordinates; coordinate k is the least second permutation of (first permutation - k)."""
    scattered = permute((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(n, dtype=np.uint32)
    least = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(scattered), 256):
        ranked = permute(scattered[at : at + 256, None] - shifts, 0x21F0AAAD, 0x735A2D97)
        np.minimum(least, ranked.min(axis=0), out=least)
    return least


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = sig.reshape(bands, rows).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return out.view(np.int64)


SKETCH = "doc_id long, n_shingles long, set_id binary, bands array<long>"


def sketches(docs: DataFrame, size: int, bands: int, rows: int, with_text: bool = False) -> DataFrame:
    """doc_id, n_shingles, set_id (a digest of the whole set), bands, and the text if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts, digests, all_bands, ends = [], [], [], [0]
                for text in part.column(1).to_pylist():
                    s = shingle_hashes(shingle_words(text), size, hashes)
                    counts.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    if len(s):
                        all_bands.append(band_hashes(signature(s, bands * rows), bands, rows))
                    ends.append(ends[-1] + bands * (len(s) > 0))
                values = np.concatenate(all_bands) if all_bands else np.empty(0, dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists, *([part.column(1)] if with_text else [])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_id", "bands", *(["text"] if with_text else [])])

    return map_arrow(docs, SKETCH + ", text string" * with_text, run)


def verify(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose whole shingle sets are similar enough."""
    texts = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    with_b = pairs.join(texts, "b")
    both = with_b.join(docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def shingles(text: str) -> set:
        words = shingle_words(text)
        return set(zip(*(words[k:] for k in range(size)))) if len(words) >= size else {tuple(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                good = []
                for k, (text_a, text_b) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    if text_a != last:
                        last, left = text_a, shingles(text_a)
                    right = shingles(text_b)
                    common = len(left & right)
                    if 100 * common >= percent * (len(left) + len(right) - common):
                        good.append(k)
                yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in good], pa.int64()), pa.array([b[k] for k in good], pa.int64())], names=["a", "b"])

    return map_arrow(both, "a long, b long", run)


def near_duplicates(df: DataFrame, size: int, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    Texts without words (null and empty ones too) link with nothing. Texts shorter than
    ``size`` words are one shingle. Rows that share an id are linked. Rows without an id
    link with nothing and are kept, with a null component. A set is of the whole text,
    however long; other columns play no part.
    """
    docs = documents_of(df, id_col, text_col)
    sketched = materialize(sketches(docs, size, bands, rows))
    some = sketched.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    least = some.groupBy("set_id").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r"))
    reps = materialize(least.select("set_id", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n"), F.col("r.bands").alias("bands")))
    members = reps.select(F.explode("bands").alias("bucket"), "rep", "n")

    # written first, so that a frequent bucket can be split when members are joined to it
    pivots = materialize(members.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("pivot"), F.count("*").alias("size")).filter("size > 1").select("bucket", "pivot"))
    shared = materialize(members.join(pivots, "bucket"))
    nodes = shared.select(F.col("rep").alias("node")).distinct()
    texts = materialize(_one_text(docs.join(nodes, docs["doc_id"] == nodes["node"], "left_semi"), some, reps, size, bands, rows))
    fits = lambda n, m: F.least(n, m) * 100 >= F.greatest(n, m) * percent
    stars = shared.filter((F.col("rep") != F.col("pivot.rep")) & fits(F.col("n"), F.col("pivot.n")))
    tried = materialize(stars.select(F.col("pivot.rep").alias("a"), F.col("rep").alias("b")).distinct())
    links = verify(tried, texts, size, percent).unionByName(_by_id(some, reps))
    components = joined_components(reps.select(F.col("rep").alias("node"), F.col("rep").alias("component")), links)

    held = shared.select("bucket", "rep", "n")
    for k in range(GUIDED + 1):
        held = materialize(_mixed(held, components))
        if held.isEmpty():
            break
        pairs = _guided(held, fits, k) if k < GUIDED else _by_prefix(held, texts, size, percent)
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"))
        components = joined_components(components, verify(pairs, texts, size, percent))
        tried = tried.unionByName(pairs)
        held = held.select("bucket", "rep", "n")

    named = reps.join(components, reps["rep"] == components["node"]).select("set_id", F.col("component").alias("component_id"))
    linked = some.select("doc_id", "n_shingles", "set_id").join(named, "set_id").select("doc_id", "n_shingles", "component_id")
    alone = sketched.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _one_text(docs: DataFrame, some: DataFrame, reps: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``docs`` (doc_id, text) with one row for each id and each set that it stands for, so that pairs don't meet as often as rows repeat."""
    several = materialize(some.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if several.isEmpty():
        return docs
    once, repeated = docs.join(several, "doc_id", "left_anti"), docs.join(several, "doc_id", "left_semi").distinct()
    sets = sketches(repeated, size, bands, rows, with_text=True).select("doc_id", "set_id", "text")
    own = sets.join(reps.select("set_id", F.col("rep").alias("doc_id")), ["set_id", "doc_id"], "left_semi")
    return once.unionByName(own.groupBy("doc_id", "set_id").agg(F.min("text").alias("text")).select("doc_id", "text"))


def _by_id(some: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the sets of rows that share an id."""
    sets = some.select("doc_id", "set_id").join(reps.select("set_id", "rep"), "set_id").select("doc_id", "rep")
    several = sets.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("high")).filter("a < high").select("doc_id", "a")
    return sets.join(several, "doc_id").select("a", F.col("rep").alias("b")).filter("a < b").distinct()


def _mixed(held: DataFrame, components: DataFrame) -> DataFrame:
    """Members (bucket, rep, n, component, top) of the buckets that hold several components; ``top`` is the bucket's largest."""
    labelled = held.join(components, held["rep"] == components["node"]).select("bucket", "rep", "n", "component")
    parts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    mixed = materialize(parts.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("t"), F.count("*").alias("parts")).filter("parts > 1").select("bucket", F.col("t.component").alias("top")))
    return labelled.join(mixed, "bucket")


def _guided(held: DataFrame, fits, k: int) -> DataFrame:
    """Each member outside the largest component with one member of it and one outside it, others in each round, and few in all; what is linked so needs no comparison with the rest."""
    outside = F.col("component") != F.col("top")
    chosen = held.groupBy("bucket", outside.alias("out")).agg(F.min(F.struct(F.xxhash64("rep", "bucket", F.lit(k)).alias("h"), "rep", "n", "component")).alias("g"))
    met = held.filter(outside).join(materialize(chosen), "bucket").filter((F.col("component") != F.col("g.component")) & fits(F.col("n"), F.col("g.n")))
    few = met.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set(F.struct("g.h", F.col("g.rep").alias("x")))), 1, GUIDES).alias("gs"))
    return few.select("rep", F.explode("gs").alias("g")).select(F.least("rep", "g.x").alias("a"), F.greatest("rep", "g.x").alias("b")).distinct()


def shingles_by_rarity(members: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``members`` (rep, ...) with ``s``, the hashes of their shingles, those in the fewest members first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(shingle_words(x), size, hashes).view(np.int64) for x in batch.column(1).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(sets) if sets else [], pa.int64())], names=["of", "shingle"])

    own = texts.join(members.select(F.col("rep").alias("of")), texts["doc_id"] == F.col("of"), "left_semi").select("doc_id", "text")
    # rows that share an id have one set here, so what is found is a candidate, whose texts decide
    pairs = materialize(map_arrow(own, "of long, shingle long", run).distinct())
    counts = materialize(pairs.groupBy("shingle").agg(F.count("*").alias("c")).filter("c > 1"))
    ranked = pairs.join(counts, "shingle", "left").groupBy("of").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "shingle"))).alias("s"))
    return members.join(ranked.select("of", F.col("s.shingle").alias("s")), F.col("rep") == F.col("of")).drop("of")


def _by_prefix(held: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Distinct pairs of different components, one of them outside its bucket's largest, that can be similar by their rarest shingles.

    Sets of n and m shingles need ``need(n, m)`` in common. If the first they have in
    common, in one order of all shingles, is at places p and q, they have n - p and m - q
    at most. So a set with partners of ``low`` shingles or more need show only its first
    n - need(n, low) + 1. Size classes make ``low`` near the partner's own size.
    """
    need = lambda n, m: F.ceil((n + m) * percent / (100 + percent))
    of = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(SIZE_CLASS))).cast("int")
    reach = int(np.ceil(np.log(100 / percent) / np.log(SIZE_CLASS))) + 1
    members = materialize(held.groupBy("rep").agg(F.first("n").alias("n0"), F.first("component").alias("component"), F.max(F.col("component") != F.col("top")).alias("outside")))
    sets = materialize(shingles_by_rarity(members, texts, size).withColumn("n", F.size("s").cast("long")))
    classed = sets.select("rep", "n", "component", "outside", "s", of(F.col("n")).alias("own"), F.explode(F.sequence(of(F.col("n")) - reach, of(F.col("n")) + reach)).alias("other"))
    # one less than the class begins with, as logarithms are rounded
    low = F.greatest(F.ceil(F.pow(F.lit(SIZE_CLASS), F.col("other"))) - 1, F.ceil(F.col("n") * percent / 100), F.lit(1))
    shown = (F.col("n") - need(F.col("n"), low) + 1).cast("int")
    front = classed.withColumn("shown", shown).filter((F.col("shown") > 0) & (low * percent <= F.col("n") * 100))
    front = materialize(front.select("rep", "n", "component", "outside", "own", "other", F.posexplode(F.slice("s", 1, F.col("shown"))).alias("p", "shingle")))
    mine = front.filter("outside").select("shingle", F.col("own").alias("c"), F.col("other").alias("d"), F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("p").alias("px"), F.col("component").alias("cx"))
    theirs = front.select("shingle", F.col("own").alias("d"), F.col("other").alias("c"), "rep", "n", "p", "component")
    common = F.least(F.col("n") - F.col("p"), F.col("nx") - F.col("px"))
    pairs = mine.join(theirs, ["shingle", "c", "d"]).filter((F.col("cx") != F.col("component")) & (common >= need(F.col("n"), F.col("nx"))))
    return pairs.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()
