"""Benchmark decontamination with DataFrame functions only.

Items and documents are lower-cased words. A window of a document has an item's number
of words; that of greatest similarity decides. Windows with a 64-bit SimHash of their
shingles, each weighted by its occurrences, are looked up among the items. Fingerprints
are cut into 8 blocks of 8 bits: two that differ in at most 23 bits differ in at most 2
of some block, so an index of the items' blocks with all changes of up to 2 bits finds
every item within that radius. The exact similarity of the weighted shingle sets, sum of
minima over sum of maxima, decides.

A document and an item meet by a shingle of those that tell the item from others; blocks
are probed for the windows and the item that met, and for no other pair. Nor need every
window be printed. One that has no shingle of an item is not similar to it. A shingle at
place p of the document and q of the item lies on the diagonal p - q. A window that starts before all diagonals of its shared shingles has none of them at its
start, and one that starts after all has none at its end, so it can be moved towards them
and lose none. Two shingles of one window differ by less than twice its words in their
diagonals. So it is enough to print, for each document and item, the windows that start
from one diagonal to the next within that distance. Of what these windows hold nothing is
lost but fingerprints beyond the radius; in simulations of edits none was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.common import documents_of, materialize

SHINGLE = 5
PERCENT = 80
BLOCKS, BLOCK_BITS, FLIPS = 8, 8, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Rows of item shingles, or of their index, up to which they are broadcast (about 40 bytes each).
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_word_hashes(df: DataFrame) -> DataFrame:
    """``words`` becomes ``h``, a hash of each. A column of its own, so that shingles don't make it again for each place."""
    return df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).drop("words")


def shingles_of(h: Column, size: int) -> Column:
    """Hash of the ``size`` words from each place on; empty for fewer words."""
    at = F.sequence(F.lit(0), F.size(h) - size)
    made = F.transform(at, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))))
    return F.when(F.size(h) >= size, made).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """Bit b is set if more than half of the occurrences have it; counted in two lanes of 32 bits."""
    lanes, low, zero = F.lit((1 << 32) | 1), F.lit(0xFFFFFFFF), F.lit(0).cast("long")
    bits, shifted = F.sequence(F.lit(0), F.lit(31)), lambda x, k: F.call_function("shiftrightunsigned", x, k)
    sums = F.transform(bits, lambda b: F.aggregate(hashes, zero, lambda acc, h: acc + shifted(h, b).bitwiseAND(lanes)))
    most = lambda count: F.when(count * 2 > F.size(hashes), F.lit(1).cast("long")).otherwise(zero)
    decided = F.transform(sums, lambda x: F.call_function("shiftleft", most(shifted(x, F.lit(32))), F.lit(32)).bitwiseOR(most(x.bitwiseAND(low))))
    return F.aggregate(F.arrays_zip(decided.alias("two"), bits.alias("bit")), zero, lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", x["two"], x["bit"])))


def tagged(hashes: Column) -> Column:
    """A set that stands for the occurrences: the k-th of equal shingles is told from the others."""
    nth = lambda h, i: F.xxhash64(h, F.size(F.filter(F.slice(hashes, 1, i + 1), lambda x: x == h)))
    once = F.transform(hashes, lambda h: F.xxhash64(h, F.lit(1)))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), once).otherwise(F.transform(hashes, nth))


def similarity(a: Column, b: Column) -> Column:
    """Of two tagged sets."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def block_of(fingerprint: Column, k: Column) -> Column:
    return F.call_function("shiftrightunsigned", fingerprint, k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long"))


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast if the rows are few enough; else the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def of_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and ``key``, the id with a digest of the text: rows that differ in either are told apart, those without an id too."""
    return documents_of(df, id_col, text_col).withColumn("key", row_key(F.col("doc_id"), F.col("text")))


def row_key(doc_id: Column, text: Column) -> Column:
    return F.struct(F.coalesce(doc_id, F.lit(0).cast("long")).alias("id"), doc_id.isNull().alias("none"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"))


def prepare_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (a key of id and words), item_id, n (words), size (of shingles, less than 5 for shorter items), hashes, fingerprint; items without words are left out, and equal rows are one."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    items = items.filter(F.size("words") > 0).withColumn("n", F.size("words")).withColumn("size", F.least(F.col("n"), F.lit(SHINGLE)))
    items = items.withColumn("item", row_key(F.col("item_id"), F.array_join("words", " "))).dropDuplicates(["item"])
    of_size = F.coalesce(*(F.when(F.col("size") == k, shingles_of(F.col("h"), k)) for k in range(1, SHINGLE + 1)))
    items = with_word_hashes(items).select("item", "item_id", "n", "size", of_size.alias("hashes"))
    return items.select("item", "item_id", "n", "size", "hashes", simhash(F.col("hashes")).alias("fingerprint"))


def _placed(size: int) -> Column:
    return F.transform(f"s{size}", lambda x, i: F.struct(F.lit(size).alias("size"), i.alias("at"), x.alias("hash")))


def telling(items: DataFrame, percent: int) -> DataFrame:
    """(item, hash) of the shingles by which an item meets documents: its rarest ones among the items, of more than ``100 - percent`` hundredths of its weight.

    A window that has none of them has less than ``percent`` hundredths of the item's
    weight in common with it, so it isn't similar enough. What many items share is asked
    only where an item has nothing rarer.
    """
    weights = items.select("item", "size", F.size("hashes").alias("m"), F.explode("hashes").alias("hash")).groupBy("item", "size", "m", "hash").agg(F.count("*").alias("w"))
    rarity = weights.groupBy("hash", "size").agg(F.count("*").alias("c"))
    order = Window.partitionBy("item").orderBy("c", "hash").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("w").over(order), F.lit(0))
    return weights.join(rarity, ["hash", "size"]).withColumn("before", before).filter(F.col("before") * 100 <= (100 - percent) * F.col("m")).select("item", "size", "hash")


def placed_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, n_words, size, at, hash) of documents (key, text); all sizes in one pass."""
    read = with_word_hashes(docs.select("key", words_of(F.col("text")).alias("words")))
    read = read.select("key", F.size("h").alias("n_words"), *(shingles_of(F.col("h"), k).alias(f"s{k}") for k in sizes))
    # an inner explode would have its array computed once more, in a filter
    return read.select("key", "n_words", F.explode_outer(F.concat(*(_placed(k) for k in sizes))).alias("s")).select("key", "n_words", "s.size", "s.at", "s.hash")


def lay_windows(docs: DataFrame, items: DataFrame, sizes: list[int], percent: int) -> DataFrame:
    """Distinct (key, item, n, size, start): for each document and item that meet by a telling shingle, the starts from one diagonal of a shared shingle to the next."""
    met = materialize(placed_shingles(docs, sizes).join(_bounded(materialize(telling(items, percent))), ["size", "hash"]).select("key", "item").distinct())
    own = items.select("item", "n", "size", F.posexplode("hashes").alias("at_item", "hash"))
    asked = met.join(_bounded(own), "item")
    held = docs.join(met.select("key").distinct(), "key", "left_semi")
    hits = placed_shingles(held, sizes).join(asked, ["key", "size", "hash"])
    diagonals = hits.groupBy("key", "n_words", "item", "n", "size").agg(F.array_sort(F.collect_set(F.col("at") - F.col("at_item"))).alias("d"))
    near = lambda d, i: F.coalesce(F.get("d", i + 1) - d < 2 * F.col("n"), F.lit(False))
    filled = F.flatten(F.transform("d", lambda d, i: F.when(near(d, i), F.sequence(d, F.get("d", i + 1) - 1)).otherwise(F.array(d))))
    start = F.greatest(F.lit(0), F.least(F.col("start"), F.col("n_words") - F.col("n")))
    return diagonals.select("key", "n_words", "item", "n", "size", F.explode(filled).alias("start")).select("key", "item", "n", "size", start.alias("start")).distinct()


def fingerprints(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """Windows with their shingles and SimHash; each document's words are made once for all its windows."""
    per_doc = windows.groupBy("key", "size").agg(F.collect_set(F.struct("start", "n")).alias("windows"))
    held = docs.join(per_doc, "key").select("key", "size", "windows", words_of(F.col("text")).alias("words"))
    held = with_word_hashes(held).select("key", "size", "h", F.explode("windows").alias("w"))
    held = held.select("key", "size", "w.start", "w.n", F.slice("h", F.col("w.start") + 1, F.col("w.n")).alias("h"))
    of_size = F.coalesce(*(F.when(F.col("size") == k, shingles_of(F.col("h"), k)) for k in sizes))
    held = held.select("key", "size", "start", "n", of_size.alias("hashes"))
    return held.withColumn("fingerprint", simhash(F.col("hashes")))


def item_index(items: DataFrame) -> DataFrame:
    """(item, block, value) of each item's fingerprint with up to ``FLIPS`` bits of the block changed."""
    masks = F.array(*(F.lit(m) for m in range(1 << BLOCK_BITS) if m.bit_count() <= FLIPS))
    blocks = items.select("item", "fingerprint", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    return blocks.select("item", F.col("fingerprint").alias("of_item"), "block", F.explode(F.transform(masks, lambda m: block_of(F.col("fingerprint"), F.col("block")).bitwiseXOR(m.cast("long")))).alias("value"))


def probed_pairs(laid: DataFrame, printed: DataFrame, items: DataFrame) -> DataFrame:
    """(key, n, start, item, hamming): those of the windows laid for an item whose fingerprint is within the radius, by the blocks of the item's index."""
    windows = laid.select("key", "n", "start", "item").join(printed.select("key", "n", "start", "fingerprint"), ["key", "n", "start"])
    probes = windows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    probes = probes.withColumn("value", block_of(F.col("fingerprint"), F.col("block")))
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("of_item")))
    near = probes.join(_bounded(item_index(items)), ["item", "block", "value"]).filter(distance <= RADIUS)
    return near.select("key", "n", "start", "item", distance.cast("int").alias("hamming")).distinct()


def found_windows(docs: DataFrame, benchmark: DataFrame, percent: int) -> DataFrame:
    """key, item_id, start_word, n_words, hamming, similarity: the best window of each row of ``of_rows`` and item that match."""
    items = materialize(prepare_items(benchmark))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect()) or [SHINGLE]  # 1 to 5
    laid = materialize(lay_windows(docs, items, sizes, percent))
    printed = materialize(fingerprints(docs, laid.select("key", "n", "size", "start").distinct(), sizes))
    near = probed_pairs(laid, printed, items)
    exact = items.select("item", "item_id", tagged(F.col("hashes")).alias("item_set"))
    exact = F.broadcast(exact) if (items.agg(F.sum(F.size("hashes"))).first()[0] or 0) <= BROADCAST_ROWS else exact
    window = printed.select("key", "n", "start", tagged(F.col("hashes")).alias("window_set"))
    scored = near.join(window, ["key", "n", "start"]).join(exact, "item").withColumn("similarity", similarity(F.col("window_set"), F.col("item_set")))
    best = scored.filter(F.col("similarity") * 100 >= percent).groupBy("key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("place"), "n", "hamming")).alias("b"))
    return best.select("key", "item_id", (-F.col("b.place")).alias("start_word"), F.col("b.n").alias("n_words"), "b.hamming", "b.similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, n_words, hamming, similarity: the best window of each document and item that match.

    Whole texts are searched, however long. Items shorter than 5 words match as a whole.
    Null and empty texts and items match nothing. A text shorter than an item is one
    window. Rows with the same id and text are one document; other rows that share an id,
    or have none, are searched one by one. Without items or documents the result is empty.
    """
    found = found_windows(of_rows(docs, id_col, text_col), benchmark, percent)
    return found.select(F.when(~F.col("key.none"), F.col("key.id")).alias("doc_id"), *found.columns[1:])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all columns; rows are judged one by one, whatever their ids."""
    found = found_windows(of_rows(docs, id_col, text_col), benchmark, percent).select(F.col("key").alias("key of the found")).distinct()
    key = row_key(docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(found, key == found["key of the found"], "left_anti")
