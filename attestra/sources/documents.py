"""Documents to blocks: text natively, other formats by a port; words of pages are in ``pages``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions.text import normalize_text, strip

BLOCK_COLUMNS = ("doc_key", "pos", "text", "start", "end", "kind", "section", "location", "paragraph")


def text_blocks(docs: DataFrame) -> DataFrame:
    """(doc_key, text) to blocks separated by empty lines, with spans, running section and kind.

    A block's span is that of the part between the empty lines, its white space included,
    and its text the part's normalized text. Empty parts count as paragraphs. A part that
    starts with # is a heading, and, unless nothing follows the #, the section from there
    on; one that starts with -, * or + is a list item.
    """
    separator = r"(?U)\n[\s\x1C-\x1F]*\n"
    parts = F.split("text", separator)
    seps = F.regexp_extract_all("text", F.lit(f"({separator})"), 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    lengths = F.zip_with(parts, seps, lambda p, s: F.length(p) + F.coalesce(F.length(s), F.lit(0)))
    offsets = F.aggregate(lengths, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]
    placed = F.zip_with(parts, offsets, lambda p, at: F.struct(p.alias("part"), at.alias("start")))
    exploded = docs.select("doc_key", F.posexplode(placed).alias("paragraph", "p")).select("doc_key", (F.col("paragraph") + 1).alias("paragraph"), "p.part", "p.start")
    kept = exploded.withColumn("raw", strip(F.col("part"))).filter(F.col("raw") != "")
    kind = F.when(F.col("raw").startswith("#"), "heading").when(F.col("raw").rlike(r"^[-*+]"), "list_item").otherwise("paragraph")
    order = Window.partitionBy("doc_key").orderBy("paragraph")
    name = strip(F.regexp_replace("raw", "^#+", ""))
    own = F.when(F.col("raw").startswith("#") & (name != ""), name)
    end = F.col("start") + F.length("part")
    return kept.select(
        "doc_key", (F.row_number().over(order) - 1).alias("pos"), normalize_text(F.col("raw")).alias("text"), "start", end.alias("end"), kind.alias("kind"),
        F.last(own, ignorenulls=True).over(order).alias("section"), F.concat(F.lit("char="), F.col("start"), F.lit(":"), end).alias("location"), "paragraph",
    )


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, text) of the .txt and .md files below ``path``; one row a file."""
    found = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").text(path)
    return found.select(F.col("_metadata.file_path").alias("doc_key"), F.col("value").alias("text"))


#: Suffixes of texts; other formats need a parser port.
TEXT_SUFFIXES = (".txt", ".md")


def read_documents(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], list[dict]]] | None = None) -> DataFrame:
    """Blocks of all documents below ``path``, by the suffix of each in any case.

    Texts are cut into blocks here; ``parsers`` (suffix to port) makes those of other formats.
    A file of any other suffix fails the job that reads the blocks. Blocks of texts hold
    no columns of pages.
    """
    parsers = {k.lower(): v for k, v in (parsers or {}).items()}
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)?$", 0))
    message = F.concat(F.lit("unsupported document type: "), suffix, F.lit(" of "), F.col("path"))
    known = suffix.isin(*TEXT_SUFFIXES, *parsers)
    checked = found.select("path", "content", F.when(known, suffix).otherwise(F.raise_error(message)).alias("suffix"))
    own = checked.filter(~F.col("suffix").isin(*parsers)) if parsers else checked
    out = text_blocks(own.filter("suffix IS NOT NULL").select(F.col("path").alias("doc_key"), F.decode("content", "UTF-8").alias("text"))).select(*BLOCK_COLUMNS)
    for kind, parser in parsers.items():
        out = out.unionByName(_parsed(checked.filter(F.col("suffix") == kind), parser).select(*BLOCK_COLUMNS))
    return out


def read_binary_documents(spark: SparkSession, path: str, glob: str, parser: Callable[[bytes], list[dict]]) -> DataFrame:
    """Blocks that ``parser`` (a port to a library for DOCX or PDF files) makes of each file."""
    return _parsed(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path), parser)


def _parsed(found: DataFrame, parser: Callable[[bytes], list[dict]]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"doc_key": path, "pos": k, **b} for path, content in zip(frame["path"], frame["content"]) for k, b in enumerate(parser(content))]
            yield pd.DataFrame(rows, columns=list(BLOCK_COLUMNS))

    return found.select("path", "content").mapInPandas(run, "doc_key string, pos int, text string, start int, end int, kind string, section string, location string, paragraph int")


def styled_blocks(paragraphs: DataFrame) -> DataFrame:
    """(doc_key, paragraph, text, style) of a word-processor document to blocks.

    Empty paragraphs go, but count; a style whose name begins with "heading" makes a
    heading and the section from there on; spans count the stripped texts, one character
    apart.
    """
    kept = paragraphs.withColumn("raw", strip(F.col("text"))).filter("raw <> ''")
    order = Window.partitionBy("doc_key").orderBy("paragraph")
    head = F.coalesce(F.lower("style").startswith("heading"), F.lit(False))
    end = (F.sum(F.length("raw") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")
    return kept.select(
        "doc_key", (F.row_number().over(order) - 1).alias("pos"), normalize_text(F.col("raw")).alias("text"), (end - F.length("raw")).alias("start"), end.alias("end"),
        F.when(head, "heading").otherwise("paragraph").alias("kind"), F.last(F.when(head, F.col("raw")), ignorenulls=True).over(order).alias("section"),
        F.concat(F.lit("paragraph="), F.col("paragraph")).alias("location"), "paragraph",
    )
