"""Words of pages to blocks: visual lines, page noise, tables of ids, headings, paragraphs, exact places.

A page's lines are read in order by one scan, whose state is the table that a header line
begins. What the scan makes of a page depends on that page alone, so pages are the unit
of work; sections, row numbers and spans run on over a document, by windows over its
blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.text import is_heading, normalize_text

#: What lines a table's header, where its second column begins, and what ids and their first parts look like.
HEADER_FIRST, HEADER_SECOND, HEADER_INSET = "id", ("requirement", "acceptance"), 3.0
WHOLE_ID = re.compile(r"[A-Z]{2,}(?:-[A-Z0-9]+)+")
ID_PART = re.compile(r"[A-Z]{2,}(?:-[A-Z0-9]+)*-")
#: Lines below an id's first part in which its number may stand; the gap of lines that ends a paragraph; characters between blocks.
ID_LINES, PARAGRAPH_GAP, BETWEEN = 3, 12.0, 2


def page_lines(words: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """(doc_key, page, page_height, x, y0, y1, word) to visual lines (doc_key, page, line, y0, y1, page_height, text, words).

    From top to bottom, a word whose top is within ``tolerance`` of its line's first word is
    on that line; a fold over the words of a page, whose lines are runs of its words.
    ``words`` holds (x, word) from left to right. Words that were dealt by ``doc_key``
    before are not dealt again, here or by ``without_page_noise``.
    """
    held = F.array_sort(F.collect_list(F.struct("y0", "x", "word", "y1")))
    pages = words.groupBy("doc_key", "page").agg(held.alias("w"), F.max("page_height").alias("page_height"))
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))

    def step(acc, w):
        new, at = F.coalesce(w["y0"] - acc["top"] > tolerance, F.lit(True)), acc["at"] + 1
        begins = F.when(new, F.concat(acc["begins"], F.array(at))).otherwise(acc["begins"])
        return F.struct(F.when(new, w["y0"]).otherwise(acc["top"]).alias("top"), at.alias("at"), begins.alias("begins"))

    # places from 1 on, and one after the last
    begins = F.aggregate("w", start, step, lambda acc: F.concat(acc["begins"], F.array(acc["at"] + 1)))
    begun = pages.select("doc_key", "page", "page_height", "w", begins.alias("begins"))
    runs = F.transform(F.sequence(F.lit(0), F.size("begins") - 2), lambda k: F.slice("w", F.get("begins", k), F.get("begins", k + 1) - F.get("begins", k)))
    each = begun.select("doc_key", "page", "page_height", F.posexplode(runs).alias("line", "run"))
    y0 = F.array_min(F.transform("run", lambda w: w["y0"])).cast("double").alias("y0")
    y1 = F.array_max(F.transform("run", lambda w: w["y1"])).cast("double").alias("y1")
    words_of = F.array_sort(F.transform("run", lambda w: F.struct(w["x"].cast("double").alias("x"), w["word"].alias("word")))).alias("words")
    lines = each.select("doc_key", "page", "line", y0, y1, "page_height", words_of)
    text = F.trim(F.array_join(F.transform("words", lambda x: x["word"]), " "))
    return lines.select("doc_key", "page", "line", "y0", "y1", "page_height", text.alias("text"), "words")


def without_page_noise(lines: DataFrame, top: float = 35.0, bottom: float = 55.0) -> DataFrame:
    """Lines without header and footer texts found on two pages or more, page numbers in the footer, and empty lines; texts are compared normalized.

    Lines are made and read once: a text is on two pages or more if the first and the last
    page that has it at an edge differ.
    """
    lines = lines.withColumn("_text", normalize_text(F.col("text"))).filter("_text <> ''")
    low = F.col("y1") > F.col("page_height") - bottom
    edge = F.coalesce((F.col("y0") < top) | low, F.lit(False))
    at_edge, of_text = F.when(edge, F.col("page")), Window.partitionBy("doc_key", "_text")
    repeated = edge & F.col("doc_key").isNotNull() & F.col("page").isNotNull() & (F.min(at_edge).over(of_text) < F.max(at_edge).over(of_text))
    left = lines.withColumn("_repeated", F.coalesce(repeated, F.lit(False))).filter("not _repeated")
    return left.filter(~(F.col("_text").rlike(r"^\d+\s*/\s*\d+$") & low)).drop("_text", "_repeated")


@dataclass(slots=True)
class Line:
    y0: float
    y1: float
    text: str
    heading: bool
    words: list[tuple[float, str]]
    parted: tuple[float, tuple[str, str]] | None = None

    def cells(self, split: float) -> tuple[str, str]:
        """Words left of ``split``, and the others; the last ones asked for are kept."""
        if self.parted is None or self.parted[0] != split:
            left = " ".join([w for x, w in self.words if x < split]).strip()
            self.parted = split, (left, " ".join([w for x, w in self.words if x >= split]).strip())
        return self.parted[1]

    def column(self) -> float | None:
        """Where the second column of the table begins whose header this line is."""
        if not self.words or self.words[0][1].casefold() != HEADER_FIRST:
            return None
        names = [w.casefold() for _, w in self.words[:2]]
        if len(names) == 2 and names[0] == HEADER_FIRST and names[1] in HEADER_SECOND:
            return self.words[1][0] - HEADER_INSET
        return None


def table_row(lines: list[Line], at: int, split: float) -> tuple[str, str, int] | None:
    """(id, text, line after it) of the row that begins at a line, if one does.

    An id may be parted: its number is then the first word in the left column of the next
    lines. A row ends where another id or a heading begins.
    """
    row_id = lines[at].cells(split)[0]
    if ID_PART.fullmatch(row_id):
        below = (line.cells(split)[0] for line in lines[at + 1 : at + 1 + ID_LINES])
        number = next(filter(None, below), "")
        row_id += number if number.isdigit() else ""
    if not WHOLE_ID.fullmatch(row_id):
        return None
    begins = lambda line: line.heading or any(p.fullmatch(line.cells(split)[0]) for p in (WHOLE_ID, ID_PART))
    end = next((k for k in range(at + 1, len(lines)) if begins(lines[k])), len(lines))
    said = [right for line in lines[at:end] if (right := line.cells(split)[1])]
    return (row_id, " ".join(said), end) if said else None


def page_items(lines: list[Line]) -> Iterator[tuple[str, str | None, str, int, int]]:
    """(kind, id, text, first line, last line) of a page's headings, table rows and paragraphs, in order.

    A table lasts from its header to a heading, another header, or a line whose left column
    begins no row. Header lines are left out; lines of a table with nothing on the left are
    those of a paragraph, before its first row.
    """
    split, at, waiting = None, 0, []

    def paragraph() -> Iterator[tuple[str, str | None, str, int, int]]:
        if waiting:
            yield "paragraph", None, "\n".join(lines[k].text for k in waiting), waiting[0], waiting[-1]
            waiting.clear()

    while at < len(lines):
        line, begin = lines[at], at
        row = None
        if (column := line.column()) is not None:
            split, at = column, at + 1
            yield from paragraph()
            continue
        if split is not None and (line.heading or line.cells(split)[0]):
            row = None if line.heading else table_row(lines, at, split)
            split = split if row else None
        if row:
            yield from paragraph()
            at = row[2]
            yield "table_row", row[0], row[1], begin, at - 1
            continue
        if line.heading or (waiting and line.y0 - lines[waiting[-1]].y1 > PARAGRAPH_GAP):
            yield from paragraph()
        if line.heading:
            yield "heading", None, line.text, at, at
        else:
            waiting.append(at)
        at += 1
    yield from paragraph()


def _parts(lists: pa.ListArray) -> tuple[list[int], pa.StructArray]:
    """Where each list's structs begin, and the last's end, and all structs in a row."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return [0, *sizes.cumsum().tolist()], lists.flatten()


ITEMS = "doc_key string, page int, item int, kind string, source_req_id string, raw string, top double, bottom double"


def page_blocks(lines: DataFrame) -> DataFrame:
    """Visual lines without noise to blocks, in the order of pages: (doc_key, pos, text, start, end, kind, section, location, paragraph, page, source_req_id, requirement_text, top, bottom).

    ``text`` is normalized; that of a table row is its id and its requirement. Spans count
    the texts, two characters apart. A row's location has its page, section and number among
    the document's rows; a heading's its page and itself; a paragraph's its page.
    """
    head = is_heading(normalize_text(F.col("text")))
    held = F.array_sort(F.collect_list(F.struct("line", "y0", "y1", "text", head.alias("heading"), "words")))
    pages = lines.groupBy(F.col("doc_key").cast("string").alias("doc_key"), F.col("page").cast("int").alias("page")).agg(held.alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            begins, lines = _parts(batch.column(2))
            y0, y1, text, heading = (lines.field(name).to_pylist() for name in ("y0", "y1", "text", "heading"))
            word_begins, words = _parts(lines.field("words"))
            said = list(zip(words.field("x").to_pylist(), words.field("word").to_pylist()))
            whole = [Line(*rest, bool(head), said[a:b]) for *rest, head, a, b in zip(y0, y1, text, heading, word_begins, word_begins[1:])]
            for key, page, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), begins, begins[1:]):
                of_page = whole[a:b]
                for k, (kind, row_id, text_of, first, last) in enumerate(page_items(of_page)):
                    out.append((key, page, k, kind, row_id, text_of, of_page[first].y0, of_page[last].y1))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=[x.split()[0] for x in ITEMS.split(", ")])

    down = Window.partitionBy("doc_key").orderBy("page", "item")
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    items = pages.mapInArrow(run, ITEMS).withColumn("said", normalize_text(F.col("raw")))
    items = items.withColumn("text", F.when(F.col("kind") == "table_row", F.concat_ws(" ", "source_req_id", "said")).otherwise(F.col("said")))
    end = F.sum(F.length("text") + BETWEEN).over(so_far) - BETWEEN
    section = F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(down)
    row = F.sum((F.col("kind") == "table_row").cast("int")).over(so_far)
    placed = items.withColumn("end", end.cast("int")).withColumn("section", section).withColumn("row", row).withColumn("pos", (F.row_number().over(down) - 1).cast("int"))
    place = F.concat(F.lit("page="), F.col("page"))
    location = (
        F.when(F.col("kind") == "table_row", F.concat(place, F.lit(",section="), F.coalesce("section", F.lit("")), F.lit(",row="), F.col("row")))
        .when(F.col("kind") == "heading", F.concat(place, F.lit(",section="), F.col("text")))
        .otherwise(place)
    )
    return placed.select(
        "doc_key", "pos", "text", (F.col("end") - F.length("text")).alias("start"), "end", "kind", "section", location.alias("location"), (F.col("pos") + 1).alias("paragraph"), "page",
        "source_req_id", F.when(F.col("kind") == "table_row", F.col("said")).alias("requirement_text"), F.round("top", 2).alias("top"), F.round("bottom", 2).alias("bottom"),
    )
