"""Page scan against a replay of its rules, line by line."""

import random
import re

from pyspark.sql import Row

from attestra.sources import pages
from attestra.sources.pages import Line, page_items

WORD = "doc_key string, page int, page_height double, x double, y0 double, y1 double, word string"
HEIGHT = 842.0


def replay(lines):
    """All table rows of a page first, header by header; then its lines again, with what the rows have taken left out."""
    left = lambda k, split: " ".join(w for x, w in lines[k].words if x < split)
    right = lambda k, split: " ".join(w for x, w in lines[k].words if x >= split)
    is_header = lambda k: [w.lower() for _, w in lines[k].words[:2]] in (["id", "requirement"], ["id", "acceptance"])
    whole = lambda t: re.fullmatch(r"[A-Z][A-Z]+(-[A-Z0-9]+)+", t)
    part = lambda t: re.fullmatch(r"[A-Z][A-Z]+(-[A-Z0-9]+)*-", t)
    n, rows, taken, k = len(lines), {}, set(), 0
    while k < n:
        if not is_header(k):
            k += 1
            continue
        split = lines[k].words[1][0] - 3
        taken.add(k)
        k += 1
        while k < n and not lines[k].heading and not is_header(k):
            name = left(k, split)
            if name == "":
                k += 1
                continue
            if part(name):
                for j in range(k + 1, min(k + 4, n)):
                    if left(j, split):
                        name += left(j, split) if left(j, split).isdigit() else ""
                        break
            stop = k + 1
            while stop < n and not lines[stop].heading and not whole(left(stop, split)) and not part(left(stop, split)):
                stop += 1
            text = " ".join(t for t in (right(j, split) for j in range(k, stop)) if t)
            if not whole(name) or not text:
                break
            rows[k] = (name, text, stop - 1)
            taken |= set(range(k, stop))
            k = stop
    out, held = [], []

    def flush():
        if held:
            out.append(("paragraph", None, "\n".join(lines[j].text for j in held), held[0], held[-1]))
            held.clear()

    for k in range(n):
        if k in rows:
            flush()
            out.append(("table_row", rows[k][0], rows[k][1], k, rows[k][2]))
        elif k in taken:
            flush()
        elif lines[k].heading:
            flush()
            out.append(("heading", None, lines[k].text, k, k))
        else:
            if held and lines[k].y0 - lines[held[-1]].y1 > 12:
                flush()
            held.append(k)
    flush()
    return out


def random_page(rng):
    """Words of a page in lines: headers, ids (parted ones too), cells, headings, and prose."""
    y, lines = 60.0, []
    for _ in range(rng.randint(1, 25)):
        split = rng.choice([120.0, 150.0])
        kind = rng.choice(["head", "id", "id", "part", "number", "cell", "cell", "left", "prose", "title"])
        words = {
            "head": [(40.0, rng.choice(["ID", "Id"])), (split, rng.choice(["Requirement", "Acceptance", "Other"]))],
            "id": [(40.0, f"BR-COM-{rng.randint(1, 9):03d}"), (split, "the"), (split + 30, rng.choice(["lock", "door"]))][: rng.randint(1, 3)],
            "part": [(40.0, "BR-COM-"), (split + 1, "shall")][: rng.randint(1, 2)],
            "number": [(40.0, rng.choice(["002", "x7", "12"])), (split, "open")][: rng.randint(1, 2)],
            "cell": [(split, "more"), (split + 40, "words")],
            "left": [(40.0, "plain"), (70.0, "text")],
            "prose": [(30.0 + 20 * k, w) for k, w in enumerate("all of this is prose".split())],
            "title": [(40.0, f"{rng.randint(1, 4)}.{rng.randint(1, 9)}"), (70.0, "Heading")],
        }[kind]
        lines.append((y, words))
        y += rng.choice([11.0, 12.0, 30.0])
    return lines


def as_lines(page):
    text = lambda words: " ".join(w for _, w in words)
    return [Line(y, y + 9, text(words), bool(re.match(r"[1-9]\d*(\.\d+)*\.?\s+\S", text(words))), words) for y, words in page]


def test_items_equal_a_replay_on_random_pages():
    rng, kinds = random.Random(17), set()
    for _ in range(3_000):
        lines = as_lines(random_page(rng))
        got = list(page_items(lines))
        assert got == replay(lines)
        kinds |= {(kind, row is not None and row.count("-")) for kind, row, *_ in got}
    assert {("table_row", 2), ("heading", False), ("paragraph", False)} <= kinds


def test_blocks_of_documents_equal_a_replay(spark):
    rng = random.Random(18)
    docs = {f"d{d}": [random_page(rng) for _ in range(3)] for d in range(12)}
    words = [(d, p, HEIGHT, x, y, y + 9, w) for d, of in docs.items() for p, page in enumerate(of, 1) for y, line in page for x, w in line]
    got = pages.page_blocks(pages.without_page_noise(pages.page_lines(spark.createDataFrame(words, WORD).repartition(5)))).orderBy("doc_key", "pos").collect()
    want = []
    for d in sorted(docs):
        at, section, row, pos = 0, None, 0, 0
        for p, page in enumerate(docs[d], 1):
            for kind, row_id, text, first, last in replay(as_lines(page)):
                text = f"{row_id} {text}" if kind == "table_row" else text
                row += kind == "table_row"
                section = text if kind == "heading" else section
                place = {"table_row": f"page={p},section={section or ''},row={row}", "heading": f"page={p},section={text}", "paragraph": f"page={p}"}[kind]
                want.append((d, pos, text, at, at + len(text), kind, section, place, pos + 1, p, row_id, page[first][0], page[last][0] + 9))
                at, pos = at + len(text) + 2, pos + 1
    columns = ("doc_key", "pos", "text", "start", "end", "kind", "section", "location", "paragraph", "page", "source_req_id", "top", "bottom")
    assert [tuple(r[c] for c in columns) for r in got] == want


def test_parted_ids_headings_within_tables_and_page_ends(spark):
    body = [
        (1, 100.0, [(40.0, "ID"), (120.0, "Requirement")]), (1, 112.0, [(40.0, "BR-COM-"), (120.0, "The"), (140.0, "lock")]), (1, 120.0, [(40.0, "002"), (120.0, "shall"), (150.0, "open")]),
        (1, 140.0, [(40.0, "2"), (60.0, "Doors")]), (1, 160.0, [(40.0, "BR-COM-003"), (120.0, "prose")]), (2, 100.0, [(40.0, "BR-COM-004"), (120.0, "too")]),
    ]
    df = spark.createDataFrame([("d", p, HEIGHT, x, y, y + 8, w) for p, y, line in body for x, w in line], WORD)
    got = pages.page_blocks(pages.page_lines(df)).orderBy("pos").collect()
    assert [(r["kind"], r["text"], r["location"]) for r in got] == [
        ("table_row", "BR-COM-002 The lock shall open", "page=1,section=,row=1"), ("heading", "2 Doors", "page=1,section=2 Doors"),
        ("paragraph", "BR-COM-003 prose", "page=1"), ("paragraph", "BR-COM-004 too", "page=2"),
    ]
    assert (got[0]["requirement_text"], got[0]["top"], got[0]["bottom"]) == ("The lock shall open", 100.0 + 12, 128.0)


def test_noise_is_compared_normalized(spark):
    words = [("d", p, HEIGHT, 40.0 + 30 * k, y, y + 8, w) for p in (1, 2) for y, line in ((20.0, ["Draft ", "copy"] if p == 1 else ["Draft", "copy"]), (100.0, [f"body{p}"]), (800.0, [f"{p}", "/", "2"])) for k, w in enumerate(line)]
    lines = pages.without_page_noise(pages.page_lines(spark.createDataFrame(words, WORD)))
    assert sorted(r["text"] for r in lines.collect()) == ["body1", "body2"]


def test_no_words(spark):
    assert pages.page_blocks(pages.without_page_noise(pages.page_lines(spark.createDataFrame([], WORD)))).count() == 0


def test_words_dealt_by_document_are_dealt_no_more_and_read_once(spark):
    words = [("d", p, HEIGHT, 40.0, y, y + 8, w) for p in (1, 2) for y, w in ((20.0, "Draft"), (100.0, f"body{p}"))]
    dealt = spark.createDataFrame(words, WORD).repartition(3, "doc_key")
    plan = pages.without_page_noise(pages.page_lines(dealt))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan ") == 1


def test_page_numbers_count_as_texts_of_edges(spark):
    at = [(1, 20.0, "3 / 9"), (2, 800.0, "3 / 9"), (3, 100.0, "3 / 9"), (None, 20.0, "3 / 9")]
    words = spark.createDataFrame([(d, p, HEIGHT, 40.0, y, y + 8, w) for d in ("d", None) for p, y, w in at], WORD)
    got = pages.without_page_noise(pages.page_lines(words)).select("doc_key", "page", "y0").collect()
    assert sorted(map(str, got)) == sorted(map(str, [Row(doc_key="d", page=3, y0=100.0), Row(doc_key="d", page=None, y0=20.0), *(Row(doc_key=None, page=p, y0=y) for p, y in ((1, 20.0), (3, 100.0), (None, 20.0)))]))


def test_a_table_reads_the_words_of_a_line_once_for_its_cells():
    class Counted(list):
        read = 0

        def __iter__(self):
            Counted.read += 1
            return super().__iter__()

    rows = [[(40.0, "ID"), (120.0, "Requirement")], *([(40.0, f"BR-{k}"), (120.0, "said")] for k in range(200))]
    lines = [Line(20.0 * k, 20.0 * k + 9, " ".join(w for _, w in words), False, Counted(words)) for k, words in enumerate(rows)]
    assert [x[:3] for x in page_items(lines)] == [("table_row", f"BR-{k}", "said") for k in range(200)]
    assert Counted.read <= 2 * len(rows)
