"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no query terms.
STOP_WORDS = ("and", "are", "for", "from", "into", "should", "that", "the", "then", "this", "when", "with")
#: A sentence's end, with closing quotes and brackets; a numbered heading; an id and its text.
SENTENCE_END = r"[.!?]+[\"')\]]*(?=\s|$)"
HEADING = r"^[1-9]\d*(?:\.\d+)*\.?\s+\S"
ID_ROW = r"^([A-Z]{2,}(?:-[A-Z0-9]+)+) (.+)$"
#: Where a text has its lines cut.
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


#: White space other than the space: Unicode's, and the four separators of ASCII.
OTHER_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACES = f"[ {OTHER_SPACES}]+"


def normalize_text(text: Column) -> Column:
    """Blanks in a line become one space, lines are trimmed, runs of empty lines become one."""
    unified = F.regexp_replace(text, "\r\n?", "\n")
    lines = F.transform(F.split(unified, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\f\x0B]+", " ")))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), F.lit(" \n"))


def collapse(text: Column) -> Column:
    """White space of any kind becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(F.translate(text, OTHER_SPACES, " " * len(OTHER_SPACES)), "  +", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}|{SPACES}$", "")


def fold(text: Column) -> Column:
    """``collapse`` without case: lower case, and sharp s as two letters."""
    return F.regexp_replace(F.lower(collapse(text)), "ß", "ss")


def slug(name: Column) -> Column:
    """Lower-case letters and digits joined by hyphens; 'project' if nothing is left."""
    made = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", F.lit("project")).otherwise(made)


def collection_name(prefix: str, project: Column, longest: int = 63) -> Column:
    return F.substring(F.concat(F.lit(f"{prefix}-"), slug(project)), 1, longest)


def singular(token: Column) -> Column:
    return (
        F.when(token.endswith("ies") & (F.length(token) > 4), F.regexp_replace(token, "ies$", "y"))
        .when(token.endswith("s") & ~token.endswith("ss") & (F.length(token) > 3), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def pascal_title(title: Column) -> Column:
    words = F.regexp_extract_all(title, F.lit("([A-Za-z0-9]+)"), 1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.regexp_replace(w, "^.", ""))), "")


def sentences(text: Column) -> Column:
    """Pieces of the collapsed text that end a sentence, and what is left after the last."""
    pieces = F.regexp_extract_all(collapse(text), F.lit(f"(.*?{SENTENCE_END}|.+$)"), 1)
    return F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda s: s != "")


def is_one_sentence(text: Column) -> Column:
    """Whether the text is normalized, and the only end of a sentence is the text's end."""
    ends = F.regexp_extract_all(text, F.lit(f"({SENTENCE_END})"), 1)
    return (text == collapse(text)) & (F.size(ends) == 1) & text.rlike(f"(?:{SENTENCE_END})$")


def count_words(text: Column) -> Column:
    """Budget cost in words."""
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def count_quarters(text: Column) -> Column:
    """Budget cost of a quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def count_quarters_up(json: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(json) / 4).cast("int"))


def query_terms(text: Column, limit: int = 12, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """The first distinct words of three characters or more, a letter first, that are no stop words; lower-cased."""
    words = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z0-9_]{2,})"), 1), lambda w: F.lower(w))
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(*stop_words))), 1, limit)


def ipv4_literals(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?<![\d.])(\d{1,3}(?:\.\d{1,3}){3})(?![\d.])"), 1)
    return F.filter(found, lambda ip: F.forall(F.split(ip, r"\."), lambda octet: octet.cast("int") <= 255))


def is_heading(line: Column) -> Column:
    """A numbered line of 120 characters at most."""
    return (F.length(line) <= 120) & line.rlike(HEADING)


def is_safe_relative(path: Column) -> Column:
    return ~(path.rlike(r"^([/\\]|[A-Za-z]:)") | path.rlike(r"(^|[/\\])\.\.([/\\]|$)") | (F.trim(path) == ""))


def explicit_rows(text: Column, pattern: str = ID_ROW) -> Column:
    """Lines of an id and its text, as structs (id, text): each id at its first place, with the text of its last line."""
    lines = F.filter(F.transform(F.split(text, LINE_ENDS), collapse), lambda x: x.rlike(pattern))
    rows = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("id"), F.regexp_extract(x, pattern, 2).alias("text")))
    both = F.transform(F.array(rows), lambda r: F.struct(F.reverse(r).alias("rows"), F.reverse(F.transform(r, lambda x: x["id"])).alias("ids")))
    last = lambda b: F.transform(F.array_distinct(F.reverse(b["ids"])), lambda i: F.element_at(b["rows"], F.array_position(b["ids"], i).cast("int")))
    return F.element_at(F.transform(both, last), 1)  # as elements of an array of one, lines are read once and not once an id


def quote_candidates(text: Column) -> Column:
    """Texts of id rows, then sentences; each once, in that order."""
    return F.array_distinct(F.concat(F.transform(explicit_rows(text), lambda r: collapse(r["text"])), sentences(text)))
