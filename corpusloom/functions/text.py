"""Scalar text functions as Column expressions.

Whitespace follows Python's ``str.isspace`` so that results do not depend on
the ASCII-only ``\\s`` of the Java regex engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace and line-break characters of Python strings.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_BREAK = r"(?:\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029])"

# Formats and defaults that results are compared on.
ELLIPSIS = "…"
PREVIEW_PLACEHOLDER = " …"
SHORTEN_PLACEHOLDER = " [...]"
NOTE_TEMPLATE = "### {header}\n{body}"
PASSAGE = "**Passage %d** — %s\n\n%s\n"
DEFAULT_TITLE = "untitled"
DEFAULT_HEADER_PATH = "/"
QA_PROMPT = "Given Context: %s Give the best full answer amongst the option to question %s"
SUMMARY_PROMPT = "Write a summary of the following, including as many key details as possible: %s:"


def strip(c: Column) -> Column:
    """Trim all whitespace, not only spaces."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalize(c: Column) -> Column:
    """Trim, then collapse each whitespace run to one space."""
    return F.regexp_replace(strip(c), f"{SPACE}+", " ")


def clean_basic(c: Column) -> Column:
    """Trim, turn three dots into an ellipsis, collapse runs of spaces."""
    return F.regexp_replace(F.replace(strip(c), F.lit("..."), F.lit(ELLIPSIS)), " {2,}", " ")


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Whitespace-separated words; NULL counts as 0."""
    return F.coalesce(F.size(words(F.coalesce(c, F.lit("")))), F.lit(0)).cast("bigint")


def tokens_ceil(c: Column) -> Column:
    """About four characters per token, rounded up; 0 for empty text."""
    n = F.coalesce(F.length(c), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((n + 3) / 4))).cast("bigint")


def tokens_floor(c: Column) -> Column:
    """About four characters per token, rounded down, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("bigint")


def shorten(c: Column, width: int, placeholder: str = SHORTEN_PLACEHOLDER) -> Column:
    """Collapse whitespace and cut at a word so that text plus placeholder fit."""
    flat = normalize(c)
    room = width - len(placeholder)
    head = F.regexp_extract(flat, "^(.{1,%d})(?= )" % room, 1)
    cut = F.when(head == "", placeholder.lstrip()).otherwise(F.concat(head, F.lit(placeholder)))
    return F.when(F.length(flat) <= width, flat).otherwise(cut)


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def flatten_lines(c: Column) -> Column:
    """Join the lines of a text with single spaces; a final break adds none."""
    return F.regexp_replace(F.regexp_replace(c, LINE_BREAK + r"\z", ""), LINE_BREAK, " ")


def newlines_to_spaces(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


def section_block(header: Column, body: Column, template: str = NOTE_TEMPLATE) -> Column:
    """Fill a ``{header}`` / ``{body}`` template."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = min((i for i in (rest.find("{header}"), rest.find("{body}")) if i >= 0), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        if at:
            parts.append(F.lit(rest[:at]))
        name = "{header}" if rest.startswith("{header}", at) else "{body}"
        parts.append(header if name == "{header}" else F.coalesce(body, F.lit("")))
        rest = rest[at + len(name):]
    return F.concat(*parts)


def header_of_list(c: Column) -> Column:
    """Header given as a list: its first entry, or the default title."""
    return F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(DEFAULT_TITLE))


def header_or_default(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(DEFAULT_TITLE))


def title_or_default(c: Column) -> Column:
    return F.coalesce(c, F.lit(DEFAULT_TITLE))


def truthy(c: Column) -> Column:
    """NULL, an empty string and the number 0 count as missing."""
    s = c.cast("string")
    return F.when((s == "") | (s == "0"), None).otherwise(s)


def citation_label(rank: Column, *candidates: Column) -> Column:
    """First non-empty candidate, else ``node-{rank}``."""
    fallback = F.concat(F.lit("node-"), rank.cast("string"))
    return F.coalesce(*[truthy(c) for c in candidates], fallback)


def passage_block(rank: Column, label: Column, body: Column) -> Column:
    return F.format_string(PASSAGE, rank.cast("int"), label, body)


def iso_seconds(ts_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM-dd'T'HH:mm:ss")


def iso_date(ts_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM-dd")


def with_instruction(question: Column, instruction: str) -> Column:
    return F.concat(question, F.lit("\n\n" + instruction))


def qa_prompt(context: Column, question: Column) -> Column:
    return F.format_string(QA_PROMPT, context, question)


def summary_prompt(context: Column) -> Column:
    return F.format_string(SUMMARY_PROMPT, context)
