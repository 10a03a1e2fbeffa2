"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnlight.functions.patterns import EMPHASIS, EXCERPT, HEADING_MARK, LINK, MARKDOWN

BUDGET_TOKEN = r"\p{IsHan}|[\p{L}\p{N}]+|\S"
PLAN_TOKEN = r"[\p{L}\p{N}_]+"
INDEX_TERM = r"[\p{L}\p{N}]+"


def _accents() -> tuple[str, str]:
    """Letters in lower case that are another one with marks, and those; then the marks themselves, which stand for nothing."""
    pairs = []
    for c in map(chr, range(0xC0, 0x2000)):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if c == c.lower() and len(bare) == 1 and bare != c and unicodedata.category(c)[0] == "L":
            pairs.append((c, bare))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def lit(x: str) -> Column:
    return F.lit(x)


def count_tokens(text: Column) -> Column:
    """Tokens of the chunk budget: single Han characters, runs of letters and digits, other marks. Null: 0."""
    return F.coalesce(F.regexp_count(text, lit(BUDGET_TOKEN)), F.lit(0))


def plan_token_count(text: Column) -> Column:
    """Tokens by which a query counts as long: runs of letters, digits and underscores."""
    return F.coalesce(F.regexp_count(text, lit(PLAN_TOKEN)), F.lit(0))


def folded(text: Column) -> Column:
    """Lower case without accents, as the full-text index has it."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def index_terms(text: Column) -> Column:
    """Terms of the full-text index, in order, with repeats."""
    return F.regexp_extract_all(folded(F.coalesce(text, lit(""))), lit(INDEX_TERM), F.lit(0))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def brief(text: Column, limit: int = 300) -> Column:
    """Squeezed text; beyond limit characters its first limit - 3 and '...'. A limit of 3 or less shortens nothing."""
    flat = squeeze(text)
    if limit <= 3:
        return flat
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.left(flat, F.lit(limit - 3))), lit("..."))).otherwise(flat)


def path_id(path: Column) -> Column:
    """The last two parts of a path."""
    return F.array_join(F.slice(F.split(path, "/"), F.greatest(F.lit(-2), -F.size(F.split(path, "/"))), F.lit(2)), "/")


def note_url(path: Column, url: Column, empty_is_none: bool = False) -> Column:
    """url and the file's stem; without a url file:// and the path. An empty url counts as one unless empty_is_none."""
    there = url.isNotNull() & (url != "") if empty_is_none else url.isNotNull()
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.when(there, F.concat(url, stem)).otherwise(F.concat(lit("file://"), path))


def strip_link_urls(text: Column) -> Column:
    """[label](url) as label; the url may hold one pair of parentheses."""
    return F.regexp_replace(text, LINK, "$1")


def strip_markdown(text: Column, keep_headings: bool = False, compact: bool = True) -> Column:
    """Text without the marks of Markdown; see chunking.strip_markdown for the same in Python."""
    s = F.coalesce(text, lit(""))
    for pattern, new in MARKDOWN if keep_headings else [*MARKDOWN, (HEADING_MARK, "")]:
        s = F.regexp_replace(s, pattern, new)
    s = F.regexp_replace(s, EMPHASIS, "")
    lines = F.transform(F.split(s, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"^\s+|\s+$", ""))
    joined = F.array_join(lines, "\n")
    if compact:
        joined = F.regexp_replace(joined, r"\n{3,}", "\n\n")
    return F.regexp_replace(joined, r"^\s+|\s+$", "")


def frontmatter(text: Column) -> Column:
    """The lines between an opening --- line and a closing --- or ... line; null without them."""
    found = F.regexp_extract(text, r"(?s)\A---[ \t\r]*\n((?:(?!---[ \t\r]*(?:\n|\z)|\.\.\.[ \t\r]*(?:\n|\z)).*?\n)*?)(?:---|\.\.\.)[ \t\r]*(?:\n|\z)", 1)
    has = text.rlike(r"(?s)\A---[ \t\r]*\n(?:.*\n)?(?:---|\.\.\.)[ \t\r]*(?:\n|\z)")
    return F.when(has, found)


def frontmatter_value(block: Column, key: str) -> Column:
    """First value of a key in the frontmatter, without one pair of quotes; null if there is none."""
    raw = F.regexp_extract(block, rf"(?m)^\s*{key}\s*:[ \t]*(\S.*?)\s*$", 1)
    bare = F.regexp_replace(raw, r"""^"(.*)"$|^'(.*)'$""", "$1$2")
    return F.when(block.rlike(rf"(?m)^\s*{key}\s*:[ \t]*\S"), bare)


def skipped_by_status(status: Column) -> Column:
    """Notes without a status, or with the status seed, are not indexed."""
    return status.isNull() | (status == "") | (F.lower(status) == "seed")


def extraction_groups(text: Column) -> Column:
    """Groups of an extraction: parts between blank lines, trimmed, none empty."""
    parts = F.split(text, r"\n\s*\n+")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def label_excerpt(text: Column, limit: int = 120) -> Column:
    s = F.coalesce(text, lit(""))
    for pattern, new in EXCERPT:
        s = F.regexp_replace(s, pattern, new)
    return F.trim(F.left(squeeze(s), F.lit(limit)))


def map_snippet(text: Column, limit: int = 360) -> Column:
    flat = squeeze(F.coalesce(text, lit("")))
    return F.concat(F.trim(F.left(flat, F.lit(limit))), F.when(F.length(flat) > limit, lit("...")).otherwise(lit("")))


def hard_pieces(text: Column, limit: int) -> Column:
    """Pieces of at most limit budget tokens, each token with the white space after it; without tokens, runs of limit characters."""
    tokens = F.regexp_extract_all(text, lit(rf"(?:{BUDGET_TOKEN})\s*"), F.lit(0))
    count = F.ceil(F.size(tokens) / limit).cast("int")
    parts = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(tokens, (i - 1) * limit + 1, F.lit(limit)), ""))
    chars = F.regexp_extract_all(text, lit(rf"(?s).{{1,{limit}}}"), F.lit(0))
    return F.when(F.size(tokens) > 0, parts).otherwise(chars)


def chunk_at(chunks: Column, at: Column) -> Column:
    """A chunk of a list by its place from 0, or from the end for a negative one; null place: the first, out of range: null."""
    i = F.coalesce(at, F.lit(0))
    return F.try_element_at(chunks, F.when(i < 0, i).otherwise(i + 1).cast("int"))


def index_text(title: Column, body: Column) -> Column:
    """A note's title over its body without marks, or the one that there is."""
    clean = strip_markdown(body)
    has = title.isNotNull() & (title != "")
    return F.when(has & (clean == ""), title).when(has, F.concat(title, lit("\n\n"), clean)).otherwise(clean)


def concise_path(path: Column, folder: str) -> Column:
    """An absolute path with slashes, without the folder if it lies there."""
    slashes = F.translate(path, "\\", "/")
    prefix = folder.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(slashes, lit(prefix)), F.substring(slashes, len(prefix) + 1, 2**31 - 1)).otherwise(slashes)


def light_color(text: Column) -> Column:
    """A light colour, #rrggbb, by a 32-bit polynomial hash of the UTF-16 units."""
    units = F.hex(F.encode(text, "UTF-16BE"))
    number = lambda i: F.conv(F.substr(units, i * 4 + 1, lit(4)), 16, 10).cast("long")
    at = F.when(F.length(units) > 0, F.sequence(lit(0), (F.length(units) / 4 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(at, lit(0).cast("long"), lambda s, i: (s * 31 + number(i)).bitwiseAND(lit(0xFFFFFFFF)))
    part = lambda shift: F.lower(F.hex(F.shiftright(h, shift).bitwiseAND(lit(63)) + 192))
    return F.concat(lit("#"), part(0), part(8), part(16))
