"""Chunkers for Markdown, plain-text and journal notes.

Splitting is a fold over lines, paragraphs and tokens with a budget, so it runs
in Python, batch by batch; everything around it stays in Column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import regex

from tarnlight.functions import patterns

MAX_TOKENS, MIN_TOKENS, MIN_TAIL = 1000, 10, 0.05
GAP = r"[ \t\r\n\f\v]"
WORDS = r"\p{Han}|[\p{N}\p{L}]+"
TOKEN = regex.compile(rf"{WORDS}|(?!{GAP}).", regex.S)
PIECE = regex.compile(rf"(?:{WORDS}|(?!{GAP}).){GAP}*", regex.S)
INDENT = r"\s{0,3}"
FENCE = re.compile(rf"{INDENT}(```+|~~~+)")
HEADING = re.compile(rf"{INDENT}(#{{1,6}})\s+(.+?)\s*$")
SPACE = " \t\r\n\f\v\0"
SKIPPED_ENTRIES = ("\u7cbe\u529b", "\u611f\u6069")

RULES = [(re.compile(pattern, re.A), new.replace("$", "\\")) for pattern, new in patterns.MARKDOWN]
HEADING_MARK = re.compile(patterns.HEADING_MARK, re.A)


def count_tokens(text: str | None) -> int:
    """Tokens of the budget; none crosses a line feed, so that those of parts between line feeds add up."""
    return sum(len(TOKEN.findall(line)) for line in text.split("\n")) if text else 0


def strip_markdown(text: str | None, keep_headings: bool = False, compact: bool = True) -> str:
    if not text:
        return ""
    for pattern, new in RULES:
        text = pattern.sub(new, text)
    if not keep_headings:
        text = HEADING_MARK.sub("", text)
    text = re.sub(patterns.EMPHASIS, "", text)
    lines: list[str] = []
    for line in text.split("\n"):
        line = re.sub(r"[ \t]+", " ", line).strip(SPACE)
        if compact and not line and (not lines or not lines[-1]):
            continue
        lines.append(line)
    return "\n".join(lines).strip(SPACE)


def opened_fence(line: str) -> str | None:
    m = FENCE.match(line)
    return m[1] if m else None


def closes(line: str, fence: str) -> bool:
    return re.match(rf"\s{{0,3}}{re.escape(fence[0])}{{{len(fence)},}}\s*$", line) is not None


def with_fences(lines: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """(line, whether it belongs to a fenced block, its marks included)."""
    fence = None
    for line in lines:
        inside = fence is not None
        if inside:
            fence = None if closes(line, fence) else fence
        else:
            fence = opened_fence(line)
            inside = fence is not None
        yield line, inside


def drop_small_tail(chunks: list[str], limit: int) -> list[str]:
    return chunks[:-1] if len(chunks) > 1 and count_tokens(chunks[-1]) < limit * MIN_TAIL else chunks


def keep_large(chunks: list[str], least: int = MIN_TOKENS) -> list[str]:
    return [c for c in chunks if count_tokens(c) >= least]


def hard_split(text: str, limit: int) -> list[str]:
    pieces = PIECE.findall(text)
    if not pieces:
        return [text[i : i + limit] for i in range(0, len(text), limit)]
    limit = max(limit, 1)
    return ["".join(pieces[i : i + limit]) for i in range(0, len(pieces), limit)]


class Pack:
    """Greedy packing of parts under a token budget; a part but the first costs one more."""

    def __init__(self, glue: str, limit: int):
        self.glue, self.limit = glue, limit
        self.parts: list[str] = []
        self.tokens = 0
        self.out: list[str] = []

    def flush(self) -> None:
        if self.parts:
            self.out.append(self.glue.join(self.parts))
        self.parts, self.tokens = [], 0

    def add(self, part: str, tokens: int, keep_cost: bool = False) -> None:
        extra = 1 if self.parts else 0
        if self.parts and self.tokens + tokens + extra > self.limit:
            self.flush()
            extra = 0
        self.parts.append(part)
        self.tokens += tokens + (extra if keep_cost else 0)


def ruby_lines(text: str) -> list[str]:
    """Lines without the empty ones at the end."""
    lines = text.split("\n")
    while lines and not lines[-1]:
        lines.pop()
    return lines


def split_lines(text: str, limit: int) -> list[str]:
    pack = Pack("\n", limit)
    for line in ruby_lines(text):
        n = count_tokens(line)
        if n > limit:
            pack.flush()
            pack.out += hard_split(line, limit)
        else:
            pack.add(line, n)
    pack.flush()
    return pack.out


def split_tokens(text: str | None, limit: int = MAX_TOKENS) -> list[str]:
    """Paragraphs packed under limit tokens; a longer one fills what is left of the pack, then goes by lines and tokens."""
    if not text:
        return []
    if count_tokens(text) <= limit:
        return [text]
    pack = Pack("\n\n", limit)
    paragraphs = re.split(r"\n{2,}", text)
    while paragraphs and not paragraphs[-1]:
        paragraphs.pop()
    for para in paragraphs:
        n = count_tokens(para)
        if n <= limit:
            pack.add(para, n)
            continue
        if pack.parts:
            room = limit - pack.tokens
            if room > 0:
                first, *rest = hard_split(para, room) or [""]
                first = first.strip(SPACE)
                pack.parts += [first] if first else []
                para = "".join(rest).strip(SPACE)
            pack.flush()
        if para:
            pack.out += split_lines(para, limit)
    pack.flush()
    return drop_small_tail(pack.out, limit)


def split_frontmatter(raw: str) -> tuple[str | None, str]:
    """(lines between the marks, the text after them); (None, raw) without a closed frontmatter."""
    lines = raw.splitlines(keepends=True)
    if not lines or not re.match(r"---\s*$", lines[0]):
        return None, raw
    for i, line in enumerate(lines[1:], 1):
        if line.rstrip() in ("---", "..."):
            return "".join(lines[1:i]), "".join(lines[i + 1 :])
    return None, raw


def frontmatter_value(block: str | None, key: str) -> str | None:
    for line in (block or "").splitlines():
        name, _, value = line.partition(":")
        value = value.strip()
        if name.strip() == key and value:
            if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            return value
    return None


def heading_of(line: str) -> tuple[int, str] | None:
    m = HEADING.match(line)
    return (len(m[1]), strip_markdown(re.sub(r"\s+#+\s*$", "", m[2]))) if m else None


def markdown_sections(text: str, shift: int) -> list[tuple[list[str], str]]:
    """(heading path, cleaned body) of the sections; a heading without body is left to the next, unless it is last."""
    found, path, levels, lines = [], [], {}, []

    def clean() -> None:
        found.append((path, strip_markdown("\n".join(lines))))

    for line, fenced in with_fences(ruby_lines(text)):
        heading = None if fenced else heading_of(line)
        if heading is None:
            lines.append(line)
            continue
        if any(x.strip() for x in lines):
            clean()
        level = max(heading[0] + shift, 1)
        levels = {k: v for k, v in levels.items() if k < level} | {level: heading[1]}
        path, lines = [levels[k] for k in sorted(levels)], []
    if lines or path:
        clean()
    return found


def joined(path: list[str], body: str) -> str:
    return "\n\n".join([*path, body] if body else path)


def split_section(path: list[str], body: str, limit: int) -> list[str]:
    head = "\n\n".join(path)
    room = limit - count_tokens(head)
    if not path or room <= 0:
        return split_tokens(joined(path, body), limit)
    return [joined(path, part.strip(SPACE)) for part in split_tokens(body, room)] or [head]


def markdown_body(text: str, limit: int, shift: int = 0) -> list[str]:
    sections = [s for s in markdown_sections(text, shift) if joined(*s)] if text else []
    if len(sections) < 2:
        return split_section(*sections[0], limit) if sections else []
    pack = Pack("\n\n", limit)
    for path, body in sections:
        whole = joined(path, body)
        n = count_tokens(whole)
        if n > limit:
            pack.flush()
            pack.out += split_section(path, body, limit)
        else:
            pack.add(whole, n, keep_cost=True)
    pack.flush()
    return drop_small_tail(pack.out, limit)


def only_heading(title: str | None, body: str) -> tuple[str | None, str, int]:
    """A sole first-level heading takes the place of the title; the levels below move up by one."""
    if not title or not body:
        return title, body, 0
    found, kept = [], []
    for line, fenced in with_fences(body.splitlines(keepends=True)):
        heading = None if fenced else heading_of(line)
        if heading and heading[0] == 1:
            found.append(heading[1])
        else:
            kept.append(line)
    return (found[0], "".join(kept), -1) if len(found) == 1 else (title, body, 0)


def markdown_chunks(raw: str | None, limit: int = MAX_TOKENS, least: int = MIN_TOKENS) -> list[str]:
    """Chunks of a Markdown note; none without a status or with the status seed."""
    block, body = split_frontmatter(raw or "")
    status = frontmatter_value(block, "status")
    if not status or status.lower() == "seed":
        return []
    return keep_large(titled_chunks(frontmatter_value(block, "title"), body, limit), least)


def titled_chunks(title: str | None, body: str, limit: int = MAX_TOKENS) -> list[str]:
    title, body, shift = only_heading(title, body)
    if not title:
        return markdown_body(body, limit, shift)
    chunks = markdown_body(body, max(limit - count_tokens(title), 1), shift)
    return [f"{title}\n\n{c}" for c in chunks] or [title]


def without_metadata(text: str) -> str:
    """Text without the metadata lines of exported notes, outside of fenced blocks."""

    def metadata(line: str) -> bool:
        return line.strip() == "---" or line.startswith("- ") and ":" in line or line.startswith("  - [[") or line.lstrip().startswith("<")

    return "".join(line for line, fenced in with_fences(text.splitlines(keepends=True)) if fenced or not metadata(line))


HEADING_LINE = re.compile(r"\s{0,3}#{1,6}\s+\S+")


def text_sections(text: str) -> list[str]:
    sections: list[list[str]] = [[]]
    for line, fenced in with_fences(ruby_lines(text)):
        if not fenced and HEADING_LINE.match(line) and sections[-1]:
            sections.append([])
        sections[-1].append(line)
    return [s for s in (strip_markdown("\n".join(x).strip(SPACE), keep_headings=True) for x in sections) if s]


def split_text_section(section: str, limit: int) -> list[str]:
    if count_tokens(section) <= limit:
        return [section]
    head, _, body = section.partition("\n")
    room = limit - count_tokens(head)
    if not HEADING_LINE.match(head) or room <= 0:
        return split_tokens(section, limit)
    return [f"{head}\n{part}" for part in split_tokens(body.strip(SPACE), room)] or [head]


def text_body(text: str, limit: int, repeated: str) -> list[str]:
    shorter = max(limit - count_tokens(repeated), 1)

    def room(first: str) -> int:
        return limit if not repeated or first.startswith(repeated) else shorter

    sections = text_sections(text)
    if len(sections) < 2:
        return split_text_section(sections[0], room(sections[0])) if sections else []
    out: list[str] = []
    held: list[str] = []
    tokens = 0  # of the sections held
    for section in sections:
        n = count_tokens(section)
        if n > room(section):
            out += ["\n\n".join(held)] if held else []
            held, tokens = [], 0
            out += split_text_section(section, room(section))
        elif held and tokens + n > room(held[0]):
            out.append("\n\n".join(held))
            held, tokens = [section], n
        else:
            held.append(section)
            tokens += n
    out += ["\n\n".join(held)] if held else []
    return drop_small_tail(out, limit)


def text_chunks(raw: str | None, limit: int = MAX_TOKENS, least: int = MIN_TOKENS) -> list[str]:
    """Chunks of an exported plain note; its first heading is repeated on those that don't begin with it."""
    body = without_metadata(split_frontmatter(raw or "")[1])
    first = next((line.strip() for line, fenced in with_fences(body.splitlines()) if not fenced and re.match(r"#\s+\S+", line.strip())), "")
    head = strip_markdown(first, keep_headings=True)
    chunks = text_body(body, limit, head)
    return keep_large([c if not first or c.startswith(head) else f"{head}\n\n{c}" for c in chunks], least)


def journal_chunks(raw: str | None, limit: int = MAX_TOKENS, least: int = MIN_TOKENS) -> list[str]:
    """Chunks of a journal: its second-level sections of three lines or more, but for some headings."""
    out: list[str] = []
    entry: list[str] | None = None
    heading = ""

    def close() -> None:
        if entry is not None and len(entry) >= 3 and not any(k in heading for k in SKIPPED_ENTRIES):
            out.extend(split_tokens("\n".join(entry), limit))

    for line, fenced in with_fences(x for x in (raw or "").splitlines() if x.strip()):
        clean = strip_markdown(line, keep_headings=True, compact=False)
        if not fenced and line.startswith("## "):
            close()
            entry, heading = [clean], line[3:].strip()
        elif entry is not None and (fenced or not line.lstrip().startswith("<")):
            entry.append(clean)
    close()
    return keep_large(out, least)


READERS: dict[str, Callable[..., list[str]]] = {"text": text_chunks, "notion": text_chunks, "markdown": markdown_chunks, "md": markdown_chunks, "journal": journal_chunks}
