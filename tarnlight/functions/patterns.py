"""Patterns and what takes their place ($1 for a group), for Java, Python and RE2 alike."""

INSIDE = r"[^\]]"
BLANK = r"[ \t]"
LINE = rf"(?m)^{BLANK}*"
URL = r"https?://\S+"
TICKS = "`{1,3}"
ALIAS, WIKI = rf"\[{{2}}([^|\]]+)[|]({INSIDE}+)\]{{2}}", rf"\[{{2}}({INSIDE}+)\]{{2}}"
FLAT = "[^()]"
LINK = rf"\[({INSIDE}+)\]\((?:{FLAT}|\({FLAT}*\))*\)"

#: References, pictures, links, tags, addresses, quotes, tasks, lists, in the order in which they go.
MARKDOWN = [
    (rf"(?m)^\s*\[{INSIDE}+\]:\s+\S+.*$", ""),
    (rf"!\[{INSIDE}*\]\([^)]*\)", " "),
    (rf"!(?:\[{INSIDE}*\]){{2}}", " "),
    (r"\[{2}([^|\]]+)[|](.*?)\]{2}", "$2"),
    (WIKI, "$1"),
    (LINK, "$1"),
    (rf"\[({INSIDE}+)\]\[{INSIDE}*\]", "$1"),
    ("<[^>]+>", " "),
    (URL, " "),
    (rf"{LINE}>+{BLANK}?", ""),
    (rf"{LINE}[-*+]?{BLANK}*\[[ xX]\]{BLANK}+", ""),
    (rf"{LINE}[-*+]{BLANK}+", ""),
    (rf"{LINE}\d+\.{BLANK}+", ""),
]
HEADING_MARK = r"(?m)^\s{0,3}#+\s+"
EMPHASIS = "[_*`~]"
#: What is left out of an excerpt.
EXCERPT = [(URL, " "), (ALIAS, "$2"), (WIKI, "$1"), (rf"\[({INSIDE}+)\]\([^)]+\)", "$1"), (rf"{TICKS}[^`]*{TICKS}", " "), ("[-#*>_~]", " ")]
KEYWORD = r"[\x{4e00}-\x{9fff}]{2,4}|[a-zA-Z][-\w]{2,}"
