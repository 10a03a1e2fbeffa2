from tarnlight.functions import chunking as c

WORDS = lambda n, at=0: " ".join(f"w{i}" for i in range(at, at + n))


def note(body, title="The Title", status="evergreen"):
    return f'---\ntitle: "{title}"\nstatus: {status}\n---\n{body}'


def test_budget_tokens():
    assert c.count_tokens("你好abc") == 3 and c.count_tokens("abc你好") == 1 and c.count_tokens(None) == c.count_tokens("") == 0
    assert c.count_tokens("one-two (3)") == 6


def test_splitter_keeps_tokens_and_drops_small_tails():
    assert c.split_tokens(f"{WORDS(99)}\n\n{WORDS(4)}", 100) == [WORDS(99)]
    assert c.split_tokens(f"{WORDS(99)}\n\n{WORDS(5)}", 100) == [WORDS(99), WORDS(5)]
    parts = c.split_tokens(f"{WORDS(10)}\n\n{WORDS(190, 10)}", 100)
    assert [c.count_tokens(p) for p in parts] == [100, 100] and " ".join(parts).split() == WORDS(200).split()
    assert c.hard_split("", 5) == [] and c.split_tokens("") == []


def test_cleaning():
    assert c.strip_markdown("- [x] done [a](http://x/(y)) and [[p|label]] `code`") == "done a and label code"
    assert c.strip_markdown("# Head\n> quote", keep_headings=True) == "# Head\nquote"
    assert c.strip_markdown(None) == ""


def test_markdown_needs_a_status():
    body = f"# One\n{WORDS(20)}"
    assert c.markdown_chunks(note(body, status="")) == [] == c.markdown_chunks(note(body, status="Seed")) == c.markdown_chunks(body) == c.markdown_chunks(None)
    assert c.markdown_chunks(note(body)) == [f"One\n\n{WORDS(20)}"]


def test_markdown_headings():
    body = f"# A\n{WORDS(4)}\n# B\n{WORDS(4, 4)}\n## C\n{WORDS(4, 8)}"
    got = c.markdown_chunks(note(body, title="T"), 8, 1)
    assert got == [f"T\n\nA\n\n{WORDS(4)}", f"T\n\nB\n\n{WORDS(4, 4)}", f"T\n\nB\n\nC\n\n{WORDS(4, 8)}"]
    got = c.markdown_chunks(note(f"{WORDS(2)}\n\n## H\n{WORDS(9, 2)}", title="T"), 6, 1)
    assert all(c.count_tokens(x) <= 6 and x.startswith("T") for x in got)


def test_fences_hide_headings():
    text = "```\n# not a heading\n```\n# Real\nbody"
    assert [p for p, _ in c.markdown_sections(text, 0)] == [[], ["Real"]]
    assert list(c.with_fences(["~~~~", "# a", "~~~", "~~~~", "b"]))[-1] == ("b", False)


def test_text_notes_repeat_their_first_heading():
    raw = f"---\nx: y\n---\n# Top\n- key: value\n  - [[link]]\n<div>\n## One\n{WORDS(6)}\n## Two\n{WORDS(6, 6)}"
    got = c.text_chunks(raw, 12, 1)
    assert got[0].startswith("# Top") and all(x.startswith("# Top") for x in got) and "key" not in "".join(got)


def test_journal_entries():
    raw = "# Day\nbefore\n## Work\nline one\nline two\n\n<b>\n## 感恩\na\nb\nc\n## Short\nonly\n### Sub\n"
    assert c.journal_chunks(raw, 1000, 1) == ["## Work\nline one\nline two", "## Short\nonly\n### Sub"]
