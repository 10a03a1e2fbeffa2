"""Text functions: the Column versions against those in Python, and the small ones by cases."""

from pyspark.sql import functions as F

from tarnlight.functions import chunking as C
from tarnlight.functions import text as T
from tarnlight.functions import vectors as V
from tarnlight.operators import duplicates, evaluation
from tarnlight.operators.fulltext import counted, terms
from tarnlight.plans import retrieval
from tarnlight.sources import config

SF = "/root/testdata/sf0.001"
HARD = ["", " ", "\n\n", "# One\n\n**bold** and [a](http://x/(y)) `code`\n- item\n", "一二三 four 5_6", "a\t b\n\n\n\nc", "> quote\n\n| a | b |\n|---|---|\n", "![img](x.png) <b>tag</b> --- ***", "~~gone~~ __under__ *it*", "```py\nx = 1\n```\nafter"]
FRONT = ["---\ntitle: A\nstatus: seed\n---\nbody", "---\ntitle: 'x: y'\n...\nbody", "no front", "---\nopen", "---\nstatus: \"evergreen\"\nstatus: b\n---\n", ""]


def both(spark, texts, column, python):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["x"] for r in rows.select("i", column(F.col("text")).alias("x")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == python(t), repr(t)


def tables(spark):
    docs = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    pages = [r[0] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    return docs + pages


def test_twins_agree(spark):
    """What the readers run in Python gives what the Column functions give, on all documents and pages."""
    texts = HARD + tables(spark)
    both(spark, texts, T.count_tokens, C.count_tokens)
    both(spark, texts, T.strip_markdown, C.strip_markdown)
    both(spark, texts, lambda t: T.strip_markdown(t, keep_headings=True), lambda t: C.strip_markdown(t, keep_headings=True))
    whole = [t for t in texts if t.strip()]
    both(spark, whole, lambda t: T.hard_pieces(t, 40), lambda t: C.hard_split(t, 40))
    fronts = FRONT + [f"---\ntitle: {i}\nstatus: s{i % 3}\n---\n{t}" for i, t in enumerate(texts[:50])]
    for key in ("title", "status"):
        both(spark, fronts, lambda t, key=key: T.frontmatter_value(T.frontmatter(t), key), lambda t, key=key: C.frontmatter_value(C.split_frontmatter(t)[0], key))


def test_diacritics_are_folded(spark):
    words = ["Čeština", "Őrült", "naïve", "été", "Ångström", "việt", "ELEVE", "Łódź"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(T.index_terms(F.col("w"))).collect()
    assert [r[0] for r in rows] == [["cestina"], ["orult"], ["naive"], ["ete"], ["angstrom"], ["viet"], ["eleve"], ["łodz"]] == [terms(w) for w in words]


def test_phrases_are_counted_with_overlaps(spark):
    df = spark.createDataFrame([(0, "a a a b a, of the of the OF THE"), (1, ""), (2, "ab a")], "i int, text string")
    got = {r["i"]: list(r["f"]) for r in counted(df, [["a"], ["a", "a"], ["of", "the"], ["the", "of"], ["b", "a", "of"]]).collect()}
    assert got == {0: [4, 2, 3, 2, 1], 1: [0] * 5, 2: [1, 0, 0, 0, 0]}


def test_small_functions(spark, tmp_path):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    chunks = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    assert [value(T.chunk_at(chunks, F.lit(i).cast("int"))) for i in (0, 2, -1, -3, 3, -4, None)] == ["a", "c", "c", "a", None, None, "a"]
    assert value(T.chunk_at(F.array().cast("array<string>"), F.lit(0))) is None
    assert [value(T.index_text(F.lit(t), F.lit(b))) for t, b in (("T", "*b*"), ("T", ""), ("", "b"), (None, "b"))] == ["T\n\nb", "T", "b", "b"]
    assert [value(T.concise_path(F.lit(p), "/home/me")) for p in ("/home/me/a.md", "\\home\\me\\b\\c.md", "/home/meagre/a.md", "/home/me")] == ["a.md", "b/c.md", "/home/meagre/a.md", "/home/me"]

    def color(text):
        h, units = 0, text.encode("utf-16-be")
        for i in range(0, len(units), 2):
            h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) & 0xFFFFFFFF
        return "#" + "".join(f"{(h >> s & 63) + 192:02x}" for s in (0, 8, 16))

    for text in ("", "note", "日本語 🙂", "x" * 300):
        assert value(T.light_color(F.lit(text))) == color(text)
    assert value(V.parsed(F.lit("[1, 2.5]"))) == [1.0, 2.5] and value(V.parsed(F.lit("no"))) is None
    assert value(V.parsed(V.dumped(F.array(F.lit(0.1), F.lit(-3.0))))) == [0.1, -3.0]
    path = str(tmp_path / "dismissed.txt")
    assert duplicates.dismissed(spark, path).count() == 0
    duplicates.dismiss(spark, path, "b|c", " a|b ", "")
    duplicates.dismiss(spark, path, "a|b", "d|e")
    assert sorted(r[0] for r in duplicates.dismissed(spark, path).collect()) == ["a|b", "b|c", "d|e"]
    keys = {evaluation.cache_key(b"c", [("n", "f", v)], limit=n) for v in (1, 2) for n in (10, 20)}
    assert len(keys) == 4 and evaluation.cache_key(b"c", [], a=1, b=2) == evaluation.cache_key(b"c", [], b=2, a=1)
    assert retrieval.extract_article(" ", lambda p: "x") == "" and retrieval.extract_article("text", lambda p: p[-4:]) == "text"
    (tmp_path / "c.json").write_text('{"paths": [{"name": "a", "db": "x@t"}]}')
    assert config.health(tmp_path / "c.json")["status"] == "ok" and len(config.health(tmp_path / "c.json")["configDigest"]) == 64


def test_report_counts_files_without_chunks(spark):
    chunks = spark.createDataFrame([("n", "a", 0, "h1", "w " * 60), ("n", "b", 0, "h2", "few"), ("n", "c", 0, "h2", "few")], "lookup string, path string, chunk int, hash string, text string")
    files = spark.createDataFrame([("n", p) for p in "abcd"] + [("m", "z")], "lookup string, path string")
    got = {r["lookup"]: tuple(r)[1:] for r in evaluation.chunk_report(chunks, files).collect()}
    assert got == {"n": (4, 3, 1, 3, 2, 0, 1), "m": (1, 0, 1, 0, 0, 0, 0)}
    assert sorted((r["issue"], r["path"]) for r in evaluation.samples(chunks).collect()) == [("duplicate", "c"), ("ok", "a"), ("small", "b"), ("small", "c")]


def test_cells_find_the_nearest(spark, monkeypatch):
    """Against brute force: recall of 0.9 at least, every vector in a cell, exact similarities; blocks change nothing."""
    from tarnlight.operators import vector_search as vs

    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    cells = vs.fitted(vectors, 10)
    assert cells.probes < 0.9 * len(cells.centroids)
    rows = lambda df: {(r["id"], r["other"]): r["sim"] for r in df.collect()}
    want, got = rows(vs.all_pairs(vectors, k=10)), rows(vs.by_cells(vectors, 10, cells))
    assert len(got) == len(want) and len({a for a, _ in got}) == vectors.count()
    assert sum(p in got for p in want) >= 0.9 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got if p in want)
    monkeypatch.setattr(vs, "BLOCK", 16)
    assert rows(vs.by_cells(vectors, 10, cells)).keys() == got.keys()
    assert rows(vs.neighbours(vectors, 10, exact_rows=100)).keys() == got.keys()
    assert vs.neighbours(vectors.limit(0), 10).count() == 0
