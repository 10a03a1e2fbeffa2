import datetime as dt

from tarnlight import cli
from tarnlight.operators import fulltext, ingest, text_index
from tarnlight.sources import config, files
from tarnlight.streaming.ingest import watch

WHEN = [dt.datetime(2024, 1, d, tzinfo=dt.timezone.utc) for d in range(1, 9)]


def embed(texts):
    return [[float(len(t)), 1.0] for t in texts]


def write(folder, name, words):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(f"# {name}\n" + " ".join(f"{name[0]}{i}" for i in range(words)), encoding="utf-8")


def run(spark, store, folder, when, **options):
    found = files.scan(spark, str(folder))
    matched = found.selectExpr("'n' AS lookup", "path")
    return ingest.index(store, matched, files.chunked(found, "n", "text"), embed, when, **options).collect()


def test_runs_find_only_what_changed(spark, tmp_path):
    notes, store = tmp_path / "notes", ingest.Store(spark, str(tmp_path / "store"))
    for name in ("a.md", "sub/b.markdown", "c.md"):
        write(notes, name, 30)
    (notes / "skipped.txt").write_text("no note")
    first = run(spark, store, notes, WHEN[0])[0]
    assert (first["matched"], first["created"], first["skipped"]) == (3, 3, 0) and store.last_scan() == WHEN[0]
    write(notes, "a.md", 31)
    (notes / "c.md").rename(notes / "d.md")
    second = run(spark, store, notes, WHEN[1])[0]
    assert (second["created"], second["reused"], second["skipped"], second["errors"]) == (1, 1, 1, 0)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in store.chunks().collect()) == ["a.md", "b.markdown", "d.md"]


def test_bad_files_keep_their_chunks_and_the_scan_time(spark, tmp_path):
    notes, store = tmp_path / "notes", ingest.Store(spark, str(tmp_path / "store"))
    write(notes, "a.md", 30)
    run(spark, store, notes, WHEN[0])
    (notes / "a.md").write_bytes(b"\xff\xfe\xff")
    row = run(spark, store, notes, WHEN[1])[0]
    assert row["errors"] == 1 and store.last_scan() == WHEN[0] and store.chunks().count() == 1


def test_an_empty_scan_prunes_nothing(spark, tmp_path):
    notes, store = tmp_path / "notes", ingest.Store(spark, str(tmp_path / "store"))
    write(notes, "a.md", 30)
    run(spark, store, notes, WHEN[0])
    (notes / "a.md").unlink()
    run(spark, store, notes, WHEN[1])
    assert store.chunks().count() == 1 and store.last_scan() == WHEN[0]
    run(spark, store, notes, WHEN[2], allow_empty_prune=True)
    assert store.chunks().count() == 0 and store.last_scan() == WHEN[2]


def test_the_text_index_follows_the_chunks(spark, tmp_path):
    """After additions, changes and prunes the index counts what a pass over the texts counts."""
    notes, store = tmp_path / "notes", ingest.Store(spark, str(tmp_path / "store"))
    assert store.text_index() is None and store.row_count() == 0 and not store.vectors_ready()
    phrases = [["a1"], ["b2", "b3"], ["a1", "a1"], ["nowhere"]]
    for step in range(3):
        if step == 0:
            for name in ("a.md", "b.md", "c.md"):
                write(notes, name, 30)
        elif step == 1:
            (notes / "a.md").write_text("# a\n" + "a1 á1 A1, b2 b3 b2 b3 " + "x y " * 20, encoding="utf-8")
            (notes / "c.md").unlink()
        else:
            write(notes, "d.md", 50)
            (notes / "b.md").unlink()
        run(spark, store, notes, WHEN[step])
        counted, stats = text_index.found(store.text_index(), phrases)
        want = fulltext.counts(store.chunks(), phrases)
        rows = lambda df: sorted((*r[:4], tuple(r["f"])) for r in df.where("exists(f, x -> x > 0)").collect())
        assert rows(counted) == rows(want)
        assert [tuple(r) for r in stats.collect()] == [tuple(r) for r in fulltext.statistics(want, len(phrases)).select(*stats.columns).collect()]
        assert {r["path"] for r in store.text_index()[1].select("path").distinct().collect()} == {r["path"] for r in store.chunks().collect()}
    assert store.row_count() == store.chunks().count() and store.vectors_ready(2) and not store.vectors_ready(3)


def test_modes():
    assert files.build_mode("full", True, WHEN[0]) == files.build_mode("delta", False, None) == files.build_mode("delta", True, None) == "full"
    assert files.build_mode("delta", True, WHEN[0]) == "delta"


def test_stream_indexes_files_as_they_come(spark, tmp_path):
    notes, store = tmp_path / "notes", ingest.Store(spark, str(tmp_path / "store"))
    write(notes, "a.md", 30)
    for expected in (1, 2):
        watch(spark, str(notes), store, "n", "text", embed, checkpoint=str(tmp_path / "cp")).awaitTermination(120)
        assert store.chunks().count() == expected
        write(notes, "b.md", 40)


def test_configuration():
    import pytest

    data = {"paths": [{"name": "a", "db": "x@y@t", "searchDefault": True}, {"name": "b", "threshold": 0.5}]}
    c = config.parse_config(data)
    assert (c.lookups[0].db_file, c.lookups[0].db_table, c.lookups[1].threshold) == ("x@y", "t", 0.5)
    names = lambda xs: [x.name for x in xs]
    assert names(config.resolve_lookups(c, [" b ", "b", "", "zzz"])) == ["b"] and names(config.resolve_lookups(c, None)) == ["a"] and names(config.resolve_lookups(c, [], False)) == ["a", "b"]
    assert names(config.selected_for_map(c, "b")) == ["b"] == names(config.selected_for_map(c, '["b"]'))
    for bad in ([{"name": " "}], [{"name": "a"}, {"name": "a"}], [{"name": "a", "db": "x"}], [{"name": "a", "db": "x@1t"}]):
        with pytest.raises(config.ConfigError):
            config.parse_config({"paths": bad})
    with pytest.raises(config.ConfigError):
        config.selected_for_map(c, "zzz")


def test_command_line_functions(spark, tmp_path):
    write(tmp_path / "notes", "a.md", 30)
    write(tmp_path / "notes", "b.md", 60)
    c = config.parse_config({"paths": [{"name": "n", "reader": "text", "dir": str(tmp_path / "notes"), "db": f"{tmp_path / 'db'}@t"}]})
    assert cli.run_index(spark, c, embed)[0]["created"] == 2
    assert cli.run_index(spark, c, embed)[0]["created"] == 0
    rows = cli.run_query(spark, c, embed, "a1 a2", top=5)
    assert rows[0]["file"].endswith("a.md") and cli.shown(rows, "jsonl").count("\n") == 1 and cli.shown(rows, "text").startswith("1. ")
    plus = cli.run_query(spark, c, embed, "a1 a2", top=5, chat=lambda prompt: "b1, b2" if "Keywords" in prompt else "other words")
    assert {r["file"].rsplit("/", 1)[1] for r in plus} == {"a.md", "b.md"}
    assert cli.main(["query", "x", "-c", str(tmp_path / "none.json"), "--embedder", "json:loads"]) == 2
