"""Each query against its SQL on the small tables, and what has no SQL by its invariants."""

import glob
import os

import duckdb
import pytest

from tarnlight import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_equals_its_sql(spark, db, name):
    df = q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = db.execute(f"SELECT {', '.join(columns)} FROM ({q.SQL[name]})")
    want = sorted((tuple(map(normal, r)) for r in relation.fetchall()), key=repr)
    got = sorted((tuple(map(normal, r)) for r in df.select(columns).collect()), key=repr)
    assert got == want and (got or name == "embedding_reuse")


def test_entry_is_whole(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_readers_give_chunks_of_the_budget(spark):
    from tarnlight.functions.text import count_tokens

    for name in ("chunk_text_reader", "chunk_markdown_reader", "chunk_journal_reader"):
        rows = q.QUERIES[name](spark, SF)
        low, high, n = rows.select(count_tokens(rows.text).alias("t")).selectExpr("min(t)", "max(t)", "count(*)").first()
        assert 10 <= low and high <= 1010 and n > 100


def test_second_indexing_run_changes_nothing(spark):
    first, second = sorted(q.QUERIES["ingest_run"](spark, SF).collect(), key=lambda r: r["run"])
    assert first["created"] > 0 and first["skipped"] == 0
    assert second["created"] == second["reused"] == second["errors"] == 0 and second["skipped"] >= first["created"]


def test_sample_and_clusters(spark):
    assert q.QUERIES["random_sample"](spark, SF).count() == 3
    sims = {frozenset(r[:2]): r[2] for r in q.QUERIES["dup_edges"](spark, SF).collect()}
    members: dict[str, list[str]] = {}
    for r in q.QUERIES["dup_clusters"](spark, SF).collect():
        members.setdefault(r["cluster_id"], []).append(r["id"])
        assert r["avg_similarity"] <= r["max_similarity"] + 1e-6
    assert members
    for name, ids in members.items():
        assert name == "|".join(sorted(ids)) and len(ids) > 1
        assert all(frozenset((a, b)) in sims for a in ids for b in ids if a < b)


def test_communities_have_the_least_size(spark):
    rows = q.QUERIES["communities_of_graph"](spark, SF).collect()
    sizes: dict[int, int] = {}
    for r in rows:
        sizes[r["community"]] = sizes.get(r["community"], 0) + 1
    assert len(rows) == 500 and sorted(sizes) == list(range(1, len(sizes) + 1))
    assert min(sizes.values()) >= 12 or len(sizes) == 1
    assert [sizes[c] for c in sorted(sizes)] == sorted(sizes.values(), reverse=True)


def test_layout_and_terrain(spark):
    box = q.QUERIES["pca_layout"](spark, SF).selectExpr("min(x)", "max(x)", "min(y)", "max(y)").first()
    assert [round(v, 6) for v in box] == [-1, 1, -1, 1]
    rows = q.QUERIES["contours"](spark, SF).collect()
    ends: dict = {}
    for r in rows:
        for p in ((r["x1"], r["y1"]), (r["x2"], r["y2"])):
            ends[r["level"], p] = ends.get((r["level"], p), 0) + 1
    assert sum(n % 2 for n in ends.values()) < 0.02 * len(ends)  # lines are closed, but for rounding
    peaks = q.QUERIES["peak_anchors"](spark, SF).collect()
    assert {r["community"] for r in peaks} == set(range(10)) and max(r["rank"] for r in peaks) <= 3
    placed = q.QUERIES["mountain_layout"](spark, SF).collect()
    assert len(placed) == 500 and min(r["density_weight"] for r in placed) >= 0.35
