import random

from tarnlight.llm import chats

SCHEMA = "tree_id long, node_id long, parent_id long, role string, text string, score long"


def brute(rows, branches=chats.BRANCHES):
    nodes = {}
    for r in sorted(rows, key=lambda r: tuple((x is not None, x) for x in (r[2], r[3], r[4], r[5]))):
        if r[0] is not None and r[1] is not None:
            nodes.setdefault((r[0], r[1]), r)
    parents = {(t, r[2]) for (t, _), r in nodes.items() if r[2] is not None}
    paths = {}
    for key, r in nodes.items():
        if key in parents:
            continue
        path, seen = [], set()
        while key in nodes and key not in seen:
            seen.add(key)
            path.append(nodes[key])
            key = (key[0], nodes[key][2])
        if key in seen:
            continue
        paths.setdefault(r[0], []).append((-sum(x[5] or 0 for x in path), r[1], path[::-1]))
    out = set()
    for tree, found in paths.items():
        for b, (score, leaf, path) in enumerate(sorted(found, key=lambda f: f[:2])[:branches], 1):
            text = "".join(f"<|{r[3] or 'unknown'}|>\n{(r[4] or '').replace('<|', '< |')}<|end|>\n" for r in path)
            out.add((tree, b, leaf, len(path), -score, text))
    return out


def test_random_trees_and_awkward_rows(spark):
    rng, rows = random.Random(1), []
    for tree in range(25):
        for node in range(rng.randint(1, 40)):
            parent = None if not node else rng.choice([rng.randrange(node), node - 1])
            rows.append((tree, node, parent, rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "a <|end|> b"]), rng.choice([1, 2, None])))
    rows += [(100, 1, 2, "u", "x", 1), (100, 2, 1, "u", "y", 1), (100, 3, 2, "u", "below a cycle", 1), (101, 1, 77, "u", "lost parent", 1), (None, 1, None, "u", "t", 1), (102, None, None, "u", "t", 1)]
    rows += [(103, 1, None, "u", "twice", 1)] * 2 + [(104, i, i - 1 if i else None, "u", "deep", 1) for i in range(70)] + [(105, 1, 1, "u", "own parent", 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS top", "3 AS ids", "4 AS t")
    assert {tuple(r) for r in chats.conversations(df).collect()} == brute(rows)


def test_turns_become_trees(spark):
    turns = [(1, 0, "user", "a b"), (1, 1, "assistant", "c"), (1, 2, "assistant", "d e f"), (1, 3, "user", "g")]
    df = chats.replies(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert {r["node_id"]: (r["parent_id"], r["score"]) for r in df.collect()} == {0: (None, 2), 1: (0, 1), 2: (0, 3), 3: (2, 1)}
    best = chats.conversations(df, 1).first()
    assert (best["leaf_id"], best["score"], best["n_messages"]) == (3, 6, 3)


def test_awkward_turns(spark):
    """Nulls, repeats, empty and very long texts; the score counts every word."""
    long = "word " * 30_000
    turns = [(1, 0, "user", long), (1, 1, "assistant", long + "more"), (1, 2, "assistant", long), (1, 2, "user", "the same turn"), (1, 3, None, None), (1, 3, None, None), (1, 4, None, "")]
    turns += [(None, 0, "user", "x"), (2, None, "user", "x"), (3, 5, None, None)]
    df = chats.replies(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n", "2 AS tree_id", "3 AS score"))
    got = {(r["tree_id"], r["node_id"]): (r["parent_id"], r["score"]) for r in df.collect()}
    assert got == {(1, 0): (None, 30_000), (1, 1): (0, 30_001), (1, 2): (0, 30_000), (1, 3): (2, 0), (1, 4): (2, 0), (3, 5): (None, 0)}
    best = {(r["tree_id"], r["branch"]): (r["leaf_id"], r["score"], len(r["text"])) for r in chats.conversations(df).collect()}
    assert best[1, 1][:2] == (1, 60_001) and best[1, 2][:2] == (3, 60_000) and best[3, 1][:2] == (5, 0) and len(best) == 4
    rows = [(*r,) for r in df.collect()]
    assert {tuple(r) for r in chats.conversations(df).collect()} == brute(rows)


def test_empty_table(spark):
    assert chats.conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert chats.conversations(chats.replies(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
