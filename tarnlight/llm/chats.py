"""Reply trees as conversations: root-to-leaf paths by iterative self-joins, ranked by score.

Each round joins the table of partial paths with itself on the top of one and
the end of the other, which doubles their length: the number of rounds is the
logarithm of the deepest path. Only ids and sums travel; the ids of whole paths
are listed, and texts joined, for the chosen branches alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.shared import cut

BRANCHES = 3


def replies(turns: DataFrame) -> DataFrame:
    """(tree_id, node_id, parent_id, role, text, score) from (conv_id, turn, role, text).

    A turn answers the last turn of the run of another role before it, so that
    turns in a row by one role are alternatives. score: words of the text, all
    of them; 0 for a null or empty one. A null role is a role of its own. Rows
    with a null conv_id or turn are left out; of rows with the same conv_id and
    turn one is taken, the least by (role, text), nulls first. Other columns are
    not read; an empty table gives none.
    """
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null")
    rows = rows.withColumn("n", F.row_number().over(same)).where("n = 1").drop("n")
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = rows.withColumns({"prev_turn": F.lag("turn").over(w), "prev_role": F.lag("role").over(w)})
    change = F.when(~F.col("role").eqNullSafe(F.col("prev_role")), F.col("prev_turn"))
    parent = F.last(change, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    score = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long")
    return before.select(F.col("conv_id").alias("tree_id"), F.col("turn").alias("node_id"), parent.alias("parent_id"), "role", "text", score.alias("score"))


def conversations(messages: DataFrame, branches: int = BRANCHES) -> DataFrame:
    """(tree_id, branch, leaf_id, n_messages, score, text): the best branches of each tree, each as one conversation.

    messages: (tree_id, node_id, parent_id, role, text, score). The score of a
    path is the sum of its messages' scores, null as 0; ties go to the lesser
    leaf_id. A message whose parent is null or missing is a root. Of rows with
    the same tree and node one is taken, the least by (parent_id, role, text).
    Rows with a null tree_id or node_id and messages on a cycle or below one
    are in no path. A null role is 'unknown', a null text is empty; '<|' in a
    text becomes '< |', so that it can't be taken for a marker. An empty table
    gives none. Other columns are not read.

    First each message gets, by doubling, its score and length up to the root;
    what stands above it is enumerated, by the same jumps, for the leaves of the
    chosen branches alone.
    """
    w = Window.partitionBy("tree_id", "node_id").orderBy("parent_id", "role", "text", "score")
    rows = messages.select("tree_id", "node_id", "parent_id", "role", "text", "score").where("tree_id is not null and node_id is not null")
    rows = rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    there = rows.select(F.col("tree_id").alias("t"), F.col("node_id").alias("above"))
    linked = rows.join(there, F.expr("tree_id = t and parent_id = above"), "left")
    paths = cut(linked.select("tree_id", "node_id", F.col("above").alias("top"), F.coalesce("score", F.lit(0)).alias("score"), F.lit(1).alias("n_messages")))
    leaves = paths.join(paths.select(F.col("tree_id").alias("t"), F.col("top").alias("parent")).where("parent is not null").distinct(), F.expr("tree_id = t and node_id = parent"), "left_anti").select(F.col("tree_id").alias("t"), F.col("node_id").alias("leaf"))
    most = paths.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    jumps = []  # of 1, 2, 4 ... messages: (tree_id, node_id, top)
    for _ in range(most.bit_length() + 1):  # more rounds than any path without a cycle needs
        jump = paths.where("top is not null").select("tree_id", "node_id", "top")
        if jump.isEmpty():
            break
        jumps.append(jump)
        x, y = paths.alias("x"), paths.alias("y")
        joined = x.join(y, F.expr("x.tree_id = y.tree_id and x.top = y.node_id"), "left")
        sums = [(F.col(f"x.{c}") + F.coalesce(f"y.{c}", F.lit(0))).alias(c) for c in ("score", "n_messages")]
        paths = cut(joined.select("x.tree_id", "x.node_id", F.col("y.top").alias("top"), *sums))
    whole = paths.where("top is null").join(leaves, F.expr("tree_id = t and node_id = leaf"), "left_semi")
    best = Window.partitionBy("tree_id").orderBy(F.desc("score"), "node_id")
    chosen = cut(whole.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches).select("tree_id", "branch", F.col("node_id").alias("leaf_id"), "n_messages", "score"))
    steps = chosen.select("tree_id", "branch", F.col("leaf_id").alias("id"), F.lit(0).alias("up"))
    for k, jump in enumerate(jumps):
        up = jump.toDF("t", "below", "above")
        higher = steps.join(up, F.expr("tree_id = t and id = below")).select("tree_id", "branch", F.col("above").alias("id"), (F.col("up") + (1 << k)).alias("up"))
        steps = cut(steps.union(higher))
    said = rows.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), turn_text(F.col("role"), F.col("text")).alias("said"))
    parts = steps.join(said, F.expr("tree_id = t and id = n"))
    texts = parts.groupBy("tree_id", "branch").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "said"))).alias("parts"))
    return chosen.join(texts, ["tree_id", "branch"]).select("tree_id", "branch", "leaf_id", "n_messages", "score", F.array_join(F.col("parts.said"), "").alias("text"))


def turn_text(role, text):
    safe = F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), safe, F.lit("<|end|>\n"))


def op8_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations() of the replies() that the turns of conversations are, all of them."""
    return conversations(replies(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP8_SQL = f"""
WITH RECURSIVE before AS (
  SELECT *, lag(turn) OVER w AS prev_turn, lag(role) OVER w AS prev_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), messages AS (
  SELECT conv_id, turn, last_value(CASE WHEN role IS DISTINCT FROM prev_role THEN prev_turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS parent,
    '<|' || role || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS said,
    len(regexp_extract_all(text, '\\S+')) AS score
  FROM before
), paths AS (
  SELECT conv_id, turn, 1 AS n, score, said AS text FROM messages WHERE parent IS NULL
  UNION ALL
  SELECT m.conv_id, m.turn, p.n + 1, p.score + m.score, p.text || m.said FROM paths p JOIN messages m ON m.conv_id = p.conv_id AND m.parent = p.turn
), leaves AS (
  SELECT * FROM paths p WHERE NOT EXISTS (SELECT 1 FROM messages m WHERE m.conv_id = p.conv_id AND m.parent = p.turn)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS branch FROM leaves
)
SELECT conv_id AS tree_id, CAST(branch AS INT) AS branch, turn AS leaf_id, CAST(n AS INT) AS n_messages, CAST(score AS BIGINT) AS score, text FROM ranked WHERE branch <= {BRANCHES}
"""
QUERIES = {"op8_chats": op8_chats}
SQL = {"op8_chats": OP8_SQL}
