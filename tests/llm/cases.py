"""Rows that every operator must take, and tables made of them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "id long, label string, cls string, version string, band long, n int, digest string, shard int, `a.b` int"


def prose(words: int, seed: int) -> str:
    rng = random.Random(seed)
    out = []
    while len(out) < words:
        size = min(rng.randint(6, 14), words - len(out))
        line = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(size)]
        out += [line[0].capitalize(), *line[1:-1], line[-1] + "."] if size > 1 else line
    return " ".join(out[:words])


def awkward() -> list[tuple]:
    """Null in each column, empty and blank texts, a very long one, ties and repeated rows."""
    long = prose(30_000, 1)
    rows = [
        (None, prose(60, 2), "en", "s", 1),
        (1, None, "en", "s", 1),
        (2, prose(60, 3), None, "s", 1),
        (3, prose(60, 4), "en", None, None),
        (4, "", "en", "s", 0),
        (5, " \n\t ", "en", "s", 4),
        (6, long, "en", "s", len(long)),
        (7, "one", "en", "s", 3),
        (8, "x" * 5000, "en", "s", 5000),
        (9, "日本語 текст Ωmega 🙂 á", "en", "s", 1),
        (None, None, None, None, None),
    ]
    return rows + [(10, prose(60, 5), "en", "s", 1)] * 3 + [(11, prose(60, 5), "en", "s", 1)]


def table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "doc_id AS id", "'l' AS label", "'c' AS cls", "'v' AS version", "7L AS band", "1 AS n", "'d' AS digest", "3 AS shard", "5 AS `a.b`")
    return df
