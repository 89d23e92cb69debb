"""Small tables with every awkward case, and brute-force answers."""

import pytest

LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(30_000))
NEAR = " ".join(f"alpha{i}" for i in range(100))

#: doc_id, text, and columns whose names operators use themselves
ROWS = [
    (1, None), (2, ""), (3, "one two"), (4, LONG), (5, LONG), (6, NEAR), (7, NEAR + " tail"), (8, "x " + NEAR), (8, "x " + NEAR),
    (9, "É ünïcode 😀 text, with\nlines | and\n\nblank ones. <|endoftext|> it's  fine"), (None, "no id at all"), (None, None),
    (10, "Mail bob.smith@mail.example.com or +49 (30) 1234567, card 4111 1111 1111 1111, ip 10.0.0.255 not 1.2.3.456."),
    (11, "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License."),
    (12, "▁ odd \u0000 \u0085 signs  here"), (13, "ONE TWO"), (14, "a" * 5000),
]
CLASH = ("score", "h1", "row", "node", "kept", "__k1", "rank", "length", "labels", "ids")


def docs(spark, rows=ROWS):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return docs(spark, [])
