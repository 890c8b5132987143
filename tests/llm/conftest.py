import random

import pytest

#: Columns whose names the operators use themselves.
CLASHING = ["size", "kept", "rank", "name", "start", "shard", "range", "piece", "marks", "score", "zipped", "bands",
            "component", "prints", "_to", "block", "length", "span"]


def words(seed, n, vocabulary=4000):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def nasty(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows, near copies and clashing columns."""
    base = words(1, 120)
    tokens = base.split()
    near = " ".join([*tokens[:60], "changed", *tokens[61:]])
    passage = words(2, 70)
    rows = [(10, base, "s1"), (11, near, "s1"), (12, base, None), (13, None, "s2"), (14, "", "s2"), (15, " \t\n ", "s3"),
            (16, "single", "s3"), (17, "Single", "s3"), (18, words(3, 30) + " " + passage + " " + words(4, 30), "s1"),
            (19, words(5, 20) + " " + passage + " " + words(6, 40), "s4"), (20, "é" * 400 + " ünï “çødé” 漢字かな 🎉", None),
            (21, words(7, 20_000), "s1"), (22, "x" * 300_000, "s4"), (23, "ab" * 500 + words(8, 5), "s2"),
            (24, words(9, 50), "s5"), (24, words(9, 50), "s5"), (None, words(10, 60), "s1"), (26, words(11, 8), "s1"),
            (27, words(12, 300), "s2"), (28, words(12, 300) + " more", "s6"), (29, "a.b,c. D! it's 12,5 ok..", "s6")]
    full = [(i, t, "en", s, len(t or ""), *range(len(CLASHING))) for i, t, s in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{c}` int" for c in CLASHING)
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(nasty):
    return nasty.where("false")


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
