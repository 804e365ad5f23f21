from __future__ import annotations

import random

import pytest

#: Names that stages use inside; as extra columns they must change nothing.
CLASHING = ("row", "fp", "shard", "size", "id", "place", "block", "chunk", "digest", "group", "n_words", "kept_row")
WORDS = ("the of and to in river stone cloud light winter garden window paper silver music "
         "table mountain bridge letter morning evening forest island harbor market copper").split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (str(rng.randint(0, 99)) if rng.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows() -> list[tuple]:
    """(doc_id, text): NULLs, empty and long texts, ties, repeated rows, odd characters, near copies."""
    rng = random.Random(5)
    base = sentence(rng, 400)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, base), (5, base), (6, base.upper()),
            (7, base.replace("river", "riverside", 1)), (8, "one"), (9, "one two"), (10, "a b c d e f g h i j k l"),
            (11, "x " * 5000), (12, "naïve café — “quoted” 日本語 текст 🙂　end"), (13, "<|endoftext|> mid <|endoftext|>"),
            (14, "tab\there\x0bvt\x0cff\rcr\x1cfs"), (15, "z" * 20000), (None, "no id here at all, none"), (None, base),
            (16, "# $ % & | < > * " * 4), (17, "WHY ARE WE SHOUTING AT EVERY ONE HERE TODAY!!! " * 3), (17, "same id, other text"),
            (18, "same"), (18, "same"), (19, "line one is here\nline one is here\nline one is here\nline two now")]
    rows += [(100 + k, sentence(rng, rng.randint(1, 60))) for k in range(40)]
    rows += [(200 + k, base + " " + sentence(rng, 3)) for k in range(15)]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in edge_rows], schema)


@pytest.fixture(scope="session")
def none(spark, edge):
    return spark.createDataFrame([], edge.schema)
