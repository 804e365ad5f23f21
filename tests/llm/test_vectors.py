"""Neighbours against brute force in double precision."""

from __future__ import annotations

import numpy as np
import pytest

from mailstrata.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, key string, list string, block string, score string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in rows], SCHEMA)


def _exact(rows, k=10):
    """{query id: [(vec_id, score)]} by the contract."""
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows
            if v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for at, (i, v) in enumerate(good):
        if i is None or i % 100:
            continue
        near = []
        for other, (j, w) in enumerate(good):
            if other != at:
                square = 0.0
                for a, b in zip(w, v):
                    square += (a - b) * (a - b)
                near.append((float(np.sqrt(square)), np.inf if j is None else j))
        out.append((i, sorted(near)[:k]))
    return sorted(out)


def _got(df):
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.score, np.inf if r.vec_id is None else r.vec_id))
    return out


def test_defined_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(0, 450, 5)]
    rows += [(1, None), (2, []), (3, [0.0] * 4), (4, [1.0, None, 0.0, 0.0]), (6, [float("nan")] * 4), (100, [float("inf")] * 4),
             (7, [1.0, 2.0]), (None, rows[0][1]), (8, rows[0][1]), (9, [-0.0, 1.0, 0.0, 0.0]), (11, [0.0, 1.0, -0.0, 0.0])]
    want = _exact([r for r in rows if not r[1] or len(r[1]) == 4])
    got = _got(vectors.neighbours(_frame(spark, rows)))
    assert sorted(got) == [i for i, _ in want]
    for i, near in want:
        assert [(s, j) for _, s, j in got[i]] == near and [r for r, _, _ in got[i]] == list(range(1, len(near) + 1))


@pytest.mark.parametrize("rows", [[], [(5, [1.0, 2.0])], [(100, None)]])
def test_nothing_to_search(spark, rows):
    assert vectors.neighbours(_frame(spark, rows)).count() == 0


def test_few_and_repeated_rows(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [0.0, 1.0])]
    got = [tuple(r) for r in vectors.neighbours(_frame(spark, rows)).collect()]
    one = [(100, 1, 7, 0.0), (100, 2, 100, 0.0), (100, 3, 8, float(np.sqrt(2.0)))]
    assert sorted(got) == sorted(one + one)


def test_recall_over_many_lists_and_copies(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_ROWS", 64)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 32)) * 2
    rows = [(i, (centres[i % 6] + rng.standard_normal(32)).tolist()) for i in range(3000)]
    hot = rows[0][1]
    rows = [(i, hot if i % 3 == 0 else v) for i, v in rows]
    want, got = _exact(rows), _got(vectors.neighbours(_frame(spark, rows)))
    hits = sum(len({j for _, j in near} & {j for _, _, j in got[i]}) for i, near in want)
    assert hits >= 0.9 * sum(len(near) for _, near in want)
    exact = {(i, j): s for i, near in want for s, j in near}
    assert all(exact.get((i, j), s) == s for i, near in got.items() for _, s, j in near)
    for i, near in want:
        if i % 300 == 0:  # its copies, least ids first
            assert [(s, j) for _, s, j in got[i]] == near


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = dict(_exact(rows))
    got = _got(vectors.neighbours(spark.read.parquet(f"{sf}/embeddings.parquet")))
    hits = sum(len({j for _, j in want[i]} & {j for _, _, j in got[i]}) for i in want)
    assert set(got) == set(want) and hits >= 0.9 * 10 * len(want)
