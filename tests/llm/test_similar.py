"""Near-duplicates of the pipeline, against the similarity of all pairs."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from mailstrata.llm import contraction, similar, simhash
from mailstrata.llm.common import staged, word_hashes


def slow_shingles(text):
    words = (text or "").encode().lower().split()
    size = min(5, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set()


def slow_kept(rows):
    """Rows kept of (id, text): the least of each component of all pairs, one by one."""
    sets = [slow_shingles(t) for _, t in rows]
    own = list(range(len(rows)))

    def find(k):
        while own[k] != k:
            k = own[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and find(a) != find(b):
                own[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return sorted(min(g) for g in groups.values())


def near_copies(seed, groups=25, copies=6):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(12, 400))]
        rows.append(" ".join(words))
        for _ in range(copies):
            other = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 25))):
                other[rng.randrange(len(other))] = f"x{rng.randint(0, 10 ** 6)}"
            rows.append(" ".join(other))
    rng.shuffle(rows)
    return [(k, t) for k, t in enumerate(rows)]


def test_stage_equals_the_similarity_of_all_pairs(spark):
    rows = near_copies(7)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect())
    assert got == slow_kept(rows) and len(got) < len(rows)
    # These are pairs that four bits of a fingerprint do not hold.
    assert len(got) < simhash.keep_one(frame).count()


def test_large_groups_in_blocks_equal_the_similarity_of_all_pairs(spark):
    """Coarse groups far beyond a block: copies of copies, so that no text is similar to all of its group."""
    rng = random.Random(3)
    rows = near_copies(11, groups=4, copies=30)
    words = [f"v{rng.randint(0, 3000)}" for _ in range(120)]
    for step in range(60):
        words[(2 * step) % 120] = f"y{step}"
        rows.append((1000 + step, " ".join(words)))
        rows.append((2000 + step, "shared opening of a form " * 3 + " ".join(f"z{rng.randint(0, 9)}" for _ in range(8))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_kept(rows)
    assert sorted(r.doc_id for r in similar.keep_one(frame, block_marks=1500).collect()) == want
    assert sorted(r.doc_id for r in similar.keep_one(frame).collect()) == want


def test_copies_share_no_key_with_each_other(spark):
    """Repeated texts are one text before any key is dealt, whatever their ids."""
    rows = [(k, "the same words again and again in one hot text") for k in range(500)] + [(900, "a text of its own words here")]
    frame = spark.createDataFrame([(i, str(i).encode(), t.encode()) for i, t in rows], "id long, digest binary, text binary")
    frame = frame.withColumn("digest", similar.text_key(frame.text))
    assert similar.sketches(frame).count() == 2
    assert sorted(r.doc_id for r in similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [0, 900]


def test_rows_of_a_run_meet_across_tasks(spark):
    rows = near_copies(5, groups=6)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(r.doc_id for r in similar.keep_one(frame).collect()) == slow_kept(rows)


def test_components_by_contraction(spark):
    rng = random.Random(2)
    chain = [(k, k + 1) for k in range(0, 300)]
    star = [(1000, 1000 + k) for k in range(1, 200)]
    loose = [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(150)]
    edges = chain + star + loose + loose[:20] + [(b, a) for a, b in loose[:30]] + [(5000, 5000), (6000, None)]
    got = {r.node: r.root for r in contraction.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    own = {}
    for a, b in edges:
        if b is not None and a != b:
            x, y = own.setdefault(a, {a}), own.setdefault(b, {b})
            if x is not y:
                x |= y
                own.update({k: x for k in y})
    assert set(got) == set(own)
    assert {frozenset(k for k in got if got[k] == r) for r in set(got.values())} == {frozenset(s) for s in own.values()}
    assert contraction.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_rows(spark, edge, edge_rows, none):
    kept = similar.keep_one(edge)
    assert kept.columns == edge.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == slow_kept([r for r in edge_rows if r[0] is not None])
    assert sum(r.doc_id is None for r in rows) == sum(i is None for i, _ in edge_rows)
    assert similar.keep_one(none).count() == 0


def test_forest_of_random_sets():
    rng = np.random.default_rng(4)
    for dense in (False, True):
        base = rng.integers(0, 1 << 62, 60)
        sets = []
        for k in range(120):
            own = base.copy() if dense else rng.integers(0, 90, 60)
            own[rng.integers(0, 60, rng.integers(0, 12))] = rng.integers(0, 1 << 62)
            sets.append(np.unique(own)[: rng.integers(45, 61)])
        found = similar.forest(np.array([len(s) for s in sets]), np.concatenate(sets))
        want = slow_components(sets)
        own = {k: k for k in range(len(sets))}
        for a, b in found:
            own[b] = a
        assert {frozenset(k for k in own if own[k] == r) for r in set(own.values())} == want


def slow_components(sets):
    own = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if 5 * len(x & y) >= 4 * len(x | y):
                own = [own[b] if o == own[a] else o for o in own]
    return {frozenset(k for k, o in enumerate(own) if o == r) for r in set(own)}


def test_similar_texts_share_a_key():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        both = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
        a, b = both[:54], both[6:]  # 48 of 60
        assert (similar.keys(a) == similar.keys(b)).any()


def test_forest_gives_candidates_without_any_shared_key(spark):
    """Texts within the radius meet through the vantage-point forest alone, and no others do."""
    rng = random.Random(8)
    rows = []
    for k in range(60):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(400)]
        other = list(words)
        other[200] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    frame = spark.createDataFrame([(i, str(i).encode(), t.encode()) for i, t in rows], "id long, digest binary, text binary")
    drawn = similar.sketches(frame)
    keys = F.unhex(F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{k}")), 256) for k in range(similar.BANDS // 4)]))
    apart = staged(drawn.withColumn("keys", keys), "apart")  # as many keys, none of them shared
    prints = {r.id: r.fp & (1 << 64) - 1 for r in drawn.collect()}
    groups = {}
    for r in similar.coarse(apart).join(drawn, "node").select("id", "root").collect():
        groups.setdefault(r.root, set()).add(r.id)
    want = [{a, a + 1} for a in range(0, 120, 2) if (prints[a] ^ prints[a + 1]).bit_count() <= simhash.RADIUS]
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want)) and len(want) > 20


def test_word_hashes_do_not_depend_on_blocks():
    """Words before, across and behind the borders of blocks, and one that is longer than a block."""
    words = [b"river", b"stone", b"of", b"x" * 700_000] + [b"w%d" % (k % 900) for k in range(150_000)] + [b"stone", b"x" * 700_000]
    found = word_hashes(b" ".join(words))[0].tolist()
    alone = {w: int(word_hashes(w)[0][0]) for w in set(words)}
    assert found == [alone[w] for w in words]
    assert len(set(alone.values())) == len(alone)
