"""Operators over a whole corpus, against brute force over the edge rows."""

from __future__ import annotations

import heapq
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from mailstrata.llm import bpe, decontaminate, pii, quality, scoring, sharding, simhash, tokenbin


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """Component number of each fingerprint by comparing all pairs."""
    own = {p: p for p in prints}

    def find(p):
        while own[p] != p:
            p = own[p]
        return p

    for a in own:
        for b in own:
            if a < b and (a ^ b).bit_count() <= 4 and find(a) != find(b):
                own[find(a)] = find(b)
    return {p: find(p) for p in own}


def test_near_duplicates(edge, edge_rows, none):
    prints = [slow_fingerprint(t) for _, t in edge_rows]
    of = slow_components(set(prints))
    least = defaultdict(lambda: math.inf)
    for (i, _), p in zip(edge_rows, prints):
        if i is not None:
            least[of[p]] = min(least[of[p]], i)
    want = sorted(((i, p, None if least[of[p]] == math.inf else least[of[p]]) for (i, _), p in zip(edge_rows, prints)), key=repr)
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(edge).collect()), key=repr)
    assert got == want
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    rows = kept.collect()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert sorted(ids) == sorted({c for i, _, c in want if i is not None})
    assert sum(r.doc_id is None for r in rows) == sum(i is None for i, _ in edge_rows)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_links_are_those_of_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    points = set()
    for centre in rng.integers(0, 1 << 63, 60, dtype=np.uint64).tolist():
        for _ in range(40):
            p = centre
            for b in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                p ^= 1 << b
            points.add(p)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    labels = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for node, root in labels.items():
        groups[root].add(node & (1 << 64) - 1)
    for p, root in slow_components(points).items():
        want[root].add(p)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values() if len(g) > 1}


def test_every_close_pair_shares_a_shard():
    rng = np.random.default_rng(9)
    points = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in points]
    close = points ^ np.array(flips, dtype=np.uint64)
    met = np.zeros(len(points), dtype=bool)
    for mask, radius in simhash.BANDS:
        tree = simhash.Tree.fit(points[::4], mask, radius)
        homes = [defaultdict(set), defaultdict(set)]
        for side, values in enumerate((points, close)):
            for at, shard in zip(*tree.route(values)):
                homes[side][int(at)].add(int(shard))
        met |= np.array([bool(homes[0][i] & homes[1][i]) for i in range(len(points))])
    assert met.all()
    assert sum(r + 1 for _, r in simhash.BANDS) == simhash.RADIUS + 1
    assert sum(m for m, _ in simhash.BANDS) == (1 << 64) - 1


def test_sharding(edge, edge_rows, none):
    rows = sharding.shard(edge).collect()
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in edge_rows), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=repr) == want
    shard_of, slots, loads = {}, defaultdict(list), Counter()
    for r in rows:
        assert shard_of.setdefault((r["size"], r.text_crc32), r.shard) == r.shard and 0 <= r.shard < 40
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for _, size, crc in want:
        groups[(size, crc)] += size
    heap = [(0, s) for s in range(40)]
    for size in sorted(groups.values(), reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    assert max(loads.values()) == max(load for load, _ in heap)
    assert sharding.shard(none).count() == 0


def test_longest_first_equals_the_heap():
    rng = random.Random(8)
    for shards, sizes, most in ((40, 300, 500), (3, 20, 90), (40, 5, 20_000), (1, 4, 9), (40, 2000, 2)):
        classes = sorted({rng.randint(1, 10_000): rng.randint(1, most) for _ in range(sizes)}.items(), reverse=True)
        heap = [(0, s) for s in range(shards)]
        for (size, groups), runs in zip(classes, sharding.longest_first(classes, shards)):
            want = Counter()
            for _ in range(groups):
                load, s = heap[0]
                want[s] += 1
                heapq.heapreplace(heap, (load + size, s))
            assert dict(runs) == dict(want)
    assert sharding.longest_first([(7, 10**12)], 40) == [[(s, 10**12 // 40) for s in range(40)]]


def test_sharding_of_one_size_and_one_hot_text(spark):
    frame = spark.createDataFrame([(k, f"text {k:06d}") for k in range(3000)] + [(k, "hot") for k in range(3000, 4500)], "doc_id long, text string")
    rows = sharding.shard(frame).collect()
    assert len(rows) == 4500 and len({r.shard for r in rows if r.doc_id >= 3000}) == 1
    ordinary = Counter(r.shard for r in rows if r.doc_id < 3000)
    loads = Counter()
    for r in rows:
        loads[r.shard] += r["size"]
    assert len(ordinary) == 39 and max(ordinary.values()) - min(ordinary.values()) <= 1
    assert max(loads.values()) == 1500 * 19


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 50_257, 150_000), rng.integers(0, 2, 70_000), np.zeros(999, int), rng.integers(0, 1 << 50, 3000),
                np.zeros(0, int), np.where(rng.random(9000) < 0.02, 1 << 30, 7), np.full(500, tokenbin.ESCAPE)):
        doc_ids, counts, back = tokenbin.read_image(tokenbin.write_image([4, None], [len(ids), 0], ids.astype(np.uint64)))
        assert doc_ids == [4, None] and counts.tolist() == [len(ids), 0] and (back == ids).all()
    with pytest.raises(ValueError):
        tokenbin.read_image(b"x" * 64)


def test_token_files(edge, edge_rows, none, monkeypatch):
    library = Tokenizer.from_file(bpe.resolve(bpe.DEFAULT))
    rows = []
    for i, text in edge_rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        rows.append((i, len(ids), zlib.crc32(ids.tobytes())))
    monkeypatch.setattr(tokenbin, "FILE_IDS", 3000)
    files = tokenbin.write_files(edge)
    got = sorted(tokenbin.read_back(files).collect(), key=lambda r: r.start)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(rows, key=repr)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])))[:-1].tolist()
    assert tokenbin.read_back(tokenbin.write_files(none)).count() == 0


def slow_scores(rows):
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    train = [w for i, w in tokens if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = Counter(), Counter()
    for w in train:
        one.update(w)
        two.update(zip([None, *w], w))
    n, v, mu = sum(one.values()), len(one), scoring.MU
    for i, w in tokens:
        total = 0.0
        for a, b in zip([None, *w], w):
            seen = two[a, b] / (one[a] + mu)
            if seen:
                step = math.floor((math.log10(seen) + 12) / 12 * 255)
                seen = 10 ** (-12 + step / 255 * 12)
            total += math.log10(seen + mu / (one[a] + mu) * (one[b] + 1) / (n + v + 1))
        yield (i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(one[x] > 0 for x in w), n,
               sum(math.log10((one[x] + 1) / (n + 1 * (v + 1))) for x in w), total)


def test_scores(edge, edge_rows, none):
    def key(r):
        return repr(r[0]), r[2], round(r[5], 6)

    want = sorted(slow_scores(edge_rows), key=key)
    got = sorted((tuple(r) for r in scoring.score(edge).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)
    assert scoring.score(none).count() == 0


def test_elias_fano_trie():
    rng = np.random.default_rng(2)
    for n, top in ((1000, 10 ** 6), (500, 3), (5000, 4000), (300, 1 << 60), (1, 1 << 40), (0, 1)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        assert (scoring.Monotone(memoryview(scoring.Monotone.image(values))).get(np.arange(n)) == values).all()
    pairs = np.unique(rng.integers(0, 300, 4000).astype(np.uint64) << np.uint64(32) | rng.integers(0, 5000, 4000).astype(np.uint64))
    p = rng.random(len(pairs)) ** 4
    trie = scoring.Trie.mapped(scoring.Trie.image(pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF), p))
    ask = np.concatenate((pairs, rng.integers(0, 400, 3000).astype(np.uint64) << np.uint64(32) | rng.integers(0, 6000, 3000).astype(np.uint64)))
    known = dict(zip(pairs.tolist(), scoring.quantise(p).tolist()))
    assert trie.look_up(ask >> np.uint64(32), ask & np.uint64(0xFFFFFFFF)).tolist() == [known.get(k, 0) for k in ask.tolist()]
    assert (scoring.dequantise(scoring.quantise(p)) <= p * (1 + 1e-12) + 2e-12).all()


def test_pipeline_against_plain_python(spark, edge_rows, tmp_path):
    item = "the quick silver harbor met seven copper bridges near one quiet winter market"
    rows = [*edge_rows, (900, "intro words before it " + item + " and then some more words follow here"),
            (901, "write to someone at ann.lee@mail3.example.com before the evening market opens again today")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "surrogates", "encoding"]
    mask = quality.mask(quality.CURRENT)
    from pyspark.sql import functions as F
    rejected = {(r.doc_id, r.text) for r in spark.createDataFrame(rows, "doc_id long, text string").join(
        quality.ledger(spark.createDataFrame(rows, "doc_id long, text string")).where(
            F.col("failed_bits").bitwiseAND(mask) != 0).select(F.col("doc_id").alias("bad")).distinct(), F.expr("doc_id <=> bad")).collect()}
    rows_in = [r for r in rows if r[0] is not None and r not in rejected]
    of = slow_components({slow_fingerprint(t) for _, t in rows_in})
    first = {}
    for i, t in sorted(rows_in):
        first.setdefault(of[slow_fingerprint(t)], (i, t))
    index = decontaminate.Index([(1, item.encode())])
    kept = {i: t for i, t in first.values() if not index.hits(t.encode())}
    assert 900 not in kept and 901 in kept and len(kept) > 10
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r.doc_id is not None}
    assert set(got) == set(kept)
    import hashlib
    for i, t in kept.items():
        if i != 901:
            assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert got[901].decoded_sha256 != hashlib.sha256(kept[901].encode()).hexdigest()
    assert pii.anonymize(spark.createDataFrame([(1, kept[901])], "i int, text string")).first().text != kept[901]
