"""Repair and prefix trie of conversations against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mailstrata.llm import repair, trie
from mailstrata.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, kinds string, part string, one string, depth string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    """NULLs everywhere, ties, repeats, odd roles, long texts, and a conversation far longer than a block."""
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "User", "", None]
    texts = ["hello.", "why?", "no end", "", " \t", "two. three", None, "x" * 5000, "é日本."]
    rows = [(1, None, None, None), (1, 0, "user", "a."), (2, 5, "user", "same."), (2, 5, "user", "same."), (2, 7, "user", "same."),
            (None, 1, "user", "nobody."), (None, 2, "assistant", "nothing"), (3, 0, "assistant", "only."), (4, 0, "system", "s."),
            (5, -3, "system", "s."), (5, 9, "user", "q"), (-7, 0, "user", "minus."), (99, 0, "user", "u."), (200, 0, "user", "base.")]
    for c in range(100, 180):
        for t in range(rng.randint(0, 9)):
            rows.append((c, rng.choice([t, t, t, rng.randint(0, 5), None]), rng.choice(roles), rng.choice(texts)))
    rows += [(300, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(60)]
    rows += [(301, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(60)]
    rows += [(400, t, ("user", "assistant", "tool")[rng.randint(0, 2)], rng.choice(["a.", "b.", f"{t}", f"{t}."])) for t in range(700)]
    rows += [(c, t, "user", "common.") for c in range(500, 530) for t in range(2)]
    return rows


def _sorted(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def _repair(rows, damage=True):
    """The contract, word for word: every audit is grown row by row, the cheapest then least one stays."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        own = by[conv]
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20 if damage else 9
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, own in by.items():
        own = _sorted(own)
        counts, seen, steps = dict(blank=0, duplicate=0, truncated=0), set(), []
        for turn, role, text in own:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            steps.append((role, text, fault))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
        names = {"u": "user", "a": "assistant"}
        best = {"": (0, "", ())}

        def put(into, state, cost, audit, made):
            if state not in into or (cost, audit) < into[state][:2]:
                into[state] = (cost, audit, made)

        def inserts(best):
            for _ in range(4):
                for state, (cost, audit, made) in list(best.items()):
                    for x in "ua":
                        if x in follow[state]:
                            put(best, x, cost + 3, audit + "I", (made, names[x] + ":"))
            return best

        for role, text, fault in steps:
            best, after = inserts(best), {}
            for state, (cost, audit, made) in best.items():
                put(after, state, cost + 4, audit + "D", made)
                if fault in ("blank", "duplicate"):
                    continue
                extra = 3 if fault else 0
                if role[:1] in follow[state] and role:
                    put(after, role[:1], cost + extra, audit + "K", (made, f"{role}:{text}"))
                for x in "ua":
                    if x in follow[state]:
                        put(after, x, cost + 3 + extra, audit + "R", (made, f"{names[x]}:{text}"))
            best = after
        best = inserts(best)
        cost, audit, made = min(best[s] for s in ("", "a") if s in best)
        lines = []
        while made:
            made, line = made
            lines.append(line)
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines[::-1]).encode()).hexdigest())
    return out


def _got(df):
    rows = [tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


@pytest.mark.parametrize("block", [4096, 7])
def test_repair_equals_brute_force(spark, odd_rows, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    df = _frame(spark, odd_rows).repartition(3)
    assert _got(repair.ledger(repair.repair(df))) == _repair(odd_rows, damage=False)
    rows = repair.damaged(repair.rows_of(df))
    assert _got(repair.ledger(repair.repaired(repair.blocks(rows)))) == _repair(odd_rows)


def test_repair_gives_turns(spark):
    df = _frame(spark, [(1, 0, "user", "hi."), (1, 1, "tool", "no end"), (2, 0, "system", "s."), (2, 1, "assistant", "a.")])
    got = {r.conv_id: (r.audit, [tuple(t) for t in r.turns]) for r in repair.repair(df).collect()}
    assert got == {1: ("KR", [("user", "hi."), ("assistant", "no end")]),
                   2: ("KIK", [("system", "s."), ("user", ""), ("assistant", "a.")])}


def test_ranks_order_audits():
    rng = random.Random(8)
    kinds = bytes(rng.randint(0, 8) for _ in range(50))
    letter, ranks, levels, (start,) = repair.ranked([(kinds, repair.inserted(repair.ENDING))])
    words = ["".join(chr(64 + x) for x in letter[repair.path(letter, levels, node)[:-1]]) for node in range(len(letter))]
    for a in range(len(words)):
        assert (words[a] < words[0]) == (ranks[a] < ranks[0]) and (words[a] == words[0]) == (ranks[a] == ranks[0])


def test_no_rows(spark):
    none = _frame(spark, [])
    assert repair.ledger(repair.repair(none)).count() == 0
    nodes, lists = trie.of_conversations(none)
    assert trie.digest_nodes(nodes, lists).count() == 0


def _trie(rows, rebuild=True):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn, role or "", text or ""))
    by = {c: [(r, t) for _, r, t in _sorted(own)] for c, own in by.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in by}
        trunc = {c: c - int(abs(c) % 100) * (1 if c >= 0 else -1) for c in by}
        by = {c: by.get(trunc[c], [])[:h[c]] + own[h[c]:] for c, own in by.items()}
    members = defaultdict(list)
    for c, own in by.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    out = {}
    for key, convs in members.items():
        under = [k for k in members if len(k) >= len(key) and k[:len(key)] == key]
        children = [k for k in under if len(k) == len(key) + 1]
        leaves = [k for k in under if len(by[min(members[k])]) == len(k) and not any(len(by[c]) > len(k) for c in members[k])]
        saved = sum((len(members[k]) - 1) * (len(k[-1][1]) if k else 0) for k in under)
        ends = ",".join(str(c) for c in sorted(convs) if len(by[c]) == len(key))
        out[(min(convs), len(key))] = (min(members[key[:-1]]) if key else None, len(convs), len(children), len(leaves), saved,
                                       hashlib.sha256(ends.encode()).hexdigest())
    return out


def _nodes(df):
    rows = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert len(rows) == len({(r[0], r[1]) for r in rows})
    return {(r[0], r[1]): tuple(r[2:]) for r in rows}


def test_trie_equals_brute_force(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 4)
    rows = [r for r in odd_rows if r[0] != 400]
    df = _frame(spark, rows).repartition(3)
    assert _nodes(trie.digest_nodes(*trie.of_conversations(df))) == _trie(rows, rebuild=False)
    steps, lengths = trie.rebuilt(df)
    assert _nodes(trie.digest_nodes(*trie.trie(steps, lengths))) == _trie(rows)
    nested = [(i, t, "user", f"{t}") for i in range(12) for t in range(12 - i)]  # every conversation a prefix of the one before
    assert _nodes(trie.digest_nodes(*trie.of_conversations(_frame(spark, nested)))) == _trie(nested, rebuild=False)


def test_queries_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _got(QUERIES["op12_conversation_repair"](spark, SF)) == _repair(rows)
    assert _nodes(QUERIES["op13_prefix_trie"](spark, SF)) == _trie(rows)


def test_running_sums_over_many_tasks(spark):
    from mailstrata.llm.turns import running
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("conv_id"), F.col("id").alias("turn"), F.lit(1).cast("long").alias("one")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.conv_id, r.turn): r.sum_one for r in running(df, "conv_id", [F.col("turn").asc()], ["one"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(i % 3 or None, i): i // 3 + 1 for i in range(5000)}
