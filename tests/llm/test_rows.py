"""Operators that work row by row, against brute force over the edge rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailstrata.llm import bpe, chat, decontaminate, licenses, pii, quality, tokenbin

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(df, *columns):
    return sorted(([tuple(r) for r in df.select(*columns).collect()]), key=repr)


def test_licenses(spark, edge, edge_rows, none):
    rows = licenses.scan(edge).collect()
    assert len(rows) == len(edge_rows) and all(r.license_id is None and r.n_notices == 0 for r in rows)
    mit = dict(licenses.TEXTS)["MIT"]
    copy = mit.replace("<year> <copyright holders>", "1999-2024 Some One").replace('"', "'").replace("sublicense", "sub-license").upper()
    found = licenses.scan(spark.createDataFrame(
        [(1, copy), (2, mit + " and more"), (3, "prose\n Released under the MIT licence \nLicensed under CC BY-NC 4.0.")],
        "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.license_id, r.notice_ids, r.n_notices) for r in found] == [("MIT", "", 0), (None, "", 0), (None, "CC-BY-NC-4.0,MIT", 2)]
    assert len({licenses.known(spark, (t,)).popitem()[0] for t in licenses.TEXTS}) == len(licenses.TEXTS)
    assert all(re.search(licenses.HINT, body) for _, body in licenses.NOTICES)
    assert licenses.scan(none).count() == 0


def test_bpe_equals_the_library(spark, edge, edge_rows, none):
    library = Tokenizer.from_file(bpe.resolve(bpe.DEFAULT))
    want = []
    for i, text in edge_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(back.encode()).hexdigest()))
    got = bpe.round_trip(edge)
    assert pairs(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert pairs(bpe.decode(bpe.encode(edge)), "doc_id", "decoded") == sorted(((i, t or "") for i, t in edge_rows), key=repr)
    assert bpe.round_trip(none).count() == 0


def test_bpe_on_random_strings():
    library, codec, rng = Tokenizer.from_file(bpe.resolve(bpe.DEFAULT)), bpe.codec(bpe.DEFAULT), random.Random(1)
    letters = [chr(c) for c in [*range(0x250), *range(0x370, 0x500), *range(0x4E00, 0x4E40)]] + ["🙂", " ", "　", "\U000323b0", "՘"]
    for _ in range(600):
        text = "".join(rng.choice(rng.choice(["abc ", "a'sll ", "  \n", letters])) for _ in range(rng.randint(0, 50)))
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)
    long = "ab" * 50_000
    assert codec.encode(long) == library.encode(long, add_special_tokens=False).ids


@pytest.mark.parametrize("make", [lambda: bpe.codec(bpe.DEFAULT), lambda: tokenbin.library(bpe.DEFAULT)])
def test_vector_cuts_equal_the_library(make):
    library, of, rng = Tokenizer.from_file(bpe.resolve(bpe.DEFAULT)), make(), random.Random(3)
    letters = [*map(chr, range(0x130)), "é", " ", "  ", "\n", "!", " \n", "'s", "<|endoftext|>", "日"]
    texts = ["".join(rng.choice(letters if rng.random() < 0.3 else list("ab 1.\n é\t")) for _ in range(rng.randint(0, 40)))
             for _ in range(3000)] + ["", "  ", "ÿ", "a" * 9000 + " " * 9000 + "\n\n b"]
    assert sum(bpe.is_plain(t.encode()) for t in texts) > 500
    assert [x.tolist() for x in of.encode_arrays([t.encode() for t in texts])] == \
        [library.encode(t, add_special_tokens=False).ids for t in texts]


def slow_measures(text):
    text = text or ""
    words, lines = WORD.findall(text), text.split("\n")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 5)}
    dup = sum(1 for k, line in enumerate(lines) if WORD.search(line) and line in lines[:k])
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_quality_ledger(edge, edge_rows, none):
    book = quality.ledger(edge)
    names = quality.MEASURES[:5]
    want = sorted(((i, *slow_measures(t)) for i, t in edge_rows), key=repr)
    assert pairs(book, "doc_id", *names) == want
    for r in book.collect():
        low = r.n_words < 10
        assert bool(r.failed_bits & quality.bit("few_words")) == low
        assert bool(r.failed_bits & quality.bit("repeated_windows")) == (100 * r.n_repeat_words > 20 * r.n_words)
    kept = quality.keep(edge)
    assert kept.columns == edge.columns
    assert kept.count() == book.where(quality.accepted(F.col("failed_bits"))).count()
    assert quality.keep(none).count() == 0 and quality.ledger(none).count() == 0


def test_quality_ablation_counts(edge):
    book = quality.ledger(edge)
    bits = [r.failed_bits for r in book.select("failed_bits").collect()]
    for r in quality.ablation(book).collect():
        mask, bit = quality.mask(r.policy), quality.bit(r.rule)
        assert (r.documents, r.failures, r.rejected, r.rejected_only_by_rule) == (
            len(bits), sum(bool(b & bit) for b in bits), sum(bool(b & mask) for b in bits), sum(b & mask == bit for b in bits))


def test_decontamination_against_every_window(spark, edge, edge_rows, none):
    rng = random.Random(2)
    items = [(k, " ".join(f"w{rng.randint(0, 40)}" for _ in range(n))) for k, n in enumerate([5, 6, 12, 18, 18, 30, 3, 1])]
    items += [(90, None), (91, ""), (92, items[3][1])]
    docs = list(edge_rows)
    for k, (_, body) in enumerate(items[:8]):
        words = body.split()
        docs.append((500 + k, "start here " + body.upper() + "\nand on"))
        docs.append((600 + k, "start " + " ".join(words[:-1]) + " changed and on"))
        docs.append((700 + k, " ".join(words[: len(words) // 2])))
    want = set()
    for i, text in docs:
        words = [w.lower().encode() for w in WORD.findall(text or "")]
        for item, body in items:
            target = [w.encode() for w in WORD.findall((body or "").lower())]
            if not target or not words:
                continue
            size, n = min(5, len(target)), len(target)
            windows = [words[s:s + n] for s in range(max(1, len(words) - n + 1))]
            if max((decontaminate.similarity(decontaminate.shingles(w, size), decontaminate.shingles(target, size))
                    for w in windows if len(w) >= size), default=0) >= decontaminate.THRESHOLD:
                want.add((i, item))
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(*b, 1) for b in items], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(frame, bench).collect()}
    assert got == want and len(want) > 10
    clean = decontaminate.drop_contaminated(frame, bench)
    assert sorted(map(repr, (r.doc_id for r in clean.collect()))) == sorted(repr(i) for i, _ in docs if i not in {d for d, _ in want})
    assert decontaminate.matches(none, bench).count() == 0
    assert decontaminate.matches(frame, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(frame, bench.limit(0)).count() == len(docs)


def test_hamming_blocks_miss_nothing():
    rng = np.random.default_rng(3)
    index = decontaminate.Index([(k, " ".join(f"w{x}" for x in rng.integers(0, 99, 9)).encode()) for k in range(60)])
    group = index.items[9]
    for _ in range(300):
        mark = group[rng.integers(60)].print
        for b in rng.choice(64, rng.integers(0, 30), replace=False):
            mark ^= 1 << int(b)
        assert index.candidates(9, mark) == [i for i, x in enumerate(group) if (x.print ^ mark).bit_count() <= decontaminate.RADIUS]


PERSONAL = [
    "mail ann.lee@mail3.example.com or ANN.LEE@MAIL3.EXAMPLE.COM now", "éva.77@mail8.example.com###",
    "call +1 (337) 555-7349 or +1 337 555 7349.", "card 4952935900253052 and 4952 9359 0025 3052", "number 9807915762804490 stays",
    "at 240.56.125.154. not 1.2.3.4.5 nor 999.1.1.1", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end',
    "Mr. John Smith met Frau Anna Zzyx", "ssn 123-45-6789", "plain text stays the same", "", None]


def test_surrogates(spark, none):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(PERSONAL)], "doc_id long, text string, entity string")
    got = {r.doc_id: r.text for r in pii.anonymize(frame).collect()}
    words = {i: t.split() if t else t for i, t in got.items()}
    assert got[9] == PERSONAL[9] and got[10] == "" and got[11] is None and got[4] == PERSONAL[4]
    assert words[0][1].lower() == words[0][3].lower() and words[0][3].isupper() and words[0][1] != "ann.lee@mail3.example.com"
    assert re.fullmatch(r"[a-z]{3}\.[a-z]{3}@[a-z]{4}\d\.[a-z]{7}\.com", words[0][1])
    assert got[1].endswith("###") and "éva" not in got[1]
    phone = re.findall(r"\+1 \(?(\d{3})\)? (\d{3})[- ](\d{4})", got[2])
    assert len(phone) == 2 and phone[0] == phone[1] and phone[0] != ("337", "555", "7349")
    cards = got[3].replace("card ", "").split(" and ")
    digits = [re.sub(" ", "", c) for c in cards]
    assert digits[0] == digits[1] != "4952935900253052" and digits[0][0] == "4" and len(cards[1].split()) == 4
    assert sum(int(d) if k % 2 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[0])) % 10 == 0
    ip = re.match(r"at (\d+\.\d+\.\d+\.\d+)\. not 1\.2\.3\.4\.5 nor 999\.1\.1\.1", got[5]).group(1)
    assert ip != "240.56.125.154" and all(int(x) < 256 for x in ip.split("."))
    assert re.fullmatch(r'token = "[0-9a-f]{40}" end', got[6]) and "04dbebab" not in got[6]
    first, last = re.fullmatch(r"Mr\. (\w+) (\w+) met Frau \w+ \w+", got[7]).groups()
    assert first in pii.NAMES[("male", "latin")] and first != "John" and last != "Smith" and last.istitle()
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}", got[8]) and "123-45" not in got[8]
    assert pii.anonymize(none).count() == 0 and pii.anonymize(frame).columns == frame.columns


def test_surrogates_are_distinct_and_keyed(spark):
    rows = [(f"x {a}{b}.{k:02d}@m{k % 7}.example.com +1 (2{k:02d}) 555-{k * 37:04d} 10.{k}.{k % 9}.7",)
            for a in "abcdefg" for b in "hijk" for k in range(60)]
    frame = spark.createDataFrame(rows, "text string")
    assert pii.collisions(frame).count() == 0
    new = frame.select(F.explode(pii.entities(F.col("text"))).alias("m")).distinct().select(
        "m", pii.surrogate(F.col("m")).alias("a"), pii.surrogate(F.col("m"), "other").alias("b")).collect()
    assert len({r.a for r in new}) == len(new) and sum(r.a == r.b for r in new) < 5 and all(r.a != r.m for r in new)


def test_chat_blocks_equal_one_pass(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for conv in (1, 2, None):
        for turn in range(40):
            role = ["user", "assistant"][turn % 2]
            shown = rng.choice([role, "Human" if role == "user" else "bot", None, "??"])
            text = rng.choice(["short?", "a much longer answer that goes on and on " * 6, "x\nHuman: y\nAssistant: z", "", None])
            rows.append((conv, turn, shown, text, "extra"))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string")
    columns = ("conv_id", "turn", "segment", "role", "rendered")
    whole = pairs(chat.segments(frame), *columns)
    monkeypatch.setattr(chat, "BLOCK", 7)
    assert pairs(chat.segments(frame), *columns) == whole
    # Viterbi by enumeration on a short run of lines.
    model = chat.train(chat.turns(frame))
    markers, features, opens = [1, -1, 2, -1], [0, 3, 3, 1], [True, False, True, True]
    steps = chat.scores(chat.steps_of(model), markers, features, opens)
    start = chat._start(model)
    best = max(((sum(m[a, b] for m, a, b in zip(steps, (r0, *p), p)) + start[r0], p) for r0 in range(3)
                for p in np.ndindex(3, 3, 3, 3)), key=lambda x: x[0])
    ends = (start[:, None] + chat.product(steps)).max(axis=0)
    assert np.isclose(ends.max(), best[0]) and tuple(chat.decode(steps, start, int(ends.argmax()))) == best[1]


def test_chat_recovers_hidden_markers(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(2, 8)):
            role = ["user", "assistant"][turn % 2]
            text = "What is it?" if role == "user" else "A long answer. " * 20
            rows.append((conv, turn, role if rng.random() < 0.5 else None, text, role))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, truth string")
    got = chat.segments(frame).join(frame.select("conv_id", "turn", "truth"), ["conv_id", "turn"]).collect()
    assert len(got) == len(rows) and sum(r.role == r.truth for r in got) / len(got) > 0.97
    assert all(r.rendered == f"<|{r.role}|>\n" + r.rendered.split("\n", 1)[1] for r in got)
    assert chat.segments(frame.limit(0)).count() == 0


@pytest.mark.parametrize("letters", [512, 1024, 2048])
def test_pieces_with_equal_hashes_stay_apart(spark, letters):
    """A word of this kind and its complement have equal hashes for any base; alone and together in a text."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(letters))
    two = one.translate(str.maketrans("ab", "ba"))
    library = Tokenizer.from_file(bpe.resolve(bpe.DEFAULT))
    rows = [(1, f"{one} {two} {one}"), (2, f" {two}"), (3, f"{two} {one}" * 3), (4, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows}
    got = {r.doc_id: r for r in bpe.round_trip(df).collect()}
    assert {i: r.ids_sha256 for i, r in got.items()} == {
        i: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for i, x in ids.items()}
    back = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokenbin.read_back(tokenbin.write_files(df)).collect()}
    assert back == {i: (len(x) + 1, zlib.crc32(np.array([*x, 2], dtype="<u4").tobytes())) for i, x in ids.items()}
