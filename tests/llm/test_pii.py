"""Personal data that bounds or groupings used to hide."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from mailstrata.llm import pii


def anonymized(spark, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.anonymize(frame).orderBy("doc_id").collect()]


def test_credentials_of_any_length_and_quoting(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789_-.") for _ in range(1000)) + "z"
    local = "q" * 90
    texts = [f'token = "{long}" end', "password: 'hunter22' end", "api_key=AbC123xyz. end", 'secret = "pw12" end', "password=letmein end",
             '{"api_key": "Zz9Zz9Zz9", "n": 1}', f"to {local}@mail3.example.com end", f'token = "{long * 100}"', "the secret: nobody knew"]
    got = anonymized(spark, *texts)
    shapes = [r'token = "\S{1001}" end', r"password: '[a-z]{6}\d\d' end", r"api_key=[A-Z][a-z][A-Z]\d{3}[a-z]{3}\. end",
              r'secret = "[a-z]{2}\d\d" end', r"password=[a-z]{7} end", r'\{"api_key": "\S{9}", "n": 1\}',
              r"to [a-z]{90}@[a-z]{4}\d\.[a-z]{7}\.com end", r'token = "\S{100100}"', texts[-1]]
    assert all(re.fullmatch(s, g) for s, g in zip(shapes, got))
    for hidden, text in zip([long, "hunter22", "AbC123xyz", "pw12", "letmein", "Zz9Zz9Zz9", local, long], got):
        assert hidden not in text


def test_grouping_of_a_phone_does_not_matter(spark):
    rng = random.Random(5)
    numbers = [("1", "".join(rng.choice("0123456789") for _ in range(10))) for _ in range(200)] + [("44", f"20{k:08d}") for k in range(200)]
    shapes = ["+{0} ({1}) {2}-{3}", "+{0}{1}{2}{3}", "+{0} {1} {2} {3}", "+{0}-{1}-{2}-{3}"]
    texts = [shape.format(c, n[:3], n[3:6], n[6:]) for c, n in numbers for shape in shapes]
    new = [re.sub(r"[^\d+]", "", t) for t in anonymized(spark, *texts)]
    groups = [new[k: k + 4] for k in range(0, len(new), 4)]
    assert all(len(set(g)) == 1 for g in groups) and len({g[0] for g in groups}) == len({f"{c}{n}" for c, n in numbers})
    assert all(g[0].startswith("+" + c) and g[0] != f"+{c}{n}" for (c, n), g in zip(numbers, groups))


def test_only_entities_that_meet_are_drawn_again(spark):
    # The Kelvin sign has k as its lower case and no alphabet, so it stays: whatever becomes k meets it.
    letters = "abcdefghijlmnopqrstuvwxyz"
    texts = [f"{c}@{d}.example.com" for c in letters for d in "pq"] + ["\u212a@p.example.com", "\u212a@q.example.com"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = {r.text: r.new for r in frame.select("text", pii.replaced(F.col("text")).alias("new")).collect()}
    redrawn = pii.draws(frame)
    new = {r.text: r.new for r in frame.select("text", pii.replaced(F.col("text"), redrawn=redrawn).alias("new")).collect()}
    assert len({x.lower() for x in new.values()}) == len(texts)
    assert all(new[t] == plain[t] for t in texts if ("email", t.lower()) not in redrawn)


def test_listed_and_hexadecimal_values_stay_apart_from_others(spark):
    rng = random.Random(7)
    values = {"".join(rng.choice("0123456789") for _ in range(11)) + c for c in "abcdefghijklmnopqrstuvwxyz" for _ in range(40)}
    names = {rng.choice("ABCJMP") + rng.choice("aeio") + rng.choice("nr") + rng.choice("ae") for _ in range(60)} | {"Anna", "Mary", "John"}
    texts = [f"token={v}" for v in sorted(values)] + [f"{t} {n}" for t in ("Mr.", "Ms.", "Dr.") for n in sorted(names)]
    got = anonymized(spark, *texts)
    assert len(set(got)) == len(texts)
    listed = {g: {n for (of, _), x in pii.NAMES.items() if of == g for n in x} for g in ("male", "female")}
    of = dict(zip(texts, got))
    assert of["Mr. John"][4:] in listed["male"] - {"John"} and of["Ms. Anna"][4:] in listed["female"] - {"Anna"}
    assert of["Dr. Mary"][4:] in listed["female"] - {"Mary"}
    assert all((set(v) <= set("0123456789abcdef")) == (set(of[f"token={v}"][6:]) <= set("0123456789abcdef")) for v in values)


def test_names_and_addresses_of_any_length(spark):
    label, labels, long = "x" * 300, ".".join("y1" for _ in range(3000)), "Z" + "z" * 80
    texts = ["Mr. John Ronald Smith came", "Mr. Smith-Jones came", "Mr. O'Brien came", "Dr. John Smith came", "Mrs. J. Smith's hat",
             "Herr Ludwig van der Berg kam", f"Ms. {long} came", f"a@{label}.com end", f"a@{labels}.com end", "a@b.com.1 end", "x a@b.com.",
             "pip install numpy@1.2.3 now", "Mr. JOHN SMITH came", "Ms. Łucja Škoda came"]
    got = anonymized(spark, *texts)
    hidden = ["John|Ronald|Smith", "Smith|Jones", "Brien", "John|Smith", "J\\. |Smith", "Ludwig|Berg", long, label, "y1\\.y1\\.y1\\.y1", r"a@b\.com",
              r"a@b\.com", None, "JOHN|SMITH", "Łucja|Škoda"]
    for text, new, pattern in zip(texts, got, hidden):
        assert len(new) == len(text) or "John" in text or "Smith" in text or "JOHN" in text
        assert new == text if pattern is None else not re.search(pattern, new), (text[:50], new[:50])
    assert got[3].split()[2] == got[0].split()[3] and got[5].split()[2:4] == ["van", "der"] and "'s hat" in got[4]
    assert got[12].split()[1] == got[0].split()[1].upper()


def plain_surrogate(value, kind, tweak):
    """The permutation of a value without hexadecimal class, written out for one string."""
    half = len(value) // 2
    a, b = value[:half], value[half:]
    for number in range(1, pii.ROUNDS + 1):
        digest = hashlib.sha256("\x1f".join([pii.KEY, str(number), kind, tweak.lower(), b.lower()]).encode()).digest()
        moved = ""
        for i, c in enumerate(a):
            alphabet = next((x for x in pii.ALPHABETS if c in x), None)
            moved += alphabet[(alphabet.index(c) + digest[i % 32]) % len(alphabet)] if alphabet else c
        a, b = b, moved
    return a + b


def test_documents_against_plain_code(spark):
    """Emails, IPv4, SSN and cards of whole documents, found by plain patterns and replaced one by one."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text or "" for r in rows.collect()}
    after = {r.doc_id: r.text or "" for r in pii.anonymize(rows).collect()}
    assert before.keys() == after.keys()
    seen, found = {}, 0
    for doc, text in before.items():
        for m in re.finditer(r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", text):
            head, tail = m[0].rsplit(".", 1)
            new = plain_surrogate(head, "email", "." + tail) + "." + tail
            assert new in after[doc]
            assert m[0] not in after[doc] and seen.setdefault(new.lower(), m[0].lower()) == m[0].lower()
            found += 1
        for m in re.finditer(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", text):
            new = plain_surrogate(m[0].replace("-", ""), "ssn", "")
            assert f"{new[:3]}-{new[3:5]}-{new[5:]}" in after[doc]
            found += 1
    assert found
    # What holds no digit, sign of an address or title stays byte for byte.
    quiet = [d for d, t in before.items() if not re.search(pii.HINT.replace("(?i:", "(?:"), t)]
    assert quiet and all(before[d] == after[d] for d in quiet)
