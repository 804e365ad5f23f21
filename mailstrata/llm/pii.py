"""Surrogates for personal data, by built-in expressions only.

Detected: e-mail addresses, phone numbers, payment cards (with a right check digit), IPv4 addresses,
US social security numbers, credentials assigned to a name, and names behind a title. Everything else
in a text stays byte for byte.

A surrogate is drawn by a keyed permutation of all values of the same format, so it needs no table of
what was seen, and no shuffle:

* letters stay letters of their script and case, digits digits, punctuation stays; a card gets a right
  check digit; address bytes stay in range; a listed given name becomes another of its gender and
  script;
* *coreference*: the same value (in any letter case or digit grouping) always gets the same surrogate;
* *distinctness*: a permutation gives different values different surrogates; where two classes of value
  are permuted apart (listed and unlisted names, hexadecimal and other credentials), a value that lands
  in the other class is permuted again until it is in its own. ``collisions`` checks the outcome over
  the distinct entities of a corpus before anything is replaced. What still meets (letters outside the
  alphabets that have an ordinary letter as their lower case) is drawn again by itself; every other
  entity has the surrogate that the key alone gives, in any corpus.

A name is a title and the capitalized words behind it, initials, particles ("van der") and compounds
included; without its title it is not found, not even where the same person has one elsewhere.

The permutation is a Feistel network over the two halves of the value: in each round one half's
characters are rotated within their alphabets by the digest of key, round, kind and the other half.

Defined cases: a NULL text stays NULL, an empty one empty; a text is searched whole, whatever its length,
and no entity has a longest length; ids are not used, so ties cannot arise; repeated rows, extra columns
of any name and empty tables pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailstrata.llm.common import named

KEY = "change-me"
ROUNDS = 4
#: Steps a value may take out of a class that is permuted apart; each misses with 6/26 at most.
STEPS = 32

_EXTENDED = "".join(c for c in map(chr, range(0x100, 0x180)) if len(c.upper()) == 1 and "\u0100" <= c.upper() < "\u0180"
                    and c.upper() != c and c not in "œ")
#: Alphabets a character stays in.
ALPHABETS = (
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýœß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒẞ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", _EXTENDED, _EXTENDED.upper())
HEX = ("0123456789abcdef", "0123456789ABCDEF")

#: Titles by the gender of the names behind them; "any" says nothing about it.
TITLES = {"male": ("Mr.", "Mr", "Herr", "Monsieur", "Señor", "господин"),
          "female": ("Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Señora", "госпожа"),
          "any": ("Dr.", "Dr", "Prof.", "Professor")}
#: Words inside a name that stay.
PARTICLES = ("von", "van", "der", "den", "de", "da", "di", "del", "la", "le", "bin", "al")
#: Given names by gender and script.
NAMES = {
    ("male", "latin"): (
        "James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Paul", "Mark", "George", "Edward",
        "Henry", "Charles", "Daniel", "Samuel", "Hans", "Karl", "Jürgen", "Klaus", "Stefan", "Wolfgang", "Pierre", "Jean",
        "Louis", "Jacques", "Luis", "Carlos", "Jorge", "Miguel", "José", "Pablo", "Marco", "Giovanni", "Lars", "Erik"),
    ("female", "latin"): (
        "Mary", "Linda", "Susan", "Sarah", "Karen", "Nancy", "Emma", "Anna", "Julia", "Laura", "Alice", "Helen",
        "Ruth", "Grace", "Emily", "Rachel", "Heidi", "Greta", "Ursula", "Monika", "Sabine", "Petra", "Marie", "Claire",
        "Camille", "Juliette", "Carmen", "Elena", "Sofia", "Lucía", "María", "Pilar", "Chiara", "Giulia", "Ingrid", "Astrid"),
    ("male", "cyrillic"): ("Иван", "Пётр", "Сергей", "Андрей", "Дмитрий", "Николай", "Павел", "Алексей", "Михаил", "Виктор",
                           "Олег", "Юрий", "Борис", "Максим", "Роман"),
    ("female", "cyrillic"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана", "Людмила",
                             "Галина", "Юлия", "Вера", "Надежда", "Дарья", "Ксения"),
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLES = "|".join(t.replace(".", r"\.") for titles in TITLES.values() for t in titles)
#: What a credential is assigned to; the quote closes a quoted name.
_ASSIGNED = r"(?i:\b(?:token|secret|password|passwd|api[_-]?key))[\"']? ?[=:] ?"
_BARE = r"[^\s\"'<>,;&]"
_LABEL = r"[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+"
_TOP = r"[A-Za-z]{2,}+(?![A-Za-z0-9])"
#: Letters of a name, compounds included; a possessive 's is no part of it.
_PART = r"[\p{L}\p{M}]"
_WORD = rf"\p{{Lu}}{_PART}++(?:['’-](?!s(?!{_PART})){_PART}++)*+|\p{{Lu}}['’]\p{{Lu}}{_PART}++(?:-{_PART}++)*+|\p{{Lu}}\.(?= \p{{Lu}})"
#: One pattern per kind; every open quantifier is possessive and starts at a border, so a match is linear. A value
#: without quotes stands right behind "=", or has six characters and a digit (else "the secret: nobody knew" is one).
KINDS = {
    "credential": rf"{_ASSIGNED}(?:\"[^\"\s]++\"|'[^'\s]++'|(?<==){_BARE}++|(?={_BARE}{{6}})(?=[^\s\"'<>,;&\d]*+\d){_BARE}++)",
    "email": rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++@-*+(?={_LABEL}(?:\.(?!{_TOP}){_LABEL})*+\.{_TOP})"
             rf"{_LABEL}(?:\.{_LABEL})++",
    "card": r"(?<![\p{L}\p{N}.])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}.+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}"
             r"|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.\d)",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLES}) (?:{_WORD})(?: (?:(?:{'|'.join(PARTICLES)}) )*+(?:{_WORD}))*+(?![\p{{L}}\p{{N}}])",
}
PATTERN = "|".join(KINDS.values())
#: What every entity holds; texts without it are not searched further.
HINT = rf"[0-9@\"=]|: ?'|{_TITLES}"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _text(value: str) -> Column:
    return F.lit(value)


def _rotate(c: Column, by: Column, hex_: Column) -> Column:
    """A character moved on within its alphabet; hexadecimal digits stay such in hexadecimal values."""
    out = c
    for alphabet, use in [*((x, None) for x in reversed(ALPHABETS)), (HEX[1], hex_ != ""), (HEX[0], hex_ == "lower")]:
        at = F.instr(_text(alphabet), c)
        fits = at > 0 if use is None else use & (at > 0)
        out = F.when(fits, F.substring(_text(alphabet), (at - 1 + by) % len(alphabet) + 1, F.lit(1))).otherwise(out)
    return out


def _byte(digest: Column, i: Column) -> Column:
    """Byte ``i`` (from 0, taken modulo 32) of a digest in hexadecimal."""
    return F.conv(F.substring(digest, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("int")


def _cipher(value: Column, key: Column, kind: Column, tweak: Column, hex_: Column) -> Column:
    """A keyed permutation of the values of the same length and character classes.

    A round turns halves (a, b) into (b, a rotated by the digest of b); ROUNDS is even, so the halves
    end in their places.
    """
    def turn(state: Column, number: Column) -> Column:
        digest = F.sha2(F.concat_ws("\x1f", key, number.cast("string"), kind, F.lower(tweak), F.lower(state["b"])), 256)
        # By the array of characters: a place of a string is found from its start, which is quadratic.
        moved = _let(digest, lambda d: F.array_join(F.transform(F.split(state["a"], ""), lambda c, i: F.when(
            c == "", c).otherwise(_rotate(c, _byte(d, i), hex_))), ""))
        return F.struct(state["b"].alias("a"), moved.alias("b"))

    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("a"),
                     F.substring(value, half + 1, F.length(value)).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    places = F.sequence(F.lit(1), F.length(shape))
    return F.array_join(F.transform(places, lambda i: _let(F.substring(shape, i, F.lit(1)), lambda c: F.when(
        c.between("0", "9"),
        F.substring(digits, F.length(_digits(F.substring(shape, F.lit(1), i))), F.lit(1))).otherwise(c))), "")


def _luhn(digits: Column) -> Column:
    """Sum of the check rule over all digits of a number, the last one undoubled."""
    n = F.length(digits)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + _let(
        F.substring(digits, n - i + 1, F.lit(1)).cast("int"),
        lambda d: F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))))


def _ip(m: Column, key: Column) -> Column:
    def turn(state: Column, number: Column) -> Column:
        digest = F.sha2(F.concat_ws("\x1f", key, number.cast("string"), F.lit("ip"), state["b"].cast("string")), 256)
        by = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")
        return F.struct(state["b"].alias("a"), ((state["a"] + by) % 65536).alias("b"))

    part = F.split(m, r"\.")
    start = F.struct((part[0].cast("int") * 256 + part[1].cast("int")).alias("a"),
                     (part[2].cast("int") * 256 + part[3].cast("int")).alias("b"))
    octets = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat_ws(".", octets(s["a"]), octets(s["b"])))


def _plain(word: Column) -> Column:
    """The spelling of a word in the lists of names."""
    return F.initcap(word)


def _lists(title: Column) -> list[tuple[tuple[str, str], tuple[str, ...], Column]]:
    """Every list of names with the condition that its gender can stand behind ``title``."""
    return [(of, names, title.isin([*TITLES[of[0]], *TITLES["any"]])) for of, names in NAMES.items()]


def _is_listed(word: Column, title: Column) -> Column:
    found = [fits & _plain(word).isin(list(names)) for _, names, fits in _lists(title)]
    return found[0] | found[1] | found[2] | found[3]


def _listed(word: Column, key: str, title: Column) -> Column:
    """The surrogate of a listed name that fits the title, NULL for other words.

    The names of a list stand on one ring in an order that a keyed digest gives; each becomes the next.
    """
    out = F.lit(None).cast("string")
    for of, names, fits in _lists(title):
        ring = sorted(names, key=lambda n: hashlib.sha256("\x1f".join([key, *of, n]).encode()).digest())
        turned = F.create_map(*[F.lit(x) for n, new in zip(ring, ring[1:] + ring[:1]) for x in (n, new)])
        new = turned[_plain(word)]
        shaped = F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(new)).otherwise(new)
        out = F.when(fits & _plain(word).isin(list(names)), shaped).otherwise(out)
    return out


#: Country codes at the start of a phone's digits: no code is the start of another.
CODE = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def kind_of(m: Column) -> Column:
    """Kind of a match of PATTERN; NULL for a card number whose check digit is wrong."""
    return F.when(m.rlike(f"^{_ASSIGNED}"), "credential").when(m.contains("@"), "email") \
        .when(m.rlike(r"^\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}$"), F.when(_luhn(_digits(m)) % 10 == 0, "card")) \
        .when(m.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip").when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn") \
        .when(m.rlike(r"^[+(\d]"), "phone").otherwise("name")


def canonical(m: Column, kind: Column) -> Column:
    """What coreference compares: lower case, and numbers without their grouping."""
    return F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(m, r"[^\d+]", "")).otherwise(F.lower(m))


def surrogate(m: Column, key: str = KEY, redrawn: dict[tuple[str, str], int] | None = None) -> Column:
    """The surrogate of one detected entity; ``redrawn`` counts the further draws of (kind, canonical entity).

    An entity is a head that stays, words that are permuted, and a tail: the top-level domain of an
    address, the quote of a credential; numbers are permuted as their digits and put back in shape.
    """
    def built(kind: Column) -> Column:
        head = F.when(kind == "credential", F.regexp_extract(m, rf"^{_ASSIGNED}[\"']?", 0)) \
            .when(kind == "card", F.substring(m, F.lit(1), F.lit(1))) \
            .when(kind == "name", F.regexp_extract(m, rf"^(?:{_TITLES}) ", 0)).otherwise("")
        # Punctuation behind a value without quotes belongs to the sentence.
        closing = F.when(head.rlike("[=:] ?[\"']$"), F.substring(head, F.length(head), F.lit(1))).otherwise(
            F.substring(m, F.length(F.rtrim(m, F.lit(".!?:)]}"))) + 1, F.length(m)))
        tail = F.when(kind == "credential", closing).when(kind == "email", F.regexp_extract(m, r"\.[A-Za-z]+$", 0)) \
            .when(kind == "card", F.substring(m, F.length(m), F.lit(1))).otherwise("")
        return _let(F.struct(head.alias("head"), tail.alias("tail")), lambda e: split(kind, e["head"], e["tail"]))

    def split(kind: Column, head: Column, tail: Column) -> Column:
        middle = F.substring(m, F.length(head) + 1, F.length(m) - F.length(head) - F.length(tail))
        return _let(middle, lambda x: assembled(kind, head, x, tail))

    def assembled(kind: Column, head: Column, middle: Column, tail: Column) -> Column:
        number = kind.isin("card", "phone", "ssn")
        digits = _digits(middle)
        # A phone's country code stays; it is found in the digits, so grouping cannot matter.
        code = F.when((kind == "phone") & middle.startswith("+"), F.regexp_extract(digits, CODE, 0)).otherwise("")
        value = F.when(number, F.substring(digits, F.length(code) + 1, F.length(digits))).otherwise(middle)
        words = F.when(kind == "name", F.split(value, " ")).otherwise(F.array(value))
        # Grouping and letter case are no part of what the permutation depends on.
        tweak = F.when(kind == "credential", "").when(kind == "name", "").when(kind == "email", tail) \
            .when(kind == "phone", F.when(middle.startswith("+"), F.concat(F.lit("+"), code)).otherwise("")).otherwise(head)
        # A class of its own, in any letter case: hexadecimal values stay in it and others walk out of it.
        hexadecimal = lambda c: (kind == "credential") & (F.length(c) >= 12) & c.rlike("^[0-9A-Fa-f]+$")
        hex_ = F.when(~hexadecimal(middle), "").when(middle == F.lower(middle), "lower") \
            .when(middle == F.upper(middle), "upper").otherwise("lower")
        drawn = F.concat(F.lit(key), drawn_again(kind))
        title = F.trim(head)

        def one(word: Column) -> Column:
            foreign = lambda at: ((kind == "name") & _is_listed(at, title)) | ((hex_ == "") & hexadecimal(at))
            walked = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), word, lambda at, i: F.when(
                (i == 1) | foreign(at), _cipher(at, drawn, kind, tweak, hex_)).otherwise(at))
            kept = F.when(kind != "name", None).when(word.isin(list(PARTICLES)), word).otherwise(_listed(word, key, title))
            return F.coalesce(kept, walked)

        new = F.array_join(F.transform(words, one), " ")
        shaped = _let(new, lambda n: F.when(number, _refill(middle, F.concat(code, n))).otherwise(n))
        check = lambda n: ((10 - _luhn(F.concat(head, _digits(n), F.lit("0"))) % 10) % 10).cast("string")
        return _let(shaped, lambda n: F.concat(head, n, F.when(kind == "card", check(n)).otherwise(tail)))

    def drawn_again(kind: Column) -> Column:
        if not redrawn:
            return F.lit("")
        draws = F.create_map(*[F.lit(x) for (of, value), n in redrawn.items() for x in (f"{of}\x1f{value}", f"\x1e{n}")])
        return F.coalesce(draws[F.concat(kind, F.lit("\x1f"), canonical(m, kind))], F.lit(""))

    return _let(kind_of(m), lambda kind: F.when(kind.isNull(), m).when(
        kind == "ip", _ip(m, F.concat(F.lit(key), drawn_again(kind)))).otherwise(built(kind)))


def entities(text: Column) -> Column:
    """Array of the entities of a text, in order, wrong card numbers included (they stay as they are)."""
    return F.regexp_extract_all(text, _text(PATTERN), F.lit(0))


def replaced(text: Column, key: str = KEY, redrawn: dict[tuple[str, str], int] | None = None) -> Column:
    """``text`` with every entity replaced by its surrogate."""
    between = F.split(text, PATTERN, -1)
    new = F.transform(entities(text), lambda m: surrogate(m, key, redrawn))
    joined = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(text.rlike(HINT), joined).otherwise(text)


def anonymize(df: DataFrame, text_column: str = "text", key: str = KEY) -> DataFrame:
    """``df`` with its text column replaced; all columns and rows stay. Reads ``df`` once more for the check."""
    new = replaced(named(text_column).cast("string"), key, draws(df, text_column, key))
    return df.select(*[new.alias(c) if c == text_column else named(c) for c in df.columns])


def pairs(df: DataFrame, text_column: str = "text", key: str = KEY,
          redrawn: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """(kind, entity, surrogate): the distinct entities of ``df`` and their surrogates, both canonical."""
    text = named(text_column).cast("string")
    found = df.where(text.rlike(HINT)).select(F.explode(entities(text)).alias("entity")).distinct() \
        .select(kind_of(F.col("entity")).alias("kind"), F.col("entity"), surrogate(F.col("entity"), key, redrawn).alias("new"))
    return found.where("kind is not null").select(
        "kind", canonical(F.col("entity"), F.col("kind")).alias("entity"),
        canonical(F.col("new"), F.col("kind")).alias("surrogate")).distinct()


def collisions(df: DataFrame, text_column: str = "text", key: str = KEY,
               redrawn: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """(kind, surrogate, values): surrogates that two different entities of ``df`` share; none is right."""
    return pairs(df, text_column, key, redrawn).groupBy("kind", "surrogate").agg(
        F.count("*").alias("values")).where("values > 1")


def draws(df: DataFrame, text_column: str = "text", key: str = KEY) -> dict[tuple[str, str], int]:
    """Further draws of the entities that share a surrogate, until none does; empty for ordinary corpora.

    Only entities that meet are drawn again, all others keep theirs. They are few by construction: every
    class of values is permuted within itself, so only letters outside the alphabets can bring two together.
    """
    redrawn: dict[tuple[str, str], int] = {}
    for draw in count(1):
        shared = collisions(df, text_column, key, redrawn)
        if not shared.limit(1).count():
            return redrawn
        meeting = pairs(df, text_column, key, redrawn).join(shared, ["kind", "surrogate"], "left_semi")
        redrawn = redrawn | {(r["kind"], r["entity"]): draw for r in meeting.collect()}
    return redrawn
