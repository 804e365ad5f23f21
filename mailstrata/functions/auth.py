"""Text of authentication claims: comment-aware splitting and claimed domains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailstrata import rules
from mailstrata.functions.common import count_of, first_match, let, null_if_empty, strip

#: A comment with up to two levels inside it, and how many parentheses a value may have to be read by it (the
#: pattern recurses once for each). Other values are scanned; the results are the same.
_SHALLOW = r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)"
_FEW = 16
_CUT = "\u0001"

#: A level and a token's place in one sortable number: places stay below this.
_PLACES = 1 << 32


def _places(tokens: Column, wanted: Callable[[Column], Column]) -> Column:
    """Places, from 0, of the tokens that are ``wanted``."""
    found = F.transform(tokens, lambda t, i: F.when(wanted(t), i.cast("long")))
    return F.filter(found, lambda i: i.isNotNull())


def _with_text(tokens: Column, pieces: Column) -> Column:
    """Every token behind the text that precedes it."""
    return F.transform(tokens, lambda t, i: F.concat(F.get(pieces, i), t))


def _few_parens(value: Column) -> Column:
    return count_of(value, "(") <= _FEW


def split_outside_parens(value: Column, sep: str = ";") -> Column:
    """Split on ``sep``, except inside (possibly nested) parentheses.

    Values without a parenthesis take the plain split. Otherwise the depth at every separator follows
    from places alone: the m-th separator has as many opening parentheses before it as its place exceeds
    m when closing ones are left out, and the same the other way round. A closing parenthesis without a
    partner does not take the depth below zero: it is one where the balance first reaches a new low, and
    those before a separator are counted by sorting both kinds of places together. Nothing is
    accumulated, so the work is that of sorting the places.
    """
    found = F.regexp_extract_all(value, F.lit(rf"[(){sep}]"), F.lit(0))
    between = F.split(value, rf"[(){sep}]")

    def is_sep(t: Column) -> Column:
        return t == sep

    def lone(tokens: Column) -> Column:
        """Places of closing parentheses without a partner, ascending."""
        closing = _places(tokens, lambda t: t == ")")
        among = _places(F.filter(tokens, lambda t: t != sep), lambda t: t == ")")
        lows = let(among, lambda own: F.transform(closing, lambda at, k: F.when(
            F.get(own, k) < 2 * k + 1, (2 * k + 1 - F.get(own, k)) * F.lit(_PLACES) + at)))
        return let(F.sort_array(F.filter(lows, lambda x: x.isNotNull())), lambda by_level: F.transform(
            F.filter(by_level, lambda x, i: (i == 0) | (
                F.floor(x / _PLACES) != F.floor(F.get(by_level, i - 1) / _PLACES))),
            lambda x: x % _PLACES))

    def cuts(tokens: Column) -> Column:
        """Places of the separators at depth zero."""
        opened = _places(F.filter(tokens, lambda t: t != ")"), is_sep)
        closed = _places(F.filter(tokens, lambda t: t != "("), is_sep)

        def outside(b: Column) -> Column:
            mixed = F.sort_array(F.concat(F.transform(lone(tokens), lambda x: 2 * x),
                                          F.transform(b["seps"], lambda x: 2 * x + 1)))
            lifted = _places(mixed, lambda x: x % 2 == 1)
            return let(lifted, lambda up: F.filter(b["seps"], lambda at, m: (
                F.get(b["opened"], m) - F.get(b["closed"], m) + F.get(up, m) - m) == 0))

        return let(F.struct(_places(tokens, is_sep).alias("seps"), opened.alias("opened"),
                            closed.alias("closed")), outside)

    def segments(b: Column) -> Column:
        shown, ends = b["shown"], b["ends"]

        def segment(end: Column, k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1) + 1)
            inside = F.slice(shown, (start + 1).cast("int"), (end - start).cast("int"))
            return F.concat(F.array_join(inside, ""), F.get(b["pieces"], end.cast("int")))

        return F.transform(ends, segment)

    nested = let(F.struct(found.alias("tokens"), between.alias("pieces")), lambda b: let(F.struct(
        _with_text(b["tokens"], b["pieces"]).alias("shown"), b["pieces"].alias("pieces"),
        F.concat(cuts(b["tokens"]), F.array(F.size(b["tokens"]).cast("long"))).alias("ends")), segments))
    runs = F.regexp_extract_all(value, F.lit(rf"[^(){sep}]+|{_SHALLOW}|[(){sep}]"), F.lit(0))

    def shallow(found: Column) -> Column:
        """NULL where a parenthesis is left over."""
        joined = F.array_join(F.transform(found, lambda t: F.when(t == sep, F.lit(_CUT)).otherwise(t)), "")
        return F.when(~F.exists(found, lambda t: t.isin("(", ")")), F.split(joined, _CUT))

    simple = F.when(_few_parens(value) & ~value.contains(_CUT), let(runs, shallow))
    return F.when(value.contains("("), F.coalesce(simple, nested)).otherwise(F.split(value, sep))


def balanced_comment(value: Column) -> Column:
    """STRUCT<rest, comment, balanced> of the first ``(...)`` in ``value``.

    ``comment`` keeps nested parentheses; when the first one is never closed the remaining text is
    the comment and ``balanced`` is false. Without any parenthesis ``rest`` is the value itself. The
    comment ends at the first closing parenthesis with as many opening as closing ones up to it: the k-th
    from 0, at place 2 k + 1.
    """
    before = F.substring_index(value, "(", 1)
    from_open = F.substring(value, F.length(before) + 1, F.length(value))
    tokens = F.regexp_extract_all(from_open, F.lit(r"[()]"), F.lit(0))
    pieces = F.split(from_open, r"[()]")

    def result(b: Column) -> Column:
        done, text = b["end"].isNotNull(), b["text"]
        head = F.when(done, F.concat(F.array_join(F.slice(_with_text(b["tokens"], b["pieces"]), F.lit(1), b["end"].cast("int")), ""),
                                     F.get(b["pieces"], b["end"].cast("int")))).otherwise(text)
        return let(head, lambda h: F.struct(
            strip(F.when(done, F.concat(before, F.lit(" "), F.substring(text, F.length(h) + 2, F.length(text)))).otherwise(before))
            .alias("rest"),
            null_if_empty(strip(F.substring(h, F.lit(2), F.length(h)))).alias("comment"), done.alias("balanced")))

    def read(b: Column) -> Column:
        closing = F.transform(_places(b["tokens"], lambda t: t == ")"), lambda at, k: F.when(at == 2 * k + 1, at))
        return let(F.struct(b["tokens"].alias("tokens"), b["pieces"].alias("pieces"), from_open.alias("text"),
                            first_match(closing, lambda at: at.isNotNull()).alias("end")), result)

    plain = F.struct(value.alias("rest"), F.lit(None).cast("string").alias("comment"),
                     F.lit(True).alias("balanced"))
    scanned = let(F.struct(tokens.alias("tokens"), pieces.alias("pieces")), read)

    def shallow(comment: Column) -> Column:
        after = F.substring(from_open, F.length(comment) + 1, F.length(value))
        return F.when(comment != "", F.struct(
            strip(F.concat(before, F.lit(" "), after)).alias("rest"),
            null_if_empty(strip(F.substring(comment, F.lit(2), F.length(comment) - 2))).alias("comment"), F.lit(True).alias("balanced")))

    simple = F.when(_few_parens(value), let(F.regexp_extract(value, rf"^[^(]*+({_SHALLOW})", 1), shallow))
    return F.when(value.contains("("), F.coalesce(simple, scanned)).otherwise(plain)


def known_auth_result(result: Column) -> Column:
    return F.lower(result).isin(*rules.KNOWN_AUTH_RESULTS)


def domain_text(value: Column) -> Column:
    """Like ``domain_of``, with an empty text where there is no domain."""
    text = F.ltrim(strip(F.lower(value)), F.lit("@"))
    return F.rtrim(strip(F.substring_index(text, "@", -1)), F.lit("."))


def domain_of(value: Column) -> Column:
    """Domain of ``user@domain``, ``@domain`` or ``domain``, lower case; NULL when there is none."""
    return null_if_empty(domain_text(value))


def org_domain(domain: Column) -> Column:
    """Last two labels; one label stands for itself. No public-suffix list is consulted."""
    return null_if_empty(F.substring_index(domain, ".", -2))
