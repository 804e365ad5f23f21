"""Authentication claims of a message: SPF, DKIM and DMARC results as their headers state them.

Nothing is looked up and no signature is checked. All claims of a message come from its header
block (at most 1 MiB), so they are array columns of the message row: splitting, de-duplication and
comparison stay row-local and the area needs no shuffle. Every step over a claim array is linear
or a sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailstrata import rules
from mailstrata.functions.auth import (
    balanced_comment,
    domain_text,
    known_auth_result,
    org_domain,
    split_outside_parens,
)
from mailstrata.functions.common import (
    after_index,
    first_match,
    first_token,
    let,
    null_if_empty,
    rows_of,
    strip,
    tokens,
)
from mailstrata.operators.addresses import with_from_domain
from mailstrata.operators.headers import values_of
from mailstrata.operators.observations import (
    code_counts,
    code_only,
    observation,
    observation_rows,
    present,
    warning_rows,
)

Maker = Callable[..., Column]


def last_wins(entries: Column) -> Column:
    """MAP of ARRAY<STRUCT<k,v>>; a repeated key keeps its last value.

    Up to one entry there is nothing to settle; else sort by key and position and keep the last of
    each run of equal keys.
    """

    def settle(all_entries: Column) -> Column:
        ranked = F.sort_array(F.transform(all_entries, lambda e, i: F.struct(
            e["k"].alias("k"), i.alias("i"), e["v"].alias("v"))))
        return let(ranked, lambda r: F.map_from_entries(F.transform(
            F.filter(r, lambda e, i: ~e["k"].eqNullSafe(F.get(r, i + 1)["k"])),
            lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v")))))

    return let(entries, lambda e: F.when(F.size(e) < 2, F.map_from_entries(e)).otherwise(settle(e)))


def _pair(text: Column) -> Column:
    name = F.substring_index(text, "=", 1)
    return F.struct(F.lower(strip(name)).alias("k"),
                    strip(after_index(text, F.length(name) + 2)).alias("v"))


# --- Authentication-Results ---------------------------------------------------------------


def _clause(clause: Column, authserv_id: Column) -> Column:
    """STRUCT<problem, clause, method, result, reason, properties, authserv_id>.

    ``problem`` is NULL for a result; a blank clause is neither a result nor a warning.
    """
    name = F.substring_index(clause, "=", 1)

    def words_of(c: Column) -> Column:
        return F.struct(tokens(c["rest"]).alias("words"), c["comment"].alias("reason"),
                        F.lower(strip(name)).alias("method"))

    def read(b: Column) -> Column:
        words, method = b["words"], b["method"]
        result = F.lower(F.get(words, F.lit(0)))
        pairs = F.transform(
            F.filter(F.slice(words, F.lit(2), F.size(words)), lambda t: t.contains("=")), _pair)
        problem = (
            F.when(clause == "", F.lit("blank"))
            .when(~clause.contains("="), F.lit("auth-results-clause-no-equals"))
            .when(~method.rlike(rules.AUTH_METHOD_PATTERN), F.lit("auth-results-bad-method"))
            .when(F.size(words) == 0, F.lit("auth-results-missing-result"))
        )
        return F.struct(
            problem.alias("problem"), clause.alias("clause"), method.alias("method"),
            result.alias("result"), b["reason"].alias("reason"),
            last_wins(F.filter(pairs, lambda p: p["k"] != "")).alias("properties"),
            authserv_id.alias("authserv_id"))

    comment = let(strip(after_index(clause, F.length(name) + 2)), balanced_comment)
    return let(let(comment, words_of), read)


def authentication_results(value: Column) -> Column:
    """STRUCT<no_clauses, clauses, raw> of one header value."""

    def read(segments: Column) -> Column:
        first = strip(F.get(segments, F.lit(0)))
        alone = F.size(segments) == 1
        server = F.coalesce(F.when(~alone, first_token(first)), F.lit("unknown"))
        return let(server, lambda authserv: F.struct(
            alone.alias("no_clauses"),
            F.transform(F.slice(segments, F.lit(2), F.size(segments)),
                        lambda c: let(strip(c), lambda x: _clause(x, authserv)))
            .alias("clauses"),
            value.alias("raw")))

    return let(split_outside_parens(value), read)


def _results(parsed: Column) -> Column:
    """Accepted clauses of all headers, flat, in order; ``header`` is the place of a clause's header.

    The header's text stays in the header: with many clauses in one header, a copy in each of them
    would grow with the square of its length.
    """
    return F.flatten(F.transform(parsed, lambda h, i: F.transform(
        F.filter(h["clauses"], lambda c: c["problem"].isNull()), lambda c: c.withField("header", i))))


# --- DKIM-Signature -----------------------------------------------------------------------


def dkim_signature(value: Column) -> Column:
    """STRUCT<tags, bad, raw>: last-wins tag map and the segments that are no tag."""
    segments = F.filter(F.split(value, ";"), lambda s: strip(s) != "")

    def read(b: Column) -> Column:
        pairs = F.transform(F.filter(b, lambda s: s.contains("=")), _pair)
        bad = F.transform(
            b, lambda s: F.when(~s.contains("="), F.lit("dkim-tag-no-equals"))
            .when(strip(F.substring_index(s, "=", 1)) == "", F.lit("dkim-tag-empty-name")))
        return F.struct(
            last_wins(F.filter(pairs, lambda p: p["k"] != "")).alias("tags"),
            F.filter(bad, lambda x: x.isNotNull()).alias("bad"),
            value.alias("raw"))

    return let(segments, read)


def _tag(tags: Column, name: str) -> Column:
    return null_if_empty(F.try_element_at(tags, F.lit(name)))


def _signatures(parsed: Column) -> Column:
    def read(s: Column) -> Column:
        tags = s["tags"]
        signed = F.filter(
            F.transform(F.split(F.coalesce(F.try_element_at(tags, F.lit("h")), F.lit("")), ":"),
                        lambda h: F.lower(strip(h))), lambda h: h != "")
        return F.struct(
            *[_tag(tags, t).alias(t) for t in ("d", "s", "a", "c", "bh")],
            signed.alias("h"),
            F.map_filter(tags, lambda k, _: ~k.isin(*rules.DKIM_NAMED_TAGS)).alias("other_tags"),
            F.lit(False).alias("cryptographically_verified"),
            s["raw"].alias("raw"))

    return F.transform(F.filter(parsed, lambda s: F.size(s["tags"]) > 0), read)


# --- Received-SPF -------------------------------------------------------------------------


def received_spf(value: Column) -> Column:
    """STRUCT<result, detail, balanced, empty, raw> of one header value."""
    return let(strip(value), lambda text: let(balanced_comment(text), lambda c: F.struct(
        F.lower(first_token(F.substring_index(text, "(", 1))).alias("result"),
        c["comment"].alias("detail"), c["balanced"].alias("balanced"),
        (text == "").alias("empty"), value.alias("raw"))))


# --- message columns ----------------------------------------------------------------------


def with_parsed(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "ar_headers": F.transform(values_of("authentication-results"), authentication_results),
        "dkim_headers": F.transform(values_of("dkim-signature"), dkim_signature),
        "spf_headers": F.transform(values_of("received-spf"), received_spf),
    })


def with_claims(df: DataFrame) -> DataFrame:
    """``auth_results``, ``dkim_signatures`` and ``received_spf`` array columns."""
    return with_parsed(df).withColumns({
        "auth_results": _results(F.col("ar_headers")),
        "dkim_signatures": _signatures(F.col("dkim_headers")),
        "received_spf": F.transform(
            F.filter("spf_headers", lambda s: s["result"].isNotNull()),
            lambda s: F.struct(s["result"].alias("result"), s["detail"].alias("detail"),
                               s["raw"].alias("raw"))),
    })


def _claim_rows(df: DataFrame, column: str, name: str) -> DataFrame:
    claims = with_claims(df.select("source_path", "evidence_id", "fields"))
    return rows_of(claims, ("source_path", "evidence_id"), column, name, "ordinal")


def auth_result_rows(df: DataFrame) -> DataFrame:
    fields = ("method", "result", "reason", "properties", "authserv_id")
    claims = with_claims(df.select("source_path", "evidence_id", "fields")).withColumn(
        "texts", F.transform("ar_headers", lambda h: h["raw"]))
    rows = rows_of(claims, ("source_path", "evidence_id", "texts"), "auth_results", "r", "ordinal")
    return rows.select(
        "source_path", "evidence_id", "ordinal", *[f"r.{f}" for f in fields],
        F.get("texts", F.col("r.header")).alias("raw"), known_auth_result(F.col("r.result")).alias("known_result"))


def dkim_rows(df: DataFrame) -> DataFrame:
    return _claim_rows(df, "dkim_signatures", "s").select("source_path", "evidence_id", "ordinal", "s.*")


def spf_rows(df: DataFrame) -> DataFrame:
    return _claim_rows(df, "received_spf", "s").select("source_path", "evidence_id", "ordinal", "s.*")


# --- observations -------------------------------------------------------------------------


def property_domain(properties: Column, keys: tuple[str, ...]) -> Column:
    """First usable domain over ``keys`` in order; the placeholder ``none`` is no domain."""
    stated = F.transform(F.array(*map(F.lit, keys)),
                         lambda k: domain_text(F.try_element_at(properties, k)))
    return first_match(stated, lambda d: ~d.isin("", "none"))


def claimed_domains(label: str) -> Column:
    """Sorted distinct domains a message's SPF or DKIM claims are about."""
    keys = rules.SPF_DOMAIN_KEYS if label == "spf" else rules.DKIM_DOMAIN_KEYS
    stated = F.transform(
        F.filter("auth_results", lambda r: r["method"] == label),
        lambda r: property_domain(r["properties"], keys))
    if label == "dkim":  # a signature's own d= is compared as written
        stated = F.concat(stated, F.transform("dkim_signatures", lambda s: s["d"]))
    return F.sort_array(F.array_distinct(F.filter(stated, lambda d: d.isNotNull())))


def alignment(domain: Column, from_domain: Column) -> Column:
    return (F.when(from_domain.isNull(), F.lit("unknown"))
            .when(domain == from_domain, F.lit("aligned"))
            .when(org_domain(domain) == org_domain(from_domain), F.lit("relaxed-aligned"))
            .otherwise(F.lit("unaligned")))


def conflicting_methods(results: Column) -> Column:
    """ARRAY<STRUCT<method, results MAP<result, ARRAY<authserv_id>>>> for methods with more than one
    distinct result.

    Rows are sorted once; neighbours tell where runs of equal results and of equal methods begin, and each
    run is one slice, so every row is copied a fixed number of times.
    """
    ranked = F.sort_array(F.transform(
        results, lambda r: F.struct(r["method"].alias("m"), r["result"].alias("r"),
                                    r["authserv_id"].alias("a"))))

    def starts(rows: Column, differs: Callable[[Column, Column], Column]) -> Column:
        """Places where a run of rows begins, and the end of the last one."""
        places = F.transform(rows, lambda e, i: F.when(
            (i == 0) | F.coalesce(differs(F.get(rows, i - 1), e), F.lit(True)), i))
        return F.concat(F.filter(places, lambda i: i.isNotNull()), F.array(F.size(rows)))

    def run(rows: Column, at: Column, k: Column) -> Column:
        """The rows of the k-th run."""
        return F.slice(rows, F.get(at, k) + 1, F.get(at, k + 1) - F.get(at, k))

    def each_run(at: Column, made: Callable[[Column], Column]) -> Column:
        return F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda _, k: made(k))

    def servers(rows: Column) -> Column:
        return F.transform(F.filter(rows, lambda e, i: (i == 0) | ~e["a"].eqNullSafe(F.get(rows, i - 1)["a"])),
                           lambda e: e["a"])

    def states(rows: Column) -> Column:
        """ARRAY<STRUCT<m, r, servers>>: one element per method and result."""
        at = starts(rows, lambda x, y: (x["m"] != y["m"]) | (x["r"] != y["r"]))
        return let(at, lambda at: each_run(at, lambda k: let(run(rows, at, k), lambda own: F.struct(
            F.get(own, F.lit(0))["m"].alias("m"), F.get(own, F.lit(0))["r"].alias("r"), servers(own).alias("servers")))))

    def methods(found: Column) -> Column:
        at = starts(found, lambda x, y: x["m"] != y["m"])
        return let(at, lambda at: F.filter(each_run(at, lambda k: let(run(found, at, k), lambda own: F.when(
            F.size(own) > 1, F.struct(F.get(own, F.lit(0))["m"].alias("method"), F.map_from_entries(F.transform(
                own, lambda s: F.struct(s["r"].alias("key"), s["servers"].alias("value")))).alias("results"))))),
            lambda x: x.isNotNull()))

    return let(let(ranked, states), methods)


#: Groups of authentication observations that can be asked for alone.
AUTH_GROUPS = ("absent", "results", "conflicts", "signatures", "alignment", "received_spf")


def auth_observations(df: DataFrame, groups: tuple[str, ...] = AUTH_GROUPS) -> DataFrame:
    """The observations of the authentication area, one pass, row-local.

    Only the chosen ``groups`` are built; what they do not need is pruned from the plan.
    """
    if groups == ("absent",):
        return _absent(df)
    return observation_rows(_observed(df, groups, observation), "authentication", "observed")


def auth_code_counts(df: DataFrame) -> DataFrame:
    """``area, code, observations, messages`` of the authentication area, some rows a message to be summed."""
    return code_counts(_observed(df, AUTH_GROUPS, code_only), "authentication", "observed")


def _observed(df: DataFrame, groups: tuple[str, ...], observation: Maker) -> DataFrame:
    """``observed``: the observations of the chosen groups, each made by ``observation``."""
    df = with_from_domain(with_claims(df.select("source_path", "evidence_id", "fields")))
    df = df.withColumns({
        "spf_domains": claimed_domains("spf"),
        "dkim_domains": claimed_domains("dkim"),
        "conflicts": conflicting_methods(F.col("auth_results")),
        "ar_spf": F.sort_array(F.array_distinct(F.transform(
            F.filter("auth_results", lambda r: r["method"] == "spf"), lambda r: r["result"]))),
    })
    nothing = (F.size("auth_results") + F.size("dkim_signatures") + F.size("received_spf")) == 0
    made = {
        "absent": [present((nothing, observation(
            0, "no-auth-headers", "no authentication claim to read")))],
        "results": [F.transform("auth_results", lambda r, i: _result_observation(r, i, observation))],
        "conflicts": [F.transform("conflicts", lambda c, i: observation(
            i + (2 << 32), "conflicting-auth-results",
            F.concat(F.lit("claims disagree on "), c["method"]), c["method"],
            method=c["method"], results=F.to_json(c["results"])))],
        "signatures": [F.transform("dkim_signatures", lambda s, i: observation(
            i + (3 << 32), "dkim-signature-present",
            F.concat(F.lit("unverified signature for "), F.coalesce(s["d"], F.lit("no domain"))),
            s["d"], d=s["d"], s=s["s"], a=s["a"], c=s["c"], body_hash_claim=s["bh"],
            signed_headers=F.to_json(s["h"]))),
        present((F.size("dkim_signatures") == 0, observation(
            3 << 32, "dkim-signature-absent", "the message claims no signer")))],
        "alignment": [_alignment_observations("spf", 4, observation),
                      _alignment_observations("dkim", 5, observation)],
        "received_spf": [F.flatten(F.transform(
            "received_spf", lambda s, i: _spf_observations(s, i, observation)))],
    }
    parts = [part for group in groups for part in made[group]]
    return df.withColumn("observed", F.concat(*parts))


def _absent(df: DataFrame) -> DataFrame:
    """Messages without a claim. One claim of any kind settles a message, so the kinds are asked one after the
    other, the cheapest first, and each only until it gives one."""
    names = (F.exists(values_of("received-spf"), lambda v: received_spf(v)["result"].isNotNull()),
             F.exists(values_of("dkim-signature"), lambda v: F.size(dkim_signature(v)["tags"]) > 0),
             F.exists(values_of("authentication-results"), lambda v: F.exists(
                 authentication_results(v)["clauses"], lambda c: c["problem"].isNull())))
    claimed = F.when(names[0], True).when(names[1], True).otherwise(F.coalesce(names[2], F.lit(False)))
    rows = df.select("source_path", "evidence_id", claimed.alias("claimed"))
    return observation_rows(rows.withColumn("observed", present((~F.col("claimed"), observation(
        0, "no-auth-headers", "no authentication claim to read")))), "authentication", "observed")


def _result_observation(r: Column, i: Column, observation: Maker) -> Column:
    code = F.concat_ws("-", r["method"], r["result"])
    domain = property_domain(r["properties"], rules.CLAIM_DOMAIN_KEYS)
    detail = F.concat(r["method"], F.lit("="), r["result"], F.lit(" according to "),
                      r["authserv_id"])
    return observation(
        i + (1 << 32), code, detail, r["method"], method=r["method"], result=r["result"],
        authserv_id=r["authserv_id"], domain=domain, reason=r["reason"],
        properties=F.to_json(r["properties"]))


def _alignment_observations(label: str, block: int, observation: Maker) -> Column:
    me = F.col("from_domain")

    def one(d: Column, i: Column) -> Column:
        state = alignment(d, me)
        return observation(
            i + (block << 32), F.concat(F.lit(f"{label}-alignment-"), state),
            F.concat(F.lit(f"{label} domain "), d, F.lit(" against From domain "),
                     F.coalesce(me, F.lit("(none)"))), d,
            **{f"{label}_domain": d, "from_domain": me, "strict": d == me,
               "relaxed": org_domain(d) == org_domain(me)})

    return F.transform(f"{label}_domains", one)


def _spf_observations(s: Column, i: Column, observation: Maker) -> Column:
    known = F.col("ar_spf")
    differs = (F.size(known) > 0) & ~F.array_contains(known, s["result"])
    seq = i * 2 + (6 << 32)
    return present(
        (F.lit(True), observation(
            seq, F.concat(F.lit("received-spf-"), s["result"]),
            F.concat(F.lit("Received-SPF states "), s["result"]),
            result=s["result"], detail=s["detail"])),
        (differs, observation(
            seq + 1, "spf-claim-disagreement",
            F.concat(F.lit("Received-SPF states "), s["result"], F.lit(", results state "),
                     F.array_join(known, ", ")),
            received_spf=s["result"], auth_results_spf=F.to_json(known))),
    )


# --- warnings -----------------------------------------------------------------------------


# Sequence numbers left for the clauses of one header: more than any column value has bytes for.
_ROOM = 1 << 29


def auth_warnings(df: DataFrame) -> DataFrame:
    df = with_parsed(df.select("source_path", "fields"))

    def of_results(h: Column, i: Column) -> Column:
        seq = i.cast("bigint") * _ROOM
        clauses = F.transform(
            F.filter(h["clauses"], lambda c: c["problem"].isNotNull() & (c["problem"] != "blank")),
            lambda c, k: _coded(seq + k + 1, c["problem"], c["clause"]))
        return F.concat(present((h["no_clauses"], _coded(
            seq, F.lit("auth-results-no-clauses"), h["raw"]))), clauses)

    def of_dkim(h: Column, i: Column) -> Column:
        seq = i.cast("bigint") * _ROOM + (1 << 60)
        segments = F.transform(h["bad"], lambda code, k: _coded(seq + k, code, h["raw"]))
        return F.concat(segments, present(
            (F.size(h["tags"]) == 0, _coded(seq + (_ROOM - 2), F.lit("dkim-no-tags"), h["raw"])),
            ((F.size(h["tags"]) > 0) & ~F.map_contains_key(h["tags"], "d"),
             _coded(seq + (_ROOM - 1), F.lit("dkim-missing-d"), h["raw"]))))

    def of_spf(h: Column, i: Column) -> Column:
        seq = i.cast("bigint") * 4 + (2 << 60)
        return present(
            (h["empty"], _coded(seq, F.lit("received-spf-empty"), h["raw"])),
            (~h["balanced"], _coded(seq + 1, F.lit("received-spf-unbalanced-paren"), h["raw"])),
            (~h["empty"] & h["result"].isNull(),
             _coded(seq + 2, F.lit("received-spf-no-result"), h["raw"])))

    warned = F.concat(F.flatten(F.transform("ar_headers", of_results)),
                      F.flatten(F.transform("dkim_headers", of_dkim)),
                      F.flatten(F.transform("spf_headers", of_spf)))
    return warning_rows(df.withColumn("warned", warned), "auth", "warned")


def _coded(seq: Column, code: Column, detail: Column) -> Column:
    return F.struct(seq.cast("bigint").alias("seq"), code.alias("code"), detail.alias("detail"),
                    F.lit(None).cast("string").alias("part"))
