"""URL spellings in text: candidates, trimming, defanging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailstrata import rules
from mailstrata.functions.common import SPACE, count_of, let

# What counts as a URL in running text.
URL_PATTERN = rf"(?iU)(?:hxxps?|https?)(?:\[:\]|:)//[^{SPACE}\"'<>]+"
DISPLAY_URL_PATTERN = rf"(?iU)https?://[^{SPACE}\"'<>]+"


def url_spellings(text: Column) -> Column:
    """ARRAY<STRING> of URL-like substrings in text order, before trimming."""
    return F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(0))


def clean_url_text(text: Column) -> Column:
    """Drop trailing sentence punctuation, then closers that have no opener.

    The closing run at the end holds no openers, so the closers to drop follow from counts: of each
    kind at most ``closers - openers`` go, and the cut stops at the first one that has to stay.
    """

    def cut(url: Column) -> Column:
        def drop(run: Column) -> Column:
            lengths = []
            for opener, closer in (("(", ")"), ("[", "]"), ("{", "}")):
                surplus = F.greatest(count_of(url, closer) - count_of(url, opener), F.lit(0))
                after_kept = F.call_function(
                    "substring_index", run, F.lit(closer), -(surplus + F.lit(1))
                )
                lengths.append(F.length(after_kept))
            return F.left(url, F.length(url) - F.least(*lengths))

        # Trimming from the end, not a pattern: linear wherever runs of such characters stand.
        run = F.length(url) - F.length(F.rtrim(url, F.lit(")]}'\"")))
        return let(F.right(url, run), drop)

    return let(F.rtrim(text, F.lit(".,;:!?")), cut)


def looks_defanged(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("hxxp") | low.contains("[.]") | low.contains("[:]")


def undefang_url(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?i)^hxxps(?=://|\[:\])", "https")
    out = F.regexp_replace(out, r"(?i)^hxxp(?=://|\[:\])", "http")
    out = F.replace(out, F.lit("[:]"), F.lit(":"))
    return F.replace(out, F.lit("[.]"), F.lit("."))


def _dots(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit("[.]"))


def defang_url(url: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(low.startswith("https://"),
               F.concat(F.lit("hxxps://"), _dots(F.substring(url, 9, 2**31 - 1))))
        .when(low.startswith("http://"),
              F.concat(F.lit("hxxp://"), _dots(F.substring(url, 8, 2**31 - 1))))
        .otherwise(F.regexp_replace(url, r"\.(?!\])", "[.]"))
    )


def defang_text(text: Column) -> Column:
    """Defang every http(s) URL inside free text; only a lower-case scheme is rewritten."""

    def shown(url: Column) -> Column:
        out = F.replace(url, F.lit("https://"), F.lit("hxxps://"))
        return _dots(F.replace(out, F.lit("http://"), F.lit("hxxp://")))

    gaps = F.split(text, DISPLAY_URL_PATTERN, -1)
    urls = F.regexp_extract_all(text, F.lit(DISPLAY_URL_PATTERN), F.lit(0))
    pieces = F.zip_with(gaps, urls, lambda g, u: F.concat(g, F.coalesce(shown(u), F.lit(""))))
    return F.array_join(pieces, "")


def truncate_display(value: Column, limit: int) -> Column:
    before, after = rules.TRUNCATION_MARK
    extra = F.length(value) - F.lit(limit)
    return F.when(
        extra > 0,
        F.concat(F.left(value, F.lit(limit)), F.lit(before), extra.cast("string"), F.lit(after)),
    ).otherwise(value)
