"""Link structure of HTML parts. Nothing is rendered; the standard library tokenizes.

The tokenizer only logs what it meets, in order; what belongs to which anchor is then read off the
positions in that log.
"""

from __future__ import annotations

from bisect import bisect_left
from html.parser import HTMLParser
from itertools import pairwise
from typing import Any

from pyspark.sql import DataFrame

from mailstrata.sources.arrow_stage import arrow_stage

LINK_TYPE = "struct<kind:string,tag:string,attr:string,value:string,anchor_text:string>"
LINKS_TYPE = f"struct<failed:string,links:array<{LINK_TYPE}>>"


class _Log(HTMLParser):
    """Link attributes, ends of anchors and text nodes in document order."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[tuple[int, str, str, str]] = []  # (position, tag, attribute, value)
        self.ends: list[int] = []
        self.texts: list[tuple[int, str]] = []
        self.size = 0
        self.feed(html)
        self.close()

    def place(self) -> int:
        self.size += 1
        return self.size

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.links += [(self.place(), tag, name, value) for name, value in attrs
                       if name in ("href", "src") and value is not None]

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.ends.append(self.place())

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            self.texts.append((self.place(), data))


def _anchor_texts(log: _Log) -> dict[str, str]:
    """Target -> text of the first anchor that shows it; an anchor ends at its end tag, and is void if
    another one starts before that."""
    starts = [(at, value) for at, tag, attr, value in log.links if (tag, attr) == ("a", "href")]
    places = [at for at, _ in log.texts]
    shown: dict[str, str] = {}
    for (at, value), (following, _) in pairwise([*starts, (log.size + 1, "")]):
        k = bisect_left(log.ends, at)
        if k < len(log.ends) and log.ends[k] < following and value not in shown:
            inside = log.texts[bisect_left(places, at): bisect_left(places, log.ends[k])]
            shown[value] = "".join(text for _, text in inside).strip()
    return shown


def _links(html: str, absolute_only: bool) -> dict[str, Any]:
    try:
        log = _Log(html)
    except Exception as exc:
        return {"failed": str(exc), "links": []}
    shown = _anchor_texts(log)
    rows = [(f"html-{attr}", tag, attr, value, shown.get(value)) for _, tag, attr, value in log.links]
    rows += [("html-text", None, None, text, None) for _, text in log.texts]
    names = ("kind", "tag", "attr", "value", "anchor_text")
    return {"failed": None, "links": [dict(zip(names, map(_valid, row))) for row in rows
                                      if not absolute_only or "//" in row[3]]}


def _valid(text: str | None) -> str | None:
    return None if text is None else text.encode("utf-8", "replace").decode("utf-8")


def html_links(df: DataFrame, html_col: str, out: str = "html_links", absolute_only: bool = False,
               ) -> DataFrame:
    """Replace an HTML column by STRUCT<failed, links>: attributes in document order, then texts.

    ``anchor_text`` is the first text shown for that target in the document. ``absolute_only`` keeps
    only values that can hold an absolute URL.
    """
    return arrow_stage(df, html_col, out, LINKS_TYPE, lambda html: _links(html, absolute_only))
