"""HTML: titles and links as expressions, Markdown as a vectorised function on the standard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.text import bound, once

_SKIP = {"script", "style", "nav", "footer", "noscript", "template", "title"}
_BREAKS = {"p", "div", "section", "article", "ul", "ol", "table", "tr", "blockquote", "pre"}


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.cells = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIP or tag == "head":
            self.hidden += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" | " if self.cells else "")
            self.cells += 1
        elif tag in _BREAKS:
            self.cells = 0
            self.out.append("\n" if tag == "tr" else "\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP or tag == "head":
            self.hidden = max(0, self.hidden - 1)
        elif tag in _BREAKS or tag[:1] == "h" and tag[1:].isdigit():
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def to_markdown(html: str | None) -> str:
    """Visible text as Markdown, without links and images; repeated blocks once."""
    if not html:
        return ""
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    seen, blocks = set(), []
    for block in "".join(parser.out).split("\n\n"):
        text = "\n".join(re.sub(" +", " ", x).strip() for x in block.split("\n")).strip()
        if text and text not in seen:
            seen.add(text)
            blocks.append(text)
    return "\n\n".join(blocks)


@F.pandas_udf(T.StringType())
def _markdown(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pages.map(to_markdown)


def markdown(html: Column) -> Column:
    return once(_markdown)(html)


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))


def links(html: Column) -> Column:
    """array<string>: href values, fragments and other schemes aside, first occurrences in order."""
    found = F.regexp_extract_all(html, F.lit(r"href=[\"']([^\"']+)[\"']"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda h: ~F.regexp_like(h, F.lit("^(#|javascript:|mailto:|tel:|data:)"))))


def _without_dots(path: Column) -> Column:
    """A path from its root on, without . and .. segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    ends_in_folder = F.element_at(parts, -1).isin(".", "..")
    return bound(F.array_join(kept, "/"), lambda p: F.concat(F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p)), F.when(ends_in_folder & ~F.endswith(p, F.lit("/")) & (p != ""), "/").otherwise("")))


def absolute(url: Column, href: Column) -> Column:
    """href against the address of its page, as RFC 3986 resolves references; fragments go."""
    reference = F.regexp_replace(href, "(?s)#.*$", "")
    scheme, authority = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(url, r"^[^/?#]*//([^/?#]*)", 1)
    origin = F.concat(scheme, F.lit("://"), authority)
    base_path = F.regexp_extract(url, r"^[^/?#]*//[^/?#]*([^?#]*)", 1)
    page = F.regexp_replace(url, "(?s)#.*$", "")
    path, query = F.regexp_extract(reference, r"^([^?]*)", 1), F.regexp_extract(reference, r"(?s)(\?.*)$", 1)
    folder = F.when(base_path == "", "/").otherwise(F.regexp_replace(base_path, "[^/]*$", ""))
    whole = F.regexp_extract(reference, r"^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/?]*)?)", 1)
    elsewhere = F.regexp_extract(reference, r"^(//[^/?]*)", 1)
    tail = lambda head: F.regexp_extract(F.substr(reference, F.length(head) + 1), r"^([^?]*)", 1)
    rooted = lambda p: F.when(p == "", "").otherwise(_without_dots(p))
    return (
        F.when(whole.endswith(":"), reference)  # mailto: and the like have no path to shorten
        .when(whole != "", F.concat(whole, rooted(tail(whole)), query))
        .when(elsewhere != "", F.concat(scheme, F.lit(":"), elsewhere, rooted(tail(elsewhere)), query))
        .when(reference == "", page)
        .when(path == "", F.concat(origin, base_path, query))
        .when(F.startswith(path, F.lit("/")), F.concat(origin, _without_dots(path), query))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, path)), query))
    )


def site(url: Column) -> Column:
    """The authority: host with port."""
    return F.parse_url(url, F.lit("AUTHORITY"))
