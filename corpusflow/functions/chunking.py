"""Cutting text into chunks: by priority of separators, by words, by characters."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import bound, once, stripped

SIZE, OVERLAP = 2048, 320
# Where a text may be cut, best first.
SEPARATORS = ["\n## ", "\n### ", "\n#### ", "\n\n", "\n", ". ", "? ", "! ", "。", "؟", " "]


class _Marks(NamedTuple):
    """Where a text may be cut with one separator: a piece may end at ends[i], the next then starts at starts[i]."""

    ends: list[int]
    starts: list[int]


def _marks(text: str, separator: str, compat: bool) -> _Marks:
    """White space at a cut goes; a heading's mark stays after it and a sentence's end before it, but for compat."""
    before = after = len(separator)
    if not compat:
        heading = separator.lstrip("\n").startswith("#")
        before = 0 if heading or not separator.strip() else len(separator.rstrip())
        after = len(separator) - len(separator.lstrip("\n")) if heading else len(separator)
    else:
        before = 0
    found = [m.start() for m in re.finditer(re.escape(separator), text)]
    return _Marks([i + before for i in found], [i + after for i in found])


def pieces(text: str, size: int = SIZE, separators: list[str] | None = None, compat: bool = False) -> list[str]:
    """Slices of at most `size` characters that end at the best separators; what cannot be cut stays whole.

    From each place, the slice goes to the last mark in reach of the best separator that has one there. Where a weaker
    separator had to be used, the next slices do not go beyond the next mark of a better one.
    """
    marks = [_marks(text, x, compat) for x in (SEPARATORS if separators is None else separators)]
    out: list[str] = []
    at, level, n = 0, 0, len(text)

    def next_of(levels: range) -> tuple[int, int, int]:
        """(end, start after it, level) of the first mark after `at`; the text's end without one."""
        found = (n, n, 0)
        for k in levels:
            i = bisect_right(marks[k].ends, at)
            if i < len(marks[k].ends) and marks[k].ends[i] < found[0]:
                found = (marks[k].ends[i], marks[k].starts[i], k)
        return found

    while at < n:
        end, start, new = next_of(range(level))
        if end - at > size:
            best = next_of(range(len(marks)))
            for k in range(level, len(marks)):
                i = bisect_right(marks[k].ends, at + size) - 1
                if i >= 0 and marks[k].ends[i] > at:
                    best = (marks[k].ends[i], marks[k].starts[i], k)
                    break
            end, start, new = best
        out.append(text[at:end])
        at, level = start, new
    return out or [text]


def split_markdown(text: Column, size: int = SIZE, compat: bool = False) -> Column:
    """array<string> of pieces; blank text has none."""

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([pieces(t, size, compat=compat) if t and t.strip() else [] for t in texts])

    return once(cut)(text)


def overlap_tail(previous: Column, overlap: int = OVERLAP) -> Column:
    """The last `overlap` characters, from the first white space on; '' without one."""
    window = F.substring(previous, -overlap, overlap)
    return F.when(F.regexp_like(window, F.lit(r"\s")), F.regexp_replace(window, r"^\S*\s", "")).otherwise("")


def section_of(piece: Column) -> Column:
    """The last heading line of levels 2 to 4 in a piece; null without one."""
    lines = F.filter(F.split(piece, "\n"), lambda x: F.regexp_like(x, F.lit("^#{2,4} ")))
    return F.when(F.size(lines) > 0, F.trim(F.regexp_replace(F.element_at(lines, -1), "^#+", "")))


def chunks(docs: DataFrame, pieces_column: str, overlap: int = OVERLAP, size: int = SIZE) -> DataFrame:
    """One row a chunk: the columns of docs without the pieces, chunk_index, text, section_title, chunk_hash.

    Each chunk begins with the end of the piece before it in its row, and has the last heading so far. Rows are apart,
    also with equal addresses. Indexes are given before blank chunks go, so they may have gaps.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    rest = [c for c in docs.columns if c != pieces_column]

    def joined(all_: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            tail = F.coalesce(overlap_tail(F.get(all_, i - 1), overlap), F.lit(""))
            return bound(tail, lambda t: F.when(t == "", piece).otherwise(F.concat(t, F.when(t.rlike(r"[ \n\t]$"), "").otherwise(" "), piece)))

        return F.transform(all_, one)

    def titled(texts: Column) -> Column:
        heads = F.filter(F.transform(texts, lambda t, i: F.struct(i.alias("i"), section_of(t).alias("title"))), lambda h: h.title.isNotNull())
        last = lambda known, i: F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter(known, lambda h: h.i <= i), lambda h: h.title)), -1)
        return bound(heads, lambda known: F.transform(texts, lambda t, i: F.struct(i.alias("chunk_index"), stripped(t).alias("text"), last(known, i).alias("section_title"))))

    made = bound(F.col(pieces_column), lambda all_: bound(joined(all_), titled))
    rows = docs.select(*rest, F.explode(made).alias("__c")).select(*rest, "__c.*")
    return rows.where("text <> ''").withColumn("chunk_hash", F.sha2("text", 256))


def word_windows(text: Column, size: int = 512, overlap: int = 64, url_words: int = 10) -> Column:
    """array<string>: windows of words; one that would end with a URL takes more words after it. The last window ends
    with the last word, and a text without words is its own window."""
    step = size - overlap

    def plain(words: Column) -> Column:  # of words that were split once
        last = F.greatest(F.lit(0), F.ceil((F.size(words) - size) / step)).cast("int")
        windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(size)), " "))
        return F.when(F.size(words) == 0, F.array(text)).otherwise(windows)

    @F.pandas_udf("array<string>")
    def with_urls(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_word_windows(t or "", size, overlap, url_words) for t in texts])

    linked = F.contains(text, F.lit("://"))
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), "")
    # the function sees only the texts that it is for
    return F.when(linked & F.regexp_like(text, F.lit(r"\S")), with_urls(F.when(linked, text))).otherwise(bound(words, plain))


def _word_windows(text: str, size: int, overlap: int, url_words: int) -> list[str]:
    words, out, at = text.split(), [], 0
    while at < len(words):
        end = min(at + size, len(words))
        while end < len(words) and words[end - 1].startswith(("http://", "https://")):
            end = min(end + url_words, len(words))
        out.append(" ".join(words[at:end]))
        if end == len(words):
            break
        at = max(at + 1, end - overlap)
    return out or [text]


def char_windows(text: Column, size: int = 2000, stride: int = 1500) -> Column:
    """array<string>: overlapping windows of characters; a text of at most `size` is its own."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(stride))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))
