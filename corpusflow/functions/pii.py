"""Personal data by pattern: redaction as expressions, spans as a vectorised function.

Names and places would need a recogniser model, which is not part of this library: spans_with() takes one, and without
one only regular types are found.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.text import bound

# Types and their patterns, in the order in which they are applied. Group 1 keeps what stands before.
PATTERNS = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "URL": r"https?://[^\s)>\]]+",
    "ID_NPWP": r"\b\d{2}\.\d{3}\.\d{3}\.\d-\d{3}\.\d{3}\b",
    "IBAN_CODE": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "CREDIT_CARD": r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}\b",
    "ID_NIK": r"\b\d{16}\b",
    "ID_NPWP_PLAIN": r"\b\d{15}\b",
    "ID_BPJS": r"\b\d{13}\b",
    "US_SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "IP_ADDRESS": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "PHONE_NUMBER": r"\+\d{1,3}[ -]\(?\d{2,4}\)?[ -]\d{3,4}[ -]\d{3,4}\b",
    "CRYPTO": r"\b(?:bc1[a-z0-9]{25,59}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b",
}
# Types looked for in pages, and in work items; and how sure a match is.
SITE_TYPES = ["EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IBAN_CODE", "IP_ADDRESS", "URL", "CRYPTO", "US_SSN", "ID_NIK", "ID_NPWP", "ID_NPWP_PLAIN"]
ITEM_TYPES = ["EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IBAN_CODE", "IP_ADDRESS", "URL", "CRYPTO", "US_SSN", "ID_NIK", "ID_NPWP", "ID_BPJS"]
SCORES = {"ID_NIK": 0.6, "ID_NPWP": 0.85, "ID_NPWP_PLAIN": 0.5, "ID_BPJS": 0.55, "EMAIL_ADDRESS": 1.0, "URL": 0.5, "PHONE_NUMBER": 0.4}
SPANS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("text", T.StringType())]))


def shown(kind: str) -> str:
    return kind.removesuffix("_PLAIN")


#: Where it matches nowhere, none of PATTERNS does.
_SCREEN = r"@[A-Za-z0-9.-]|://|\d{13}|\d{4}[ -]\d{4}|\d\.\d|\d-\d{2}-\d|\+\d|[A-Z]{2}\d{2}[A-Z0-9]{11}|bc1[a-z0-9]{25}|[13][a-km-zA-HJ-NP-Z1-9]{25}"


def _replaced(text: Column, types: list[str] | None, allowed: Column | None, form: str) -> Column:
    def steps(t: Column) -> Column:
        for kind, pattern in PATTERNS.items():
            if kind in (types or SITE_TYPES):
                # an allowed type gets a pattern that matches nowhere; so the text occurs once in each step
                used = F.lit(pattern) if allowed is None else F.when(F.array_contains(allowed, shown(kind)), "(?!)").otherwise(pattern)
                t = F.regexp_replace(t, used, F.lit(form.format(shown(kind))))
        return t

    return bound(text, lambda t: F.when(F.regexp_like(t, F.lit(_SCREEN)), steps(t)).otherwise(t))


def redacted(text: Column, types: list[str] | None = None, allowed: Column | None = None, form: str = "<{}>") -> Column:
    """text with each match replaced by its type; types in the array `allowed` stay."""
    return _replaced(text, types, allowed, form)


def marked(text: Column, types: list[str] | None = None, allowed: Column | None = None) -> Column:
    """text with each match as a mark, from which types_of() and unmarked() are read: one pass for both. What the text
    itself has of \\x01 becomes an empty mark, so it is never read as one of ours."""
    return _replaced(F.replace(text, F.lit("\x01"), F.lit("\x01\x02")), types, allowed, "\x01{}\x02")


def types_of(marks: Column) -> Column:
    """The sorted types in a marked text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(marks, F.lit("\x01([A-Z_]+)\x02"), F.lit(1))))


def unmarked(marks: Column, form: str = "<$1>") -> Column:
    return F.replace(F.regexp_replace(marks, "\x01([A-Z_]+)\x02", form), F.lit("\x01\x02"), F.lit("\x01"))


def types_in(text: Column, types: list[str] | None = None, allowed: Column | None = None) -> Column:
    """The sorted types that redacted() replaces."""
    return types_of(marked(text, types, allowed))


def spans_of(text: str, types: list[str]) -> list[tuple]:
    """Matches from the left that do not overlap; an earlier type wins a place."""
    taken: list[tuple] = []
    for kind, pattern in PATTERNS.items():
        if kind in types:
            for m in re.finditer(pattern, text):
                if all(m.end() <= t[1] or m.start() >= t[2] for t in taken):
                    taken.append((shown(kind), m.start(), m.end(), SCORES.get(kind, 0.85), m[0]))
    return sorted(taken, key=lambda t: t[1])


@F.pandas_udf(SPANS)
def _spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([spans_of(t, ITEM_TYPES) if t else [] for t in texts])


def spans(text: Column) -> Column:
    """array<struct<type,start,end,score,text>> of a work item."""
    return _spans(text)


def spans_with(recognise: Callable[[str], list[tuple[str, int, int, float]]] | None = None, types: list[str] | None = None) -> Callable[[Column], Column]:
    """Like spans(), with what a recogniser finds (type, start, end, score) where no pattern does; default off."""

    @F.pandas_udf(SPANS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                rows = spans_of(t, types or ITEM_TYPES) if t else []
                for kind, start, end, score in (recognise(t) if t and recognise else []):
                    if all(end <= r[1] or start >= r[2] for r in rows):
                        rows.append((kind, start, end, score, t[start:end]))
                out.append(sorted(rows, key=lambda r: r[1]))
            yield pd.Series(out)

    return found


def redact_items(body: Column, enabled: bool = True) -> Column:
    """Work items: `[REDACTED:TYPE]`; switched off, the body as it is."""
    return redacted(body, ITEM_TYPES, form="[REDACTED:{}]") if enabled else body


def leak_verdict(n: Column) -> Column:
    """Of distinct personal items in an output: more than five block it, fewer are redacted."""
    return F.when(n > 5, "block").when(n > 0, "redact").otherwise("pass")
