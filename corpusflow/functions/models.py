"""Scorers behind plain interfaces. The defaults are deterministic stand-ins: their values are not those of a model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import once

DIMENSIONS = 256
_TOKEN = re.compile(r"\w+")
INJECTION_WORDS = {"ignore": 0.35, "previous": 0.2, "instructions": 0.35, "system": 0.15, "prompt": 0.2, "jailbreak": 0.9, "abaikan": 0.35, "instruksi": 0.35, "sebelumnya": 0.2, "override": 0.25, "disregard": 0.4}
TOXIC_WORDS = {"idiot": 0.9, "moron": 0.9, "disgusting": 0.8, "clown": 0.75, "stupid": 0.8, "pathetic": 0.8}
LABELS = ["toxicity", "severe_toxicity", "obscene", "threat", "insult", "identity_attack"]


class _Slots(dict):
    """Place and sign of each word met, made once."""

    def __missing__(self, word: str) -> tuple[int, int]:
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        found = (h, 1 if h >> 63 else -1)
        if len(word) <= 64 and len(self) < 200_000:
            self[word] = found
        return found


_SLOTS = _Slots()


def embed_text(text: str | None, dimensions: int = DIMENSIONS) -> list[float]:
    """Hashed bag of words of unit length; zero without words."""
    slots = [_SLOTS[w] for w in _TOKEN.findall((text or "").lower())]
    out = np.bincount([h % dimensions for h, _ in slots], [sign for _, sign in slots], dimensions).astype(np.float32)
    norm = float(np.linalg.norm(out))
    return (out / norm if norm else out).tolist()


def embedder(score: Callable[[str | None], list[float]] = embed_text) -> Callable[[Column], Column]:
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(score)

    return once(embed)


def overlap(query: str | None, candidate: str | None) -> float:
    """Share of the query's words that the candidate has."""
    q, c = (set(_TOKEN.findall((x or "").lower())) for x in (query, candidate))
    return len(q & c) / len(q) if q else 0.0


def pair_scorer(score: Callable[[str | None, str | None], float] = overlap) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("double")
    def pairs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([score(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return pairs


def lexicon_risk(text: Column, words: dict[str, float] = INJECTION_WORDS) -> Column:
    """Sum of the weights of the words present, 1 at most: an expression, no model."""
    tokens = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+")
    hits = [F.when(F.array_contains(tokens, w), F.lit(p)).otherwise(0.0) for w, p in words.items()]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return F.round(F.least(F.lit(1.0), total), 6)


def toxicity(text: Column) -> Column:
    """map<string,double> over six labels; the lexicon fills toxicity and insult."""
    tokens = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+")
    worst = F.greatest(*[F.when(F.array_contains(tokens, w), F.lit(p)).otherwise(0.0) for w, p in TOXIC_WORDS.items()])
    pairs: list[Column] = []
    for label in LABELS:
        pairs += [F.lit(label), worst if label in ("toxicity", "insult") else F.lit(0.0)]
    return F.create_map(*pairs)
