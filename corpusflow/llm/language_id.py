"""Language identification by Bayesian fusion of evidence.

The posterior of a language is the product of
- the text's likelihood under a smoothed byte-trigram model of letters and blanks, tempered by 1/3 as each byte is in
  three trigrams;
- the likelihood of the declared markup language (an html lang or xml:lang attribute, or a given column);
- the likelihood of the address's suffix, where that suffix belongs to a language;
- the host's prior, smoothed towards its domain's, that towards the corpus's; a host without a dot has no domain. The
  counts are of each text's best class, from a grouped aggregation over all rows; a row's own class is taken out of its
  prior, so no text speaks twice.

`und` stands for no language: a class with a uniform trigram model, a prior of its own and even evidence. A row is
accepted unless `und` has the best posterior or its text has no letters. Trigram weights are integers (1/4096 nat), so sums are exact and equal in any order.

Each text is read and scored once, into a written table; priors and posteriors are joins and column expressions over
it. Only hosts, domains and classes are grouped, so a host may hold any share of the rows.

The trigram model is fitted on at most `per_language` distinct labelled texts of each language, taken in hash order,
without those that would go over `language_bytes` bytes together; more than `max_languages` languages are an error. All
else covers every row and whole texts.

Rules: a null or empty text has no likelihood, so lang is the best by the other evidence and accepted is false. A null
host is a host of its own. Ties go to the first language in code order. Repeated rows count each. Columns lang_id,
lang_posterior, lang_accepted and those with a leading `__` must be new. An empty table gives an empty table. Fitting
needs labelled rows; identify_fitted() has a rule for when there are none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.shared import BROADCAST_ROWS, Scratch, slices, tidy

PER_LANGUAGE, LANGUAGE_BYTES, MAX_LANGUAGES = 400, 4 << 20, 64
BUCKETS = 1 << 16
UNIT = 4096
TEMPER = 3
#: Weight of the next level's share, in rows.
SMOOTHING = 20.0
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.7
UND = "und"
#: Country suffixes with one main language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "id": "id", "pl": "pl", "ru": "ru", "jp": "ja", "kr": "ko", "cn": "zh", "tr": "tr", "se": "sv", "dk": "da", "no": "no", "fi": "fi"}
_DECLARED = re.compile(rb"<(?:html|body|article)\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.I)
_LETTER = re.compile(r"[^\W\d_]")

#: A byte as it counts: letters and all beyond ASCII themselves, white space a blank, others 0.
_KIND = np.array([x if x >= 128 or 97 <= x <= 122 else 32 if x == 32 or 9 <= x <= 13 else 0 for x in range(256)], np.uint32)


class NoLabels(ValueError):
    """There is nothing to fit on."""


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x (languages + und), int32


def _grams(data: bytes) -> np.ndarray:
    """Hashed trigrams of letters and blanks; digits and signs are no evidence of a language."""
    b = np.frombuffer(data.lower(), np.uint8)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    b = _KIND[b]
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    code = code[(b[:-2] > 0) & (b[1:-1] > 0) & (b[2:] > 0)]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def fit(rows: list[tuple[str, str]]) -> Model:
    """From (text, language)."""
    languages = sorted({l for _, l in rows})
    if not languages:
        raise ValueError("no labelled rows to fit on")
    counts = np.zeros((BUCKETS, len(languages)))
    for text, l in rows:
        counts[:, languages.index(l)] += np.bincount(_grams(text.encode()), minlength=BUCKETS)
    log = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS))
    log = np.column_stack([log, np.full(BUCKETS, -np.log(BUCKETS))])
    return Model(languages, np.rint(log * UNIT).astype(np.int32))


def fit_on(docs: DataFrame, text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES, language_bytes: int = LANGUAGE_BYTES) -> Model:
    """Fitted on the per_language distinct texts of each language with the smallest hashes, or on all if there are fewer."""
    labelled = docs.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(text).alias("t"), F.col(label).alias("l")).withColumn("h", F.xxhash64("t"))
    scratch = Scratch(docs.sparkSession, "language-fit")
    hashes = scratch.table(labelled.select("l", "h", F.octet_length("t").alias("b")).distinct(), "hashes")
    sizes = {r.l: r.n for r in hashes.groupBy("l").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()}
    if not sizes:
        raise NoLabels("no labelled rows to fit on")
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages")
    # hashes are even, so a range from the smallest holds about four times the texts that are needed; it grows while it holds too few
    share = {l: min(1.0, 4 * per_language / max(1, n)) for l, n in sizes.items()}
    chosen: list[tuple[str, int]] = []
    while share:
        ranges = F.create_map(*[F.lit(x) for l, s in share.items() for x in (l, (1 << 63) - 1 if s >= 1 else int(s * (1 << 64)) - (1 << 63))])
        held: dict[str, list[tuple[int, int]]] = {l: [] for l in share}
        for r in hashes.where(F.col("h") <= ranges[F.col("l")]).collect():
            held[r.l].append((r.h, r.b))
        done = [l for l, s in share.items() if s >= 1 or len(held[l]) >= per_language]
        for l in done:
            room = language_bytes
            for h, b in sorted(held[l])[:per_language]:
                if b <= room:
                    chosen.append((l, h))
                    room -= b
        share = {l: min(1.0, 8 * s) for l, s in share.items() if l not in done}
    if not chosen:
        raise NoLabels("every labelled text is longer than language_bytes")
    keys = docs.sparkSession.createDataFrame(chosen, "l string, h long")
    rows = labelled.join(F.broadcast(keys), ["l", "h"]).groupBy("l", "h").agg(F.min("t").alias("t")).collect()
    scratch.drop(hashes)
    return fit([(r.t, r.l) for r in rows])


def _scores(model: Model, text: bytes | None) -> np.ndarray:
    """Log likelihoods in units, und last."""
    grams = _grams(text or b"")
    if not len(grams):
        return np.zeros(len(model.languages) + 1, np.int64)
    seen = np.bincount(grams, minlength=BUCKETS) if len(grams) > BUCKETS else None
    if seen is not None:
        return seen @ model.weights.astype(np.int64)
    return model.weights[grams].sum(0, dtype=np.int64)


def _domain(host: Column) -> Column:
    """The last two labels of a dotted host; others have none."""
    return F.when(host.contains("."), F.substring_index(host, ".", -2)).otherwise(F.lit(""))


def _evidence(languages: list[str], said: str | None, right: float) -> np.ndarray:
    """Log likelihoods, und last: it says each language as often."""
    if not said or said not in languages:
        return np.zeros(len(languages) + 1)
    wrong = (1 - right) / max(1, len(languages) - 1)
    return np.log([*(right if l == said else wrong for l in languages), 1 / len(languages)])


def likelihood(model: Model, text: bytes | None, declared: str | None, suffix: str | None) -> tuple[np.ndarray, int | None, bool]:
    """(log likelihoods of all evidence of a row's own with und last, the text's best class, whether it has letters)."""
    scores = _scores(model, text)
    if declared is None and text and b"lang" in text and (m := _DECLARED.search(text)):
        declared = m[1].decode()
    log = scores / (UNIT * TEMPER) + _evidence(model.languages, (declared or "").lower()[:2], DECLARED_RIGHT) + _evidence(model.languages, SUFFIXES.get((suffix or "").lower()), SUFFIX_RIGHT)
    return log, int(np.argmax(scores)) if scores.any() else None, bool(text) and bool(_LETTER.search(text.decode()))


def posterior(model: Model, text: bytes | None, declared: str | None, suffix: str | None, prior: np.ndarray) -> tuple[str, float, bool]:
    """(language, its posterior among languages, accepted) of one text. A prior without und gives it an even share."""
    if len(prior) == len(model.languages):
        prior = np.append(prior, np.logaddexp.reduce(prior) - np.log(len(prior)))
    log, _, letters = likelihood(model, text, declared, suffix)
    log = log + prior
    at = int(np.argmax(log[:-1]))
    return model.languages[at], float(1 / np.exp(log[:-1] - log[at]).sum()), letters and bool(log[at] >= log[-1])


def _scored(docs: DataFrame, model: Model, text: str, host: Column, suffix: Column, declared: Column, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with __host, __log (log likelihoods of the row's own evidence), __best and __letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = len(keep)
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(host, F.lit("")).alias("__host"), F.col(f"`{text}`").cast("string").alias("__text"), suffix.alias("__suffix"), declared.alias("__said"))
    made = T.StructType([*given.schema.fields[: k + 1], T.StructField("__log", T.ArrayType(T.DoubleType())), T.StructField("__best", T.IntegerType()), T.StructField("__letters", T.BooleanType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, k + 1):
                rows = [likelihood(shared.value, x.as_py(), d, s) for x, s, d in zip(part.column(k + 1).cast(pa.binary()), part.column(k + 2).to_pylist(), part.column(k + 3).to_pylist(), strict=True)]
                log, best, letters = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[: k + 1], pa.array([x.tolist() for x in log], pa.list_(pa.float64())), pa.array(best, pa.int32()), pa.array(letters, pa.bool_())], [f.name for f in made])

    return given.mapInArrow(run, made)


def host_counts(scored: DataFrame, classes: int) -> tuple[DataFrame, list[int]]:
    """(__host, __n, __d, and their totals __n_all, __d_all): how many texts of the host, and of its domain (null without
    one), are best in each class; and the same of all hosts together."""
    by_class = scored.groupBy("__host", "__best").agg(F.count(F.lit(1)).alias("n"))
    by_host = by_class.groupBy("__host").agg(*[F.coalesce(F.sum(F.when(F.col("__best") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(classes)])
    by_host = by_host.withColumn("__domain", _domain(F.col("__host")))
    total = by_host.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(classes)]).first()
    domains = by_host.where("__domain <> ''").groupBy("__domain").agg(F.array(*[F.sum(f"n{i}") for i in range(classes)]).alias("__d"))
    found = by_host.join(domains, "__domain", "left").select("__host", F.array(*[f"n{i}" for i in range(classes)]).alias("__n"), "__d")
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y).alias(f"{c}_all")
    return found.select("*", add("__n"), add("__d")), list(total)


def _log_prior(total: list[int], classes: int) -> Column:
    """array<double> from __n, __d and __best: each level without the row's own class, smoothed towards the next."""
    own = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i.eqNullSafe(F.col("__best")), F.lit(1)).otherwise(F.lit(0)))
    one = F.when(F.col("__best").isNull(), F.lit(0)).otherwise(F.lit(1))
    corpus = F.zip_with(F.array(*[F.lit(x) for x in total]), own, lambda t, o: (t - o + 1) / (F.lit(sum(total) + classes) - one))
    less = lambda counts: F.zip_with(counts, own, lambda c, o: c - o)
    smoothed = lambda c, above: F.zip_with(less(F.col(c)), above, lambda n, p: (n + SMOOTHING * p) / (F.col(f"{c}_all") - one + SMOOTHING))
    domain = F.when(F.col("__d").isNull(), corpus).otherwise(smoothed("__d", corpus))
    host = F.when(F.col("__n").isNull(), domain).otherwise(smoothed("__n", domain))
    return F.transform(host, lambda p: F.log(p))


def identify(docs: DataFrame, model: Model, text: str = "text", host: str | None = None, url: str | None = None, declared: str | None = None, keep: list[str] | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs, or its columns `keep`, with lang_id string, lang_posterior double (6 digits) and lang_accepted boolean."""
    keep = docs.columns if keep is None else keep
    made = {"lang_id", "lang_posterior", "lang_accepted"}
    if clash := made & set(keep) | {c for c in keep if c.startswith("__")}:
        raise ValueError(f"columns {sorted(clash)} are made here")
    none = F.lit(None).cast("string")
    address = F.lower(F.try_parse_url(url, F.lit("HOST"))) if url else none
    from_host = F.col(host).cast("string") if host else address
    said = F.col(declared).cast("string") if declared else none
    scratch, classes = Scratch(docs.sparkSession, "language"), len(model.languages) + 1
    scored = scratch.table(_scored(docs, model, text, from_host, F.substring_index(address, ".", -1), said, keep), "scored", compression="zstd")
    counts, total = host_counts(scored, classes)
    counts = scratch.table(counts, "hosts")
    few = counts.limit(broadcast_rows + 1).count() <= broadcast_rows
    joined = scored.join(F.broadcast(counts) if few else counts, "__host", "left")
    fused = joined.withColumn("__log", F.zip_with("__log", _log_prior(total, classes), lambda x, y: x + y))
    fused = fused.withColumn("__top", F.array_max(F.slice("__log", 1, classes - 1)))
    names = F.array(*[F.lit(l) for l in model.languages])
    share = 1 / F.aggregate(F.slice("__log", 1, classes - 1), F.lit(0.0), lambda x, y: x + F.exp(y - F.col("__top")))
    return fused.select(
        *[F.col(f"`{c}`") for c in keep],
        F.get(names, (F.array_position("__log", F.col("__top")) - 1).cast("int")).alias("lang_id"),
        F.round(share, 6).alias("lang_posterior"),
        (F.col("__letters") & (F.col("__top") >= F.element_at("__log", -1))).alias("lang_accepted"),
    )


def identify_fitted(docs: DataFrame, labelled: DataFrame, text: str = "text", keep: list[str] | None = None, **given: str) -> DataFrame:
    """identify() with a model of `labelled`. Without labelled rows no language is known: lang_id and lang_posterior are
    null, and text with letters is accepted."""
    try:
        model = fit_on(labelled)
    except NoLabels:
        letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
        return docs.select(*[F.col(f"`{c}`") for c in keep or docs.columns], letters.alias("lang_accepted")).withColumns({"lang_id": F.lit(None).cast("string"), "lang_posterior": F.lit(None).cast("double")}).select(*(keep or docs.columns), "lang_id", "lang_posterior", "lang_accepted")
    return identify(docs, model, text, keep=keep, **given)
