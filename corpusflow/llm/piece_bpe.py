"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A block of texts is one flat array of code points. It is cut into words where no piece of the vocabulary spans the cut,
and each distinct word of a block is encoded once. All distinct words are merged together: in a round, each word's pair
of neighbouring symbols with the smallest rank is found by a segmented minimum, its places are merged at once from the
left, and the flat arrays are compacted. Words without a pair leave; the rounds end when none is left.

Merging several places of a word at once equals the library's order (best score, then leftmost) unless a merge makes a
neighbouring pair that is as good or better: then the places to the right of it wait for the next round. A long run of
one character whose runs are pieces of one score grows from the left only, so such runs are cut beforehand into the
longest piece (`Model.even_runs`).

Rules:
- Models: BPE with byte fallback, identity normalization, white space escaped and kept, no user-defined or unused
  pieces; others raise ValueError. No begin or end ids and no sampling.
- A null text gives null ids, an empty one no ids; null ids decode to null. Texts may have any length: a text of many
  blocks is cut between words.
- Unknown characters are the pieces of their UTF-8 bytes. Decoding takes any ids of the model: byte pieces that are no
  UTF-8 become U+FFFD each, control pieces nothing, the unknown piece the model's surface for it; other ids raise.
- Rows are independent, so ties, repeated rows and ids, and empty tables need no rule. Other columns pass through; a
  column already named like the new one raises ValueError.
"""

from __future__ import annotations

import codecs
import hashlib
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.shared import keeping, slices, small_batches, worker_state

SPACE = 0x2581
#: Code points that are cut, encoded and expanded together.
BLOCK_CHARS = 1 << 21
_NONE = np.int32(2**31 - 1)
_PAIR_BITS = 22
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """The tables of a model file: pieces, mergeable pairs with ranks, cuts."""

    def __init__(self, data: bytes):
        self.pieces: list[bytes] = []
        scores, kinds, trainer, normalizer = [], [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b""))
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
            raise ValueError("the model is not BPE with byte fallback")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("the model changes texts before it encodes them")
        if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model has user-defined or unused pieces")
        self.prefix = bool(normalizer.get(3, 1))
        self.kinds = np.array(kinds, np.int8)
        self.size = len(self.pieces)
        self.byte_ids = np.zeros(256, np.int32)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        self._decoding(trainer.get(44, " ⁇ ".encode()))
        texts = {self.pieces[i].decode(): int(i) for i in np.flatnonzero(self.kinds == NORMAL)}
        self._encoding(texts, np.array(scores))

    def _decoding(self, unknown: bytes) -> None:
        space = chr(SPACE).encode()
        self.opens = np.zeros(self.size, bool)  # a leading space that goes at a text's start
        out: list[bytes] = []
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds.tolist(), strict=True)):
            out.append({CONTROL: b"", UNKNOWN: unknown}.get(kind, piece.replace(space, b" ")) if kind != BYTE else bytes([int(piece[3:5], 16)]))
            self.opens[i] = kind == NORMAL and self.prefix and piece.startswith(space)
        self.surfaces = pa.array(out, pa.binary())
        self.lengths = np.array([len(x) for x in out], np.int64)

    def _encoding(self, texts: dict[str, int], scores: np.ndarray) -> None:
        self.char_ids = np.full(0x110000, -1, np.int32)
        joined = np.zeros(1 << _PAIR_BITS, bool)  # may neighbouring characters stand in one piece?
        keys, ranks, merged = [], [], []
        order = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        for text, i in texts.items():
            if len(text) == 1:
                self.char_ids[ord(text)] = i
            for k in range(1, len(text)):
                a, b = texts.get(text[:k]), texts.get(text[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    ranks.append(order[i])
                    merged.append(i)
        chars = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts if len(t) > 1]
        if chars:
            joined[np.concatenate([self._pair(c[:-1], c[1:]) for c in chars])] = True
        self.joined = joined
        at = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[at]
        self.ranks, self.merged = np.array(ranks, np.int32)[at], np.array(merged, np.int32)[at]
        self.longest = max((len(t) for t in texts), default=1)
        self.even_runs = {ord(c): k for c in sorted({t[0] for t in texts if len(t) > 2}) if (k := self._even_run(c, texts, order))}

    def _even_run(self, c: str, texts: dict[str, int], order: np.ndarray) -> int:
        """The longest piece of c alone, if all pieces of several c have one score, so that a run becomes that piece from
        the left, again and again; else 0."""
        held = [k for k in range(2, self.longest + 1) if c * k in texts]
        if len(held) < 2 or c not in texts or len({order[texts[c * k]] for k in held}) > 1:
            return 0
        got, _ = self.encode_words(np.full(4 * held[-1], texts[c], np.int32), np.zeros(1, np.int64))
        return held[-1] if got.tolist() == [texts[c * held[-1]]] * 4 else 0

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (b.astype(np.uint32) * np.uint32(0x85EBCA6B))) >> np.uint32(32 - _PAIR_BITS)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of neighbours; no pair has the rank _NONE. Characters without a piece are negative."""
        if not len(self.keys):
            return np.full(len(left), _NONE), np.full(len(left), -1, np.int32)
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], _NONE), np.where(found, self.merged[at], np.int32(-1))

    def cuts(self, chars: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Where words start, the first with the block. borders: where texts start."""
        out = borders.copy()
        out[:1] = True
        out[1:] |= ~self.joined[self._pair(chars[:-1], chars[1:])]
        for c, longest in self.even_runs.items():
            is_c = np.concatenate([[False], chars == c, [False]])
            edge = np.concatenate([borders, [True]])
            begins = np.flatnonzero(is_c[1:] & (~is_c[:-1] | edge))
            ends = np.flatnonzero(is_c[:-1] & (~is_c[1:] | edge))
            for i in np.flatnonzero((ends - begins > 2 * longest + self.longest) & out[np.minimum(begins, len(out) - 1)]).tolist():
                out[begins[i] + longest : ends[i] - longest - self.longest : longest] = True
        return out

    def encode_words(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols of all words, and each word's start in them (with the end)."""
        words = len(starts)
        done_ids: list[np.ndarray] = []
        done_words: list[np.ndarray] = []
        word = np.repeat(np.arange(words), np.diff(np.append(starts, len(symbols))))
        rank, merged = np.full(len(symbols), _NONE), np.full(len(symbols), -1, np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside], merged[inside] = self.lookup(symbols[inside], symbols[inside + 1])
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(symbols)))
            if (least == _NONE).any():
                left = np.repeat(least == _NONE, sizes)
                done_ids.append(symbols[left])
                done_words.append(word[left])
                symbols, word, rank, merged = symbols[~left], word[~left], rank[~left], merged[~left]
                continue
            symbols, word, rank, merged = self._round(symbols, word, rank, merged, np.repeat(least, sizes))
        ids, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_ids, done_words))
        at = np.argsort(of, kind="stable")
        return ids[at].astype(np.int32), np.searchsorted(of[at], np.arange(words + 1))

    def _round(self, symbols, word, rank, merged, least):
        """Each word's pairs of the least rank merged, from the left, as far as the order allows."""
        n = len(symbols)
        hit = np.flatnonzero(rank == least)
        run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
        place = np.arange(len(hit))
        hit = hit[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
        several = word[hit]
        again = np.zeros(len(hit), bool)
        again[1:] = several[1:] == several[:-1]
        if again.any():
            hit = self._in_order(symbols, word, merged, least, hit, again)
        symbols[hit] = merged[hit]
        keep = np.ones(n, bool)
        keep[hit + 1] = False
        rank[hit], merged[hit] = _NONE, -1
        at = (np.cumsum(keep) - 1)[hit]  # the merged symbols' places afterwards
        symbols, word, rank, merged = symbols[keep], word[keep], rank[keep], merged[keep]
        beside = np.zeros(len(symbols), bool)
        beside[at] = True
        beside[at[at > 0] - 1] = True
        beside[:-1] &= word[:-1] == word[1:]
        beside[-1] = False
        changed = np.flatnonzero(beside)
        rank[changed], merged[changed] = self.lookup(symbols[changed], symbols[changed + 1])
        return symbols, word, rank, merged

    def _in_order(self, symbols, word, merged, least, hit, again):
        """The places of `hit` that may merge in one round: those up to the first, in a word, whose new neighbours
        would be a pair of the same or a smaller rank."""
        n = len(symbols)
        last_again = np.concatenate([again[1:], [False]])
        m = merged[hit]
        before, after = np.maximum(hit - 1, 0), np.minimum(hit + 2, n - 1)
        left = symbols[before].copy()
        touching = np.concatenate([[False], (hit[1:] == hit[:-1] + 2) & again[1:]])
        left[touching] = m[:-1][touching[1:]]
        stops = (self.lookup(left, m)[0] <= least[hit]) & (hit > 0) & (word[before] == word[hit])
        stops |= (self.lookup(m, symbols[after])[0] <= least[hit]) & (hit + 2 < n) & (word[after] == word[hit])
        stops &= again | last_again
        total = np.cumsum(stops) - stops  # stops before each place
        group = np.maximum.accumulate(np.where(again, 0, np.arange(len(hit))))
        return hit[total - total[group] == 0]

    def encode_block(self, chars: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of a block of words, and how many each word has. Distinct words are encoded once."""
        offsets = np.append(starts, len(chars)).astype(np.int64) * 4
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(chars))])
        coded = held.dictionary_encode()
        flat = np.frombuffer(coded.dictionary.buffers()[2] or b"", np.uint32)
        first = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1] // 4
        flat, first = flat[first[0] : first[-1]], (first - first[0])[:-1]
        symbols = self.char_ids[flat]
        unknown = symbols < 0
        symbols[unknown] = -1 - flat[unknown].astype(np.int32)
        ids, at = self.encode_words(symbols, first)
        ids, at = self._bytes_of_unknown(ids, at)
        which = coded.indices.to_numpy()
        sizes = np.diff(at)[which]
        return ids[_ranges(at[:-1][which], sizes)], sizes

    def _bytes_of_unknown(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not (ids < 0).any():
            return ids, at
        chars = np.where(ids < 0, -1 - ids, 0)
        sizes = np.where(ids < 0, 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF), 1)
        total = np.concatenate([[0], np.cumsum(sizes)])
        out = np.repeat(ids, sizes)
        raw = np.frombuffer(chars[ids < 0].astype(np.uint32).tobytes().decode("utf-32-le").encode(), np.uint8)
        out[np.repeat(ids < 0, sizes)] = self.byte_ids[raw]
        return out, total[at]

    def encode(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of texts that stand in one buffer of UTF-8, the i-th up to byte ends[i]; and how many each has."""
        chars = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        heads = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        begins = np.searchsorted(heads, np.concatenate([[0], ends]))  # in characters, with the end
        full = np.flatnonzero(np.diff(begins) > 0)
        del heads
        chars = np.where(chars == 0x20, np.uint32(SPACE), chars)
        at = begins[full]
        if self.prefix:
            chars, at = np.insert(chars, at, SPACE), at + np.arange(len(at))
        counts, out, taken = np.zeros(len(ends), np.int64), [], 0
        borders = np.zeros(len(chars), bool)
        borders[at] = True
        while taken < len(chars):
            here, starts = self._block(chars, borders, taken)
            ids, sizes = self.encode_block(here, starts)
            of = np.searchsorted(at, starts + taken, side="right") - 1
            counts[full] += np.bincount(of, sizes, len(full)).astype(np.int64)
            out.append(ids)
            taken += len(here)
        return np.concatenate(out) if out else np.zeros(0, np.int32), counts

    def _block(self, chars: np.ndarray, borders: np.ndarray, taken: int) -> tuple[np.ndarray, np.ndarray]:
        """The next words, of BLOCK_CHARS characters or of one longer word, and their starts."""
        size = BLOCK_CHARS
        while True:
            here = chars[taken : taken + size]
            starts = np.flatnonzero(self.cuts(here, borders[taken : taken + len(here)]))
            if taken + size >= len(chars):
                return here, starts
            # the last word may go on, and so may a run whose cuts depend on its end
            whole = starts[starts <= len(here) - 4 * self.longest]
            whole = whole[~np.isin(here[whole], list(self.even_runs))]
            if len(whole) > 1:
                return here[: whole[-1]], starts[starts < whole[-1]]
            size *= 2

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each list of ids; the i-th list is ids[offsets[i]:offsets[i + 1]]."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is not one of the model's")
        data = np.frombuffer(self.surfaces.take(pa.array(ids)).buffers()[2] or b"", np.uint8)
        total = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        seen = np.concatenate([[0], np.cumsum(self.kinds[ids] != CONTROL)])
        # the first piece of a text that is not a control piece loses the space that it starts with
        lists = np.flatnonzero(seen[offsets[1:]] > seen[offsets[:-1]])
        first = np.searchsorted(seen, seen[offsets[lists]], side="right") - 1
        drop = total[first[self.opens[ids[first]]]] if len(first) else np.zeros(0, np.int64)
        gone = np.zeros(len(data) + 1, np.int64)
        gone[drop + 1] = 1
        at = total[offsets] - np.cumsum(gone)[total[offsets]]
        keep = np.ones(len(data), bool)
        keep[drop] = False
        raw = data[: total[-1]][keep[: total[-1]]].tobytes()
        texts = [raw[a:b].decode("utf-8", "corpusflow-bytes") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        control = np.flatnonzero(self.kinds[ids] == CONTROL)
        if len(control):  # bytes on both sides of one are no character together
            apart = total[control] - np.cumsum(gone)[total[control]]
            of = np.searchsorted(offsets, control, side="right") - 1
            for i in np.unique(of).tolist():
                bounds = [at[i], *apart[of == i], at[i + 1]]
                texts[i] = "".join(raw[x:y].decode("utf-8", "corpusflow-bytes") for x, y in zip(bounds[:-1], bounds[1:], strict=True))
        return texts


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _one_by_one(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("corpusflow-bytes", _one_by_one)


def _encoder(model, text: int, schema: pa.Schema):
    data, name = model

    @keeping("piece_bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_state(name, lambda: Model(data.value))
        for whole in batches:
            for batch in slices(whole, text):
                column = batch.column(text)
                sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(sizes)
                start = column.buffers()[1] and np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset]
                raw = (column.buffers()[2] or pa.py_buffer(b""))[int(start or 0) : int(start or 0) + int(ends[-1] if len(ends) else 0)].to_pybytes()
                ids, counts = held.encode(raw, ends)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()), mask=column.is_null())
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], schema=schema)

    return run


def _decoder(model, at: int, schema: pa.Schema):
    data, name = model

    @keeping("piece_bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_state(name, lambda: Model(data.value))
        for batch in batches:
            column = batch.column(at)
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
            ids = pc.list_flatten(column)
            if ids.null_count:
                raise ValueError("an id is null")
            out = pa.array(held.decode(ids.to_numpy().astype(np.int64), offsets), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.if_else(column.is_null(), pa.scalar(None, pa.string()), out)], schema=schema)

    return run


def _with(df: DataFrame, name: str, kind: T.DataType, column: str, model: str | bytes, make) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {name} already")
    data = model if isinstance(model, bytes) else Path(model).read_bytes()
    Model(data)  # refuses here what it cannot do
    spark = df.sparkSession
    small_batches(spark)
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    held = (spark.sparkContext.broadcast(data), "piece_bpe-" + hashlib.sha1(data).hexdigest())
    return df.mapInArrow(make(held, df.columns.index(column), to_arrow_schema(schema)), schema)


def encoded(docs: DataFrame, model: str | bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with `ids` (array of int), the library's ids of each text. model: a file on the driver, or its bytes; it is
    sent to the executors (a vocabulary, some hundred kB)."""
    return _with(docs.withColumn(text, F.col(text).cast("string")), ids, T.ArrayType(T.IntegerType(), False), text, model, _encoder)


def decoded(docs: DataFrame, model: str | bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with `text`, what the library decodes from each list of ids."""
    return _with(docs.withColumn(ids, F.col(ids).cast("array<int>")), text, T.StringType(), ids, model, _decoder)
