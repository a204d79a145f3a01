"""Token counts by a byte-level BPE tokenizer, compiled to finite-state transducers.

Two deterministic transducers are composed:

1. The pre-tokenizer is a transducer of 12 states over character classes. Each transition is annotated with the
   pieces that it opens: one at this character, one at the character before, or none. A batch of texts is cut into
   chunks of equal length. Each chunk is read from all states at once (states that meet are merged and read on once),
   which gives a map from state to state; the maps compose through a parallel prefix scan, so that each chunk knows
   its state and emits its pieces. An end mark between texts brings every state back to the start.
2. The merges are a transducer over bytes. For each prefix of a piece there is one last token; the number of tokens of
   the prefix is that of the prefix before that token, plus one. A state is what the future can depend on: the longest
   end of what was read that begins some token, with the last token and the relative count at each of its places. A
   transition is annotated with the change of the count. Transitions are made when first met and kept in a dense
   table; all pieces of a batch step through it together.

When the table has `MAX_STATES` states, pieces that need another one are counted by the library's own model.

Rules: a null text is empty and has no tokens. Strings of special tokens inside a text count as one token each, as the
library's default has it. Nothing is truncated, and no token is added. Extra columns pass through.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.shared import keeping, small_batches, worker_state

MAX_STATES = 100_000
CHUNK = 256
#: Bytes of text that step through the tables together.
BLOCK_BYTES = 2 << 20
#: Bytes of a piece read in step with the others; longer pieces go on alone.
STEPS = 48

_END, _L, _N, _O, _SP, _W, _WSP, _WW, _A, _AR, _AV, _AL = range(12)
_COTHER, _CAPOS, _CSPACE, _CWHITE, _CNUM, _CLETTER, _CSTMD, _CR, _CV, _CLL, _CE, _CMARK = range(12)
_STOP = 0x110000


def _pre_tokenizer() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class], opens[state, class]: 1 a piece at this character, 2 one at the character before."""
    fresh = {_COTHER: _O, _CAPOS: _A, _CSPACE: _SP, _CWHITE: _W, _CNUM: _N, _CMARK: _END}
    run = {_COTHER: _O, _CAPOS: _O, _CNUM: _N}
    nxt, opens = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    letters = {_CLETTER, _CSTMD, _CR, _CV, _CLL, _CE}
    white = {_CSPACE, _CWHITE}
    for s in range(12):
        for c in range(12):
            new, out = fresh.get(c, _L), 1
            if c == _CMARK:
                out = 3 if s in (_AR, _AV, _AL) else 1
            elif s == _L and c in letters or s == _N and c == _CNUM or s == _O and c in (_COTHER, _CAPOS):
                new, out = s, 0
            elif s in (_SP, _W, _WSP, _WW) and c in white:
                new, out = (_WSP if c == _CSPACE else _WW), 0
            elif s == _SP:
                new, out = run.get(c, _L), 0
            elif s == _WSP:
                new, out = run.get(c, _L), 2
            elif s == _WW:
                out = 3
            elif s == _A:
                if c == _CSTMD:
                    new, out = _END, 0
                elif c in (_CR, _CV, _CLL):
                    new, out = {_CR: _AR, _CV: _AV, _CLL: _AL}[c], 0
                elif c in (_COTHER, _CAPOS):
                    new, out = _O, 0
            elif (s, c) in ((_AR, _CE), (_AV, _CE), (_AL, _CLL)):
                new, out = _END, 0
            elif s in (_AR, _AV, _AL):  # that letter was the first of a word
                new, out = (_L, 2) if c in letters else (new, 3)
            nxt[s, c], opens[s, c] = new, out
    return nxt, opens


def _classes() -> np.ndarray:
    out = np.full(_STOP + 1, _COTHER, np.uint8)
    for cp in range(_STOP):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = _CLETTER
        elif kind == "N":
            out[cp] = _CNUM
    white = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[white] = _CWHITE
    out[0x20], out[0x27], out[_STOP] = _CSPACE, _CAPOS, _CMARK
    for letters, c in (("stmd", _CSTMD), ("r", _CR), ("v", _CV), ("l", _CLL), ("e", _CE)):
        for x in letters:
            out[ord(x)] = c
    return out


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TokenCounter:
    """Counts tokens of texts; one a worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("a byte-level BPE tokenizer with its usual pattern and no normalizer is needed")
        self.model = Tokenizer.from_file(path).model
        self.letter = byte_letters()
        byte = {c: b for b, c in self.letter.items()}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.tokens = {bytes(byte[c] for c in t) for t in spec["model"]["vocab"] if all(c in byte for c in t) and t not in self.special}
        self.begins = {t[:i] for t in self.tokens for i in range(len(t))}  # of longer tokens
        self.next_class, self.opens = (x.reshape(-1) for x in _pre_tokenizer())
        self.classes = _classes()
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self._reset()

    # --- the transducer of the merges ---

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.of: list[tuple | None] = [None]
        self.move = np.full((4096, 256), -1, np.int32)
        self.change = np.zeros((4096, 256), np.int8)
        self.move[0] = 0  # state 0 has left the table
        self.start = self._state((b"", (b"",), (0,)))

    def _state(self, key: tuple) -> int:
        at = self.states.get(key)
        if at is None:
            at = self.states[key] = len(self.of)
            self.of.append(key)
            if at >= len(self.move):
                self.move = np.concatenate([self.move, np.full_like(self.move, -1)])
                self.change = np.concatenate([self.change, np.zeros_like(self.change)])
        return at

    def encoded(self, data: bytes) -> int:
        return len(self.model.tokenize("".join(map(self.letter.__getitem__, data))))

    def _fit(self, before: bytes, token: bytes) -> bool:
        """Whether these two stay two neighbouring tokens."""
        key = (before, token)
        found = self.fits.get(key)
        if found is None:
            ids = [t.value for t in self.model.tokenize("".join(map(self.letter.__getitem__, before + token)))]
            found = self.fits[key] = ids == ["".join(map(self.letter.__getitem__, x)) for x in key if x]
            if len(self.fits) > 2_000_000:
                self.fits.clear()
        return found

    def _add(self, state: int, b: int) -> int:
        """Makes the transition; 0 if the table is full."""
        if len(self.of) >= MAX_STATES:
            return 0
        text, last, count = self.of[state]
        text += bytes([b])
        for k in range(len(text)):
            token = text[k:]
            if token in self.tokens and self._fit(last[k], token):
                break
        else:
            raise ValueError(f"byte {b} has no token")
        made = count[k] + 1  # relative to the place before
        last, count = (*last, token), (*count, made)
        # only places from where a longer token may still come count
        live = [text[k:] in self.begins for k in range(len(text) + 1)]
        k = live.index(True)
        to = self._state((text[k:], tuple(x if y else None for x, y in zip(last[k:], live[k:], strict=True)), tuple(c - made if y else None for c, y in zip(count[k:], live[k:], strict=True))))
        self.move[state, b], self.change[state, b] = to, made
        return to

    def _pieces(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each piece of data."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        state = np.full(len(order), self.start, np.int32)
        total = np.zeros(len(order), np.int32)
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(min(longest, STEPS)), side="left")  # those longer than k
        for k, n in enumerate(active):
            b = data[starts[:n] + k]
            at = state[:n].astype(np.int64) * 256 + b
            to = self.move.reshape(-1)[at]
            if (new := to < 0).any():
                for x in np.unique(at[new]):
                    self._add(int(x) >> 8, int(x) & 255)
                to = self.move.reshape(-1)[at]
                to[to < 0] = 0
            total[:n] += self.change.reshape(-1)[at]
            state[:n] = to
        for i in np.flatnonzero((sizes > STEPS) & (state > 0)).tolist():
            s, t, end = int(state[i]), int(total[i]), int(starts[i] + sizes[i])
            for b in data[int(starts[i]) + STEPS : end].tolist():
                to = int(self.move[s, b])
                if to < 0:
                    to = self._add(s, b)
                if not to:
                    s = 0
                    break
                t += int(self.change[s, b])
                s = to
            state[i], total[i] = s, t
        for i in np.flatnonzero(state == 0).tolist():
            total[i] = self.encoded(data[starts[i] : starts[i] + sizes[i]].tobytes())
        out = np.empty_like(total)
        out[order] = total
        return out

    # --- the pre-tokenizer ---

    def _opened(self, cls: np.ndarray) -> np.ndarray:
        """For each character whether a piece opens there; cls ends with a mark."""
        n = len(cls)
        rows = -(-n // CHUNK)
        steps = np.full(rows * CHUNK, _CMARK, np.uint8)
        steps[:n] = cls
        steps = np.ascontiguousarray(steps.reshape(rows, CHUNK).T)
        first = 4
        state = np.repeat(np.arange(12, dtype=np.uint8)[None], rows, 0)
        for k in range(first):
            state = self.next_class[state.astype(np.intp) * 12 + steps[k][:, None]]
        key = np.arange(rows)[:, None] * 12 + state
        seen = np.zeros(rows * 12, bool)
        seen[key] = True
        lanes = np.flatnonzero(seen)
        row, lane = lanes // 12, (lanes % 12).astype(np.uint8)
        for k in range(first, CHUNK):
            lane = self.next_class[lane.astype(np.intp) * 12 + steps[k][row]]
        maps = lane[np.cumsum(seen)[key] - 1]
        d = 1
        while d < rows:  # prefix scan: maps[i] becomes the map of all chunks up to i
            maps[d:] = np.take_along_axis(maps[d:], maps[:-d].astype(np.intp), 1)
            d *= 2
        state = np.concatenate([[_END], maps[:-1, _END]]).astype(np.uint8)
        opens = np.empty((CHUNK, rows), np.uint8)
        for k in range(CHUNK):
            at = state.astype(np.intp) * 12 + steps[k]
            opens[k] = self.opens[at]
            state = self.next_class[at]
        opens = opens.T.reshape(-1)[:n]
        out = (opens & 1).astype(bool)
        out[:-1] |= (opens[1:] & 2).astype(bool)
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        parts, of, extra = [], [], [0] * len(texts)
        for i, t in enumerate(texts):
            pieces = [t]
            for s in self.special:
                if s in t:
                    cut = [p.split(s) for p in pieces]
                    extra[i] += sum(len(c) - 1 for c in cut)
                    pieces = [x for c in cut for x in c]
            parts += pieces
            of += [i] * len(pieces)
        cps, ends = [], []
        n = 0
        mark = np.array([_STOP], np.uint32)
        for p in parts:
            cp = np.frombuffer(p.encode("utf-32-le"), np.uint32)
            cps += [cp, mark]
            n += len(cp) + 1
            ends.append(n)
        if not cps:
            return extra
        cp = np.concatenate(cps)
        opened = np.flatnonzero(self._opened(self.classes[cp]))
        width = (1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)).astype(np.int64)
        width[cp == _STOP] = 1
        place = np.concatenate([[0], np.cumsum(width)])
        data = np.frombuffer("\0".join(parts).encode() + b"\0", np.uint8)
        starts = place[opened]
        sizes = np.diff(np.append(starts, place[-1]))
        real = cp[opened] != _STOP
        tokens = np.zeros(len(opened), np.int64)
        tokens[real] = self._pieces(data, starts[real], sizes[real])
        upto = np.concatenate([[0], np.cumsum(tokens)])
        at = np.searchsorted(opened, np.concatenate([[0], ends]))
        per = np.diff(upto[at])
        out = np.array(extra, np.int64)
        np.add.at(out, of, per)
        return out.tolist()


def blocks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours of about `most` bytes together."""
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def with_token_counts(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of `text` (long) as the last column, which must be a new name."""
    if out in docs.columns:
        raise ValueError(f"docs already has a column {out}")
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])

    @keeping(f"token counter {tokenizer}")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_state(f"token counter {tokenizer}", lambda: TokenCounter(tokenizer))
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            counts: list[int] = []
            for a, b in blocks([len(x) for x in texts], BLOCK_BYTES):
                counts += counter.counts(texts[a:b])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def counted(docs: DataFrame, tokenizer: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit)."""
    out = with_token_counts(docs.select(doc_id, text), tokenizer, text)
    return out.select(doc_id, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
