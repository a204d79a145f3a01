"""Packing: every document's tokens into windows of fixed length, in the corpus's mixture of sources.

Sources are queues of tokens. The documents are dealt into partitions of about PARTITION_TOKENS tokens by a hash of
their place, so each partition holds a share of every source. Partition p fills the places from the total of all
partitions before it: a window cut by a partition's end is filled on by the next, so only the last window of all is
short. Inside a partition, deficit round-robin fills window after window: each queue's deficit grows by its target
share of the window; queues give their whole tokens of credit, and the places that rounding leaves go to the largest
deficits. An empty queue's places go to the others in the same way (work conserving), so nothing is left over. The
deficits at a partition's start are its target share of all places before it less what its queue has given in the
earlier partitions, known from sums over partitions: they are carried without one partition waiting for another.

The target shares are given, or the corpus's own token shares. Documents are cut where a queue's turn ends; each token
is in exactly one piece.

Rules: a null text is empty; a document is its ids and then END_ID, so an empty one is that id alone. A null source is
a queue of its own. Repeated rows are separate documents. An empty table gives no pieces. Windows are numbered from 0;
offsets within a window have no gaps. Only the id, text and source columns are read. The number of distinct sources
must fit in memory (a mixture has few); a source may hold any share of the rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.shared import Scratch, keeping, slices, worker_state

WINDOW = 4096
END_ID = 2
PARTITION_TOKENS = 1_000_000
#: Entries of each worker's caches of words and pieces.
WORDS, PIECES = 200_000, 250_000

_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = re.compile(r"[ \t\n\r]+")


def id_kind(path: str) -> str:
    """array type code of the ids: 16 bits where all fit, else 32."""
    from tokenizers import Tokenizer

    return _kind_of(Tokenizer.from_file(path))


def _kind_of(library) -> str:
    return "H" if library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"


class WordTokens:
    """Ids of whole texts from a word-level BPE whose pieces never span white space, cached by word and piece.

    A word of letters below U+0250 is lower-cased and cut as the tokenizer's normalizer and pattern do, and each piece
    goes to the library's model; any other word, and any that may hold a special token, goes to the library whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        from corpusflow.llm.token_counts import byte_letters

        self.library = Tokenizer.from_file(path)
        self.model, self.letter = self.library.model, byte_letters()
        self.kind = _kind_of(self.library)
        part = lambda x: json.loads(x.__getstate__()) if x is not None else {}
        kinds = [n["type"] for n in part(self.library.normalizer).get("normalizers", [])]
        split = part(self.library.pre_tokenizer).get("pretokenizers", [{}])[0]
        self.pattern = None
        if kinds == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("invert"):
            self.pattern = regex.compile(split["pattern"]["Regex"])
        self.plain = re.compile(r"[\x21-\x7e\xa1-\u024f]*\Z")
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            shown = piece if piece.isascii() else "".join(map(self.letter.__getitem__, piece.encode()))  # ASCII stands for itself
            found = array(self.kind, [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(self.pieces) < PIECES and len(piece) <= 64:
                self.pieces[piece] = found
        return found

    def _word(self, word: str) -> bytes:
        if self.pattern is None or "<|" in word or not self.plain.match(word):
            out = array(self.kind, self.library.encode(word, add_special_tokens=False).ids).tobytes()
        else:
            out = b"".join(map(self._piece, self.pattern.findall(word.lower())))
        if len(self.words) < WORDS and len(word) <= 64:
            self.words[word] = out
        return out

    def ids(self, text: str) -> bytes:
        """Ids as machine words of self.kind."""
        if self.pattern is None:
            return array(self.kind, self.library.encode(text, add_special_tokens=False).ids).tobytes()
        words = _SPACE.split(text) if _ODD_SPACE.search(text) else text.split()
        known, make = self.words.get, self._word
        return b"".join([known(w) or make(w) for w in words])


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(uid, doc_id, source, n, ids): ids as words of id_kind, ending with end_id; uid is unique once written."""

    @keeping(f"word tokens {tokenizer}")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_state(f"word tokens {tokenizer}", lambda: WordTokens(tokenizer))
        encode, kind = words.ids, words.kind
        end = array(kind, [end_id]).tobytes()
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, 1):
                ids = [encode(x) + end if x else end for x in part.column(1).to_pylist()]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(range(uid, uid + n), pa.int64()), part.column(0), part.column(2), pa.array([len(x) // len(end) for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["uid", "doc_id", "source", "n", "ids"])
                uid += n

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string"), F.col(source).cast("string").alias("source"))
    return chosen.mapInArrow(run, "uid long, doc_id long, source string, n long, ids binary")


def deficit_round_robin(left: list[int], deficits: list[float], shares: list[float], at: int, window: int) -> Iterator[tuple[int, list[int]]]:
    """Yields (first place, tokens of each queue) until all queues are empty; `at` is the first place to fill."""
    left, deficits = list(left), list(deficits)
    queues = range(len(left))
    while (rest := sum(left)) > 0:
        room = min(window - at % window, rest)
        take = [0] * len(left)
        for q in queues:
            deficits[q] += shares[q] * room
            take[q] = max(0, min(int(deficits[q] // 1), left[q]))
        over = sum(take) - room
        if over > 0:  # credit from before: those with the least deficit wait
            for q in sorted(queues, key=lambda q: (deficits[q] - take[q], q)):
                less = min(take[q], over)
                take[q] -= less
                over -= less
        while over < 0:  # rounding and empty queues leave places
            open_ = [q for q in queues if take[q] < left[q]]
            need = [max(0.0, shares[q]) for q in open_]
            if -over <= len(open_):
                for q in sorted(open_, key=lambda q: (take[q] - deficits[q], q))[:-over]:
                    take[q] += 1
                    over += 1
            else:
                total, room_left = sum(need), -over
                for q, s in zip(open_, need, strict=True):
                    more = min(left[q] - take[q], max(1, int(room_left * (s / total if total else 1 / len(open_)))), -over)
                    take[q] += more
                    over += more
        for q in queues:
            left[q] -= take[q]
            deficits[q] -= take[q]
        yield at, take
        at += room


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, shares: dict[str | None, float] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", partition_tokens: int = PARTITION_TOKENS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (uint32 bytes), doc_tokens, sequence_id, offset, source."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    tokens = scratch.table(tokenized(docs, tokenizer, end_id, doc_id, text, source), "tokens", compression="zstd")
    totals = {r.source: r.n for r in tokens.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    sources = sorted(totals, key=lambda s: (s is None, s or ""))
    total = sum(totals.values())
    target = [totals[s] / total if shares is None else float(shares.get(s, 0)) for s in sources]
    partitions = max(1, -(-total // partition_tokens))
    index = {s: i for i, s in enumerate(sources)}
    width = np.uint16 if id_kind(tokenizer) == "H" else np.uint32
    placed = tokens.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(partitions)))
    sums = scratch.table(_carried(placed.groupBy("part", "source").agg(F.sum("n").alias("n"))), "sums")

    def fill(key, rows: pa.Table, base: pa.Table) -> pa.Table:
        rows = rows.sort_by([("uid", "ascending")])
        queue: list[list[int]] = [[] for _ in sources]
        for i, s in enumerate(rows.column("source").to_pylist()):
            queue[index[s]].append(i)
        n = rows.column("n").to_pylist()
        ids, docs_ = rows.column("ids").combine_chunks(), rows.column("doc_id").to_pylist()
        given = [0] * len(sources)
        for s, g in zip(base.column("source").to_pylist(), base.column("given").to_pylist(), strict=True):
            given[index[s]] = g
        first = base.column("first").to_pylist()[0]
        left = [sum(n[i] for i in q) for q in queue]
        deficits = [t * first - g for t, g in zip(target, given, strict=True)]
        head, done = [0] * len(sources), [0] * len(sources)
        out: list[tuple] = []
        for at, take in deficit_round_robin(left, deficits, target, first, window):
            for q, m in enumerate(take):
                while m:
                    i = queue[q][head[q]]
                    length = min(m, n[i] - done[q])
                    out.append((docs_[i], done[q], length, np.frombuffer(ids[i].as_buffer(), width)[done[q] : done[q] + length].astype(np.uint32).tobytes(), n[i], at // window, at % window, sources[q]))
                    at, m, done[q] = at + length, m - length, done[q] + length
                    if done[q] == n[i]:
                        head[q], done[q] = head[q] + 1, 0
        columns = list(zip(*out, strict=True)) if out else [[]] * 8
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _PIECE, strict=True)], schema=_PIECE)

    pieces = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, source string"
    return placed.groupBy("part").cogroup(sums.groupBy("part")).applyInArrow(fill, pieces)


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string())])


def _carried(sums: DataFrame) -> DataFrame:
    """(part, source, given, first): tokens of the source, and of all, in earlier partitions.

    Prefix sums in two levels: within blocks of 1024 partitions, and over the blocks' totals, which are few.
    """
    each = sums.groupBy("part").agg(F.sum("n").alias("all"))
    by_block = each.select("part", F.col("all").alias("n")).groupBy(F.floor(F.col("part") / 1024).alias("block")).agg(F.sum("n").alias("n"))
    starts = by_block.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("block_first"))
    inner = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = each.withColumn("block", F.floor(F.col("part") / 1024)).select("part", "block", F.coalesce(F.sum("all").over(inner), F.lit(0)).alias("inner_first")).join(starts, "block").select("part", (F.col("block_first") + F.col("inner_first")).alias("first"))
    # a source may miss from a partition: its own running sum is carried to the last partition that has it
    blocks = sums.withColumn("block", F.floor(F.col("part") / 1024))
    of_block = blocks.groupBy("source", "block").agg(F.sum("n").alias("n"))
    src_starts = of_block.select("source", "block", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("given_before"))
    given = blocks.select("part", "source", "block", F.coalesce(F.sum("n").over(Window.partitionBy("source", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("given_inner"))
    joined = given.join(src_starts, (given["source"].eqNullSafe(src_starts["source"])) & (given["block"] == src_starts["block"])).select(given["part"], given["source"], (F.col("given_before") + F.col("given_inner")).alias("given"))
    return joined.join(first, "part")

