"""Media columns: audio held as WAV bytes, and its features as fixed-shape Arrow tensors with time spans.

- Stored form: mono RIFF WAVE with 8-bit unsigned samples, lossless for any bytes.
- Polyphase resampling: a windowed-sinc low-pass at the common rate, of which only the taps that meet a sample are used.
- Features: overlapped Hann frames of the resampled signal, power spectrum, triangular mel filterbank, log.
- Segmentation: frame energies in decibels below the loudest frame open a segment above `open_db` and close it below
  `close_db` (hysteresis).
- Spectrogram rows are cut into tensors of FRAMES x MELS, padded with the floor; each has its time span, so the Arrow
  type is a fixed-shape tensor however long the clip is. Spark's own arrays have no fixed shape, so a clip's tensors and
  spans are stored as one Arrow stream in a binary column.
- Long clips are resampled, framed and written in blocks of frames; beside the clip, its stored tensors (a quarter of
  its size) and one energy a frame, memory does not grow with its length.

Rules: null bytes or a WAVE without samples have no tensors and no segments. A null or empty text is stored as one
payload of padding. Equal bytes give equal values: each clip is computed alone, and the feature string is made of the
stored tensors, rounded. Repeated rows and ids, null ones too, are clips of their own. An empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.shared import Scratch, slices, tidy

RATE = 16_000
TO_RATE = 12_000
FRAME, HOP, MELS, FRAMES = 256, 192, 16, 32
OPEN_DB, CLOSE_DB = -12.0, -18.0
FLOOR = 1e-6
#: Frames computed together.
BLOCK = 4096
PAD_TO, PAD_BYTE = 576, b"\xff"


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    pad = len(samples) & 1
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(samples) + pad, b"WAVE") + fmt + struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * pad


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of an 8-bit mono WAVE; chunks may come in any order."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE")
    at, rate, data = 12, 0, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("8-bit mono PCM is needed")
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
            if len(data) != size:
                raise ValueError("cut short")
        at += 8 + size + (size & 1)
    if data is None or not rate:
        raise ValueError("no samples")
    return data, rate


@lru_cache
def _phases(up: int, down: int, half: int = 8) -> np.ndarray:
    """taps[phase, tap] of the low-pass, split by output phase."""
    cut = 1 / max(up, down)
    n = np.arange(-half * max(up, down), half * max(up, down) + 1)
    taps = up * cut * np.sinc(n * cut) * np.hanning(len(n) + 2)[1:-1]
    width = -(-len(taps) // up)
    return np.pad(taps, (0, width * up - len(taps))).reshape(width, up).T.copy()


def resampled_length(n: int, up: int, down: int) -> int:
    return -(-n * up // down)


def resample_range(x: np.ndarray, up: int, down: int, start: int, stop: int) -> np.ndarray:
    """Outputs start to stop of x at up/down of its rate, from the samples that they need.

    The filter's delay is taken out. Each output is one phase's taps on its neighbours.
    """
    g = int(np.gcd(up, down))
    up, down = up // g, down // g
    if up == down or stop <= start:
        return x[start:stop]
    taps = _phases(up, down)
    width, delay = taps.shape[1], 8 * max(up, down)
    low, high = (start * down + delay) // up + 1 - width, ((stop - 1) * down + delay) // up + 1
    held = x[max(low, 0) : min(max(high, 0), len(x))]
    near = np.concatenate([np.zeros(max(0, min(-low, high - low))), held, np.zeros(max(0, high - max(low, len(x))))])
    views = np.lib.stride_tricks.sliding_window_view(near, width)
    out = np.empty(stop - start)
    for p in range(up):  # every up-th output has one phase
        k = np.arange(start + p, stop, up)
        if len(k):
            at = k * down + delay
            out[p::up] = views[at // up + 1 - width - low] @ taps[at[0] % up][::-1]
    return out


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """x at up/down of its rate."""
    return resample_range(x, up, down, 0, resampled_length(len(x), up, down))


@lru_cache
def _mel(rate: int) -> np.ndarray:
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    freq = np.arange(FRAME // 2 + 1) * rate / FRAME
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((freq - low) / (mid - low), (high - freq) / (high - mid))).T.copy()


def frame_count(n: int) -> int:
    """Frames of n samples; the last is padded with silence."""
    return max(1, -(-(n - FRAME) // HOP) + 1)


def framed(read: Callable[[int, int], np.ndarray], n: int, rate: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(frames x MELS log energies, frame energies) of `block` frames at a time; read(a, b) gives samples of the n."""
    frames, window, mel = frame_count(n), np.hanning(FRAME + 1)[:-1], _mel(rate)
    for at in range(0, frames, block):
        some = min(block, frames - at)
        first, last = at * HOP, (at + some - 1) * HOP + FRAME
        x = read(first, min(last, n))
        x = np.concatenate([x, np.zeros(last - first - len(x))])
        part = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * window
        power = np.square(np.abs(np.fft.rfft(part, axis=1)))
        yield np.log(power @ mel + FLOOR), np.einsum("ij,ij->i", part, part)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log energies, frame energies) of a whole signal."""
    mel, energy = zip(*framed(lambda a, b: x[a:b], len(x), rate, BLOCK), strict=True)
    return np.concatenate(mel), np.concatenate(energy)


def segments(energy: np.ndarray, open_db: float = OPEN_DB, close_db: float = CLOSE_DB) -> list[tuple[int, int]]:
    """Runs of frames [first, end) by hysteresis: opened above one level, kept up to the lower one."""
    if not len(energy) or energy.max() <= FLOOR:
        return []
    db = 10 * np.log10(np.maximum(energy, FLOOR) / energy.max())
    alive = np.concatenate([[False], db >= close_db, [False]])
    edge = np.flatnonzero(alive[1:] != alive[:-1])
    loud = np.concatenate([[0], np.cumsum(db >= open_db)])
    # a run above the lower level counts from its first loud frame
    return [(a + int(np.argmax(db[a:b] >= open_db)), b) for a, b in edge.reshape(-1, 2).tolist() if loud[b] > loud[a]]


def tensor_array(tensors: np.ndarray) -> pa.Array:
    """An Arrow fixed-shape tensor array of FRAMES x MELS float32."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(tensors, np.float32).reshape(-1)), FRAMES * MELS)
    return pa.ExtensionArray.from_storage(_TENSOR, flat)


_TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))
_STORED = pa.schema([("log_mel", _TENSOR), ("start_ms", pa.int64()), ("end_ms", pa.int64())])


def _ms(frame: int) -> int:
    return frame * HOP * 1000 // TO_RATE


def store_tensors(media: bytes | None) -> tuple[bytes, int, list[tuple[int, int]]] | None:
    """(Arrow stream of tensors with their spans, frames, segments in milliseconds) of a WAVE; None for no samples."""
    if not media:
        return None
    data, rate = from_wav(media)
    if not data:
        return None
    raw = np.frombuffer(data, np.uint8)
    n = resampled_length(len(raw), TO_RATE, rate)

    class Samples:
        """raw from -1 to 1, block by block."""

        def __len__(self) -> int:
            return len(raw)

        def __getitem__(self, part: slice) -> np.ndarray:
            return (raw[part] - 127.5) / 127.5

    samples, energies, at = Samples(), [], 0
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _STORED) as out:
        for mel, energy in framed(lambda a, b: resample_range(samples, TO_RATE, rate, a, b), n, TO_RATE, BLOCK // FRAMES * FRAMES):
            count = -(-len(mel) // FRAMES)
            tensors = np.full((count * FRAMES, MELS), np.log(FLOOR), np.float32)
            tensors[: len(mel)] = mel
            starts = [_ms(at + i * FRAMES) for i in range(count)]
            ends = [_ms(at + min((i + 1) * FRAMES, len(mel))) for i in range(count)]
            out.write_batch(pa.record_batch([tensor_array(tensors), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], schema=_STORED))
            energies.append(energy)
            at += len(mel)
    return sink.getvalue().to_pybytes(), at, [(_ms(a), _ms(b)) for a, b in segments(np.concatenate(energies))]


def stored_batches(stream: bytes) -> Iterator[pa.RecordBatch]:
    """(log_mel fixed-shape tensors, start_ms, end_ms) as they were stored."""
    with pa.ipc.open_stream(stream) as found:
        if found.schema != _STORED:
            raise ValueError("not a stream of log-mel tensors")
        yield from found


def feature_string(stream: bytes | None, spans: list[tuple[int, int]]) -> str:
    """frames:segments:digest; the digest is over the stored log energies in sixteenths and the segments' spans."""
    if stream is None:
        return "0:0:"
    digest, frames = hashlib.sha256(), 0
    for batch in stored_batches(stream):
        rows = batch.column(0).to_numpy_ndarray().reshape(-1, MELS)
        own = (batch.column(2)[-1].as_py() - batch.column(1)[0].as_py()) * TO_RATE // (HOP * 1000)
        digest.update(np.rint(rows[:own] * 16).astype("<i2").tobytes())
        frames += own
    digest.update(repr(spans).encode())
    return f"{frames}:{len(spans)}:{digest.hexdigest()[:16]}"


_SPAN = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
_SPAN_DDL = "array<struct<start_ms:long,end_ms:long>>"


def _spans(found: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start_ms": a, "end_ms": b} for a, b in found]


def tensor_column(media: DataFrame, column: str = "media") -> DataFrame:
    """One row a clip: the other columns, tensors (an Arrow stream of FRAMES x MELS tensors and spans), frames, segments.

    Clips without samples have null in all three. Columns of these names raise ValueError.
    """
    made = ["tensors", "frames", "segments"]
    if set(made) & set(media.columns):
        raise ValueError(f"columns {made} are made here")
    rest = [c for c in media.columns if c != column]
    schema = T.StructType([*media.drop(column).schema.fields, *T.StructType.fromDDL(f"tensors binary, frames long, segments {_SPAN_DDL}").fields])
    at = len(rest)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                found = [store_tensors(x.as_py()) or (None, None, None) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64()), pa.array([None if f[2] is None else _spans(f[2]) for f in found], _SPAN)], [*rest, *made])

    return media.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{column}`")).mapInArrow(run, schema)


def audio_features(media: DataFrame, column: str = "media") -> DataFrame:
    """One row a tensor: the other columns, tensor_no, start_ms, end_ms, log_mel (FRAMES x MELS floats), segments.

    Read from the stored tensors. Columns of these names raise ValueError.
    """
    made = ["tensor_no", "start_ms", "end_ms", "log_mel", "segments"]
    if set(made) & set(media.columns):
        raise ValueError(f"columns {made} are made here")
    rest = [c for c in media.columns if c != column]
    stored = tensor_column(media, column).where("tensors is not null")
    schema = T.StructType([*media.drop(column).schema.fields, *T.StructType.fromDDL(f"tensor_no int, start_ms long, end_ms long, log_mel array<float>, segments {_SPAN_DDL}").fields])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = 0
                for block in stored_batches(batch.column("tensors")[i].as_py()):
                    n = block.num_rows
                    cols = [pa.repeat(batch.column(c)[i], n) for c in rest]
                    cols += [pa.array(range(at, at + n), pa.int32()), block.column(1), block.column(2), block.column(0).storage.cast(pa.list_(pa.float32())), pa.repeat(batch.column("segments")[i], n)]
                    yield pa.RecordBatch.from_arrays(cols, [*rest, *made])
                    at += n

    return stored.mapInArrow(run, schema)


def padded_payload(data: bytes) -> bytes:
    n = max(1, -(-len(data) // PAD_TO)) * PAD_TO
    return data + PAD_BYTE * (n - len(data))


def stored_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's padded bytes as the samples of a WAVE."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                data = [x.as_py() or b"" for x in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([to_wav(padded_payload(x)) for x in data], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def texts_as_audio(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each whole text stored as a WAVE, read back, and its tensors stored: digests of both and the feature string."""
    scratch = Scratch(docs.sparkSession, "audio")
    media = scratch.table(stored_texts(docs, doc_id, text), "media", compression="zstd")

    @tidy
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                rows = []
                for x in part.column(2):
                    wave = x.as_py()
                    back, _ = from_wav(wave)
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(wave), hashlib.sha256(wave).hexdigest()))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    names = ["doc_id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    digested = media.mapInArrow(digests, "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string")
    stored = scratch.table(tensor_column(digested), "tensors", compression="zstd")
    scratch.drop(media)
    kept = [c for c in names if c != "media"]

    @tidy
    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(kept)
        for batch in batches:
            found = [feature_string(x.as_py(), [(s["start_ms"], s["end_ms"]) for s in spans or []]) for x, spans in zip(batch.column(at), batch.column(at + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(found, pa.string())], [*kept, "feature"])

    return stored.select(*kept, "tensors", "segments").mapInArrow(described, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
