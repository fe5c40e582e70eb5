"""Audio columns: samples stored losslessly, and features computed from what is read back.

Media are RIFF/WAVE files of unsigned 8-bit mono PCM. Features come from the
samples after polyphase resampling: log energies in mel bands of overlapped
frames, and segments of sound found by two thresholds on the frames' energy (a
segment begins above the upper and lasts until the energy is below the lower).
Features are cut into tensors of one shape, each with its span of time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm.common import text_rows

#: Samples a second in the stored media and for the features.
RATE = 16000
TARGET_RATE = 8000
#: Taps of the filter for each output phase.
TAPS = 16
#: A frame and the step to the next, in resampled samples (32 and 16 ms).
FRAME = 256
HOP = 128
BANDS = 16
FLOOR = 1e-6
#: Thresholds over the quietest tenth of frames, in units of the range from there to the loudest tenth.
UPPER, LOWER = 0.6, 0.35
#: Frames in a tensor; the last is filled with the floor.
TENSOR_FRAMES = 64
#: Payloads are filled with spaces to a multiple of this.
MULTIPLE = 192


def payload(text: bytes) -> bytes:
    """text with spaces appended up to a positive multiple of MULTIPLE bytes."""
    size = max(1, -(-len(text) // MULTIPLE)) * MULTIPLE
    return text.ljust(size, b" ")


def encode_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A WAVE file of unsigned 8-bit mono PCM."""
    filled = samples + b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(filled), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + filled


def decode_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of encode_wav()'s form; other chunks than these two are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, None
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif kind == b"data":
            if rate is None or at + 8 + size > len(media):
                raise ValueError("a WAVE file without format or with missing samples")
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("a WAVE file without samples")


@lru_cache(maxsize=8)
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """The low-pass filter's coefficients by output phase (up, taps): a Hamming-windowed sinc, each phase summing to one."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    phases = h.reshape(taps, up).T[:, ::-1]
    return (phases / phases.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, rate: int, target: int, taps: int = TAPS) -> np.ndarray:
    """x at another rate by a polyphase filter: only outputs that are kept are computed."""
    g = gcd(rate, target)
    up, down = target // g, rate // g
    if up == down:
        return x
    filters = _phases(up, down, taps)
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.full(taps, x[0] if len(x) else 0, np.float32), x, np.full(taps, x[-1] if len(x) else 0, np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for p in range(up):  # outputs k = p, p + up, ...: phase and inputs repeat
        k = np.arange(p, n, up)
        if len(k):
            first = k[0] * down // up + taps // 2 + 1
            out[p::up] = view[first : first + (len(k) - 1) * down + 1 : down] @ filters[k[0] * down % up]
    return out


@lru_cache(maxsize=8)
def _mel(rate: int, frame: int, bands: int) -> np.ndarray:
    """Triangular filters (bins, bands), evenly spaced on the mel scale."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    lo, mid, hi = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid))).astype(np.float32)


_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def log_mel(x: np.ndarray, rate: int = TARGET_RATE) -> np.ndarray:
    """(frames, BANDS) log energies of overlapped frames; a last short frame is filled with silence."""
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    padded = np.zeros((frames - 1) * HOP + FRAME, np.float32)
    padded[: len(x)] = x
    view = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    out = np.empty((frames, BANDS), np.float32)
    for i in range(0, frames, 4096):
        spectrum = np.fft.rfft(view[i : i + 4096] * _WINDOW, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) / FRAME
        out[i : i + 4096] = np.log(power @ _mel(rate, FRAME, BANDS) + FLOOR)
    return out


def segments(mel: np.ndarray, upper: float = UPPER, lower: float = LOWER) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of the segments of sound, by hysteresis."""
    energy = mel.mean(axis=1)
    quiet, loud = np.quantile(energy, [0.1, 0.9])
    on, off = energy >= quiet + upper * (loud - quiet), energy < quiet + lower * (loud - quiet)
    if loud - quiet <= 1e-6:
        return []
    # A frame's state is that of the last frame that crossed either threshold.
    mark = np.where(on, 1, np.where(off, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    state = np.where(last >= 0, mark[last], 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], state, [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


@dataclass
class Features:
    mel: np.ndarray
    segments: list[tuple[int, int]]

    def spans(self) -> list[tuple[float, float]]:
        """(start, end) of the segments in seconds."""
        return [(a * HOP / TARGET_RATE, ((b - 1) * HOP + FRAME) / TARGET_RATE) for a, b in self.segments]

    def digest(self) -> str:
        """Frames, segments, share of sound and mean log energy by band, rounded."""
        sound = sum(b - a for a, b in self.segments) / len(self.mel)
        bands = ",".join(f"{v:.2f}" for v in self.mel.astype(np.float64).mean(axis=0).tolist())
        return f"frames={len(self.mel)};segments={len(self.segments)};sound={sound:.4f};mel={bands}"

    def tensors(self) -> bytes:
        """An Arrow stream of (tensor, start, end): fixed-shape tensors of (TENSOR_FRAMES, BANDS) and their seconds."""
        n = -(-len(self.mel) // TENSOR_FRAMES)
        filled = np.full((n * TENSOR_FRAMES, BANDS), np.log(np.float32(FLOOR)), np.float32)
        filled[: len(self.mel)] = self.mel
        array = pa.FixedShapeTensorArray.from_numpy_ndarray(filled.reshape(n, TENSOR_FRAMES, BANDS))
        start = np.arange(n) * TENSOR_FRAMES * HOP / TARGET_RATE
        last = np.minimum((np.arange(n) + 1) * TENSOR_FRAMES, len(self.mel)) - 1
        made = pa.RecordBatch.from_arrays([array, pa.array(start), pa.array((last * HOP + FRAME) / TARGET_RATE)], names=["tensor", "start", "end"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, made.schema) as w:
            w.write_batch(made)
        return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    """What Features.tensors() wrote."""
    return pa.ipc.open_stream(stream).read_all()


def features(media: bytes) -> tuple[bytes, Features]:
    """(samples, features) of a stored file."""
    samples, rate = decode_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x, rate, TARGET_RATE))
    return samples, Features(mel, segments(mel))


#: Rows that one batch from Python holds at most.
_ROWS = 128


def stored(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each row's text as a WAVE file, and its length in bytes without padding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, _ROWS):
                part = b.slice(i, _ROWS)
                texts = [t or b"" for t in part.column(1).to_pylist()]
                media = [encode_wav(payload(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    src = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("_text"))
    return text_rows(src).mapInArrow(run, src.select("doc_id").schema.add("n_bytes", "long").add("media", "binary"))


def read_back(media: DataFrame) -> DataFrame:
    """stored() with what its media hold: see audio_columns()."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "tensors", "spans"]
    span = pa.struct([("start", pa.float64()), ("end", pa.float64())])
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.list_(span)]

    def one(file: bytes) -> tuple:
        samples, f = features(file)
        spans = [{"start": a, "end": b} for a, b in f.spans()]
        return (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(file), hashlib.sha256(file).hexdigest(), f.digest(), file, f.tensors(), spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, _ROWS):
                part = b.slice(i, _ROWS)
                rows = [one(m) for m in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names=names)

    spans = T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())]))
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.BinaryType(), T.BinaryType(), spans]
    fields = [T.StructField(n, k) for n, k in zip(names[2:], kinds, strict=True)]
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, T.StructType([*media.select("doc_id", "n_bytes").schema.fields, *fields]))


def audio_columns(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the audio form of each row's text.

    The text is stored as a column of WAVE files, and all else is read back
    from that column: n_bytes (the text's), payload_bytes, payload_sha256 and
    tail_crc32 (of the last 16 bytes) from its samples, media_bytes and
    media_sha256 from the stored form, feature, a digest of the features, the
    media themselves, tensors (an Arrow stream of fixed-shape tensors with
    their time spans) and spans (segments of sound, in seconds).

    Null texts are empty; an empty text is MULTIPLE spaces. Equal texts give
    equal values, whatever rows are beside them. Other columns are left out.
    """
    return read_back(stored(docs, text, doc_id))
