"""Operator 3: media columns holding audio, and their features.

Samples are stored as WAV (8-bit PCM). Features come from the stored bytes: a polyphase
resampler (windowed-sinc low pass, only the taps that meet a sample are computed),
overlapped frames, log-mel filterbanks pooled into fixed-shape tensors with time spans,
and active segments by an energy threshold with hysteresis (a higher one to open, a lower
one to close). Long recordings are handled in blocks with the overlap the filter and the
frames need, so memory is bounded and block borders do not show.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import mapped

#: Bytes that a payload is padded to a multiple of.
UNIT = 192


@dataclass(frozen=True)
class AudioSpec:
    """Rates in Hz, frame and hop in samples of the working rate, tensor shape (frames, mels), thresholds in dB below full scale."""

    rate: int = 16_000
    work_rate: int = 8_000
    taps: int = 16
    frame: int = 200
    hop: int = 80
    fft: int = 256
    mels: int = 24
    tensor_frames: int = 96
    open_db: float = -14.0
    close_db: float = -20.0
    block: int = 1 << 18


def to_wav(payload: bytes, rate: int) -> bytes:
    """Mono 8-bit PCM WAV around the payload (of even length)."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(stored: bytes) -> tuple[int, bytes]:
    """(rate, samples) of a mono 8-bit PCM WAV; other chunks are skipped."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(stored):
        name, size = struct.unpack_from("<4sI", stored, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif name == b"data":
            return rate, stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@cache
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """Filter taps by phase, oldest input sample first: row p has taps p, p + up, ..."""
    cutoff = 1.0 / max(up, down)
    half = taps * max(up, down)
    n = np.arange(-half, half + up)
    h = up * cutoff * np.sinc(n * cutoff) * (0.5 + 0.5 * np.cos(np.pi * np.clip(n / half, -1, 1)))
    return h[: len(h) // up * up].reshape(-1, up).T[:, ::-1].astype(np.float32)


def resampled(samples: np.ndarray, lo: int, hi: int, up: int, down: int, taps: int) -> np.ndarray:
    """Outputs lo .. hi - 1 of the resampled signal (zeros around it)."""
    bank = _phases(up, down, taps)
    reach, half = bank.shape[1], taps * max(up, down)
    out = np.empty(hi - lo, np.float32)
    for first in range(lo, min(lo + up, hi)):  # outputs first, first + up, ... are one phase
        newest, phase = divmod(first * down + half, up)
        begin, step, count = newest - reach + 1, down, len(range(first, hi, up))
        end = begin + (count - 1) * step + reach
        part = np.zeros(end - begin, np.float32)
        a, b = max(0, begin), min(len(samples), end)
        if b > a:
            part[a - begin : b - begin] = (samples[a:b].astype(np.float32) - 128) / 128
        rows = np.lib.stride_tricks.sliding_window_view(part, reach)[::step]
        out[first - lo :: up] = rows @ bank[phase]
    return out


@cache
def _mel_bank(spec: AudioSpec) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(spec.work_rate / 2), spec.mels + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(spec.fft, 1 / spec.work_rate)
    rise = (freq[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - freq[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def length_of(samples: np.ndarray, rate: int, spec: AudioSpec) -> tuple[int, int]:
    """(samples at the working rate, frames): every sample stands in a frame, the last one reaches into silence."""
    total = -(-len(samples) * spec.work_rate // rate)
    return total, max(1, 1 - (spec.frame - total) // spec.hop)


def frames(samples: np.ndarray, rate: int, spec: AudioSpec) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(log-mel rows, frame energy in dB) block by block; at least one frame."""
    common = gcd(rate, spec.work_rate)
    up, down = spec.work_rate // common, rate // common
    count = length_of(samples, rate, spec)[1]
    window = np.hanning(spec.frame).astype(np.float32)
    per_block = max(1, spec.block // spec.hop)
    for first in range(0, count, per_block):
        last = min(count, first + per_block)
        signal = resampled(samples, first * spec.hop, (last - 1) * spec.hop + spec.frame, up, down, spec.taps)
        cut = np.lib.stride_tricks.sliding_window_view(signal, spec.frame)[:: spec.hop]
        power = np.abs(np.fft.rfft(cut * window, spec.fft, axis=1).astype(np.complex64)) ** 2
        yield np.log(power @ _mel_bank(spec) + np.float32(1e-6)), 10 * np.log10((cut**2).mean(1) + 1e-10)


def active_segments(energy: np.ndarray, spec: AudioSpec) -> np.ndarray:
    """Rows (first frame, last frame + 1): opened by a frame at open_db or more, as far as frames stay at close_db or more."""
    alive = np.concatenate([[False], energy >= spec.close_db, [False]])
    edge = np.flatnonzero(alive[1:] != alive[:-1])
    runs = edge.reshape(-1, 2)
    strong = np.concatenate([[0], np.cumsum(energy >= spec.open_db)])
    return runs[strong[runs[:, 1]] > strong[runs[:, 0]]]


def tensor_blocks(samples: np.ndarray, rate: int, spec: AudioSpec, energies: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tensors [n, tensor_frames, mels], spans [n, 2] in seconds) block by block; every block's frame energy is put into ``energies``."""
    total, count = length_of(samples, rate, spec)
    size, seconds = spec.tensor_frames, spec.tensor_frames * spec.hop / spec.work_rate
    held, seen, made = np.zeros((0, spec.mels), np.float32), 0, 0
    for mel, energy in frames(samples, rate, spec):
        energies.append(energy)
        seen += len(mel)
        held = np.concatenate([held, mel])
        if seen == count:
            held = np.concatenate([held, np.full((-len(held) % size, spec.mels), np.log(np.float32(1e-6)), np.float32)])
        n = len(held) // size
        if not n:
            continue
        at = np.arange(made, made + n)
        ends = (at + 1) * seconds
        if seen == count:
            ends[-1] = total / spec.work_rate
        yield held[: n * size].reshape(n, size, spec.mels), np.stack([at * seconds, ends], 1)
        held, made = held[n * size :], made + n


def segment_times(found: np.ndarray, samples: np.ndarray, rate: int, spec: AudioSpec) -> np.ndarray:
    """Segments of ``active_segments`` in seconds; one that lasts to the last frame ends with the recording."""
    total, count = length_of(samples, rate, spec)
    return np.where(found == count, total, found * spec.hop) / spec.work_rate


def features(samples: np.ndarray, rate: int, spec: AudioSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tensors [n, tensor_frames, mels], spans [n, 2] in seconds, segments [m, 2] in seconds); the last tensor is padded with silence.

    The last frame's span and segment end with the recording.
    """
    energies: list[np.ndarray] = []
    tensors, spans = (np.concatenate(x) for x in zip(*tensor_blocks(samples, rate, spec, energies), strict=True))
    return tensors, spans, segment_times(active_segments(np.concatenate(energies), spec), samples, rate, spec)


def tensor_array(tensors: np.ndarray) -> pa.FixedShapeTensorArray:
    """The features as an Arrow array of fixed-shape tensors."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors))


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def _encode(spec: AudioSpec):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            lo, held, out, sizes = 0, 0, [], []
            for i in range(len(texts)):
                text = (texts[i].as_py() or "").encode()
                out.append(to_wav(payload_of(text), spec.rate))
                sizes.append(len(text))
                held += len(text)
                if held >= 1 << 22 or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, i + 1 - lo), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], schema=schema)
                    lo, held, out, sizes = i + 1, 0, [], []

    return run


def with_audio(docs: DataFrame, spec: AudioSpec | None = None) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with spaces to a positive multiple of 192, as the samples of a WAV.

    Null is empty; repeated rows repeat; an empty table gives none; extra columns, ``media`` and ``n_bytes`` among them, are ignored.
    """
    spec = spec or AudioSpec()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(docs, _encode(spec), "doc_id long, n_bytes long, media binary")


TENSOR_FIELDS = "doc_id long, part int, start_s double, end_s double, log_mel array<float>"


def audio_tensors(media: DataFrame, spec: AudioSpec | None = None) -> DataFrame:
    """One row per tensor of each recording (doc_id, media): part, its time span and the flat [tensor_frames * mels] values.

    A null recording gives no row, repeated rows repeat, extra columns are ignored; the values become tensors again by ``tensor_array``. The
    column's metadata say, as Arrow's canonical extension type does, that they are
    fixed-shape tensors, and of which shape.
    """
    spec = spec or AudioSpec()

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", pa.list_(pa.float32()))])
        for batch in batches:
            for i in range(batch.num_rows):
                stored = batch.column("media")[i].as_py()
                if stored is None:
                    continue
                rate, samples = from_wav(stored)
                part = 0
                for tensors, spans in tensor_blocks(np.frombuffer(samples, np.uint8), rate, spec, []):
                    n = len(tensors)
                    flat = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (spec.tensor_frames * spec.mels), pa.array(tensors.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.full(n, i))), pa.array(np.arange(part, part + n), pa.int32()), pa.array(spans[:, 0]), pa.array(spans[:, 1]), flat], schema=schema)
                    part += n

    kind = {"ARROW:extension:name": "arrow.fixed_shape_tensor", "ARROW:extension:metadata": json.dumps({"shape": [spec.tensor_frames, spec.mels]})}
    return mapped(media.select("doc_id", "media"), run, TENSOR_FIELDS).withMetadata("log_mel", kind)


def feature_text(samples: np.ndarray, rate: int, spec: AudioSpec) -> str:
    """Short form of the tensors, spans and segments, which are made block by block.

    Counts, active frames, the mean and deviation of every mel band over the frames, and the
    SHA-256 of all three: tensors in half log units, times in microseconds.
    """
    frame_count = length_of(samples, rate, spec)[1]
    seen, total, square, energies, times, digest = 0, np.zeros(spec.mels), np.zeros(spec.mels), [], [], hashlib.sha256()
    for tensors, spans in tensor_blocks(samples, rate, spec, energies):
        times.append(spans)
        digest.update(np.rint(tensors * 2).astype("<i2").tobytes())
        mel = tensors.reshape(-1, spec.mels)[: frame_count - seen]
        seen += len(mel)
        total += mel.sum(0, dtype=np.float64)
        square += np.square(mel, dtype=np.float64).sum(0)
    mean = total / frame_count
    deviation = np.sqrt(np.maximum(0, square / frame_count - mean**2))
    segments = active_segments(np.concatenate(energies), spec)
    times.append(segment_times(segments, samples, rate, spec))
    digest.update(np.rint(np.concatenate(times) * 1e6).astype("<i8").tobytes())
    levels = ".".join(f"{m:d}:{d:d}" for m, d in zip(np.rint(mean * 2).astype(int), np.rint(deviation * 2).astype(int), strict=True))
    return f"frames={frame_count};tensors={sum(map(len, times[:-1]))};segments={len(segments)};active={int((segments[:, 1] - segments[:, 0]).sum())};mel={levels};sha256={digest.hexdigest()}"


def _digest(spec: AudioSpec):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                stored = batch.column("media")[i].as_py()
                rate, payload = from_wav(stored)
                samples = np.frombuffer(payload, np.uint8)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_text(samples, rate, spec)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, types[2:], strict=True))], schema=schema)

    return run


def audio_digests(media: DataFrame, spec: AudioSpec | None = None) -> DataFrame:
    """Per recording of ``with_audio``: what is read back from the stored bytes, and the features' short form.

    Equal texts give equal values, since each recording is computed by itself; repeated rows repeat, an
    empty table gives none; extra columns are ignored.
    """
    spec = spec or AudioSpec()
    return mapped(media.select("doc_id", "n_bytes", "media"), _digest(spec), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
