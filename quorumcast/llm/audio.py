"""Audio columns: lossless samples, log-mel features and energy segments.

Samples are stored as 8-bit mono WAV in a binary column.  Features are computed from
what is read back: polyphase resampling to half the rate, overlapped log-mel filterbank
frames, and segments of sound by an energy threshold with hysteresis.  They are
stored, one value per row, as an Arrow stream of fixed-shape tensors (frames x mel
bands) with the time span of each tensor.

A long recording is worked through in blocks of frames; what is held for all of it are its
samples, the stream of its tensors (half a byte for each sample) and one energy per frame.  Equal samples give equal features: nothing depends on the
other rows of a batch.

Defined cases: NULL counts as empty; an empty payload is padded to one unit, so there is
always at least one frame; repeated rows give equal rows; an empty table gives an empty
result.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
PAD = 255
RATE = 16_000
UP, DOWN = 1, 2
TAPS = 24  # per phase
FRAME, HOP, MELS = 256, 128, 32
TENSOR_FRAMES = 64
BLOCK_FRAMES = 4096
#: Hysteresis thresholds between the quietest and the loudest frame, and the shortest segment kept.
ON, OFF, SHORTEST = 0.6, 0.4, 3
_FLOOR = 1e-6
_OUT = 16 << 20

MEDIA_SCHEMA = "id bigint, n_bytes bigint, media binary"
TENSOR_SCHEMA = ("id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
                 "media_sha256 string, rate int, tensors binary")
FEATURE_SCHEMA = ("id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
                  "media_sha256 string, feature string, tensors binary")


def encode(payload: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono WAV file of the samples."""
    size = len(payload)
    head = b"RIFF" + struct.pack("<I", 36 + size + size % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return head + b"data" + struct.pack("<I", size) + payload + b"\0" * (size % 2)


def decode(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media)) as f:
        if f.getnchannels() != 1 or f.getsampwidth() != 1:
            raise ValueError("8-bit mono is expected")
        return f.readframes(f.getnframes()), f.getframerate()


def padded(raw: bytes) -> bytes:
    """Bytes of value 255 are appended up to a positive multiple of the unit."""
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def low_pass(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Windowed-sinc filter, one row per phase, unit gain in each."""
    n = taps * max(up, down)
    n += -n % up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    h = h.reshape(-1, up).T  # row p: taps p, p + up, …
    return h / h.sum(axis=1, keepdims=True)


def resample(x: np.ndarray, first: int, last: int, bank: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Output samples ``first`` to ``last`` - 1 of the polyphase filter; zeros lie outside ``x``."""
    m = np.arange(first, last)
    at, phase = (m * down) // up, (m * down) % up
    taps = bank.shape[1]
    lo = int(at[0]) - taps // 2
    hi = int(at[-1]) + taps - taps // 2
    piece = np.zeros(hi - lo)
    a, z = max(lo, 0), min(hi, len(x))
    if a < z:
        piece[a - lo:z - lo] = x[a:z]
    windows = np.lib.stride_tricks.sliding_window_view(piece, taps)
    out = np.empty(len(m))
    for p in range(up):
        mine = phase == p
        out[mine] = windows[at[mine] - int(at[0])] @ bank[p, ::-1]
    return out


def mel_bank(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, as a matrix bins x bands."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    rise = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


_BANK = low_pass()
_WINDOW = np.hanning(FRAME)


def log_mel(samples: np.ndarray, rate: int) -> Iterator[np.ndarray]:
    """Frames x bands, block by block, of 8-bit samples resampled to half the rate."""
    bank = mel_bank(rate * UP / DOWN)
    x = (samples.astype(np.float32) - 128) / 128
    n_out = -(-len(x) * UP // DOWN)
    frames = max(1, 1 + -(-(n_out - FRAME) // HOP))
    for at in range(0, frames, BLOCK_FRAMES):
        upto = min(frames, at + BLOCK_FRAMES)
        y = resample(x, at * HOP, (upto - 1) * HOP + FRAME, _BANK)
        cut = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(cut * _WINDOW, axis=1)) ** 2 / FRAME
        yield np.log(power @ bank + _FLOOR)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames from where the energy reaches the upper threshold until it falls
    below the lower one; shorter ones than ``SHORTEST`` are dropped."""
    lo, hi = float(energy.min()), float(energy.max())
    if hi - lo < 1e-9:
        return []
    level = np.round((energy - lo) / (hi - lo), 6)
    event = np.where(level >= ON, 1, np.where(level < OFF, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    active = np.where(last >= 0, event[last], -1) > 0
    edge = np.diff(np.concatenate([[0], active.astype(np.int8), [0]]))
    return [(a, z) for a, z in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist()) if z - a >= SHORTEST]


def tensor_batch(frames: np.ndarray, first: int, rate: float) -> pa.RecordBatch:
    """Fixed-shape tensors of frames from number ``first`` on; the last is filled up with the floor."""
    n = -(-len(frames) // TENSOR_FRAMES)
    whole = np.full((n * TENSOR_FRAMES, MELS), np.log(_FLOOR), np.float32)
    whole[:len(frames)] = frames
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(whole.reshape(n, TENSOR_FRAMES, MELS))
    start = np.arange(n) * TENSOR_FRAMES
    valid = np.minimum(TENSOR_FRAMES, len(frames) - start)
    return pa.RecordBatch.from_arrays(
        [tensors, pa.array((first + start) * HOP / rate), pa.array(((first + start + valid - 1) * HOP + FRAME) / rate), pa.array(valid, pa.int32())],
        names=["log_mel", "start_s", "end_s", "n_frames"])


def tensor_stream(samples: bytes, rate: int) -> bytes:
    """Arrow stream of a recording's tensors, a record batch for each block of frames."""
    sink, writer, first = io.BytesIO(), None, 0
    for block in log_mel(np.frombuffer(samples, np.uint8), rate):
        batch = tensor_batch(block.astype(np.float32), first, rate * UP / DOWN)
        writer = writer or pa.ipc.new_stream(sink, batch.schema)
        writer.write_batch(batch)
        first += len(block)
    writer.close()
    return sink.getvalue()


def summary(stream: bytes, rate: float) -> str:
    """Frames, segments, seconds of sound, the mean of each band in hundredths, and a digest
    of the tensors (in hundredths) and their time spans, read from a stored stream."""
    total, energies, n, digest = np.zeros(MELS), [], 0, hashlib.sha256()
    for batch in pa.ipc.open_stream(stream):
        cells = batch.column("log_mel").to_numpy_ndarray()
        frames = cells.reshape(-1, MELS)[:int(batch.column("n_frames").to_numpy().sum())].astype(np.float64)
        total += frames.sum(axis=0)
        energies.append(frames.mean(axis=1))
        n += len(frames)
        times = np.stack([batch.column(c).to_numpy() for c in ("start_s", "end_s")])
        digest.update(np.rint(times * 1e6).astype(np.int64).tobytes() + np.rint(cells * 100).astype(np.int32).tobytes())
    spans = segments(np.concatenate(energies))
    sound = sum(z - a for a, z in spans) * HOP / rate
    means = ",".join(str(v) for v in np.rint(total / n * 100).astype(np.int64).tolist())
    return f"frames={n};segments={len(spans)};sound_s={sound:.3f};mel={means};tensors={digest.hexdigest()}"


def media_column(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, unpadded size and the WAV file of each text's bytes."""

    def kernel(batches):
        for batch in batches:
            raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(r) for r in raw], pa.int64()),
                                              pa.array([encode(padded(r)) for r in raw], pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(kernel, MEDIA_SCHEMA)


def tensors(media: DataFrame) -> DataFrame:
    """Checksums of the stored form and of the samples read back, and their tensors."""

    def kernel(batches):
        for batch in batches:
            rows, held = [], 0
            for i, n_bytes, stored in zip(*(batch.column(c) for c in ("id", "n_bytes", "media"))):
                stored = stored.as_py()
                payload, rate = decode(stored)
                rows.append((i.as_py(), n_bytes.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored),
                             hashlib.sha256(stored).hexdigest(), rate, tensor_stream(payload, rate)))
                held += len(rows[-1][-1])
                if held > _OUT:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in TENSOR_SCHEMA.split(", ")])

    return media.mapInArrow(kernel, TENSOR_SCHEMA)


def features(stored: DataFrame, keep_tensors: bool = True) -> DataFrame:
    """Features of what ``tensors`` has made; of a media column, its tensors are made first."""
    if "media" in stored.columns:
        stored = tensors(stored)

    def kernel(batches):
        for batch in batches:
            found = [summary(t.as_py(), r.as_py() * UP / DOWN) for t, r in zip(batch.column("tensors"), batch.column("rate"))]
            keep = [batch.column(c) for c in head] + [pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(keep + [batch.column("tensors")] * keep_tensors, names=head + ["feature"] + ["tensors"] * keep_tensors)

    schema = FEATURE_SCHEMA if keep_tensors else FEATURE_SCHEMA.removesuffix(", tensors binary")
    head = [c.split()[0] for c in FEATURE_SCHEMA.split(", ")][:-2]
    return stored.mapInArrow(kernel, schema)
