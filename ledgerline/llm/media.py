"""Audio columns: log-mel features of 8-bit samples, as fixed-shape tensors with time spans.

Texts become payloads (UTF-8 padded by spaces to a positive multiple of 192 bytes; null counts as empty),
payloads become 8-bit mono WAV files, and the features come from the files' bytes as read back: a polyphase
resampling filter, overlapped frames, a mel filterbank, log, and segments where the energy rises over one
threshold until it falls below a lower one. The log-mel windows are stored as Arrow tensors of fixed shape with
their time spans, and the query's digest is of the tensors as read back. Samples are worked on in windows of fixed length, so one very
long file needs no more memory than its bytes. Features depend on the samples alone, so equal texts get
equal values. Repeated rows stay; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192
RATE, UP, DOWN, TAPS = 8000, 3, 4, 12
FRAME, HOP, FFT, MELS, WINDOW = 240, 120, 256, 32, 64  # samples after resampling; WINDOW frames a tensor
RISE_DB, FALL_DB = 2.0, -1.0  # against the file's mean frame energy

SUMMARY = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_ms long, n_windows long, segments array<struct<start_ms:long,end_ms:long>>"
TENSORS = "doc_id long, window long, start_ms long, end_ms long, tensor binary"


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def store(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_back(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


@functools.lru_cache(1)
def resampling_filter() -> np.ndarray:
    """[inputs, UP]: the phases of a windowed-sinc filter; UP outputs from each step of DOWN inputs."""
    half = TAPS * max(UP, DOWN) // 2
    t = np.arange(-half, half + 1)
    h = np.sinc(t / max(UP, DOWN)) * np.hanning(len(t) + 2)[1:-1]
    h *= UP / h.sum()
    reach = half // UP + 1  # inputs before and after
    bank = np.zeros((2 * reach + DOWN, UP), np.float32)
    for k in range(UP):
        for i in range(len(bank)):
            at = k * DOWN - (i - reach) * UP + half
            if 0 <= at < len(h):
                bank[i, k] = h[at]
    return bank


def resample(samples: np.ndarray) -> np.ndarray:
    bank = resampling_filter()
    steps = -(-len(samples) // DOWN)
    reach = (len(bank) - DOWN) // 2
    x = np.zeros(steps * DOWN + 2 * reach, np.float32)
    x[reach : reach + len(samples)] = samples
    views = np.lib.stride_tricks.sliding_window_view(x, len(bank))[::DOWN][:steps]
    return (views @ bank).reshape(-1)


@functools.lru_cache(1)
def mel_bank() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    rate = RATE * UP / DOWN
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    freq = np.arange(FFT // 2 + 1) * rate / FFT
    up = (freq[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - freq[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel frames [n, MELS], energy in dB of each frame), WINDOW frames at a time."""
    u8 = np.frombuffer(payload, np.uint8)
    total = -(-len(u8) // DOWN) * UP
    n = max(1, -(-max(0, total - FRAME) // HOP) + 1)
    taper = np.hanning(FRAME).astype(np.float32)
    steps = WINDOW * HOP * 8  # resampled samples a block
    reach = (len(resampling_filter()) - DOWN) // 2 // DOWN * DOWN + DOWN
    mels, energy = [], []
    for lo in range(0, n * HOP, steps):
        hi = min(lo + steps, n * HOP) + FRAME - HOP
        a, b = lo // UP * DOWN - reach, -(-hi // UP) * DOWN + reach
        x = (u8[max(a, 0) : b].astype(np.float32) - 128) / 128
        y = resample(x)[(lo // UP * DOWN - max(a, 0)) // DOWN * UP :][: hi - lo]
        y = np.pad(y, (0, hi - lo - len(y)))
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * taper
        power = np.abs(np.fft.rfft(frames, FFT)).astype(np.float32) ** 2
        mels.append(np.log(power @ mel_bank() + 1e-6))
        energy.append(10 * np.log10((frames**2).mean(1) + 1e-9))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) in ms of runs that begin over the upper threshold and last until one falls below the lower."""
    level = energy - energy.mean()
    event = np.where(level >= RISE_DB, 1, np.where(level < FALL_DB, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = (last >= 0) & (event[np.maximum(last, 0)] == 1)
    edge = np.flatnonzero(np.diff(np.r_[False, on, False].astype(np.int8)))
    ms = 1000 * HOP * DOWN // (UP * RATE)
    return [(int(a) * ms, int(b) * ms) for a, b in edge.reshape(-1, 2)]


def windows(mels: np.ndarray) -> np.ndarray:
    """[n, WINDOW, MELS] float16; the last one is padded by the floor's value."""
    n = -(-len(mels) // WINDOW)
    out = np.full((n * WINDOW, MELS), np.log(np.float32(1e-6)), np.float16)
    out[: len(mels)] = mels.round(2)
    return out.reshape(n, WINDOW, MELS)


def tensor_bytes(tensor: np.ndarray, start_ms: int, end_ms: int) -> bytes:
    """One Arrow record batch with a fixed-shape tensor and its time span, as an IPC stream."""
    return store_tensors(tensor[None], np.array([start_ms]), np.array([end_ms]))


def store_tensors(tensors: np.ndarray, start_ms: np.ndarray, end_ms: np.ndarray) -> bytes:
    """An Arrow record batch with a row a window: a fixed-shape tensor and its time span, as an IPC stream."""
    kind = pa.fixed_shape_tensor(pa.float16(), list(tensors.shape[1:]))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1)), tensors[0].size)
    batch = pa.record_batch({"tensor": pa.ExtensionArray.from_storage(kind, flat), "start_ms": pa.array(start_ms), "end_ms": pa.array(end_ms)})
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def read_tensors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tensors, start_ms, end_ms) of what store_tensors() wrote."""
    batch = pa.ipc.open_stream(data).read_next_batch()
    return batch.column("tensor").to_numpy_ndarray(), batch.column("start_ms").to_numpy(), batch.column("end_ms").to_numpy()


def spans_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end in ms of n windows."""
    ms = 1000 * HOP * DOWN // (UP * RATE) * WINDOW
    return np.arange(n) * ms, np.arange(1, n + 1) * ms


def feature_digest(tensors: np.ndarray, frames: int) -> str:
    """Of tensors as read back, whose first `frames` frames are no padding."""
    mean = tensors.reshape(-1, MELS)[:frames, :8].mean(0, dtype=np.float64)
    return f"logmel{MELS}x{WINDOW}:{len(tensors)}:{hashlib.sha256(tensors.tobytes()).hexdigest()[:16]}:" + ",".join(f"{x:.1f}" for x in mean)


def _map(docs: DataFrame, schema: str, rows) -> DataFrame:
    names = [x.split()[0] for x in schema.replace("struct<start_ms:long,end_ms:long>", "").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        for batch in batches:
            out, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in rows(doc, text.as_py()):
                    out.append(row)
                    size += sum(len(x) for x in row if isinstance(x, bytes))
                if size > 1 << 24 or len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=arrow)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=arrow)

    span = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds.get(k.split(" ")[1], span)) for n, k in zip(names, schema.split(", "), strict=True)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def audio_summary(docs: DataFrame) -> DataFrame:
    """SUMMARY: one row a document, from its stored bytes read back."""

    def rows(doc, text):
        payload, n = payload_of(text)
        media = store(payload)
        back = read_back(media)
        mels, energy = log_mel(back)
        tensors = windows(mels)
        tensors = read_tensors(store_tensors(tensors, *spans_of(len(tensors))))[0]
        spans = [{"start_ms": a, "end_ms": b} for a, b in segments(energy)]
        yield doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_digest(tensors, len(mels)), len(back) * 1000 // RATE, len(tensors), spans

    return _map(docs, SUMMARY, rows)


def audio_tensors(docs: DataFrame) -> DataFrame:
    """TENSORS: one row a window of WINDOW frames; tensor is an Arrow IPC stream with a fixed-shape tensor column."""

    def rows(doc, text):
        tensors = windows(log_mel(read_back(store(payload_of(text)[0])))[0])
        for k, (x, a, b) in enumerate(zip(tensors, *(x.tolist() for x in spans_of(len(tensors))), strict=True)):
            yield doc, k, a, b, tensor_bytes(x, a, b)

    return _map(docs, TENSORS, rows)
