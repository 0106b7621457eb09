"""Audio features of byte payloads stored as 8-bit PCM WAV files.

Samples are read back from the stored bytes, resampled by a polyphase filter,
cut into overlapping frames for log-mel energies, and segmented by energy with
hysteresis (a segment opens above one level and ends below a lower one).
Features are stored as fixed-shape Arrow tensors: an Arrow stream a document,
with a row for each window of WINDOW frames that holds its time span and a
WINDOW x BANDS tensor, as many windows as the media needs.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

#: 16 kHz to 10 kHz: the filter has UP phases.
RATE, UP, DOWN = 16_000, 5, 8
TAPS = 32
#: Frames of 25 ms every 12.5 ms; a tensor holds 0.2 s.
FRAME, HOP, FFT, BANDS, WINDOW = 250, 125, 256, 16, 16
#: What log-mel energies are at least; frames after the last one hold it.
FLOOR = 1e-6
#: Hysteresis levels, as parts of the way from the quiet (10 %) to the loud (90 %) energy.
OPEN, CLOSE = 0.6, 0.4
#: Samples filtered at once.
PIECE = 1 << 20


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM WAV file whose samples are the payload."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def wav_samples(data: bytes) -> bytes:
    """The samples of such a file, found by walking its chunks."""
    f = io.BytesIO(data)
    if f.read(4) != b"RIFF" or (f.seek(8), f.read(4))[1] != b"WAVE":
        raise ValueError("not a WAV file")
    while head := f.read(8):
        name, size = struct.unpack("<4sI", head)
        if name == b"data":
            return f.read(size)
        f.seek(size + (size & 1), 1)
    raise ValueError("no samples")


def _filter() -> np.ndarray:
    """Windowed-sinc low-pass for the resampling, of TAPS taps a phase."""
    n = np.arange(TAPS * UP) - (TAPS * UP - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = cut * np.sinc(cut * n) * np.hamming(TAPS * UP)
    return h / h.sum() * UP


_H = _filter()


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase: output k is the phase (k DOWN mod UP) of the filter on the inputs before k DOWN / UP."""
    n = -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS - 1), x, np.zeros(DOWN)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n)
    for first in range(UP):  # outputs first, first + UP, ... share a phase
        phase, at = first * DOWN % UP, first * DOWN // UP
        out[first::UP] = rows[at::DOWN][: len(out[first::UP])] @ _H[phase::UP][::-1]
    return out


def _mel() -> np.ndarray:
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), BANDS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / rate)
    up, down = (f - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)).T


_MEL, _WINDOW = _mel(), np.hanning(FRAME)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies and log energy of overlapping frames; the last frame is filled up with silence."""
    n = max(1, -(-max(0, len(y) - FRAME) // HOP) + 1)
    y = np.concatenate([y, np.zeros(max(0, (n - 1) * HOP + FRAME - len(y)))])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:n]
    mels, energy = np.empty((n, BANDS)), np.empty(n)
    for i in range(0, n, 2048):
        part = frames[i : i + 2048] * _WINDOW
        power = np.abs(np.fft.rfft(part, FFT)) ** 2
        mels[i : i + 2048] = np.log(power @ _MEL + FLOOR)
        energy[i : i + 2048] = np.log((part * part).mean(axis=1) + 1e-9)
    return mels, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frames [s, e) of the segments that hysteresis finds."""
    quiet, loud = np.quantile(energy, 0.1), np.quantile(energy, 0.9)
    if loud - quiet < 1e-9:
        return []
    up, low = quiet + OPEN * (loud - quiet), quiet + CLOSE * (loud - quiet)
    mark = np.where(energy >= up, 1, np.where(energy < low, -1, 0))
    known = np.flatnonzero(mark)
    state = np.zeros(len(energy), bool)
    if len(known):
        last = np.searchsorted(known, np.arange(len(energy)), "right") - 1
        state = (last >= 0) & (mark[known[np.maximum(last, 0)]] > 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], state.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def seconds(frame: int) -> float:
    """When a frame begins."""
    return frame * HOP * DOWN / UP / RATE


def features(samples: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """The log-mel energies of all frames, as windows x WINDOW x BANDS, and the segments' time spans in seconds."""
    raw = np.frombuffer(samples, np.uint8)
    step = PIECE - PIECE % (DOWN * HOP)
    parts = []
    for lo in range(0, len(raw), step):  # pieces overlap by the filter's reach, so cutting changes nothing
        reach = -(-(TAPS - 1) // DOWN) * DOWN
        back = min(lo, reach)
        parts.append(resample(raw[lo - back : lo + step].astype(np.float64) / 128 - 1)[back * UP // DOWN :])
    mels, energy = log_mel(np.concatenate(parts))
    windows = np.full((-(-len(mels) // WINDOW) * WINDOW, BANDS), np.log(FLOOR), np.float32)
    windows[: len(mels)] = mels
    return windows.reshape(-1, WINDOW, BANDS), [(seconds(a), seconds(b)) for a, b in segments(energy)]


TENSOR = pa.fixed_shape_tensor(pa.float32(), [WINDOW, BANDS])
STORED = pa.schema([("start", pa.float64()), ("end", pa.float64()), ("log_mel", TENSOR)])


def stored_tensors(windows: np.ndarray) -> bytes:
    """An Arrow stream of the windows' time spans and tensors."""
    n = np.arange(len(windows))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(windows.ravel()), WINDOW * BANDS)
    batch = pa.record_batch([pa.array(seconds(n * WINDOW)), pa.array(seconds((n + 1) * WINDOW)), pa.ExtensionArray.from_storage(TENSOR, flat)], schema=STORED)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, STORED) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def read_tensors(data: bytes) -> pa.Table:
    """start, end and log_mel (a fixed-shape tensor) of each window."""
    return pa.ipc.open_stream(data).read_all()


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text (null: empty), filled with spaces to a positive multiple of 192; and the bytes before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw)), len(raw)


SCHEMA = "doc_id long, n_bytes long, media binary, tensors binary, segments array<struct<s:double,e:double>>"


def media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as stored media and their features; one row per row of docs, other columns do not matter.

    tensors is an Arrow stream (see `read_tensors`); its last window is filled up with
    silence. Null and empty texts are 192 spaces: one window without segments.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = [[] for _ in range(4)]
            for t in b.column("text").to_pylist():
                p, n = payload(t)
                stored = wav(p)
                windows, segs = features(wav_samples(stored))
                for c, v in zip(rows, (n, stored, stored_tensors(windows), [{"s": s, "e": e} for s, e in segs]), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("s", pa.float64()), ("e", pa.float64())])))
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names=["doc_id", "n_bytes", "media", "tensors", "segments"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op8_audio_features(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's media, all of them read back from the stored form."""
    rows = media(table(spark, sf_dir, "documents"))

    def run(batches):
        for b in batches:
            out = [[] for _ in range(6)]
            for stored, tensor, segs in zip(b.column("media"), b.column("tensors"), b.column("segments"), strict=True):
                stored = stored.as_py()
                p = wav_samples(stored)
                t = np.round(read_tensors(tensor.as_py()).column("log_mel").combine_chunks().to_numpy_ndarray(), 3) + 0.0
                mark = f"{len(segs)}:{hashlib.sha256(t.astype('<f4').tobytes() + repr(segs.as_py()).encode()).hexdigest()[:24]}"
                for c, v in zip(out, (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), mark), strict=True):
                    c.append(v)
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), *map(pa.array, out)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
