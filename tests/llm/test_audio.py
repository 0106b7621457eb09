import hashlib
import io
import wave
import zlib

import numpy as np
from manybody.llm import audio as a


def test_resampling_equals_direct_filtering():
    """Zeros between the samples, one filter at the higher rate, and every DOWN-th value."""
    assert a.UP > 1
    x = np.random.default_rng(1).normal(size=1003)
    up = np.zeros(len(x) * a.UP)
    up[:: a.UP] = x
    assert np.allclose(a.resample(x), np.convolve(up, a._H)[: len(up)][:: a.DOWN])


def test_log_mel_by_brute_force():
    y = np.random.default_rng(4).normal(size=1700)
    mels, energy = a.log_mel(y)
    assert len(mels) == 13
    for i in range(len(mels)):
        part = np.zeros(a.FRAME)
        got = y[i * a.HOP : i * a.HOP + a.FRAME]
        part[: len(got)] = got
        part *= np.hanning(a.FRAME)
        n = np.arange(a.FRAME)
        power = np.array([abs((part * np.exp(-2j * np.pi * k * n / a.FFT)).sum()) ** 2 for k in range(a.FFT // 2 + 1)])
        assert np.allclose(mels[i], [np.log((power * a._MEL[:, k]).sum() + a.FLOOR) for k in range(a.BANDS)])
        assert np.isclose(energy[i], np.log((part**2).mean() + 1e-9))


def test_tensors_hold_all_frames():
    data = bytes(np.random.default_rng(5).integers(0, 256, 192 * 60, dtype=np.uint8))
    windows, _ = a.features(data)
    mels, _ = a.log_mel(a.resample(np.frombuffer(data, np.uint8) / 128 - 1))
    t = a.read_tensors(a.stored_tensors(windows))
    assert t.schema.field("log_mel").type == a.TENSOR
    back = t.column("log_mel").combine_chunks().to_numpy_ndarray()
    assert back.shape == (-(-len(mels) // a.WINDOW), a.WINDOW, a.BANDS)
    assert np.allclose(back.reshape(-1, a.BANDS)[: len(mels)], mels, atol=1e-4)
    start, end = t.column("start").to_numpy(), t.column("end").to_numpy()
    assert start[0] == 0 and np.allclose(end[:-1], start[1:]) and np.allclose(end - start, 0.2) and end[-1] >= len(data) / a.RATE - 0.025


def test_pieces_change_nothing(monkeypatch):
    data = bytes(np.random.default_rng(2).integers(0, 256, 192 * 400, dtype=np.uint8))
    whole = a.features(data)
    monkeypatch.setattr(a, "PIECE", 5000)
    parts = a.features(data)
    assert np.allclose(whole[0], parts[0], atol=1e-5) and whole[1] == parts[1]


def test_segments_by_brute_force():
    e = np.random.default_rng(3).normal(size=300).cumsum()
    quiet, loud = np.quantile(e, 0.1), np.quantile(e, 0.9)
    on, want = False, []
    for i, v in enumerate(e):
        was, on = on, v >= quiet + a.OPEN * (loud - quiet) or on and v >= quiet + a.CLOSE * (loud - quiet)
        if on and not was:
            want.append([i, None])
        if was and not on:
            want[-1][1] = i
    assert a.segments(e) == [(s, t or 300) for s, t in want]


def test_query(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "é" * 96), (4, "x" * 193), (4, "x" * 193), (None, "a b " * 90_000)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS media").write.parquet(f"{tmp_path}/documents.parquet")
    got = a.op8_audio_features(spark, str(tmp_path)).collect()
    texts = {(i, len((t or "").encode())): t for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        raw = (texts[(r.doc_id, r.n_bytes)] or "").encode()
        p = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        stored = a.wav(p)
        assert wave.open(io.BytesIO(stored)).readframes(len(p)) == p
        assert r[1:7] == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
    assert len({r.feature for r in got}) == 4
    m = a.media(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS tensors")).toArrow()
    assert all(a.read_tensors(x.as_py()).num_rows for x in m.column("tensors")) and m.num_rows == 6
    assert a.media(spark.createDataFrame([], "doc_id long, text string")).count() == 0
