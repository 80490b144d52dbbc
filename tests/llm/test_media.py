import io
import wave

import numpy as np
from textloom.llm import media as X


def wav(x, width=2, channels=1, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        full = np.repeat((np.clip(x, -1, 0.999) * 2 ** (8 * width - 1)).astype(np.int64), channels)
        if width == 1:
            raw = (full + 128).astype(np.uint8).tobytes()
        else:
            raw = full.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        w.writeframes(raw)
    return out.getvalue()


def test_all_widths_and_channels_read_alike():
    x = np.sin(np.arange(500) / 7) * 0.7
    for width in (1, 2, 3, 4):
        for channels in (1, 2):
            rate, got = X.read_wav(wav(x, width, channels))
            assert rate == 8000 and np.allclose(got, x, atol=0.01)


def test_transform_is_the_definition():
    x = np.random.default_rng(0).normal(size=(2, 1000)).astype(np.float32)
    got = X.stft(x, 64, 32)
    n = np.arange(64)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * n / 64)
    for f in (0, 3, got.shape[1] - 1):
        for k in (0, 5, 32):
            assert abs(got[1, f, k] - abs((x[1, 32 * f : 32 * f + 64] * window * np.exp(-2j * np.pi * k * n / 64)).sum())) < 1e-3


def test_peaks_and_pairs_are_those_of_brute_force():
    m = np.random.default_rng(1).random((2, 20, 17)).astype(np.float32)
    got = X.peaks(X.decibels(m), X.decibels(m).max((1, 2)), (2, 1))
    for r in range(2):
        for t in range(20):
            for f in range(17):
                near = m[r, max(0, t - 2) : t + 3, max(0, f - 1) : f + 2]
                assert got[r, t, f] == ((near == m[r, t, f]).sum() == 1 and near.max() == m[r, t, f] and 20 * np.log10(m[r, t, f] / m[r].max()) >= -40)
    row, code = X.codes(*np.nonzero(got), 20, 5)
    want = []
    for r in range(2):
        own = np.argwhere(got[r])
        want += [(r, (int(fa) << 18 | int(fb) << 4 | int(tb - ta)) << 32 | int(ta)) for ta, fa in own for tb, fb in own if 0 < tb - ta <= 5]
    assert sorted(want) == sorted(zip(row.tolist(), code.tolist()))
    frames = [c & 0xFFFFFFFF for r, c in zip(row.tolist(), code.tolist()) if r == 0]
    assert frames == sorted(frames)


def test_a_delayed_copy_has_the_same_hashes(spark):
    rng = np.random.default_rng(2)
    x = sum(np.sin(2 * np.pi * f * np.arange(8000) / 8000) * (np.arange(8000) // 1000 == k) for k, f in enumerate(rng.integers(300, 3500, 8)))
    late = np.r_[np.zeros(128 * 10), x]
    df = spark.createDataFrame([(1, bytearray(wav(x * 0.5))), (2, bytearray(wav(late * 0.5)))], "id long, wav binary")
    a, b = (set(c >> 32 for c in r.codes) for r in X.fingerprints(df, "id", "wav").orderBy("id").collect())
    assert len(a & b) >= 0.8 * len(a)


def test_long_recordings_go_by_stretches(spark):
    x = np.random.default_rng(5).normal(size=9000) * 0.2
    whole = X.decibels(X.stft(np.frombuffer(wav(x)[44:], "<i2").astype(np.float32)[None] / 2**15))
    _, frame, bin_ = np.nonzero(X.peaks(whole, whole.max((1, 2))))
    for stretch in (1, 5, 64, 4096):
        frames, f, k = X.long_peaks(X.Wav(wav(x)), 256, 128, stretch=stretch)
        assert frames == whole.shape[1] and f.tolist() == frame.tolist() and k.tolist() == bin_.tolist()
    df = spark.createDataFrame([(1, bytearray(wav(x, channels=2)))], "id long, wav binary")
    short = X.fingerprints(df, "id", "wav").first()
    assert X.fingerprints(df, "id", "wav", long=1000).first() == short and len(short.codes) > 100


def test_any_header_is_a_row(spark):
    good = wav(np.sin(np.arange(3000)))
    rows = [(0, bytearray(good[:24] + (2**31).to_bytes(4, "little") + good[28:]))]
    rng = np.random.default_rng(6)
    for i in range(1, 60):
        bad = bytearray(good[:400])
        for at in rng.integers(0, 44, 3):
            bad[at] = int(rng.integers(256))
        rows.append((i, bad))
    got = X.fingerprints(spark.createDataFrame(rows, "id long, wav binary"), "id", "wav").collect()
    assert len(got) == 60 and next(r for r in got if r.id == 0).error


def test_hostile_rows(spark):
    good = bytearray(wav(np.sin(np.arange(3000))))
    rows = [(1, None, "x"), (2, bytearray(b""), "x"), (3, bytearray(b"RIFFnonsense"), "x"), (4, good[:20], "x"), (5, good, "x"), (5, good, "x"), (None, good, None), (6, bytearray(wav(np.zeros(5000))), "x"), (7, bytearray(wav(np.zeros(0))), "x"), (8, bytearray(wav(np.sin(np.arange(400_000) / 5))), "x"), (9, good[:-101], "x")]
    df = spark.createDataFrame(rows, "id long, wav binary, codes string")
    got = X.fingerprints(df, "id", "wav").collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    assert by[1].rate is None and by[1].error is None and by[1].codes == []
    assert all(by[i].error and by[i].codes == [] for i in (2, 3, 4))
    assert by[6].peaks == 0 and by[7].frames == 1 and by[8].seconds == 50 and by[9].error is None
    assert len({tuple(r.codes) for r in got if r.id in (5, None)}) == 1
    assert X.fingerprints(df.limit(0), "id", "wav").count() == 0
    vectors = spark.createDataFrame([(1, None), (2, []), (3, [1.0, None, float("nan")]), (4, [0.0] * 64)], "vec_id long, embedding array<float>")
    assert X.fingerprints(X.sonify(vectors), "id", "wav").count() == 4
