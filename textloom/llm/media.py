"""Audio in media columns: WAV bytes, short-time Fourier transforms, and spectral-peak fingerprints.

A media column is binary. The wave module reads it; channels are averaged. The transform is of Hann
windows; a peak is a cell of the log spectrogram greater than all others within `reach` bins and frames
and within `drop_db` of the loudest cell. Each peak is paired with every peak of its target zone, the
next `zone` frames (Wang, 2003): (frequency, frequency, frames between) is the hash, and the fingerprint
is an array of codes, hash * 2^32 + frame of the first peak, in order of time.

Transforms of all short rows of one length in a batch are one call of the FFT. Audio of more than LONG
samples is read and transformed a stretch at a time, twice, first for its loudest cell, so beside its
bytes it takes memory for a stretch and for its peaks only; the codes are the same.

Defined results: null bytes have a null rate and no codes; bytes that aren't a readable PCM WAV (empty,
truncated header, unknown format, a rate beyond 31 bits) have their error in `error` and no codes; a data
chunk that is cut off ends where it ends; audio shorter than one window is padded with silence to one;
silence has no peaks; equal neighbours (ties) aren't peaks of each other; rows repeat as they are given; a null id
is kept; an empty table gives an empty result. A code has room for 2^31 frames. Only the id and the media column are read.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

OUT = "id long, rate int, seconds double, frames int, peaks int, codes array<long>, error string"
PASS = 4 << 20
LONG = 1 << 21  # samples


def _mono(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Samples in [-1, 1), channels averaged; an incomplete last frame is left out."""
    raw = raw[: len(raw) // (width * channels) * (width * channels)]
    if width == 1:  # unsigned
        x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    elif width == 2:
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 2**15
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / 2**23
    elif width == 4:
        x = np.frombuffer(raw, "<i4").astype(np.float32) / 2**31
    else:
        raise wave.Error(f"sample width {width}")
    return x.reshape(-1, channels).mean(1) if channels > 1 else x


class Wav:
    """A recording of which any samples can be read; n of them are there, whatever the header says."""

    def __init__(self, data: bytes):
        self.w = wave.open(io.BytesIO(data))
        self.width, self.channels, self.rate = self.w.getsampwidth(), self.w.getnchannels(), self.w.getframerate()
        if not 0 <= self.rate < 2**31:
            raise wave.Error(f"sample rate {self.rate}")
        low, high = 0, self.w.getnframes()
        while low < high:  # the last sample that is whole
            middle = (low + high) // 2
            self.w.setpos(middle)
            low, high = (middle + 1, high) if len(self.w.readframes(1)) == self.width * self.channels else (low, middle)
        self.n = low

    def samples(self, lo: int, hi: int) -> np.ndarray:
        self.w.setpos(lo)
        return _mono(self.w.readframes(hi - lo), self.width, self.channels)


def read_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and all samples."""
    w = Wav(data)
    return w.rate, w.samples(0, w.n)


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1 - 2**-15) * 2**15).astype("<i2").tobytes())
    return out.getvalue()


def stft(x: np.ndarray, size: int = 256, hop: int = 128) -> np.ndarray:
    """Magnitudes of rows of equal length: rows x frames x size / 2 + 1."""
    if x.shape[1] < size:
        x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    windows = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::hop]
    return np.abs(np.fft.rfft(windows * np.hanning(size + 1)[:-1].astype(np.float32), axis=2)).astype(np.float32)


def decibels(magnitudes: np.ndarray) -> np.ndarray:
    return 20 * np.log10(np.maximum(magnitudes, 1e-7))


def peaks(db: np.ndarray, loudest: np.ndarray, reach: tuple[int, int] = (3, 3), drop_db: float = 40.0) -> np.ndarray:
    """rows x frames x bins, true at peaks. loudest: of each row, its loudest cell."""
    rows, frames, bins = db.shape
    around = np.full_like(db, -np.inf)
    t, f = reach
    padded = np.pad(db, ((0, 0), (t, t), (f, f)), constant_values=-np.inf)
    for i in range(2 * t + 1):
        for j in range(2 * f + 1):
            if (i, j) != (t, f):
                np.maximum(around, padded[:, i : i + frames, j : j + bins], out=around)
    return (db > around) & (db >= loudest[:, None, None] - drop_db) & (db > -100)


def codes(row: np.ndarray, frame: np.ndarray, bin_: np.ndarray, frames: int, zone: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of all pairs of peaks, which come by row and time."""
    clock = row * (frames + zone + 2) + frame  # rows lie further apart than a zone
    first = np.searchsorted(clock, clock + 1)
    to = np.searchsorted(clock, clock + zone + 1)
    n = to - first
    a = np.repeat(np.arange(len(row)), n)
    b = np.arange(int(n.sum())) - np.repeat(np.cumsum(np.r_[0, n])[:-1], n) + first[a]
    mark = (bin_[a].astype(np.int64) << 18 | bin_[b].astype(np.int64) << 4 | (frame[b] - frame[a]).astype(np.int64)) & 0x7FFFFFFF
    return row[a], mark << 32 | frame[a].astype(np.int64)


def long_peaks(w: Wav, size: int, hop: int, reach: tuple[int, int] = (3, 3), stretch: int = 4096) -> tuple[int, np.ndarray, np.ndarray]:
    """Frames of a long recording, and the frame and bin of each peak, from `stretch` frames at a time and their neighbours."""
    frames = (w.n - size) // hop + 1

    def spectra() -> Iterator[tuple[int, int, int, np.ndarray]]:
        for at in range(0, frames, stretch):
            to = min(frames, at + stretch)
            lo, hi = max(0, at - reach[0]), min(frames, to + reach[0])
            yield at, to, lo, decibels(stft(w.samples(lo * hop, (hi - 1) * hop + size)[None], size, hop))

    loudest = np.array([max(float(db.max()) for *_, db in spectra())])
    found = []
    for at, to, lo, db in spectra():
        frame, bin_ = np.nonzero(peaks(db, loudest, reach)[0, at - lo : to - lo])
        found.append((frame + at, bin_))
    return frames, np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def fingerprints(media: DataFrame, id_column: str, wav_column: str, size: int = 256, hop: int = 128, zone: int = 12, long: int = LONG) -> DataFrame:
    """One row a media value: OUT. long: samples beyond which a recording goes by stretches."""
    if not 1 <= zone <= 15 or size > 2**14:
        raise ValueError("zone is 1 to 15 frames, size at most 16384")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.passes(batch, "wav", PASS):
                n = b.num_rows
                rate, sound, error, length = [None] * n, [None] * n, [None] * n, np.full(n, -1, np.int64)
                for i, data in enumerate(b.column("wav").to_pylist()):
                    if data is not None:
                        try:
                            w = Wav(data)
                            sound[i] = w.samples(0, w.n) if w.n <= long else w
                            rate[i], length[i] = w.rate, w.n
                        except Exception as e:  # whatever the bytes are, the job goes on
                            error[i] = str(e) or type(e).__name__
                frames, found = np.zeros(n, np.int64), np.zeros(n, np.int64)
                rows, all_codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i in np.flatnonzero(length > long).tolist():
                    frames[i], frame, bin_ = long_peaks(sound[i], size, hop)
                    row, code = codes(np.zeros(len(frame), np.int64), frame, bin_, int(frames[i]), zone)
                    found[i] = len(frame)
                    rows.append(row + i), all_codes.append(code)
                for size_of in np.unique(length[(length >= 0) & (length <= long)]).tolist():
                    own = np.flatnonzero(length == size_of)
                    step = max(1, LONG // max(size_of, size))
                    for at in range(0, len(own), step):
                        some = own[at : at + step]
                        db = decibels(stft(np.stack([sound[i] for i in some]), size, hop))
                        row, frame, bin_ = np.nonzero(peaks(db, db.max((1, 2))))
                        frames[some], found[some] = db.shape[1], np.bincount(row, minlength=len(some))
                        row, code = codes(row, frame, bin_, db.shape[1], zone)
                        rows.append(some[row]), all_codes.append(code)
                row, code = np.concatenate(rows), np.concatenate(all_codes)
                order = np.argsort(row, kind="stable")
                row, code = row[order], code[order]
                seconds = [None if k < 0 else k / r if r else 0.0 for k, r in zip(length.tolist(), rate, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(rate, pa.int32()), pa.array(seconds, pa.float64()), pa.array(frames, pa.int32()), pa.array(found, pa.int32()), K.lists(code, np.searchsorted(row, np.arange(n + 1)), pa.int64()), pa.array(error, pa.string())],
                    ["id", "rate", "seconds", "frames", "peaks", "codes", "error"],
                )

    return media.select(F.col(id_column).cast("long").alias("id"), F.col(wav_column).cast("binary").alias("wav")).mapInArrow(run, OUT)


def sonify(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", rate: int = 8000, note: int = 512) -> DataFrame:
    """id, wav: each vector as a WAV of notes, for tables that hold no audio. Sixteen numbers a note, one partial each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(note) / rate
        partials = np.sin(2 * np.pi * (250 + 225 * np.arange(16))[:, None] * t) * np.hanning(note)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                out = []
                for v in b.column("v").to_pylist():
                    if not v:
                        out.append(None if v is None else write_wav(np.zeros(0), rate))
                        continue
                    x = np.nan_to_num(np.array([y or 0.0 for y in v], np.float64))
                    x = np.pad(x, (0, -len(x) % 16)).reshape(-1, 16)
                    sound = (x @ partials).ravel()
                    out.append(write_wav(0.9 * sound / (np.abs(sound).max() or 1.0), rate))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], ["id", "wav"])

    return vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).mapInArrow(run, "id long, wav binary")
