"""Recordings: decoding, resampling, frames of pitch and of spectral rise, clean-up. numpy kernels inside Arrow maps."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import F_MAX, F_MIN, SAMPLE_RATE


def decode_wav(content: bytes, rate: int = SAMPLE_RATE) -> np.ndarray:
    """Mono samples (the channels' mean) of a PCM file at rate."""
    with wave.open(io.BytesIO(content)) as f:
        width, channels, own = f.getsampwidth(), f.getnchannels(), f.getframerate()
        raw = f.readframes(f.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / float(1 << (8 * width - 1))
    return resampled(x.reshape(-1, channels).mean(1), own, rate)


def encode_wav(samples: np.ndarray, rate: int = SAMPLE_RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def decode_pcm(data: bytes) -> np.ndarray:
    """Samples of raw float32 bytes; no bytes are an error."""
    if not isinstance(data, (bytes, bytearray, memoryview)):
        raise TypeError("bytes of float32 samples are expected")
    if not len(data):
        raise ValueError("no samples")
    return np.frombuffer(data, "<f4")


def resampled(x: np.ndarray, own: int, rate: int) -> np.ndarray:
    if own == rate or not len(x):
        return x.astype(np.float32)
    n = int(round(len(x) * rate / own))
    if own > rate:  # a short moving average keeps what lies above the new limit out
        k = max(1, int(round(own / rate)))
        x = np.convolve(x, np.ones(k) / k, "same")
    return np.interp(np.arange(n) * own / rate, np.arange(len(x)), x).astype(np.float32)


def framed(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    n = 1 + (len(x) - size) // hop if len(x) >= size else 0
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop][:n] if n else np.zeros((0, size), x.dtype)


def magnitudes(x: np.ndarray, size: int, hamming: bool = True) -> np.ndarray:
    """Spectra of frames next to each other."""
    f = framed(x, size, size)
    return np.abs(np.fft.rfft(f * (np.hamming(size) if hamming else 1.0), axis=1))


def spectral_flux(x: np.ndarray, size: int, hamming: bool = True) -> np.ndarray:
    """The summed rise of each frame's spectrum over the frame before (silence before the first)."""
    m = magnitudes(x, size, hamming)
    return np.maximum(m - np.concatenate([np.zeros((1, m.shape[1])), m[:-1]]) if len(m) else m, 0).sum(1)


def pick_peaks(flux: np.ndarray, window: int = 10, multiplier: float = 1.6, least: float = 1e-4) -> np.ndarray:
    if len(flux) < 2:
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0.0], np.cumsum(flux)])
    i = np.arange(len(flux))
    a, b = np.maximum(0, i - window), np.minimum(len(flux), i + window + 1)
    over = np.maximum(flux - multiplier * (sums[b] - sums[a]) / (b - a), 0)
    return np.flatnonzero((over[:-1] > over[1:]) & (over[:-1] >= least))


def onsets(x: np.ndarray, rate: int = SAMPLE_RATE, size: int = 512) -> np.ndarray:
    """Seconds of onsets."""
    return pick_peaks(spectral_flux(x, size)) * size / rate


def normalized_difference(f: np.ndarray, size: int) -> np.ndarray:
    """The cumulative mean normalised difference of each frame's first half with itself, by lag."""
    half = size // 2
    spectrum = np.fft.rfft(f, 2 * size)
    head = np.fft.rfft(f[:, :half], 2 * size)
    cross = np.fft.irfft(spectrum * np.conj(head), 2 * size)[:, :half]
    power = np.concatenate([np.zeros((len(f), 1)), np.cumsum(f**2, 1)], 1)
    tau = np.arange(half)
    d = power[:, half][:, None] + (power[:, tau + half] - power[:, tau]) - 2 * cross
    d[:, 0] = 0
    norm = d * tau / np.maximum(np.cumsum(d, 1), 1e-12)
    norm[:, 0] = 1
    return norm


def bends(norm: np.ndarray, rows: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Where, beside each lag, the parabola through it and its neighbours is least."""
    y0, y1, y2 = norm[rows, lag - 1], norm[rows, lag], norm[rows, lag + 1]
    bend = y0 - 2 * y1 + y2
    shift = np.where(np.abs(bend) > 1e-12, 0.5 * (y0 - y2) / np.where(np.abs(bend) > 1e-12, bend, 1), 0)
    return np.clip(shift, -1, 1)


def pitch_track(x: np.ndarray, rate: int = SAMPLE_RATE, hop: int = 512, size: int = 2048, center: bool = False, a4: float = 442.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seconds, frequency, voiced) of frames: the first deep dip of the normalised difference function, refined by a parabola. A
    frame's pitch depends on it alone, so live sessions use this."""
    if center:
        x = np.pad(x, size // 2)
    f = framed(x.astype(np.float64), size, hop)
    low, high = int(rate / F_MAX), int(rate / F_MIN) + 1
    if not len(f):
        return np.zeros(0), np.zeros(0), np.zeros(0, bool)
    norm = normalized_difference(f, size)
    high = min(high, size // 2 - 2)
    part = norm[:, low : high + 1]
    dip = (part < 0.15) & (part <= np.roll(part, -1, 1)) & (part <= np.roll(part, 1, 1))
    first = np.where(dip.any(1), dip.argmax(1), part.argmin(1)) + low
    rows = np.arange(len(f))
    hz = rate / (first + bends(norm, rows, first))
    voiced = (norm[rows, first] < 0.2) & (np.sqrt((f**2).mean(1)) > 1e-3)
    return rows * hop / rate, hz, voiced


# Fixed values of probabilistic pitch tracking: thresholds and their prior (beta with 2 and 18), the weight of earlier dips, what a
# frame without a dip is worth, bins of a semitone, octaves a second that a pitch may move, and the chance to begin or end a tone.
THRESHOLDS, DIP_DECAY, NO_DIP, BINS, OCTAVES, SWITCH = 100, 2.0, 0.01, 10, 35.92, 0.01
#: Frames of a stretch that is decoded at once.
STRETCH = 4096


def threshold_prior() -> np.ndarray:
    """The mass of each threshold's interval under the beta distribution, as a binomial tail."""
    edges = np.linspace(0, 1, THRESHOLDS + 1)
    tail = lambda v: sum(math.comb(19, j) * v**j * (1 - v) ** (19 - j) for j in range(2, 20))
    return np.diff(tail(edges))


def pitch_candidates(norm: np.ndarray, low: int, high: int, rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frame, frequency, probability): the dips that some threshold would choose, weighed by the thresholds' prior."""
    part, prior = norm[:, low : high + 1], threshold_prior()
    levels = np.linspace(0, 1, THRESHOLDS + 1)[1:]
    dip = np.zeros(part.shape, bool)
    dip[:, 1:-1] = (part[:, 1:-1] < part[:, :-2]) & (part[:, 1:-1] <= part[:, 2:])
    dip[:, 0] = part[:, 0] < part[:, 1]
    frames, hz, weight = [], [], []
    for k in range(len(part)):
        at = np.flatnonzero(dip[k])
        if not len(at):
            continue
        under = part[k, at][:, None] < levels[None, :]
        place, n = np.cumsum(under, 0) - 1, under.sum(0)
        share = (1 - math.exp(-DIP_DECAY)) * np.exp(-DIP_DECAY * place) / (1 - np.exp(-DIP_DECAY * np.maximum(n, 1)))
        p = (np.where(under, share, 0.0) * prior).sum(1)
        p[part[k, at].argmin()] += NO_DIP * prior[n == 0].sum()
        some = p > 0
        frames.append(np.full(int(some.sum()), k))
        lag = at[some] + low
        hz.append(rate / (lag + bends(norm, np.full(len(lag), k), lag)))
        weight.append(p[some])
    return tuple(np.concatenate([*c, np.zeros(0, t)]) for c, t in ((frames, np.int64), (hz, float), (weight, float)))


def decoded(observed: np.ndarray, width: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(the likeliest state of each frame, the states' scores after the last): pitches move by a triangle of width bins, tones begin
    and end with chance SWITCH. observed: frames by states, the voiced half first."""
    n = observed.shape[1] // 2
    reach = width // 2
    shape = 1.0 - np.abs(np.arange(-reach, reach + 1)) / (reach + 1)
    total = np.convolve(np.ones(n), shape, "same")
    log = np.log(np.maximum(observed, 1e-300)).reshape(len(observed), 2, n)
    moves, stay, go = np.log(shape), math.log(1 - SWITCH), math.log(SWITCH)
    score = np.full((2, n), -math.log(2 * n)) + log[0] if before is None else before
    came = np.zeros((len(observed), 2, n), np.int32)
    for k in range(0 if before is not None else 1, len(observed)):
        padded = np.pad(score - np.log(total), ((0, 0), (reach, reach)), constant_values=-np.inf)
        reached = np.lib.stride_tricks.sliding_window_view(padded, width, 1) + moves
        best = reached.argmax(2)
        value = np.take_along_axis(reached, best[:, :, None], 2)[:, :, 0]
        source = best + np.arange(n) - reach
        kept, other = value + stay, value[::-1] + go
        swap = other > kept
        score = np.where(swap, other, kept) + log[k]
        half = np.array([0, 1])[:, None]
        came[k] = np.where(swap, source[::-1] + (1 - half) * n, source + half * n)
    states = np.zeros(len(observed), np.int64)
    states[-1] = score.ravel().argmax()
    for k in range(len(observed) - 1, 0, -1):
        states[k - 1] = came[k].ravel()[states[k]]
    return states, score


def probable_pitch_track(x: np.ndarray, rate: int = SAMPLE_RATE, hop: int = 512, size: int = 2048, center: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seconds, frequency, voiced) of frames by probabilistic difference tracking: all dips that a threshold may choose are candidates,
    and the likeliest path through them is taken. A recording is decoded in stretches, each of which goes on from the one before."""
    if center:
        x = np.pad(x, size // 2)
    f = framed(x.astype(np.float64), size, hop)
    low, high = int(rate / F_MAX), min(int(math.ceil(rate / F_MIN)), size // 2 - 2)
    bins = int(12 * BINS * math.log2(F_MAX / F_MIN)) + 1
    width = 2 * (int(round(OCTAVES * 12 * hop / rate)) * BINS // 2) + 1
    hz, voiced, score = np.zeros(len(f)), np.zeros(len(f), bool), None
    for i in range(0, len(f), STRETCH):
        own = f[i : i + STRETCH]
        frame, found, weight = pitch_candidates(normalized_difference(own, size), low, high, rate)
        place = np.clip(np.rint(12 * BINS * np.log2(found / F_MIN)), 0, bins - 1).astype(np.int64)
        observed = np.zeros((len(own), 2 * bins))
        np.add.at(observed, (frame, place), weight)
        observed[:, bins:] = ((1 - np.clip(observed[:, :bins].sum(1), 0, 1)) / bins)[:, None]
        states, score = decoded(observed, width, score)
        hz[i : i + len(own)], voiced[i : i + len(own)] = F_MIN * 2 ** (states % bins / (12 * BINS)), states < bins
    return np.arange(len(f)) * hop / rate, hz, voiced & (np.sqrt((f**2).mean(1)) > 1e-3 if len(f) else voiced)


def rms_normalized(x: np.ndarray, target: float = 0.1, peak: float | None = None) -> np.ndarray:
    level = np.sqrt((x**2).mean()) if len(x) else 0.0
    x = x * (target / level) if level > 1e-8 else x
    top = np.abs(x).max() if len(x) else 0.0
    return x * (peak / top) if peak is not None and top > peak else x


def trimmed(x: np.ndarray, top_db: float = 40.0, size: int = 2048, hop: int = 512) -> np.ndarray:
    """Without the quiet frames at both ends."""
    f = framed(np.pad(x, size // 2), size, hop)
    level = np.sqrt((f**2).mean(1)) if len(f) else np.zeros(0)
    loud = np.flatnonzero(level > level.max() * 10 ** (-top_db / 20)) if len(level) and level.max() > 0 else []
    return x[loud[0] * hop : min(len(x), (loud[-1] + 1) * hop)] if len(loud) else x[:0]


def filtered(x: np.ndarray, rate: int, low: float | None = None, high: float | None = None, order: int = 5) -> np.ndarray:
    """Butterworth magnitude between low and high without any delay: the response of filtering forth and back, in frequency."""
    if not len(x) or (low is None and high is None):
        return x
    n = 1 << int(np.ceil(np.log2(2 * len(x))))
    f = np.fft.rfftfreq(n, 1 / rate)
    gain = np.ones(len(f))
    if low:
        gain *= (f / low) ** (2 * order) / (1 + (f / low) ** (2 * order))
    if high:
        gain *= 1 / (1 + (f / high) ** (2 * order))
    return np.fft.irfft(np.fft.rfft(x, n) * gain, n)[: len(x)]


def harmonic(x: np.ndarray, rate: int, size: int = 1024, hop: int = 256, width: int = 17) -> np.ndarray:
    """What lasts in time rather than in frequency (medians both ways), in stretches of 30 s; over 120 s it is left as it is."""
    if len(x) > 120 * rate:
        return x
    out = []
    for i in range(0, len(x), 30 * rate):
        s = x[i : i + 30 * rate]
        f = framed(np.pad(s, (size // 2, size)), size, hop)
        if not len(f):
            out.append(s)
            continue
        win = np.hanning(size)
        spec = np.fft.rfft(f * win, axis=1)
        mag = np.abs(spec)
        med = lambda m, axis: np.median(np.lib.stride_tricks.sliding_window_view(np.pad(m, [(width // 2, width // 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge"), width, axis), axis=2)
        h, p = med(mag, 0), med(mag, 1)
        back = np.fft.irfft(spec * (h**2 / np.maximum(h**2 + p**2, 1e-12)), size, axis=1) * win
        y, weight = np.zeros(len(s) + 2 * size), np.zeros(len(s) + 2 * size)
        for k in range(len(f)):
            y[k * hop : k * hop + size] += back[k]
            weight[k * hop : k * hop + size] += win**2
        out.append((y / np.maximum(weight, 1e-6))[size // 2 : size // 2 + len(s)])
    return np.concatenate(out) if out else x


def preprocessed(x: np.ndarray, rate: int, highpass: float | None = None, top_db: float | None = None, use_harmonic: bool = False, band: tuple[float | None, float | None] = (None, None), target_rms: float | None = None, peak: float | None = None) -> np.ndarray:
    """High pass, trim, harmonic part, band pass, level, peak - in this order, each if asked for."""
    x = filtered(x, rate, highpass) if highpass else x
    x = trimmed(x, top_db) if top_db is not None else x
    x = harmonic(x, rate) if use_harmonic else x
    x = filtered(x, rate, *band) if any(band) else x
    if target_rms is not None:
        x = rms_normalized(x, target_rms)
    top = np.abs(x).max() if len(x) else 0.0
    return x * (peak / top) if peak is not None and top > peak else x


def chroma(x: np.ndarray, rate: int = SAMPLE_RATE, hop: int = 512, size: int = 4096, a4: float = 442.0) -> np.ndarray:
    """Energy by pitch class, a row per hop; long recordings in stretches of 60 s that share 2 s."""
    f = np.fft.rfftfreq(size, 1 / rate)
    ok = (f >= 55) & (f <= 4000)
    cls = np.round(12 * np.log2(f[ok] / a4) + 69).astype(int) % 12
    fold = (cls[:, None] == np.arange(12)).astype(float)
    out, step, halo = [], 60 * rate // hop, rate // hop
    total = 1 + len(x) // hop
    padded = np.pad(x, (size // 2, size))
    for a in range(0, total, step):
        part = padded[max(0, (a - halo) * hop) : (min(total, a + step + halo) - 1) * hop + size]
        rows = (np.abs(np.fft.rfft(framed(part, size, hop) * np.hanning(size), axis=1))[:, ok] ** 2) @ fold
        out.append(rows[a - max(0, a - halo) :][: min(step, total - a)])
    return np.concatenate(out) if out else np.zeros((0, 12))


def mel_db(x: np.ndarray, rate: int = SAMPLE_RATE, hop: int = 512, size: int = 2048, bands: int = 128, low: float = 27.5) -> np.ndarray:
    """Mel bands in decibels under the loudest, scaled to 0..1 (zeros if all are alike)."""
    to_mel, from_mel = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edges = from_mel(np.linspace(to_mel(low), to_mel(rate / 2), bands + 2))
    f = np.fft.rfftfreq(size, 1 / rate)[:, None]
    weights = np.maximum(0, np.minimum((f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])))
    power = np.abs(np.fft.rfft(framed(np.pad(x, (size // 2, size)), size, hop) * np.hanning(size), axis=1)) ** 2 @ weights
    db = 10 * np.log10(np.maximum(power, 1e-10))
    db = np.maximum(db - db.max(), -80.0) if len(db) else db
    span = db.max() - db.min() if len(db) else 0.0
    return (db - db.min()) / span if span > 0 else db * 0.0


def _kernel_rows(recordings: DataFrame, schema: pa.Schema, sql: str, rows) -> DataFrame:
    """recordings (perf_id, pcm as bytes of float32, sample_rate) through a kernel that gives columns per recording."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for perf, pcm, rate in zip(*(b.column(c).to_pylist() for c in ("perf_id", "pcm", "sample_rate"))):
                columns = rows(decode_pcm(pcm), rate)
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays([pa.array([perf] * n, schema.field(0).type), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]], schema=schema)

    return recordings.select("perf_id", "pcm", "sample_rate").mapInArrow(run, sql)


def read_recordings(spark: SparkSession, paths: str, rate: int = SAMPLE_RATE) -> DataFrame:
    """perf_id (the path), pcm, sample_rate of PCM files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pcm = [decode_wav(c, rate).astype("<f4").tobytes() for c in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(pcm, pa.binary()), pa.array([rate] * len(b), pa.int32())], names=["perf_id", "pcm", "sample_rate"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "perf_id string, pcm binary, sample_rate int")


def pitch_frames(recordings: DataFrame, hop: int = 512, center: bool = False, a4: float = 442.0, probable: bool = True) -> DataFrame:
    """perf_id, frame_idx, t, frequency_hz, midi, voiced; an unvoiced frame has no frequency and midi -1. probable: the likeliest path
    over all frames, or else each frame by itself, as live sessions hear it."""

    def rows(x: np.ndarray, rate: int) -> list:
        t, hz, voiced = (probable_pitch_track if probable else pitch_track)(x, rate, hop, center=center)
        return [np.arange(len(t)), t, pa.array(hz, mask=~voiced), np.where(voiced, 69 + 12 * np.log2(np.maximum(hz, 1e-9) / a4), -1.0), voiced]

    schema = pa.schema([("perf_id", pa.string()), ("frame_idx", pa.int64()), ("t", pa.float64()), ("frequency_hz", pa.float64()), ("midi", pa.float64()), ("voiced", pa.bool_())])
    return _kernel_rows(recordings.withColumn("perf_id", F.col("perf_id").cast("string")), schema, "perf_id string, frame_idx long, t double, frequency_hz double, midi double, voiced boolean", rows)


def flux_frames(recordings: DataFrame, size: int = 512) -> DataFrame:
    """perf_id, frame_idx, flux; onsets come of it by the window operators."""
    schema = pa.schema([("perf_id", pa.string()), ("frame_idx", pa.int64()), ("flux", pa.float64())])
    rows = lambda x, rate: (lambda f: [np.arange(len(f)), f])(spectral_flux(x, size))
    return _kernel_rows(recordings.withColumn("perf_id", F.col("perf_id").cast("string")), schema, "perf_id string, frame_idx long, flux double", rows)


def chroma_frames(recordings: DataFrame, hop: int = 512) -> DataFrame:
    """seq_id, idx, vec: the raw feature sequence; smoothing, lengths, differences and context are window operators."""
    schema = pa.schema([("seq_id", pa.string()), ("idx", pa.int64()), ("vec", pa.list_(pa.float64()))])
    rows = lambda x, rate: (lambda c: [np.arange(len(c)), list(c)])(chroma(x, rate, hop))
    return _kernel_rows(recordings.withColumn("perf_id", F.col("perf_id").cast("string")), schema, "seq_id string, idx long, vec array<double>", rows)
