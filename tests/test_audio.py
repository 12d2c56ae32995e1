"""Signal kernels against synthetic tones."""

import numpy as np

from stretto.sources import audio

RATE = 22050


def tones(midi, seconds=0.5):
    return np.concatenate([0.4 * np.sin(2 * np.pi * 442 * 2 ** ((m - 69) / 12) * np.arange(int(seconds * RATE)) / RATE) for m in midi])


def heard(hz, voiced):
    return np.where(voiced, 69 + 12 * np.log2(np.maximum(hz, 1e-9) / 442), -1.0)


def test_probable_pitch_follows_tones_through_noise():
    rng = np.random.default_rng(1)
    midi = (40, 48, 60, 64, 67, 72, 83)
    x = np.concatenate([tones(midi), np.zeros(RATE // 2)])
    x = (x + 0.02 * rng.standard_normal(len(x))).astype(np.float32)
    t, hz, voiced = audio.probable_pitch_track(x, RATE)
    m = heard(hz, voiced)
    for k, want in enumerate(midi):
        own = m[(t >= 0.5 * k + 0.08) & (t < 0.5 * k + 0.35)]
        assert np.abs(own - want).max() < 0.2
    assert not voiced[t > 0.5 * len(midi) + 0.05].any()
    assert all(len(c) == 0 for c in audio.probable_pitch_track(x[:100], RATE))
    assert not audio.probable_pitch_track(np.zeros(RATE, np.float32), RATE)[2].any()


def test_an_octave_dip_does_not_break_the_path():
    """A frame with a strong second harmonic, which a tracker of single frames takes for the octave, stays on the path."""
    n = np.arange(RATE) / RATE
    strong = np.where((n > 0.45) & (n < 0.5), 1.0, 0.2)
    x = 0.3 * np.sin(2 * np.pi * 220 * n) + 0.3 * strong * np.sin(2 * np.pi * 440 * n)
    t, hz, voiced = audio.probable_pitch_track(x.astype(np.float32), RATE)
    assert voiced[:-1].all() and np.abs(hz[voiced] / 220 - 1).max() < 0.02


def test_stretches_go_on_from_each_other(monkeypatch):
    x = tones((60, 67, 64, 62)).astype(np.float32)
    whole = audio.probable_pitch_track(x, RATE)
    monkeypatch.setattr(audio, "STRETCH", 7)
    parts = audio.probable_pitch_track(x, RATE)
    same = (whole[2] == parts[2]) & (np.abs(whole[1] - parts[1]) < 1.0)
    assert same.mean() > 0.9
    assert abs(audio.threshold_prior().sum() - 1) < 1e-9
