"""Waves: tones of known pitch and level, noise that falls, files that break."""

import math

import numpy as np
import pytest

from voxframe.functions import signals as s


def tone(hz, rate=16000, seconds=1.0, level=0.5):
    return level * np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)


@pytest.mark.parametrize("rate", (8000, 16000, 44100))
@pytest.mark.parametrize("hz", (110, 220.5, 440, 880))
def test_pitch_of_tones(rate, hz):
    for wave in (tone(hz, rate), tone(hz, rate) + 0.3 * tone(2 * hz, rate) + 0.2 * tone(3 * hz, rate)):
        assert abs(s.mean_pitch(wave, rate) / hz - 1) < 0.01
    noise = np.random.default_rng(1).normal(size=rate) * 0.1
    assert np.isnan(s.pitches(noise, rate)).mean() > 0.9 and s.mean_pitch(np.zeros(rate), rate) is None


@pytest.mark.parametrize("bits", (16, 24, 32))
def test_files_round_trip(bits):
    x = np.stack([tone(300), tone(500, level=0.999)], 1)
    y, rate, depth = s.read_wav(s.write_wav(x, 22050, bits))
    assert (rate, depth, y.shape) == (22050, bits, x.shape) and np.abs(x - y).max() <= 2.0 ** (1 - bits)
    mono, _, _ = s.read_wav(s.write_wav(x[:, 0], 8000, bits))
    assert mono.shape == (16000, 1)


def test_broken_files_tell_what_is_wrong():
    good = s.write_wav(tone(300), 16000)
    extra = good[:36] + b"LIST\x03\x00\x00\x00abc\x00" + good[36:]
    assert np.array_equal(s.read_wav(extra)[0], s.read_wav(good)[0])
    for bad, why in ((b"", "header"), (b"RIFFxxxxWAVE", "no format"), (good[:100], "cut off"), (good[:30], "cut off"), (good[:34] + b"\x07\x00" + good[36:], "agree"), (good[:20] + b"\x55\x00" + good[22:], "format 85")):
        with pytest.raises(ValueError, match=why):
            s.properties(bad)
    p = s.properties(s.write_wav(np.stack([tone(250), tone(250)], 1), 16000, 24))
    assert p["stereo"] and p["bits"] == 24 and abs(p["f0"] - 250) < 2.5 and abs(p["centroid"] - 250) < 60


def test_noise_falls_and_the_tone_stays():
    draw = np.random.default_rng(2)
    noise = 0.02 * draw.normal(size=32000)
    speech = np.concatenate([np.zeros(8000), tone(440, seconds=0.5), np.zeros(8000), tone(660, seconds=0.5)])
    out = s.denoised(speech + noise)
    assert len(out) == 32000
    quiet, loud = np.r_[1000:7000, 17000:23000], np.r_[9000:15000, 25000:31000]
    db = lambda a, b: 10 * math.log10((a**2).mean() / (b**2).mean())
    assert db(noise[quiet], out[quiet]) > 10
    assert abs(db(out[loud], speech[loud])) < 0.5 and db(speech[loud], (out - speech)[loud]) > db(speech[loud], noise[loud])
    # nothing but a steady tone stays as it is
    assert abs(db(s.denoised(tone(440))[1000:-1000], tone(440)[1000:-1000])) < 0.5
    assert len(s.denoised(np.zeros(0))) == 0 and np.abs(s.denoised(np.zeros(100))).max() == 0


def test_speed_shifts_pitch_and_keeps_level():
    for speed in (0.9, 1.1, 0.5, 1.5):
        y = s.change_speed(tone(400), speed)
        assert len(y) == math.ceil(16000 / speed - 1e-9) and abs(s.mean_pitch(y, 16000) / (400 * speed) - 1) < 0.01
        assert abs(10 * math.log10((y[500:-500] ** 2).mean() / 0.125)) < 0.1
        # values are those of the tone itself at the new places
        want = 0.5 * np.sin(2 * np.pi * 400 * speed * np.arange(len(y)) / 16000)
        assert np.abs(y - want)[500:-500].max() < 2e-3
    # what lies beyond half the new rate is gone, not folded back
    assert np.abs(s.resampled(tone(7000), 1, 2)[200:-200]).max() < 0.01
    assert np.array_equal(s.resampled(tone(300), 3, 3), tone(300)) and len(s.resampled(np.zeros(0), 1, 2)) == 0
    assert np.allclose(s.resampled(np.full(3, 0.7), 10, 9)[1], 0.7, atol=0.4)
