"""Note hashes of synthetic tones."""

import io
import wave

import numpy as np

from gristmill.operators import audio as A

RATE = 16000


def tone(*freqs, seconds=1.0):
    t = np.arange(int(RATE * seconds)) / RATE
    return sum(np.sin(2 * np.pi * f * t) for f in freqs) / max(len(freqs), 1) * 0.8


def wav(x, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(width)
        f.setframerate(RATE)
        scaled = np.clip(np.rint(x * (2 ** (8 * width - 1) - 1)), -(2 ** (8 * width - 1)), None).astype("<i4")
        f.writeframes(scaled.view(np.uint8).reshape(-1, 4)[:, :width].tobytes() if width > 1 else (scaled + 128).astype(np.uint8).tobytes())
    return out.getvalue()


def test_reading_all_widths():
    x = tone(440)
    for width in (1, 2, 3, 4):
        got, rate = A.read_wave(wav(x, width))
        assert rate == RATE and np.abs(got - x).max() < 0.02


def test_pieces_and_notes():
    assert A.pieces(np.ones(2000), RATE).shape == (3, 800) and A.pieces(np.ones(2000), RATE)[-1].sum() == 400
    assert [A.NOTES[i] for i in A.note(np.array([440.0, 880.0, 261.63, 27.5, 466.16]))] == ["A", "A", "C", "A", "A#"]
    h = A.hashes(A.pieces(tone(440, 5000), RATE), RATE)
    assert len(h) == 20 and {x.split("-")[2] for x in h} == {"A"} and {x.split("-")[4] for x in h} == {"D#"}


def test_index_and_match(spark):
    sounds = {"low": tone(440, 3000), "high": tone(520, 4500), "two": np.concatenate((tone(440, 3000), tone(700, 2500)))}
    rows = [(k, bytearray(wav(v))) for k, v in sounds.items()] + [("bad", bytearray(b"no sound")), ("none", None), ("silent", bytearray(wav(np.zeros(1600))))]
    indexed = A.index(spark.createDataFrame(rows, "path string, content binary"))
    assert {r.path for r in indexed.select("path").distinct().collect()} == {"low", "high", "two"}
    query = A.index(spark.createDataFrame([("q", bytearray(wav(tone(520, 4500, seconds=0.5)))), ("other", bytearray(wav(tone(3700))))], "path string, content binary")).withColumnRenamed("path", "query")
    got = [tuple(r) for r in A.match(query, indexed).collect()]
    assert got == [("q", "high", 1.0)]
    assert A.inverted(indexed).count() == indexed.select("hash").distinct().count()
    pairs = {(r.src, r.dst): r.weight for r in A.similar_sounds(indexed).collect()}
    assert pairs["low", "two"] == 1.0 and pairs["two", "low"] < 1.0
