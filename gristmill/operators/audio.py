"""Sounds: spectra and note hashes of short samples, an index of them, and matching.

Notes are the twelve semitones by their frequencies; a sample's hash names the
loudest note of each band. WAVE files of integer samples are read with the
standard library.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import graph

NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
#: Where the bands start, in Hz; the last ends at HIGHEST.
BANDS = (20, 60, 250, 2000, 4000, 6000)
HIGHEST = 20000
SAMPLE_MS = 50


def read_wave(data: bytes) -> tuple[np.ndarray, int]:
    """Samples from -1 to 1 of the first channel, and their number a second."""
    with wave.open(io.BytesIO(data)) as f:
        width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
        raw = f.readframes(f.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float64) - 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float64)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float64)
    return x[::channels] / 2.0 ** (8 * width - 1), rate


def pieces(x: np.ndarray, rate: int, ms: int = SAMPLE_MS) -> np.ndarray:
    """(samples, length): consecutive samples of so many milliseconds, the last one filled with zeros."""
    n = max(1, rate * ms // 1000)
    count = -(-len(x) // n)
    return np.pad(x, (0, count * n - len(x))).reshape(count, n)


def spectrum(samples: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies from 20 Hz to 20 kHz, and the decibels of every sample at them."""
    power = np.abs(np.fft.rfft(samples, axis=1)) ** 2 / samples.shape[1] ** 2
    freq = np.fft.rfftfreq(samples.shape[1], 1 / rate)
    heard = (freq >= BANDS[0]) & (freq <= HIGHEST)
    return freq[heard], 10 * np.log10(power[:, heard] + 1e-20)


def note(freq: np.ndarray) -> np.ndarray:
    """Name of the nearest semitone, as a position in NOTES."""
    return (np.rint(12 * np.log2(np.maximum(freq, 1e-9) / 440.0)).astype(np.int64) + 9) % 12


def hashes(samples: np.ndarray, rate: int) -> list[str]:
    """For every sample the loudest note of each band that the rate can hold, joined by -; silence gives an empty hash."""
    freq, db = spectrum(samples, rate)
    loud = []
    for low, high in zip(BANDS, (*BANDS[1:], HIGHEST)):
        inside = np.flatnonzero((freq >= low) & (freq < high))
        if len(inside):
            loud.append(note(freq[inside])[db[:, inside].argmax(1)])
    names = np.array(NOTES)
    silent = ~samples.any(1)
    return ["" if s else "-".join(names[[b[i] for b in loud]]) for i, s in enumerate(silent)]


def read_sounds(spark, folder: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """(path, content) of the WAVE files of a folder, optionally of those changed between two times."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true")
    if first:
        reader = reader.option("modifiedAfter", first)
    if last:
        reader = reader.option("modifiedBefore", last)
    return reader.load(folder).select("path", "content")


def index(sounds: DataFrame, ident: str = "path", content: str = "content", ms: int = SAMPLE_MS) -> DataFrame:
    """(ident, at, hash): a row for every sample that isn't silent; files that can't be read, and null ones, have none."""

    @F.pandas_udf("array<string>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(data):
            try:
                x, rate = read_wave(data)
            except (wave.Error, EOFError, TypeError, ValueError):
                return []
            return hashes(pieces(x, rate, ms), rate)

        for s in batches:
            yield s.map(one)

    return sounds.select(F.col(ident).alias(ident), F.posexplode(made(F.col(content))).alias("at", "hash")).where("hash <> ''")


def inverted(indexed: DataFrame, ident: str = "path") -> DataFrame:
    """(hash, sounds): which sounds have a hash, in order."""
    return indexed.groupBy("hash").agg(F.array_sort(F.collect_set(ident)).alias("sounds"))


def match(samples: DataFrame, indexed: DataFrame, ident: str = "path", least: float = 0.5) -> DataFrame:
    """(query, sound, score): for each query (query, hash rows) the sound that holds most of its samples, if more than `least` of them; ties by name."""
    total = samples.groupBy("query").agg(F.count("*").alias("samples"))
    known = indexed.select("hash", F.col(ident).alias("sound")).distinct()
    hits = samples.join(known, "hash").groupBy("query", "sound").agg(F.count("*").alias("hits"))
    best = hits.groupBy("query").agg(F.min(F.struct(-F.col("hits"), "sound")).alias("b"))
    scored = best.join(total, "query").select("query", "b.sound", (-F.col("b.col1") / F.col("samples")).alias("score"))
    return scored.where(F.col("score") > least)


def similar_sounds(indexed: DataFrame, ident: str = "path") -> DataFrame:
    """(src, dst, shared, weight): sounds that share hashes, by the shared part of src's."""
    return graph.containment(indexed, ident, "hash")
