"""A table of bits of bounded size that tells tasks which rows may be among many chosen ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gristmill.llm._arrays import mix

#: Most bits of a table (64 MB). Beyond some 100 million chosen rows more of the others pass it; callers sort these out later.
MOST = 1 << 29
PIECE = 1 << 16


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mix(hashes.astype(np.int64).view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def passing(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of 64-bit hashes are set; true for all chosen ones."""
    at = _places(hashes, table.size * 8)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _setter(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_numpy(), bits))
            if len(at):
                piece = at // PIECE
                first = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
                made = [_bitmap(part % PIECE).tobytes() for part in np.split(at, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(piece[first]), pa.array(made, pa.binary())], names=["piece", "bits"])

    return run


def _bitmap(places: np.ndarray) -> np.ndarray:
    solid = np.zeros(PIECE, bool)
    solid[places] = True
    return np.packbits(solid, bitorder="little")


def _united(key: tuple, table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(b.as_buffer(), np.uint8) for b in table.column("bits")]
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary())})


def bit_table(chosen: DataFrame, n: int) -> np.ndarray:
    """Bytes with the bits of n chosen hashes (one bigint column, none null): 16 bits for each of them, MOST in all at most."""
    bits = min(MOST, max(PIECE, 1 << (16 * n).bit_length()))
    pieces = chosen.mapInArrow(_setter(bits), "piece bigint, bits binary").groupBy("piece").applyInArrow(_united, "piece bigint, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in pieces.toLocalIterator():  # at most bits / 8 bytes
        at = r["piece"] * (PIECE // 8)
        out[at : at + PIECE // 8] = np.frombuffer(r["bits"], np.uint8)
    return out
