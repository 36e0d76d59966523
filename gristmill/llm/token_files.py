"""Token ids in flat binary files with 64-bit document offsets, read through memory maps.

Every task tokenizes its rows and appends the ids to one file of unsigned
integers (16 bits where the vocabulary allows it, else 32). The files' first
positions in the whole corpus are prefix sums of their lengths, so no text and
no token is shuffled. A second small pass writes each file's offsets: n + 1
unsigned 64-bit positions in the corpus.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm._frames import quoted
from gristmill.storage import mounted, new_folder, write_once

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
END_OF_TEXT = 50256


@lru_cache(maxsize=2)
def encoding(vocabulary: str, pattern: str = PATTERN):
    """Byte-level BPE of a file of ``base64 rank`` lines."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _writer(folder: str, vocabulary: str, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, place, row, out = TaskContext.get().partitionId(), 0, 0, None
        file = f"{shard:06d}-{uuid.uuid4().hex}.ids"  # of this attempt
        tokenizer = encoding(vocabulary)
        kind = np.uint16 if max(tokenizer.n_vocab - 1, end or 0) < 2**16 else np.uint32
        tail = np.zeros(0, kind) if end is None else np.array([end], kind)
        for batch in batches:
            if out is None:
                os.makedirs(folder, exist_ok=True)
                out = open(f"{folder}/{file}", "wb")
            counts = []
            for text in batch.column(1):
                text = text.as_py()
                ids = np.zeros(0, kind) if text is None else np.concatenate((tokenizer.encode_to_numpy(text, disallowed_special=()).astype(kind), tail))
                out.write(ids.tobytes())
                counts.append(len(ids))
            n = np.array(counts, np.int64)
            starts = place + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), shard, np.int32)), pa.array([file] * len(n), pa.string()), pa.array(row + np.arange(len(n))), batch.column(0), pa.array(starts), pa.array(n)],
                names=["shard", "file", "row", "doc_id", "start", "n_tokens"],
            )
            place, row = place + int(n.sum()), row + len(n)
        if out is not None:
            out.flush()
            os.fsync(out.fileno())
            out.close()

    return run


def _offsets(folder: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        start, n = (table.column(c).to_numpy() for c in ("start", "n_tokens"))
        write_once(f"{folder}/{table.column('shard')[0].as_py():06d}.offsets", np.append(start, start[-1] + n[-1]).astype(np.uint64).tobytes())
        return table.select(["doc_id", "shard", "row", "start", "n_tokens"]).rename_columns(["doc_id", "shard", "row_in_shard", "token_offset", "n_tokens"])

    return run


def write_token_files(
    docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, end_of_text: int | None = END_OF_TEXT, text: str = "text", ident: str = "doc_id"
) -> DataFrame:
    """Tokenize all texts into folder (below the shared folder if None) and return where each document lies.

    Output: doc_id, shard, row_in_shard, token_offset (position in the whole
    corpus), n_tokens. Every text is followed by end_of_text unless that is
    None. A null text has no tokens at all; an empty one only the end. Repeated
    rows are written each time. With an empty table the result is empty and the
    folder has a manifest without shards.

    Every attempt of a task writes a file of its own, whose name is in its rows.
    The manifest has the files of the attempts whose rows were committed, so
    lost executors do no harm even where an input's order changes between
    attempts; files of other attempts are removed. vocabulary is a file of
    ``base64 rank`` lines.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    path = mounted(folder)
    kind = docs.schema[ident].dataType.simpleString()
    rows = docs.select(F.col(quoted(ident)).alias("doc_id"), F.col(quoted(text)).alias("text")).mapInArrow(
        _writer(path, vocabulary, end_of_text), f"shard int, file string, row bigint, doc_id {kind}, start bigint, n_tokens bigint"
    )
    rows.write.parquet(f"{folder}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    sizes = rows.groupBy("shard", "file").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).collect()  # one row a task
    manifest = {
        "dtype": "uint16" if max(encoding(vocabulary).n_vocab - 1, end_of_text or 0) < 2**16 else "uint32",
        "vocabulary": os.path.basename(vocabulary),
        "end_of_text": end_of_text,
        "shards": [{"shard": r["shard"], "file": r["file"], "base": r["base"], "tokens": r["tokens"], "docs": r["docs"]} for r in bases],
    }
    write_once(f"{path}/manifest.json", json.dumps(manifest).encode())
    kept = {s["file"] for s in manifest["shards"]}
    for name in os.listdir(path):
        if name.endswith(".ids") and name not in kept:
            os.remove(f"{path}/{name}")
    base = spark.createDataFrame([(r["shard"], r["base"]) for r in bases], "shard int, base bigint")
    placed = rows.join(F.broadcast(base), "shard").select("shard", "row", "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens")
    result = placed.groupBy("shard").applyInArrow(_offsets(path), f"doc_id {kind}, shard int, row_in_shard bigint, token_offset bigint, n_tokens bigint")
    result.write.parquet(f"{folder}/index")
    return spark.read.schema(result.schema).parquet(f"{folder}/index")


class TokenFiles:
    """Memory-mapped view of a folder that write_token_files made."""

    def __init__(self, folder: str):
        self.folder = mounted(folder)
        with open(f"{self.folder}/manifest.json") as f:
            self.manifest = json.load(f)
        self.bases = np.array([s["base"] for s in self.manifest["shards"]], np.int64)
        self._maps: dict[int, np.ndarray] = {}

    def shard(self, k: int) -> np.ndarray:
        """Token ids of the k-th shard of the manifest."""
        if k not in self._maps:
            s = self.manifest["shards"][k]
            kind = np.dtype(self.manifest["dtype"])
            self._maps[k] = np.memmap(f"{self.folder}/{s['file']}", kind, "r") if s["tokens"] else np.zeros(0, kind)
        return self._maps[k]

    def offsets(self, k: int) -> np.ndarray:
        return np.memmap(f"{self.folder}/{self.manifest['shards'][k]['shard']:06d}.offsets", np.uint64, "r")

    def tokens(self, offset: int, n: int) -> np.ndarray:
        """The n ids from a position in the corpus, within one document."""
        if n == 0:
            return np.zeros(0, self.manifest["dtype"])
        k = int(np.searchsorted(self.bases, offset, "right")) - 1
        at = offset - int(self.bases[k])
        return self.shard(k)[at : at + n]
