"""Blocks of documents that exchange their distinct keys with a corpus-wide table.

A corpus-wide lookup (the ids of a word, the count of an n-gram) by every token would shuffle every token. Instead each run of
whole documents of about ``BLOCK_BYTES`` sends each of its distinct keys once, packed by bucket; a bucket sees all blocks' keys of
its hash range, answers, and the answers meet the block's compressed texts again by the block's name. The name is a digest
of the block's content, so a retried or repeated task gives the same name, and equal blocks share answers.
What is shuffled: distinct keys by block, answers, and the text once, compressed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .base import cut, from_files, spread
from .kernel import flat, slices

BLOCK_BYTES = 8 << 20


def pack(a: np.ndarray | bytes) -> bytes:
    """Compressed; arrays by byte planes, which is what small numbers and small differences need."""
    if isinstance(a, np.ndarray):
        a = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
    return zstandard.ZstdCompressor(level=3).compress(a)


def unpack(x: bytes, dtype=None):
    data = zstandard.ZstdDecompressor().decompress(x)
    if dtype is None:
        return data
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a 64-bit hash; it never falls as the hash rises."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def settled(df: DataFrame) -> DataFrame:
    """``df``, such that reading it again gives the same batches: as it is where it comes straight from files, else written once.

    What stands behind a shuffle may be dealt otherwise when it is read again (adaptive plans, lost executors).
    """
    return df if from_files(df) else cut(df)


def rows_of(df: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    return settled(spread(df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"), *more)))


def blocks(batches, limit: int):
    """(name, batch slice, bytes, offsets) of each block."""
    for batch in batches:
        data, ends = flat(batch.column(1))
        for a, b in slices(ends, limit):
            part, cuts = data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
            own = batch.slice(a, b - a)
            name = hashlib.blake2b(part.tobytes(), digest_size=16)
            name.update(cuts.tobytes())
            name.update(repr(own.column(0).to_pylist()).encode())
            yield name.hexdigest(), own, part, cuts


def texts(df: DataFrame, limit: int, extra: str = "") -> DataFrame:
    """(block, ids, sizes, data, bytes[, flags]): a compressed row a block. ``extra``: a boolean column that goes along."""

    def run(batches):
        for name, own, part, cuts in blocks(batches, limit):
            ids = pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column(0))
            columns = [pa.array([name]), ids, pa.array([pack(np.diff(cuts))], pa.binary()), pa.array([pack(part.tobytes())], pa.binary()), pa.array([len(part)])]
            names = ["block", "ids", "sizes", "data", "bytes"]
            if extra:
                columns.append(pa.array([pack(own.column(2).to_numpy(zero_copy_only=False).astype(np.uint8))], pa.binary()))
                names.append("flags")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"block string, ids array<{kind}>, sizes binary, data binary, bytes long" + ", flags binary" * bool(extra))


def opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a row of ``texts``."""
    sizes = unpack(row["sizes"], np.int64)
    return np.frombuffer(unpack(row["data"]), np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
