"""Shared plumbing: reading tables, spreading small inputs over the cores."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cuts import cut, from_files, release, spread  # noqa: F401

#: Rows and bytes that one Arrow batch carries to Python, whichever come first: 2,000 texts of a megabyte would be two gigabytes. Every
#: operator cuts its batches further, into slices of whole documents of about SLICE_BYTES.
ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20
SLICE_BYTES = 1 << 20
_HELD: dict = {}


def tune(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def trim() -> None:
    """Gives free memory of this Python worker back: workers outlive their tasks, and the next operator needs the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def held(owner: str, key: str, make):
    """What a worker keeps from task to task (a tokenizer, an automaton), made once. A worker holds things of one operator at a
    time: those of others are let go."""
    if any(o != owner for o, _ in _HELD):
        _HELD.clear()
        trim()
    if (owner, key) not in _HELD:
        _HELD[owner, key] = make()
    return _HELD[owner, key]
