"""Helpers shared by the operators: stage tables, word hashing over Arrow batches, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from threatloom.session import work_folder

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def stage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder as Parquet and go on from there: lineage is cut and a lost executor costs a re-read."""
    path = f"{work_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark, rows: int = 1000):
    """Fewer rows per Arrow batch for the scans inside: a batch of whole texts is held on both sides of a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Powers:
    """Powers of the base and of its inverse, grown when a longer stretch turns up."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * CHUNK_BYTES)
            steps = np.full(size, _BASE, np.uint64)
            steps[0] = 1
            cls.up = np.cumprod(steps, dtype=np.uint64)
            steps = np.full(size, _BASE_INVERSE, np.uint64)
            steps[0] = 1
            cls.down = np.cumprod(steps, dtype=np.uint64)
        return cls.up, cls.down


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the offsets of each text in them; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least, so that work arrays stay small."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word ``[^\\x20\\x09-\\x0D]+``, and the number of words before each text."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(_SPACE[data], out=inside[:-1])
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[offsets] = False  # a word ends with its text
    starts = np.flatnonzero(inside & ~before)
    # A word ends where the next byte is white space or belongs to another text.
    after = inside.copy()
    after[offsets] = False
    ends = np.flatnonzero(inside[:-1] & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, A-Z lower-cased; equal words hash alike on every machine."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        origin = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, origin + CHUNK_BYTES, "right")))
        stretch = _LOWER[data[origin : ends[last - 1]]].astype(np.uint64)
        up, down = _Powers.upto(len(stretch) + 1)
        total = np.zeros(len(stretch) + 1, np.uint64)
        np.cumsum((stretch + np.uint64(1)) * up[: len(stretch)], out=total[1:])
        begin = starts[first:last] - origin
        out[first:last] = mixed((total[ends[first:last] - origin] - total[begin]) * down[begin])
        first = last
    return out


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    factors = mixed(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    data, offsets = byte_view(texts)
    for first, last in row_chunks(offsets):
        part = data[offsets[first] : offsets[last]]
        starts, ends, counts = word_bounds(part, offsets[first : last + 1] - offsets[first])
        hashes = word_hashes(part, starts, ends)
        total = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for j in range(words):
            total += hashes[j : j + len(total)] * factors[j]
        total = mixed(total)
        for row in range(last - first):
            low, high = int(counts[row]), int(counts[row + 1])
            if high - low >= words:
                found = np.sort(total[low : high - words + 1])
                yield found[np.append(True, found[1:] != found[:-1])]
            elif high > low:
                short = (hashes[low:high] * factors[: high - low]).sum(dtype=np.uint64) + np.uint64(words * 8 + high - low)
                yield mixed(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def word_counts(texts: pa.Array) -> np.ndarray:
    """Number of words of each text; 0 for null."""
    data, offsets = byte_view(texts)
    out = np.zeros(len(texts), np.int64)
    for first, last in row_chunks(offsets):
        counts = word_bounds(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])[2]
        out[first:last] = np.diff(counts)
    return out


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``links(a, b)``, as ``(node, label)``.

    Labels spread to neighbours as minima, and every label is replaced by the label of the node it names, which shortens
    chains by half per round.  All by joins and aggregates; nothing is gathered per component.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct().toDF("node", "next"))
    labels = stage(both.groupBy("node").agg(F.min("next").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        far = labels.select(F.col("node").alias("next"), "label")
        spread = both.join(far, "next").select("node", "label", F.lit(None).cast("bigint").alias("old"))
        nearest = labels.select("node", "label", F.col("label").alias("old")).union(spread).groupBy("node").agg(
            F.min("label").alias("label"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("to"))
        moved = Observation()
        labels = stage(
            nearest.join(jump, "label", "left").select("node", F.coalesce("to", "label").alias("label"), "old")
            .observe(moved, F.sum(F.when(F.col("label") != F.col("old"), 1).otherwise(0)).alias("rows"))).select("node", "label")
        if not moved.get["rows"]:
            return labels
