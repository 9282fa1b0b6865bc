"""Packing documents into training sequences by an order-preserving dynamic programme."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import byte_view, row_chunks
from threatloom.llm.tokens import byte_bpe, default_path

BLOCK_BYTES = 8 << 20
GRID = 64
SENTENCE_PENALTY, GRID_PENALTY = 2, 24
_OUT = "doc_id bigint, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                     ("sequence_id", pa.int64()), ("offset", pa.int64())])


def best_cuts(places: list[int], penalties: list[int], length: int) -> tuple[list[int], int]:
    """Cuts (as indexes into ``places``) that minimise padding plus penalties, with every window at most ``length``.

    ``places`` ascend from 0, neighbours at most ``length`` apart.  A window from place j to place i costs
    ``length - (p_i - p_j) + penalty_i``, so the best j minimises ``cost_j + p_j`` among those within reach: a queue with
    rising values gives it in constant time per place.
    """
    n = len(places)
    cost, back = [0] * n, [0] * n
    queue, values, head = [0], [0], 0
    for i in range(1, n):
        p = places[i]
        while places[queue[head]] < p - length:
            head += 1
        back[i] = queue[head]
        total = values[head] + length - p + penalties[i]
        cost[i] = total
        value = total + p
        while len(values) > head and values[-1] >= value:
            values.pop()
            queue.pop()
        values.append(value)
        queue.append(i)
    cuts, i = [], n - 1
    while i:
        cuts.append(i)
        i = back[i]
    return cuts[::-1], cost[-1]


def window_ends(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, length: int) -> np.ndarray:
    """End of every sequence over the ids of a block.

    A cut is free at the end of a document, cheap after a sentence, dearer at a grid place inside a sentence; the grid
    keeps text without any boundary packable.  The rest behind the last full stretch may end at powers of two, which need
    no padding, where that saves more padding than its cuts cost.
    """
    total = int(doc_ends[-1])
    penalty = np.full(total + 1, -1, np.int64)
    penalty[:: min(GRID, length)] = GRID_PENALTY
    penalty[np.flatnonzero(sentence_end[ids]) + 1] = SENTENCE_PENALTY
    penalty[doc_ends] = 0
    penalty[0] = 0
    places = np.flatnonzero(penalty >= 0)
    cuts, _ = best_cuts(places.tolist(), penalty[places].tolist(), length)
    ends = places[cuts]
    last = int(ends[-2]) if len(ends) > 1 else 0
    rest = total - last
    powers = [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]
    if rest < length and (len(powers) - 1) * GRID_PENALTY < length - rest:
        ends = np.append(ends[:-1], last + np.cumsum(powers))
    return ends


def _pack_block(numbers: list, ids_of: list[np.ndarray], sentence_end: np.ndarray, length: int, first: int) -> tuple[pa.RecordBatch, int]:
    ids = np.concatenate(ids_of)
    doc_ends = np.cumsum([len(x) for x in ids_of])
    doc_starts = doc_ends - np.array([len(x) for x in ids_of])
    ends = window_ends(ids, doc_ends, sentence_end, length)
    edges = np.union1d(np.append(ends, 0), doc_ends)
    low, high = edges[:-1], edges[1:]
    doc = np.searchsorted(doc_ends, low, "right")
    window = np.searchsorted(ends, low, "right")
    window_start = np.append(0, ends[:-1])[window]
    raw = ids.astype("<u4")
    offsets = np.append(low, high[-1]).astype(np.int64) * 4
    # Pieces lie one after another over the whole block, so its bytes are the bytes of the binary column.
    pieces = pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
    out = pa.RecordBatch.from_arrays([
        pa.array([numbers[i] for i in doc], pa.int64()), pa.array(low - doc_starts[doc]), pieces, pa.array((doc_ends - doc_starts)[doc]),
        pa.array(first + window), pa.array(low - window_start)], schema=_SCHEMA)
    return out, first + len(ends)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces ``doc_id, start, ids (little-endian 32-bit), doc_tokens, sequence_id, offset``.

    Each task packs the documents of its input partition in their order, in blocks of about 8 MB of text, so there is no
    shuffle and memory is bounded by a block (or by one longer document).  A null text counts as empty: its only id is
    ``end_id``.  Repeated rows are packed as often as they occur; an id that is null stays null.  Sequence numbers are
    unique: the partition number stands in the high bits.  A lost task packs the same rows again to the same result.
    Other columns are ignored; an empty table gives no rows.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        sequence = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts, numbers = batch.column(1), batch.column(0)
            _, offsets = byte_view(texts)
            for first, last in row_chunks(offsets, BLOCK_BYTES):
                ids_of = [np.append(bpe.ids(text or ""), np.uint32(end_id)) for text in texts[first:last].to_pylist()]
                out, sequence = _pack_block(numbers[first:last].to_pylist(), ids_of, bpe.ends_sentence, length, sequence)
                yield out

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _OUT)
