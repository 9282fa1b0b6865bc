"""Token counts per field and section: documents are encoded once, token spans are joined to section spans."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from threatloom.llm.tokens import byte_bpe, default_path

RULES = ("first", "most")
_SECTION = StructType([StructField("field", IntegerType()), StructField("section", IntegerType()), StructField("start", LongType()),
                       StructField("end", LongType()), StructField("tokens", LongType())])
_ARROW = pa.list_(pa.struct([("field", pa.int32()), ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("tokens", pa.int64())]))
SEPARATOR = "\n\n"


def sections_of(raw: bytes) -> np.ndarray:
    """Ends of the sections of a field: a section ends behind a run of line ends; an empty field is one empty section."""
    data = np.frombuffer(raw, np.uint8)
    line_end = data == 10
    ends = np.flatnonzero(line_end[:-1] & ~line_end[1:]) + 1
    return np.append(ends, len(data))


def attribute(spans: np.ndarray, edges: np.ndarray, rule: str = "most") -> np.ndarray:
    """Number of tokens of each section.

    ``spans`` are the ends of the tokens, ``edges`` the ends of the sections, both over the same bytes from 0.  A token inside a
    section is its own.  A token across a boundary goes to the section of its first byte (``first``), or to the one that
    holds most of its bytes, the earlier on a tie (``most``).  Every token is counted once.
    """
    starts = np.append(0, spans)[:-1]
    first = np.searchsorted(edges, starts, "right")
    owner = first.copy()
    if rule == "most":
        last = np.searchsorted(edges, spans - 1, "right")
        for token in np.flatnonzero(last > first):
            inner = edges[first[token] : last[token]]
            cuts = np.concatenate(([starts[token]], inner, [spans[token]]))
            owner[token] = first[token] + int(np.diff(cuts).argmax())
    return np.bincount(owner, minlength=len(edges))


def section_tokens(docs: DataFrame, id_col: str = "doc_id", fields: Sequence[str] = ("text",), path: str | None = None, rule: str = "most") -> DataFrame:
    """One row per document: ``doc_id, n_tokens, sections``, the sections as ``field, section, start, end, tokens``.

    The fields of a document, each followed by a blank line if another comes after it, are one text that is encoded once;
    ``start`` and ``end`` are character positions in it.  A blank line between fields belongs to the field before.  A null
    field counts as empty; an empty field is one section without tokens (or with those of its blank line).  Sections cover
    the whole text, so their tokens add up to ``n_tokens``.  Repeated rows come out as they came in; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or default_path()
    last = len(fields) - 1

    def of_row(texts: list, bpe) -> list:
        parts = [((text or "") + (SEPARATOR if i < last else "")) for i, text in enumerate(texts)]
        whole = "".join(parts)
        spans = np.cumsum(bpe.byte_length[bpe.ids(whole)])
        names, numbers, edges, base = [], [], [], 0
        for i, part in enumerate(parts):
            raw = part.encode()
            ends = sections_of(raw)
            names += [i] * len(ends)
            numbers += range(len(ends))
            edges.append(ends + base)
            base += len(raw)
        edges = np.concatenate(edges)
        counts = attribute(spans, edges, rule)
        # Character positions: bytes that begin a character, counted up to each edge.
        begins = np.append(0, np.cumsum((np.frombuffer(whole.encode(), np.uint8) & 0xC0) != 0x80))
        ends = begins[edges]
        starts = np.append(0, ends[:-1])
        return list(zip(names, numbers, starts.tolist(), ends.tolist(), counts.tolist(), strict=True))

    @F.arrow_udf(ArrayType(_SECTION))
    def counted(*columns: pa.Array) -> pa.Array:
        bpe = byte_bpe(path)
        keys = ("field", "section", "start", "end", "tokens")
        flat, offsets = [], [0]
        for row in zip(*[c.to_pylist() for c in columns], strict=True):
            flat += of_row(list(row), bpe)
            offsets.append(len(flat))
        columns_out = list(zip(*flat, strict=True)) or [[]] * len(keys)
        items = pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(columns_out, _ARROW.value_type, strict=True)], fields=list(_ARROW.value_type))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)

    out = docs.select(F.col(id_col).alias("doc_id"), counted(*[F.col(f).cast("string") for f in fields]).alias("sections"))
    total = F.aggregate("sections", F.lit(0).cast("bigint"), lambda acc, s: acc + s.tokens)
    return out.select("doc_id", total.alias("n_tokens"), "sections")


def exploded(counts: DataFrame) -> DataFrame:
    """One row per section."""
    return counts.select("doc_id", "n_tokens", F.explode("sections").alias("s")).select("doc_id", "n_tokens", "s.*")
