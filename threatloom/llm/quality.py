"""Document quality by regularised quadratic discriminant analysis over transformed text statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from threatloom.llm.common import byte_view, row_chunks, stage, word_bounds, word_hashes

FEATURES = ("bytes", "words", "word length", "upper case", "punctuation", "digits", "symbols", "spaces", "line length",
            "distinct words", "commonest word", "repeats of the word before", "words ending in a symbol",
            "words in capitals", "beyond ASCII", "distinct trigrams", "distinct lines", "sentence ends", "exclamation marks",
            "equal bytes in a row")
_WIDTH = len(FEATURES)


def _mask(signs: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(signs.encode())] = True
    return out


_UPPER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _mask("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _mask("0123456789")
_POINT = _mask(".,;:?'\"()-")
_SYMBOL = _mask("#$%&*|@^~=<>{}[]\\/_+`")
_BLANK = _mask(" \t\n\r\v\f")
_END = _mask(".?")
_CLOSER = np.append(_mask("\n"), False)


def _distinct(values: np.ndarray) -> tuple[int, int]:
    """Number of different values and count of the commonest."""
    if not len(values):
        return 0, 0
    ordered = np.sort(values)
    edges = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return len(edges), int(np.diff(np.append(edges, len(ordered))).max())


def text_statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text, each brought near to a normal shape by a log or a root; zeros for an empty text."""
    data, offsets = byte_view(texts)
    out = np.zeros((len(texts), _WIDTH))
    for first, last in row_chunks(offsets):
        part = data[offsets[first] : offsets[last]]
        at = offsets[first : last + 1] - offsets[first]
        starts, ends, counts = word_bounds(part, at)
        hashes = word_hashes(part, starts, ends)
        size, words = np.diff(at), np.diff(counts)

        def per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
            return np.diff(np.append(0, np.cumsum(flags))[edges])

        share = 1.0 / np.maximum(size, 1)
        word_share = 1.0 / np.maximum(words, 1)
        upper = np.append(0, np.cumsum(_UPPER[part]))
        letters = upper[ends] - upper[starts]
        lower = np.append(0, np.cumsum(_LOWER[part]))
        capitals = (letters >= 2) & (lower[ends] == lower[starts])
        closing = _SYMBOL[part[ends - 1]] | (part[ends - 1] == 33)
        same = np.zeros(len(hashes), bool)
        same[1:] = hashes[1:] == hashes[:-1]
        row_start = counts[:-1][words > 0]
        same[row_start] = False
        equal = np.zeros(len(part), bool)
        equal[1:] = (part[1:] == part[:-1]) & ~_BLANK[part[1:]]
        lines = per_text(part == 10, at) + 1
        block = out[first:last]
        block[:, 0] = np.log1p(size)
        block[:, 1] = np.log1p(words)
        block[:, 2] = np.log1p(per_text(~_BLANK[part], at) * word_share)
        for column, table in ((3, _UPPER), (4, _POINT), (5, _DIGIT), (6, _SYMBOL), (7, _BLANK)):
            block[:, column] = np.sqrt(per_text(table[part], at) * share)
        block[:, 8] = np.log1p(size / lines)
        block[:, 11] = np.sqrt(per_text(same, counts) * word_share)
        block[:, 12] = np.sqrt(per_text(closing, counts) * word_share)
        block[:, 13] = np.sqrt(per_text(capitals, counts) * word_share)
        block[:, 14] = np.sqrt(per_text(part >= 128, at) * share)
        block[:, 17] = np.sqrt(per_text(_END[part], at) * word_share)
        block[:, 18] = np.sqrt(per_text(part == 33, at) * word_share)
        block[:, 19] = np.sqrt(per_text(equal, at) * share)
        breaks = np.flatnonzero(part == 10)
        triples = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7) if len(hashes) > 2 else hashes[:0]
        word_total = np.append(np.uint64(0), np.cumsum(hashes * (starts.astype(np.uint64) * np.uint64(0) + np.uint64(1)), dtype=np.uint64))
        for row in range(last - first):
            low, high = int(counts[row]), int(counts[row + 1])
            if low == high:
                continue
            kinds, most = _distinct(hashes[low:high])
            block[row, 9] = np.log(kinds / (high - low))
            block[row, 10] = np.sqrt(most / (high - low))
            if high - low > 2:
                block[row, 15] = np.sqrt(1 - _distinct(triples[low : high - 2])[0] / (high - low - 2))
            inside = breaks[np.searchsorted(breaks, at[row]) : np.searchsorted(breaks, at[row + 1])]
            edges = np.searchsorted(starts, np.concatenate(([at[row]], inside, [at[row + 1]])))
            # A line is known by the sum of its word hashes; blank lines are no lines.
            sums = (word_total[edges[1:]] - word_total[edges[:-1]])[edges[1:] > edges[:-1]]
            block[row, 16] = np.sqrt(1 - _distinct(sums)[0] / len(sums))
    return out


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians with shrunken covariances, kept as inverse Cholesky factors."""

    means: np.ndarray
    whiteners: np.ndarray
    constants: np.ndarray
    softness: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of label 1 minus that of label 0, priors included."""
        logs = [c - 0.5 * ((((x - m) @ w.T) ** 2).sum(axis=1)) for m, w, c in zip(self.means, self.whiteners, self.constants, strict=True)]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The margin laid over 0 to 1 without saturating, 0.5 where both labels are equally likely."""
        return 0.5 + np.arctan(self.margin(x) / self.softness) / np.pi


def fitted(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrink: float, softness: float = 10.0) -> Discriminant:
    """Model from class counts, sums and sums of outer products; covariances shrink towards the pooled one and its diagonal."""
    counts = np.maximum(counts, 1.0)
    means = sums / counts[:, None]
    own = squares / counts[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (own * counts[:, None, None]).sum(axis=0) / counts.sum()
    floor = np.eye(_WIDTH) * 1e-4
    whiteners, constants = [], []
    for k in range(2):
        target = 0.5 * pooled + 0.5 * np.diag(np.diag(pooled))
        factor = np.linalg.cholesky((1 - shrink) * own[k] + shrink * target + floor)
        whiteners.append(np.linalg.inv(factor))
        constants.append(np.log(counts[k] / counts.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whiteners), np.array(constants), softness)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * width, width, dtype=np.int32)), pa.array(values.reshape(-1)))


@F.arrow_udf(ArrayType(DoubleType()))
def statistics_of(texts: pa.Array) -> pa.Array:
    return _lists(text_statistics(texts))


def train(features: DataFrame, labels: DataFrame, shrink: float = 0.1) -> Discriminant:
    """Fit on the labelled rows of ``features(doc_id, x)`` that are not held out.

    Every task adds up counts, sums and outer products of its rows; these fixed-size sums are added by position, so only
    one set of them reaches the driver.  Labels other than 0 and 1 are left; several labels of one id all count.
    """
    known = labels.where("quality IN (0, 1)").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    rows = features.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("label", "x")

    def sums(batches):
        total = np.zeros((2, 1 + _WIDTH + _WIDTH * _WIDTH))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, _WIDTH)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            for k in range(2):
                mine = x[y == k]
                total[k] += np.concatenate(([len(mine)], mine.sum(axis=0), (mine.T @ mine).reshape(-1)))
        places = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total.reshape(-1))], names=["place", "value"])

    parts = rows.mapInArrow(sums, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value"))
    total = np.zeros(2 * (1 + _WIDTH + _WIDTH * _WIDTH))
    for place, value in parts.collect():
        total[place] = value
    total = total.reshape(2, -1)
    return fitted(total[:, 0], total[:, 1 : 1 + _WIDTH], total[:, 1 + _WIDTH :].reshape(2, _WIDTH, _WIDTH), shrink)


def features_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return stage(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), statistics_of(F.col(text_col)).alias("x")))


def score_of_text(model: Discriminant, text: Column) -> Column:
    """Score straight from a text column; the other columns of the row stay where they are."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(text_statistics(texts)))

    return score(text)


def score(features: DataFrame, model: Discriminant) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``features``.

    A null or empty text has the statistics of an empty text and gets its score.  Rows come out as often as they came in.
    """
    @F.arrow_udf("double")
    def scored(x: pa.Array) -> pa.Array:
        return pa.array(model.score(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, _WIDTH)))

    out = features.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
