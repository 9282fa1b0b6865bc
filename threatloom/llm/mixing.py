"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from threatloom.functions.skew import salted_join
from threatloom.llm.common import stage, word_counts

SEED = "mix-1"
_BUCKET_DIGITS = 3
_KEYS = ["no_source", "source_key"]


@F.arrow_udf(LongType())
def words_of(texts: pa.Array) -> pa.Array:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    return pa.array(word_counts(texts))


def draw_key(doc_id: Column, seed: str) -> Column:
    """Seeded place of a document in the order in which fractional repetitions are drawn."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def keyed(df: DataFrame, source: str) -> DataFrame:
    """Adds the source as two columns that are never null."""
    return df.withColumn("no_source", F.col(source).isNull()).withColumn("source_key", F.coalesce(F.col(source).cast("string"), F.lit("")))


def _ranked(sources: DataFrame) -> DataFrame:
    """Place of each source by code point, null last: range partitions are numbered one by one and added up."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(sources.repartitionByRange(parts, *_KEYS).withColumn("part", F.spark_partition_id()))
    before = dealt.groupBy("part").agg(F.count("*").alias("rows")).select(
        "part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*_KEYS))
    return dealt.withColumn("inside", inside).join(before, "part").withColumn("place", F.col("before") + F.col("inside") - 1).drop("part", "inside", "before")


def _level(sources: DataFrame, max_epochs: float) -> float:
    """Words per unit of weight once every source above its cap is clamped and the excess is shared out again."""
    cap = F.col("source_size") * F.lit(max_epochs)
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return 0.0
    level = total / weight
    while True:
        full = cap < F.lit(level) * F.col("weight")
        capped, free = sources.agg(
            F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if not free:
            return float("inf")
        higher = (total - capped) / free
        if higher == level:
            return level
        level = higher


def source_plan(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: float = 3.0) -> DataFrame:
    """One row per source: ``source_size, target, whole, cutoff`` for rows ``(no_source, source_key, size, draw)``.

    Every document is taken ``whole`` times, those with ``draw <= cutoff`` once more.  The cutoff is the end of the shortest
    run of documents, in seeded order, that comes nearest to the words still missing; it is found from sums per slice
    of the order, so that no source is sorted in one task.
    """
    totals = stage(sized.groupBy(*_KEYS).agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stage(_ranked(totals).withColumn("weight", weight).drop("place"))
    level = _level(sources, max_epochs)
    target = F.least(F.col("source_size") * F.lit(float(max_epochs)), F.lit(level) * F.col("weight"))
    sources = sources.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = stage(sources.withColumn("whole", whole.cast("int")).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size")))
    # Equal draws (repeated ids) stand or fall together.
    draws = sized.groupBy(*_KEYS, "draw").agg(F.sum("size").alias("size")).withColumn("slice", F.substring("draw", 1, _BUCKET_DIGITS))
    draws = stage(draws)
    in_order = Window.partitionBy(*_KEYS).orderBy("slice")
    slices = draws.groupBy(*_KEYS, "slice").agg(F.sum("size").alias("slice_size")).withColumn(
        "before", F.sum("slice_size").over(in_order) - F.col("slice_size"))
    slices = slices.join(sources.select(*_KEYS, "missing"), _KEYS).where("before < missing")
    inside = Window.partitionBy(*_KEYS, "slice").orderBy("draw")
    cutoffs = (
        draws.join(slices, [*_KEYS, "slice"])
        .withColumn("before", F.col("before") + F.sum("size").over(inside) - F.col("size"))
        .where(F.col("before") + F.col("size") / 2 <= F.col("missing")).where("size > 0")
        .groupBy(*_KEYS).agg(F.max("draw").alias("cutoff")))
    return stage(sources.join(cutoffs, _KEYS, "left").select(*_KEYS, "source_size", "target", "whole", "cutoff"))


def with_copies(rows: DataFrame, plan: DataFrame, source_col: str, draw: Column) -> DataFrame:
    """``rows`` with ``source_size, target, copies``; joined in shares, so a hot source is no hot task."""
    wide = keyed(rows.withColumn("_draw", draw), source_col)
    joined = salted_join(wide, plan, _KEYS, ["_draw"])
    extra = F.coalesce(F.col("_draw") <= F.col("cutoff"), F.lit(False)).cast("int")
    return joined.withColumn("copies", F.col("whole") + extra).drop("_draw", "cutoff", "whole", *_KEYS)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: Sequence[int] = (5, 2, 1), max_epochs: float = 3.0, seed: str = SEED) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    Sizes are words of the whole text, 0 for null.  Sources take ``weights`` in turn, by code point with null last, and share
    the sum of all sizes; a target stops at ``max_epochs`` times its source and the excess goes to the others by weight.
    Rows with the same id are drawn together; rows with no id as well.  A source without words has target 0.  Documents
    without words are taken as often as their source's whole repetitions.  Other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_of(F.col(text_col)).alias("size"))
    sized = stage(base)
    draw = draw_key(F.col("doc_id"), seed)
    plan = source_plan(keyed(sized, "source").withColumn("draw", draw), weights, max_epochs)
    return with_copies(sized, plan, "source", draw).withColumn("taken", F.col("copies") * F.col("size"))
