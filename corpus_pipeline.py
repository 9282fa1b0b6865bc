"""From raw documents to packed training sequences: filter, dedup, pseudonymise, mix, pack.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm import mixing, neardup, packing, pii, quality
from threatloom.llm.common import stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.  Texts are scored where they lie, no row moves."""
    model = quality.train(quality.features_of(docs), table(spark, sf_dir, "labels"))
    return docs.select(*COLUMNS).where(quality.score_of_text(model, F.col("text")) >= 0.5)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8), the one of the smallest id.

    Repeated rows of one id and text are one document.  A row without id goes by a hash of its text, above all real ids, so it
    stays only where its group has no row with an id.
    """
    mark = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62))
    keyed = docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("bigint"), mark).alias("_key"))
    verdict = neardup.near_duplicates(keyed, id_col="_key", words=5, percent=80)
    gone = verdict.where("NOT kept").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(gone, "_key", "left_anti").dropDuplicates(["_key", "text"]).select(*COLUMNS)


def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced by pseudonyms of the same format; ``n_chars`` follows the text."""
    done = pii.pseudonymised(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    draw = mixing.draw_key(F.col("doc_id"), mixing.SEED)
    sized = stage(docs.select("source", draw.alias("draw"), mixing.words_of(F.col("text")).alias("size")))
    plan = mixing.source_plan(mixing.keyed(sized, "source"))
    copies = mixing.with_copies(docs.select(*COLUMNS), plan, "source", draw)
    return copies.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, ids as little-endian 32-bit numbers."""
    pieces = packing.pack(docs, length=1024)
    return pieces.select(
        "doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("length"), "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


STAGES = [("quality", keep_good), ("near duplicates", keep_one_of_each), ("pii", hide_persons), ("mixing", mix_sources), ("packing", pack)]
# Trained models, tokenizers and similarity links cannot be written as one query; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each result is written and read again, as between jobs."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs)
    return docs
