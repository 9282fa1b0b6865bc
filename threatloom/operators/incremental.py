"""Detection again only where files changed since the last scan.

An index has one row per (repo_id, path) with a ``digest`` of the text.  Detection is per file, so the assets of a path whose
digest is as before are those of the last scan; all others are made again or dropped.  A renamed file is one path less and
another more.  Null repositories and paths are values like any other, a null text counts as empty, and a path that occurs in
several rows has one digest over all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.session import checkpointed

FILE = ("repo_id", "path")


def _digest(text: Column) -> list[Column]:
    """Row count and two sums of 60 bits of the hash: the order of rows does not matter, and copies do not cancel out."""
    hashed = F.sha2(F.coalesce(text, F.lit("")), 256)
    part = lambda start: F.sum(F.conv(F.substring(hashed, start, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return [F.count("*").cast("string"), part(1), part(16)]


def file_index(files: DataFrame) -> DataFrame:
    """One row per file: repo_id, path, digest.  Only hashes travel, not texts."""
    return files.groupBy(*FILE).agg(F.concat_ws("-", *_digest(F.col("content"))).alias("digest"))


def _same(left: DataFrame, right: DataFrame, names: dict[str, str]) -> Column:
    test = F.lit(True)
    for a, b in names.items():
        test = test & left[a].eqNullSafe(right[b])
    return test


def without(rows: DataFrame, others: DataFrame, names: dict[str, str], how: str = "left_anti") -> DataFrame:
    """Rows that have no equal (``left_semi``: that have one) among the others; nulls are equal."""
    one, two = rows.alias("one"), others.select(*[F.col(b).alias(f"_other_{b}") for b in names.values()]).distinct()
    return one.join(two, _same(one, two, {a: f"_other_{b}" for a, b in names.items()}), how)


def changes(index: DataFrame, last_index: DataFrame) -> DataFrame:
    """Every file that is not as before: repo_id, path, change (added, removed, modified)."""
    both = index.select(*FILE, "digest", F.lit(1).alias("side")).unionByName(last_index.select(*FILE, "digest", F.lit(0).alias("side")))
    sides = both.groupBy(*FILE).agg(
        F.max(F.when(F.col("side") == 1, F.col("digest"))).alias("now"), F.max(F.when(F.col("side") == 0, F.col("digest"))).alias("before"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("before"), "modified")
    return sides.withColumn("change", change).where("change IS NOT NULL").select(*FILE, "change")


def refreshed(files: DataFrame, changed: DataFrame, last_assets: DataFrame, detect: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Assets of all files: those of the last scan, but for changed files, and what ``detect`` finds in files added or modified.

    ``changed`` is a stage table, so its size is known: a small one goes to the files, and no text is moved.
    """
    key = {"repo_id": "repo_id", "path": "path"}
    fresh = without(files, changed.where("change <> 'removed'"), key, "left_semi")
    kept = without(last_assets, changed, {"repo_id": "repo_id", "file": "path"})
    return kept.unionByName(detect(fresh))


def rescan(files: DataFrame, last_index: DataFrame, last_assets: DataFrame,
           detect: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New index, assets and changes of ``files`` (repo_id, path, content) after an earlier scan."""
    index = checkpointed(file_index(files))
    changed = checkpointed(changes(index, last_index))
    return index, refreshed(files, changed, last_assets, detect), changed
