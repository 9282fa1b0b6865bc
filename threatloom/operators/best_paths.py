"""The riskiest attack paths of every repository without listing all paths.

A partial path is extended only while it can still become one of the best: its bound takes the product of success so far,
the best that walks of each length onward to a jewel can add, and the order by path key among equal risks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.catalogs import attack
from threatloom.operators import paths
from threatloom.operators.reports import first_per
from threatloom.session import checkpointed, checkpointed_by

NODE = ["repo_id", "node"]
# Risks are compared after rounding to this many digits, as in the scored listing.
DIGITS, SLACK = 9, 1e-11
_IDS = sorted(attack.PATH_TACTICS)


def _risk(success: Column, jewel: Column, exposure: Column, crossings: Column, ids: Column, known: Column) -> Column:
    total = (
        4.0 * success + jewel + exposure + F.least(F.lit(1.0), 0.3 * crossings)
        + F.least(F.lit(1.0), 0.2 * ids + 0.1 * known))
    return F.least(F.lit(10.0), total)


def _moves(edge_rows: DataFrame) -> DataFrame:
    """Edges as what a step adds to the measures of a path; technique ids as bits."""
    bit = F.lit(0).cast("bigint")
    for place, name in enumerate(_IDS):
        bit = F.when(F.col("mitre_id") == name, F.lit(1 << place).cast("bigint")).otherwise(bit)
    return edge_rows.select(
        "repo_id", F.col("source").alias("node"), F.col("target").alias("next"),
        F.greatest(1.0 - F.col("difficulty"), F.lit(0.1)).alias("success_step"),
        (F.col("source_zone") != F.col("target_zone")).cast("int").alias("crossing"), bit.alias("id_bit"),
        F.col("source_has_techniques").cast("int").alias("known_step"))


def _prospects(moves: DataFrame, jewels: DataFrame, max_depth: int) -> DataFrame:
    """Per node and number of steps the most that walks of just that many steps to a jewel can add, term by term; one row per
    node with an entry per number of steps."""
    ends = jewels.select("repo_id", F.col("node").alias("next"), "jewel_value")
    # Every level asks for the steps by where they lead.
    moves = checkpointed_by(moves, ["repo_id", "next"])
    zero = F.lit(0)
    ahead = ends.select("repo_id", "next", F.lit(1.0).alias("success"), F.col("jewel_value").alias("jewel"), zero.alias("crossings"),
                        zero.cast("bigint").alias("ids"), zero.alias("known"))
    levels = None
    for left in range(1, max_depth):
        level = checkpointed(moves.join(ahead, ["repo_id", "next"]).groupBy(*NODE).agg(
            F.max(F.col("success_step") * F.col("success")).alias("success"), F.max("jewel").alias("jewel"),
            F.max(F.col("crossing") + F.col("crossings")).alias("crossings"), F.bit_or(F.col("id_bit").bitwiseOR(F.col("ids"))).alias("ids"),
            F.max(F.col("known_step") + F.col("known")).alias("known")))
        ahead = level.withColumnRenamed("node", "next")
        level = level.withColumn("left", F.lit(left))
        levels = level if levels is None else levels.unionByName(level)
    return levels.groupBy(*NODE).agg(F.collect_list(F.struct("left", "success", "jewel", "crossings", "ids", "known")).alias("onward"))


def _walk(starts: DataFrame, moves: DataFrame, jewels: DataFrame, prospects: DataFrame | None, limit: int, max_depth: int,
          known: DataFrame | None, beam: int | None) -> DataFrame:
    """Best paths found by extending all repositories by one step per round.

    ``known`` are paths found before; ``beam`` keeps that many partial paths per node, which finds good paths fast but
    not surely the best.
    """
    best, frontier = known, starts
    for depth in range(1, max_depth + 1):
        left = max_depth - depth
        moved = frontier.join(moves, NODE).where(~F.array_contains("visited", F.col("next"))).select(
            "repo_id", "entry", "exposure", F.col("next").alias("node"), F.concat("visited", F.array("next")).alias("visited"),
            (F.col("success") * F.col("success_step")).alias("success"), (F.col("crossings") + F.col("crossing")).alias("crossings"),
            F.col("ids").bitwiseOR(F.col("id_bit")).alias("ids"), (F.col("known") + F.col("known_step")).alias("known"))
        moved = moved.withColumn("path_key", F.array_join("visited", ">"))
        if prospects is not None and left:
            moved = moved.join(prospects, NODE, "left")
            most = F.array_max(F.transform(F.filter("onward", lambda p: p.left <= left), lambda p: _risk(
                F.col("success") * p.success, p.jewel, F.col("exposure"), F.col("crossings") + p.crossings,
                F.bit_count(F.col("ids").bitwiseOR(p.ids)), F.col("known") + p.known)))
            moved = moved.withColumn("most", F.round(most + SLACK, DIGITS)).drop("onward")
        else:
            moved = moved.withColumn("most", F.lit(None).cast("double"))
        moved = checkpointed(moved)
        risk = _risk(F.col("success"), F.col("jewel_value"), F.col("exposure"), F.col("crossings"), F.bit_count("ids"), F.col("known"))
        ended = moved.join(jewels, NODE).select(
            "repo_id", "entry", F.col("node").alias("target"), "visited", "path_key", F.round(risk, DIGITS).alias("risk"))
        found = ended if best is None else best.unionByName(ended).distinct()
        best = checkpointed(first_per(found, ["repo_id"], [F.desc("risk"), "path_key"], limit).drop("rank"))
        if not left:
            break
        worst = best.groupBy("repo_id").agg(
            F.count("*").alias("held"), F.max(F.struct((-F.col("risk")).alias("risk"), "path_key")).alias("last")).where(F.col("held") >= limit)
        floor = worst.select("repo_id", (-F.col("last.risk")).alias("least"), F.col("last.path_key").alias("last_key"))
        # A longer path's key starts with this one's key, so it comes after it.
        alive = F.col("least").isNull() | (F.col("most") > F.col("least")) | (
            (F.col("most") == F.col("least")) & (F.col("path_key") < F.col("last_key")))
        frontier = moved.where("most IS NOT NULL").join(floor, "repo_id", "left").where(alive).drop("least", "last_key")
        if beam is not None:
            frontier = first_per(frontier, NODE, [F.desc("most"), "path_key"], beam).drop("rank")
        frontier = checkpointed(frontier.drop("most", "path_key"))
        if frontier.isEmpty():
            break
    return best


def best_paths(node_rows: DataFrame, edge_rows: DataFrame, limit: int = 10, max_depth: int = 6) -> DataFrame:
    """The ``limit`` riskiest simple paths of at most ``max_depth`` edges of every repository, ties by path key.

    The same rows, in the columns of ``paths.attack_paths``, as the listing ranked by ``paths.critical_paths`` gives.  A first walk
    with ``limit`` partial paths per node finds good paths; the second one drops only what cannot beat them, so it is exact.
    A repository's partial paths grow only where their bounds lie above its ``limit``-th best path.
    """
    # Every round asks for these by node, so they are written by it and not moved again.
    moves = checkpointed_by(_moves(edge_rows), NODE)
    jewels = checkpointed_by(node_rows.where("is_jewel").select("repo_id", F.col("node_id").alias("node"), "jewel_value"), NODE)
    starts = checkpointed(node_rows.where("is_entry").select(
        "repo_id", F.col("node_id").alias("entry"), F.col("node_id").alias("node"), "exposure", F.array("node_id").alias("visited"),
        F.lit(1.0).alias("success"), F.lit(0).alias("crossings"), F.lit(0).cast("bigint").alias("ids"), F.lit(0).alias("known")))
    prospects = checkpointed_by(_prospects(moves, jewels, max_depth), NODE) if max_depth > 1 else None
    good = _walk(starts, moves, jewels, prospects, limit, max_depth, None, limit)
    best = _walk(starts, moves, jewels, prospects, limit, max_depth, good, None)
    return _with_steps(best, edge_rows)


def _with_steps(best: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Step details of the few paths that are shown, joined edge by edge."""
    hops = best.select("repo_id", "entry", "target", "visited", F.posexplode(F.arrays_zip(
        F.slice("visited", F.lit(1), F.size("visited") - 1).alias("source"), F.slice("visited", F.lit(2), F.size("visited") - 1).alias("to")))
        .alias("pos", "hop"))
    step = F.struct(
        F.col("to"), "technique", "mitre_id", "difficulty", F.col("source_zone").alias("from_zone"), F.col("target_zone").alias("to_zone"),
        F.col("source_has_techniques").alias("known"))
    steps = edge_rows.select("repo_id", "source", F.col("target").alias("to"), "technique", "mitre_id", "difficulty", "source_zone", "target_zone", "source_has_techniques")
    rows = hops.select("repo_id", "entry", "target", "visited", "pos", "hop.*").join(steps, ["repo_id", "source", "to"])
    # A path has ``max_depth`` steps at most.
    told = rows.groupBy("repo_id", "entry", "target", "visited").agg(F.array_sort(F.collect_list(F.struct("pos", step.alias("step")))).alias("steps"))
    return told.withColumn("steps", F.transform("steps", lambda s: s["step"]))


def top_scored(node_rows: DataFrame, edge_rows: DataFrame, limit: int = 10, max_depth: int = 6) -> DataFrame:
    """``best_paths`` with all scores and their rank."""
    return paths.critical_paths(paths.score_paths(best_paths(node_rows, edge_rows, limit, max_depth), node_rows), limit)

