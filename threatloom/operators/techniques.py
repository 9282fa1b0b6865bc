"""ATT&CK techniques of categories, layers and threats: constant tables, narrow plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.catalogs import attack, maestro, stride
from threatloom.functions.text import lookup, strings

SECONDARY_FACTOR = 0.7


def _technique_table(table: dict) -> dict:
    return {
        code: F.array(*[
            F.struct(F.lit(i).alias("pos"), F.lit(t).alias("technique_id"), F.lit(w).alias("weight"), F.lit(r).alias("reason"))
            for i, (t, w, r) in enumerate(rows)])
        for code, rows in table.items()
    }


def of_category(category: Column) -> Column:
    """Techniques of a STRIDE-LM category with weight and reason."""
    return lookup(_technique_table(stride.TECHNIQUES), category)


def of_layer(layer: Column) -> Column:
    return lookup(_technique_table(maestro.TECHNIQUES), layer)


def map_category(rows: DataFrame, category: str = "stride_primary", scores: str = "stride_scores") -> DataFrame:
    """One row per technique of the primary category; confidence scaled by the weight."""
    return _mapped(rows, of_category(F.col(category)), F.try_element_at(scores, F.col(category)))


def map_layer(rows: DataFrame, layer: str = "maestro_primary", scores: str = "maestro_scores") -> DataFrame:
    return _mapped(rows, of_layer(F.col(layer)), F.try_element_at(scores, F.col(layer)))


def _mapped(rows: DataFrame, found: Column, confidence: Column) -> DataFrame:
    return rows.select("*", F.explode(found).alias("_t"), confidence.alias("_c")).select(
        *rows.columns, F.col("_t.technique_id").alias("technique_id"),
        (F.col("_c") * F.col("_t.weight")).alias("technique_confidence"), F.col("_t.reason").alias("reason"))


def with_technique_ids(threats: DataFrame) -> DataFrame:
    """Technique ids of the primary category, in listing order."""
    ids = F.transform(of_category(F.col("stride_primary")), lambda t: t["technique_id"])
    return threats.withColumn("mitre_ids", F.coalesce(ids, strings([])))


def best_techniques(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Techniques of both profiles of a row, primary codes in full and secondary ones at 0.7.

    A technique named several times keeps its highest confidence; the first one on equal terms.
    All candidates stand in the row, so this needs no shuffle.
    """
    def candidates(prefix: str, find, rank: int) -> Column:
        codes = F.concat(F.array(F.col(f"{prefix}_primary")), F.col(f"{prefix}_secondary"))
        return F.flatten(F.transform(codes, lambda code, i: F.transform(
            F.coalesce(find(code), F.array()),
            lambda t: F.struct(
                t["technique_id"].alias("technique_id"),
                # Rounded, so that the last bit of a product does not decide between equals.
                F.round(-(F.try_element_at(F.col(f"{prefix}_scores"), code)
                          * F.when(i == 0, 1.0).otherwise(SECONDARY_FACTOR) * t["weight"]), 12).alias("minus"),
                (F.lit(rank) + i * 10 + t["pos"]).alias("seq"), t["reason"].alias("reason")))))

    both = F.array_sort(F.concat(candidates("stride", of_category, 0), candidates("maestro", of_layer, 1000)))
    listed = rows.select(*keys, both.alias("_all"))
    first = F.filter("_all", lambda t, i: (i == 0) | (F.get("_all", i - 1)["technique_id"] != t["technique_id"]))
    return listed.select(*keys, F.explode(first).alias("_t")).select(
        *keys, "_t.technique_id", (-F.col("_t.minus")).alias("technique_confidence"), "_t.reason")


def with_details(mappings: DataFrame) -> DataFrame:
    """Name, tactic, platforms, detection and mitigation of each technique; unknown ids drop out."""
    details = lookup({
        t["technique_id"]: F.struct(
            F.lit(t["name"]).alias("name"), F.lit(t["tactic"]).alias("tactic"), strings(t["platforms"]).alias("platforms"),
            strings(t["detection"]).alias("detection"), strings(t["mitigation"]).alias("mitigation"))
        for t in attack.techniques()}, F.col("technique_id"))
    tactic_name = lookup(attack.TACTICS, F.col("_d.tactic"))
    # explode of a 0/1-element array drops unknown ids and evaluates the lookup once.
    return mappings.select("*", F.explode(F.array_compact(F.array(details))).alias("_d")).select(
        *mappings.columns, "_d.*", tactic_name.alias("tactic_name"))


def of_tactic(mappings: DataFrame, tactic: str) -> DataFrame:
    return with_details(mappings).where(F.col("tactic") == tactic)
