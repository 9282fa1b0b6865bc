"""Static-analysis findings: filters, framework mapping, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.catalogs import maestro, stride
from threatloom.functions.scores import pick
from threatloom.functions.text import any_of, lookup
from threatloom.operators.classify import classify_stride

SEVERITY_ORDER = {"ERROR": 3, "WARNING": 2, "INFO": 1}
CONFIDENCE_ORDER = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}

# Texts of which one must occur before any layer is considered.
AI_GATE = ["llm", "gpt", "ai", "model", "prompt", "agent", "rag", "embedding"]
# Texts per layer, tested in this order.
AI_LAYERS = [
    ("1-Foundation", ["prompt injection", "jailbreak", "model", "llm"]),
    ("2-DataKnowledge", ["rag", "vector", "embedding", "knowledge"]),
    ("3-Frameworks", ["agent", "langchain", "autogen", "tool calling"]),
    ("4-Tooling", ["api key", "credential", "token", "secret"]),
    ("6-Deployment", ["container", "docker", "kubernetes", "resource"]),
]


def from_severity(findings: DataFrame, minimum: str = "") -> DataFrame:
    if not minimum:
        return findings
    return findings.where(pick(F.upper("severity"), SEVERITY_ORDER, 0) >= SEVERITY_ORDER.get(minimum, 0))


def from_confidence(findings: DataFrame, minimum: str = "") -> DataFrame:
    if not minimum:
        return findings
    return findings.where(pick(F.upper("confidence"), CONFIDENCE_ORDER, 0) >= CONFIDENCE_ORDER.get(minimum, 0))


def cwe_numbers(cwe: Column) -> Column:
    """Leading number of each weakness text, with or without the CWE- prefix."""
    texts = F.transform(cwe, lambda c: F.regexp_extract(c, r"^(?:CWE-)?\s*([+-]?\d+)", 1))
    return F.transform(F.filter(texts, lambda t: t != ""), lambda t: t.cast("int"))


def mapping_confidence() -> Column:
    total = (
        0.5 + pick(F.upper("severity"), {"ERROR": 0.3, "WARNING": 0.2, "INFO": 0.1}, 0.0)
        + pick(F.upper("confidence"), {"HIGH": 0.2, "MEDIUM": 0.1, "LOW": 0.05}, 0.0)
        + F.when(F.size("cwe") > 0, 0.1).otherwise(0.0)
    )
    return F.least(F.lit(1.0), total)


def finding_text() -> Column:
    return F.concat(
        F.col("message"), F.when(F.col("category") != "", F.concat(F.lit(" "), "category")).otherwise(""),
        F.array_join(F.transform("vulnerability_class", lambda v: F.concat(F.lit(" "), v)), ""))


def ai_layer(text: Column, check_id: Column) -> Column:
    """Agentic layer a finding belongs to; empty without any AI wording."""
    combined = F.concat(F.lower(text), F.lit(" "), F.lower(check_id))
    layer = F.lit("1-Foundation")
    for code, words in reversed(AI_LAYERS):
        layer = F.when(any_of(combined, words), code).otherwise(layer)
    return F.when(any_of(combined, AI_GATE), layer).otherwise("")


def threat_severity(severity: Column) -> Column:
    return pick(F.upper(severity), {"ERROR": "high", "WARNING": "medium", "INFO": "low"}, "info")


def map_findings(findings: DataFrame) -> DataFrame:
    """STRIDE-LM category, agentic layer, confidence and reason of each finding."""
    rows = findings.withColumn("cwe_ids", cwe_numbers(F.col("cwe"))).withColumn("_text", finding_text())
    rows = classify_stride(rows, F.col("_text"), F.col("cwe_ids"))
    rows = rows.withColumn("layer", ai_layer(F.col("_text"), F.col("check_id")))
    part = lambda test, head, value: F.when(test, F.concat(F.lit(head), value))
    reason = F.concat_ws(
        " | ", F.col("message"),
        part(F.col("category") != "", "Category: ", F.col("category")),
        part(F.size("cwe") > 0, "CWE: ", F.array_join("cwe", ", ")),
        part(F.lit(True), "STRIDE-LM: ", lookup(stride.FULL_NAMES, F.col("stride_primary"))),
        part(F.col("layer") != "", "MAESTRO: ", lookup(maestro.FULL_NAMES, F.col("layer"))),
    )
    return rows.withColumns({"mapping_confidence": mapping_confidence(), "reason": reason}).drop("_text")


def confident(mappings: DataFrame, minimum: float) -> DataFrame:
    return mappings.where(F.col("mapping_confidence") >= minimum)


def grouped(mappings: DataFrame) -> DataFrame:
    """Findings per STRIDE-LM category and per agentic layer (findings without one drop out)."""
    groups = F.array_compact(F.array(
        F.struct(F.lit("STRIDE-LM").alias("framework"), F.col("stride_primary").alias("code")),
        F.when(F.col("layer") != "", F.struct(F.lit("MAESTRO").alias("framework"), F.col("layer").alias("code")))))
    return mappings.select("repo_id", F.explode(groups).alias("g")).groupBy("repo_id", "g.framework", "g.code").agg(
        F.count("*").alias("n_findings"))


def summary(findings: DataFrame) -> DataFrame:
    """Per repository: findings by severity and confidence, distinct weaknesses and rules."""
    count = lambda column, value: F.count_if(F.upper(column) == value)
    base = findings.groupBy("repo_id").agg(
        F.count("*").alias("n_findings"),
        *[count("severity", s).alias(f"n_{s.lower()}") for s in SEVERITY_ORDER],
        *[count("confidence", c).alias(f"n_{c.lower()}") for c in CONFIDENCE_ORDER],
        F.count_distinct("check_id").alias("n_rules"))
    weak = findings.select("repo_id", F.explode("cwe").alias("c")).groupBy("repo_id").agg(
        F.count_distinct("c").alias("n_cwes"))
    return base.join(weak, "repo_id", "left").fillna(0, ["n_cwes"])


def error_type(raw: Column) -> Column:
    """Type of a scanner error: a JSON string, the first string of a JSON array, else the raw JSON."""
    value = F.try_parse_json(raw)
    first = F.get_json_object(raw, "$[0]")
    is_text = F.schema_of_variant(value) == "STRING"
    first_is_text = F.schema_of_variant(F.try_variant_get(value, "$[0]", "variant")) == "STRING"
    return (
        F.when(raw.isNull(), "")
        .when(is_text, F.try_variant_get(value, "$", "string"))
        .when(first_is_text, first)
        .otherwise(raw)
    )


def finding_threats(mappings: DataFrame, as_of) -> DataFrame:
    """Findings as threats, for the compliance report."""
    place = F.concat(F.lit(" (File: "), "path", F.lit(", Line: "), F.col("start_line").cast("string"), F.lit(")"))
    return mappings.select(
        "repo_id", "ord", F.concat(F.lit("threat-"), F.col("ord").cast("string")).alias("id"),
        F.col("message").alias("title"), F.concat("message", place).alias("description"),
        threat_severity(F.col("severity")).alias("severity"), "stride_primary",
        F.transform("cwe_ids", lambda c: F.concat(F.lit("CWE-"), c.cast("string"))).alias("cwes"),
        F.array("check_id").alias("rule_ids"), F.lit(as_of).cast("timestamp").alias("discovered_at"))
