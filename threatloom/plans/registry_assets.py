"""Registered queries: files, lines, assets, flows."""

from pyspark.sql import functions as F

from threatloom.operators import assets as a
from threatloom.operators import flows as fl
from threatloom.operators import incremental as inc
from threatloom.plans import jobs
from threatloom.plans.registry_triage import text
from threatloom.session import checkpointed
from threatloom.sources import sample_views as v


def documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text").alias("content"))


def endpoints(spark, d):
    """Ends of flows: the unique assets are written once by file, and their sites counted where they lie."""
    placed = checkpointed(fl.unique_placed(v.assets(spark, d)), by=fl.FILE)
    return fl.flow_endpoints(placed, fl.line_sites(placed))


def sites(spark, d):
    """Stage table of the flow work: written once, by file, and read by every branch of a query."""
    found = v.assets(spark, d)
    return checkpointed(fl.unique_sites(found, a.repeated_ids(found)), by=fl.FILE)


def flow_rows(spark, d):
    """Flow summary by itself: it reads the sites once, so they need no stage table."""
    return fl.flow_summary(fl.unique_sites(v.assets(spark, d)))


def _page_hits(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.col("html").alias("content"))
    return a.rule_hits(a.split_lines(pages)).groupBy("page_id", "rule_id", "sub_id").agg(F.count("*").alias("n_lines"))


def _notes(rows, path):
    """Documents as files of one repository each."""
    return rows.select(F.col("doc_id").cast("string").alias("repo_id"), path.alias("path"), "content")


def rescanned(spark, d):
    """Assets of all documents by a scan after an earlier one, when some had another text and some stood under another path."""
    now = documents(spark, d)
    kind = F.pmod("doc_id", F.lit(5))
    text_then = F.when(kind == 2, F.concat(F.lit("password = 1\n"), "content")).otherwise(F.col("content"))
    path_then = F.when(kind == 1, "gone.py").when(kind == 3, "old/notes.py").otherwise("notes.py")
    files = checkpointed(_notes(now.withColumn("content", text_then), path_then))
    first = jobs.rescan(files, *_nothing(spark))
    return jobs.rescan(_notes(now, F.lit("notes.py")), first["index"], first["assets"])["assets"]


def _nothing(spark):
    """Index and assets before the first scan."""
    none = spark.createDataFrame([], "repo_id string, path string, content string")
    return inc.file_index(none), jobs.detected(none)


QUERIES = {
    "code_files": lambda s, d: a.code_files(v.files(s, d)).select("repo_id", "path"),
    "source_lines": lambda s, d: a.source_lines(documents(s, d)).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line"),
    "sensitive_lines": lambda s, d: a.source_lines(documents(s, d)).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if(a.is_sensitive_line(F.col("line"))).alias("n_sensitive")),
    "rule_hits_documents": lambda s, d: a.rule_hits(a.source_lines(documents(s, d))).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "rule_id", "severity", "cwe", "sub_id"),
    "rule_hits_pages": _page_hits,
    "assets_detected": lambda s, d: a.detect_assets(v.code_lines(s, d)).withColumn("tags", text("tags")),
    "assets_of_documents": lambda s, d: a.detect_assets(a.split_lines(documents(s, d)).select(
        F.col("doc_id").cast("string").alias("repo_id"), F.lit("notes.py").alias("file"),
        F.col("line_no").cast("bigint").alias("ord"), "line_no", "line")).select("repo_id", "id", "type", "name"),
    "assets_rescanned": lambda s, d: rescanned(s, d).select("repo_id", "id", "type", "name"),
    "assets_by_type_filter": lambda s, d: a.of_type(v.assets(s, d), "api").select(
        "repo_id", F.col("ord").cast("string").alias("ord"), "id", "name"),
    "flow_summary": flow_rows,
    "flow_endpoints": lambda s, d: endpoints(s, d).select(
        "repo_id", "id", "kind", "role", "n_flows"),
    "line_neighbourhood": lambda s, d: fl.neighbourhood(fl.line_sites(v.assets(s, d))).select(
        "repo_id", "file", "line", "auth_50", "api_50", "auth_10", "api_10", "crypto_20"),
}
