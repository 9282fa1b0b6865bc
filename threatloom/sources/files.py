"""Source trees, feeds and scanner output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.operators.archetypes import is_model_path
from threatloom.operators.assets import is_code_path

FINDING_SCHEMA = """
results ARRAY<STRUCT<check_id: STRING, path: STRING, start: STRUCT<line: INT, col: INT, offset: INT>,
  `end`: STRUCT<line: INT, col: INT, offset: INT>,
  extra: STRUCT<message: STRING, severity: STRING, lines: STRING, fingerprint: STRING, is_ignored: BOOLEAN,
    metadata: STRUCT<category: STRING, confidence: STRING, cwe: ARRAY<STRING>, owasp: ARRAY<STRING>,
      vulnerability_class: ARRAY<STRING>>>>>,
errors ARRAY<STRUCT<message: STRING, level: STRING, type: STRING, path: STRING>>
"""
CVE_DDL = """
cve STRUCT<id: STRING, descriptions: ARRAY<STRUCT<lang: STRING, value: STRING>>, published: STRING, lastModified: STRING,
  vulnStatus: STRING, references: ARRAY<STRUCT<url: STRING>>,
  weaknesses: ARRAY<STRUCT<description: ARRAY<STRUCT<lang: STRING, value: STRING>>>>>,
metrics STRUCT<cvssMetricV31: ARRAY<STRUCT<cvssData: STRUCT<baseScore: DOUBLE, baseSeverity: STRING, vectorString: STRING>>>>,
_corrupt_record STRING
"""


def read_trees(spark: SparkSession, root: str) -> DataFrame:
    """Files under ``root/<repo_id>/...``: code files and the manifests, deployment and workflow files that the jobs read.

    Hidden and vendored folders are left out, but for workflows.  The path test is on file metadata, so Spark drops other
    files before it opens them.
    """
    return _trees(spark, root, "text", F.col("value").alias("content"))


def _trees(spark: SparkSession, root: str, fmt: str, *values: Column) -> DataFrame:
    whole = lambda *paths: (
        spark.read.format(fmt).options(**({"wholetext": True} if fmt == "text" else {})).option("recursiveFileLookup", True).load([*paths])
        .select(F.col("_metadata.file_path").alias("full"), *values))
    raw = whole(root)
    # Listing passes over names with a leading dot, so the workflow folders are named outright.
    workflows = f"{root.rstrip('/')}/*/.github/workflows"
    if _exists(spark, workflows):
        raw = raw.union(whole(workflows))
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    inner = F.regexp_replace(F.col("full"), rf"^.*?\Q{base}\E/", "")
    others = [c for c in raw.columns if c != "full"]
    return raw.select(
        F.split_part(inner, F.lit("/"), F.lit(1)).alias("repo_id"),
        F.regexp_replace(inner, "^[^/]*/", "").alias("path"), *others).where(is_code_path(F.col("path")) | is_model_path(F.col("path")))


def list_trees(spark: SparkSession, root: str) -> DataFrame:
    """The files of ``read_trees`` with size and time of change, from the listing alone: no file is opened."""
    meta = [F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified")]
    return _trees(spark, root, "binaryFile", *meta)


def read_listed(spark: SparkSession, root: str, listed: DataFrame, most: int = 10_000) -> DataFrame:
    """``read_trees`` for the files of ``listed`` (repo_id, path).

    Up to ``most`` names become a test on file metadata, so that no other file is opened.  More are joined: all files are read then,
    and which ones stay is the same.
    """
    files = read_trees(spark, root)
    names = listed.select("repo_id", "path").distinct().limit(most + 1).collect()
    if len(names) > most:
        return files.join(listed.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
    return files.where(F.concat_ws("/", "repo_id", "path").isin([f"{n.repo_id}/{n.path}" for n in names]))


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def read_cves(spark: SparkSession, path: str) -> DataFrame:
    """Feed records as JSON lines; unreadable ones keep their text in ``_corrupt_record``."""
    return spark.read.schema(CVE_DDL).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_findings(spark: SparkSession, path: str, repo_id: str | None = None) -> DataFrame:
    """Static-analysis output, one document per file; the file name is the repository unless given."""
    raw = spark.read.schema(FINDING_SCHEMA).option("multiLine", True).json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1)
    rows = raw.select((name if repo_id is None else F.lit(repo_id)).alias("repo_id"), F.posexplode("results").alias("pos", "r"))
    meta = F.col("r.extra.metadata")
    none = F.array().cast("array<string>")
    return rows.select(
        "repo_id", F.col("pos").cast("bigint").alias("ord"), "r.check_id", "r.path",
        F.col("r.start.line").cast("bigint").alias("start_line"), "r.extra.message",
        F.coalesce("r.extra.severity", F.lit("")).alias("severity"),
        F.coalesce(meta["confidence"], F.lit("")).alias("confidence"), F.coalesce(meta["category"], F.lit("")).alias("category"),
        F.coalesce(meta["cwe"], none).alias("cwe"), F.coalesce(meta["vulnerability_class"], none).alias("vulnerability_class"))


def read_finding_errors(spark: SparkSession, path: str) -> DataFrame:
    """Errors of the scanner; ``type`` keeps its JSON text, see ``operators.findings.error_type``."""
    raw = spark.read.schema(FINDING_SCHEMA).option("multiLine", True).json(path)
    return raw.select(F.explode("errors").alias("e")).select("e.*")


def intake_log(rows: DataFrame, source: str, text: str, schema: str) -> DataFrame:
    """Per source the records read and how many of them are unreadable; ``bad_records`` lists these."""
    return rows.groupBy(F.col(source).alias("source")).agg(
        F.count("*").alias("n_records"), F.count_if(_unreadable(text, schema)).alias("n_errors"))


def bad_records(rows: DataFrame, source: str, text: str, schema: str) -> DataFrame:
    """Every unreadable record with its source."""
    return rows.where(_unreadable(text, schema)).select(F.col(source).alias("source"), F.col(text).alias("record"))


def _unreadable(text: str, schema: str) -> Column:
    return F.col(text).isNotNull() & F.from_json(F.col(text), schema).isNull()
