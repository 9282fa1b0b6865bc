"""Source files, source lines and the assets found on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from threatloom.catalogs import code
from threatloom.functions.text import any_of, first_of, quoted_path, strings
from threatloom.session import checkpointed

BLANKS = " \t\r\n\x0b\x0c"


def is_code_path(path: Column) -> Column:
    """A scanned suffix, and no hidden, vendor or node_modules directory on the way."""
    suffixes = "|".join(code.CODE_SUFFIXES)
    return path.rlike(rf"\.({suffixes})$") & ~path.rlike(r"(^|/)(\.[^/]*|vendor|node_modules)/")


def code_files(files: DataFrame) -> DataFrame:
    return files.where(is_code_path(F.col("path")))


def split_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """All lines of each text with their 0-based number."""
    others = [c for c in files.columns if c != content]
    return files.select(*others, F.posexplode(F.split(content, "\n")).alias("line_no", "line"))


def trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def is_code_line(line: Column) -> Column:
    """Neither blank nor a // or # line."""
    text = trimmed(line)
    return (text != "") & ~text.startswith("//") & ~text.startswith("#")


def source_lines(files: DataFrame, content: str = "content") -> DataFrame:
    return split_lines(files, content).where(is_code_line(F.col("line")))


def is_sensitive_line(line: Column) -> Column:
    return any_of(F.lower(line), code.SENSITIVE_WORDS)


def database_operation(line: Column) -> Column:
    low = F.lower(line)
    return (
        F.when(low.contains("select"), "Database Query (SELECT)").when(low.contains("insert"), "Database Insert")
        .when(low.contains("update"), "Database Update").when(low.contains("delete"), "Database Delete")
        .when(low.contains("connect"), "Database Connection").otherwise("Database Operation")
    )


def auth_method(line: Column) -> Column:
    return (
        F.when(line.contains("jwt"), "JWT Authentication").when(line.contains("oauth"), "OAuth Authentication")
        .when(line.contains("bcrypt"), "Password Hashing (bcrypt)")
        .when(line.contains("session"), "Session Management").otherwise("Authentication")
    )


def env_variable(line: Column) -> Column:
    quoted = F.concat(F.lit("ENV: "), F.element_at(F.split(line, '"'), 2))
    return F.when(line.contains('"'), quoted).otherwise("Environment Variable")


def detect_assets(lines: DataFrame) -> DataFrame:
    """Assets of all families in one narrow pass over (repo_id, file, ord, line_no, line).

    At most one asset per family and line, plus one per KEY=value line of an environment file.
    ``ord`` must order the lines of a repository; the result's ``ord`` orders its assets.
    """
    # Columns of their own: every pattern test reads them, so they are made once per line.
    lines = lines.withColumns({"_low": F.lower("line"), "_text": trimmed(F.col("line"))}).withColumn(
        "_scanned", (F.col("_text") != "") & ~F.col("_text").startswith("//") & ~F.col("_text").startswith("#"))
    line, low, text, scanned = F.col("line"), F.col("_low"), F.col("_text"), F.col("_scanned")
    yes, no = F.lit(True), F.lit(False)

    def name_of(family: str) -> Column:
        words = [p.lower() for p in code.PATTERNS[family]]
        return {
            "api": quoted_path(line), "db": database_operation(line), "auth": auth_method(line),
            "file": F.lit("File Operation"), "extapi": F.lit("External API Call"), "env": env_variable(line),
            "secret": F.concat(F.lit("Secret: "), first_of(low, words)),
            "queue": F.concat(F.lit("Message Queue: "), first_of(low, words)),
            "cache": F.lit("Cache Operation"), "crypto": F.lit("Cryptographic Operation"),
        }[family]

    def sensitive(family: str) -> Column:
        if family in ("api", "extapi"):
            return any_of(low, code.SENSITIVE_WORDS)
        if family == "file":
            return low.contains("upload") | low.contains("write")
        return no if family in ("queue", "cache") else yes

    found = []
    for rank, (family, words) in enumerate(code.PATTERNS.items()):
        asset_type, prefix, tags = code.FAMILIES[family]
        hit = scanned & any_of(low, [w.lower() for w in words])
        if family == "secret":
            hit = hit & (line.contains("=") | line.contains(":"))
        found.append(F.when(hit, F.struct(
            F.lit(rank).alias("rank"),
            F.concat(F.lit(family + "-"), F.col("file"), F.lit("-"), F.col("line_no").cast("string")).alias("id"),
            F.lit(asset_type).alias("type"),
            name_of(family).alias("name"),
            (F.lit("") if prefix is None else F.concat(F.lit(prefix), text)).alias("description"),
            sensitive(family).alias("sensitive"),
            F.lit(family == "api").alias("exposed"),
            strings(tags).alias("tags"),
        )))
    key = F.trim(F.element_at(F.split(line, "=", 2), 1), F.lit(BLANKS))
    env_file = F.col("file").endswith(".env") | F.col("file").contains(".env.")
    found.append(F.when(env_file & line.contains("=") & ~text.startswith("#"), F.struct(
        F.lit(len(code.PATTERNS)).alias("rank"),
        F.concat(F.lit("envvar-"), F.col("file"), F.lit("-"), key).alias("id"),
        F.lit("secret").alias("type"),
        F.concat(F.lit("ENV: "), key).alias("name"),
        F.concat(F.lit("Environment variable: "), key).alias("description"),
        yes.alias("sensitive"), no.alias("exposed"),
        strings(["environment", "config", "secret"]).alias("tags"),
    )))
    # Several families may hit one line: their rank comes last, for numbers as for text keys.
    textual = isinstance(lines.schema["ord"].dataType, StringType)
    order = F.concat("ord", F.lit("/"), F.hex("a.rank")) if textual else F.col("ord") * 16 + F.col("a.rank")
    return (
        lines.select("repo_id", "ord", "file", (F.col("line_no") + 1).cast("bigint").alias("line"),
                     F.explode(F.array_compact(F.array(*found))).alias("a"))
        .select("repo_id", order.alias("ord"), "a.id", "a.type", "a.name",
                "file", "line", "a.description", "a.sensitive", "a.exposed", "a.tags")
    )


def rule_hits(lines: DataFrame) -> DataFrame:
    """Regex rules over lines: one row per line and rule that matches."""
    hits = [
        F.when(F.col("line").rlike(pattern), F.struct(
            F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(cwe).alias("cwe"),
            F.lit(sub).alias("sub_id")))
        for rule, pattern, severity, cwe, sub in code.REGEX_RULES
    ]
    others = [c for c in lines.columns if c != "line"]
    return lines.select(*others, F.explode(F.array_compact(F.array(*hits))).alias("hit")).select(*others, "hit.*")


def of_type(assets: DataFrame, asset_type: str) -> DataFrame:
    return assets.where(F.col("type") == asset_type)


# So many repeated ids, as hashes, are told to every task; with more of them all rows go to the share of their id.
TOLD_IDS = 1_000_000


def id_hash() -> Column:
    return F.xxhash64("repo_id", "id")


def repeated_ids(assets: DataFrame) -> DataFrame | None:
    """Hashes of the (repo, id) that more than one row has, found by a reading of hashes alone; None if they are too many to be told.

    Two ids of one hash are taken for repeated.
    """
    rows: dict[str, int] = {}
    seen = assets.select(id_hash().alias("id_hash")).groupBy("id_hash").agg(F.count(F.lit(1)).alias("n"))
    told = checkpointed(seen.where(F.col("n") > 1).select("id_hash"), rows, "ids")
    return told if rows["ids"] <= TOLD_IDS else None


def unique_by_id(assets: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """First asset of each (repo, id): flows are told apart by asset ids.

    The columns travel as one struct that starts with ``ord`` and is compared as such, so all of them must be comparable (no maps).
    Among rows without ``ord`` there is no first: an id of such rows alone has null in all columns.

    Ids are meant to be unique: with the ``repeated_ids`` of the assets only the rows of those are moved, all others stay where they are.
    """
    carried = [c for c in assets.columns if c not in ("repo_id", "id")]
    if repeated is not None:
        hashed, told = assets.withColumn("id_hash", id_hash()), F.broadcast(repeated)
        alone = hashed.join(told, "id_hash", "left_anti").select(
            "repo_id", "id", *[F.when(F.col("ord").isNotNull(), F.col(c)).alias(c) for c in carried])
        return alone.unionByName(unique_by_id(hashed.join(told, "id_hash", "left_semi").select(*assets.columns)))
    row = F.struct("ord", *[c for c in carried if c != "ord"])
    return (
        assets.groupBy("repo_id", "id").agg(F.min(F.when(F.col("ord").isNotNull(), row)).alias("a"))
        .select("repo_id", "id", *[F.col(f"a.{c}") for c in carried])
    )
