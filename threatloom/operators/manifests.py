"""Dependencies from manifest files, as one job over manifest lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.catalogs import architecture as ar
from threatloom.operators.assets import trimmed
from threatloom.operators.reports import first_per


def languages(files: DataFrame) -> DataFrame:
    """Language of each repository: the first language one of whose marker files is at the root, else "unknown"."""
    ranks = []
    for rank, (language, markers) in enumerate(ar.LANGUAGE_MARKERS.items()):
        marked = F.col("path").isin(*markers)
        if "node_modules" in markers:
            marked = marked | F.col("path").startswith("node_modules/")
        ranks.append(F.when(marked, F.struct(F.lit(rank).alias("rank"), F.lit(language).alias("language"))))
    hits = files.select("repo_id", F.array_min(F.array_compact(F.array(*ranks))).alias("m"))
    return hits.groupBy("repo_id").agg(F.min("m").alias("m")).select("repo_id", F.coalesce("m.language", F.lit("unknown")).alias("language"))


def frameworks(files: DataFrame, repo_languages: DataFrame) -> DataFrame:
    """Framework from the text of the language's manifest; ordered tests, then the default."""
    names = sorted({test[0] for test in ar.FRAMEWORK_TESTS.values()})
    texts = files.where(F.col("path").isin(*names)).groupBy("repo_id").agg(
        *[F.max(F.when(F.col("path") == n, F.col("content"))).alias(n.replace(".", "_")) for n in names])
    rows = repo_languages.join(texts, "repo_id", "left")
    framework = F.lit("unknown")
    for language, (manifest, tests, default) in ar.FRAMEWORK_TESTS.items():
        found = F.coalesce(*[F.when(F.col(manifest.replace(".", "_")).contains(t), name) for t, name in tests], F.lit(default))
        framework = F.when(F.col("language") == language, found).otherwise(framework)
    return rows.select("repo_id", "language", framework.alias("framework"))


SECTIONS = "dependencies MAP<STRING, STRING>, devDependencies MAP<STRING, STRING>"


def in_lines(path: Column, content: Column) -> Column:
    """A JSON or XML manifest written on one line, laid out over lines by its structure, so that it reads like any other.

    JSON that does not parse, and manifests that have lines, stay as they are.
    """
    text = trimmed(content)
    parsed = F.from_json(text, SECTIONS)
    some = parsed["dependencies"].isNotNull() | parsed["devDependencies"].isNotNull()
    # to_json writes one entry per line; elements of XML part where one tag follows another.
    laid = F.when(path.endswith("package.json") & some, F.to_json(parsed, {"pretty": "true"})).when(
        path.endswith("pom.xml"), F.regexp_replace(text, r">\s*<", ">\n<"))
    return F.when(text.contains("\n"), content).otherwise(F.coalesce(laid, content))


def manifest_lines(files: DataFrame, repo_languages: DataFrame) -> DataFrame:
    """Lines of the manifests that count for the language, with their fallback rank."""
    ranked = [
        F.when((F.col("language") == language) & (F.col("path") == name), rank)
        for language, names in ar.MANIFESTS.items() for rank, name in enumerate(names)]
    names = sorted({n for names in ar.MANIFESTS.values() for n in names})
    rows = files.where(F.col("path").isin(*names)).join(repo_languages, "repo_id")
    rows = rows.withColumn("rank", F.coalesce(*ranked)).where(F.col("rank").isNotNull())
    return rows.select("repo_id", "path", "rank", F.posexplode(F.split(in_lines(F.col("path"), F.col("content")), "\n")).alias("pos", "line"))


def _section(opens: Column, closes: Column) -> Column:
    """Whether a line stands in an open section: the last opener or closer up to it decides."""
    order = Window.partitionBy("repo_id", "path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.coalesce(F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(order), F.lit(False))


def dependencies(files: DataFrame, repo_languages: DataFrame) -> DataFrame:
    """Dependencies of each repository, from the first of its manifests that names any.

    A manifest is one file of one repository, so the section windows are as long as that file.
    """
    t = F.col("text")
    of = lambda name: F.col("path") == name
    starts = lambda word: t.startswith(word)
    opens = (
        (of("go.mod") & t.startswith("require") & t.contains("("))
        | (of("Pipfile") & starts("[packages]")) | (of("Cargo.toml") & starts("[dependencies]"))
        | (of("package.json") & (t.contains('"dependencies"') | t.contains('"devDependencies"')))
    )
    closes = (
        (of("go.mod") & (t == ")")) | (of("Pipfile") & starts("[")) | (of("Cargo.toml") & starts("["))
        | (of("package.json") & (t == "}"))
    )
    lines = manifest_lines(files, repo_languages).withColumn("text", trimmed(F.col("line")))
    lines = lines.withColumns({"opens": opens, "closes": closes & ~opens, "inside": _section(opens, closes & ~opens)})
    body = F.col("inside") & ~F.col("opens")
    words = F.split(F.regexp_replace(t, r"^require\s+(?!\()", ""), r"\s+")
    single = of("go.mod") & t.rlike(r"^require\s+[^(\s]")
    bare = lambda text, signs: F.trim(F.trim(text), F.lit(signs))
    equals, colons = F.split(t, "="), F.split(t, ":")
    part = lambda parts, i: F.coalesce(F.get(parts, i), F.lit(""))
    found = lambda test, name, version: F.when(test, F.struct(F.trim(name).alias("name"), version.alias("version")))
    pinned = F.coalesce(*[
        F.when(t.contains(sign), F.struct(
            F.trim(part(F.split(t, sign), 0)).alias("name"), F.trim(part(F.split(t, sign), 1)).alias("version")))
        for sign in ("==", ">=", "<=", "~=", ">", "<")], F.struct(t.alias("name"), F.lit("").alias("version")))
    ticks = F.split(t, "'")
    quoted = F.filter(F.split(t, "['\"]"), lambda p: p != "")
    coordinate = F.split(part(quoted, 1), ":")
    pair = F.coalesce(
        found((of("go.mod") & body & (t != "") & ~starts("//") | single) & (F.size(words) >= 2), part(words, 0), part(words, 1)),
        F.when(of("requirements.txt") & (t != "") & ~starts("#"), pinned),
        found((of("Pipfile") | of("Cargo.toml")) & body & t.contains("="), part(equals, 0),
              bare(part(equals, 1), "\"'{}")),
        found(of("package.json") & body & t.contains(":"), bare(part(colons, 0), '",'), bare(part(colons, 1), '",^~')),
        found(of("Gemfile") & starts("gem ") & (F.size(ticks) >= 2), part(ticks, 1),
              F.regexp_replace(F.trim(part(ticks, 3)), "^~> ", "")),
        found(of("build.gradle") & (t.contains("implementation") | t.contains("compile") | t.contains("api"))
              & t.rlike("['\"]") & (F.size(quoted) >= 2) & (F.size(coordinate) >= 2),
              F.concat(part(coordinate, 0), F.lit(":"), part(coordinate, 1)), part(coordinate, 2)),
    )
    plain = lines.where(~of("pom.xml")).select("repo_id", "rank", "pos", F.explode(F.array_compact(F.array(pair))).alias("d"))
    rows = plain.select("repo_id", "rank", "pos", "d.name", "d.version").unionByName(_pom(lines.where(of("pom.xml"))))
    best = rows.groupBy("repo_id").agg(F.min("rank").alias("rank"))
    return rows.join(best, ["repo_id", "rank"]).select("repo_id", "pos", "name", "version")


def _pom(lines: DataFrame) -> DataFrame:
    """Blocks between <dependency> tags: last artifact and version named before the closing line."""
    t = F.col("text")
    value = lambda tag: F.when(t.contains(f"<{tag}>"), F.regexp_extract(t, f"<{tag}>(.*?)</{tag}>", 1))
    order = Window.partitionBy("repo_id", "path").orderBy("pos")
    blocks = lines.withColumn("block", F.sum(t.contains("<dependency>").cast("int")).over(order))
    ended = blocks.withColumn("ends_before", F.coalesce(F.sum(t.contains("</dependency>").cast("int")).over(
        Window.partitionBy("repo_id", "path", "block").orderBy("pos")), F.lit(0)))
    open_lines = ended.where((F.col("block") > 0) & (F.col("ends_before") == 0))
    closers = ended.where(t.contains("</dependency>") & (F.col("ends_before") == 1)).groupBy("repo_id", "path", "block").agg(
        F.min("pos").alias("pos"))
    named = open_lines.groupBy("repo_id", "path", "rank", "block").agg(
        F.max_by(value("artifactId"), F.when(value("artifactId").isNotNull(), F.col("pos"))).alias("name"),
        F.max_by(value("version"), F.when(value("version").isNotNull(), F.col("pos"))).alias("version"))
    return named.join(closers, ["repo_id", "path", "block"]).where(F.col("name") != "").select(
        "repo_id", "rank", "pos", "name", F.coalesce("version", F.lit("")).alias("version"))


def first_dependencies(rows: DataFrame, limit: int = 30) -> DataFrame:
    return first_per(rows, ["repo_id"], ["pos"], limit)
