"""Data flows between assets, kept factored.

Seven of the eight flow kinds link *every* source asset of a file with *every* destination asset
of that file (the configuration kind also every secret of a repository with every asset of its
config files).  Listing those pairs grows with the square of a file, so nothing here does: a flow
set is the product of its endpoint lists, and counts, sensitivity, edges and rule hits are computed
from per-file counts.  What stands near a line is a sum over a range of lines, and the one banded kind
joins lines inside line windows, where a window holds at most a fixed number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.catalogs import code
from threatloom.functions.skew import salted_join
from threatloom.operators.assets import unique_by_id
from threatloom.session import checkpointed

FILE = ["repo_id", "file"]
WINDOW = 50  # widest band of any rule, in lines


def is_config_file(file: Column) -> Column:
    return file.contains("config") | file.contains("setup")


def is_source(kind: str, row: str = "") -> Column:
    """``row`` is what the names of a site's columns start with."""
    source = next(k[1] for k in code.FLOW_KINDS if k[0] == kind)
    if source == "+":
        return F.col(f"{row}sensitive") & (F.col(f"{row}type") != "cryptography")
    return F.col(f"{row}type") == source


def is_destination(kind: str, row: str = "") -> Column:
    destination = next(k[2] for k in code.FLOW_KINDS if k[0] == kind)
    return (F.col(f"{row}type") != "secret") if destination == "*" else (F.col(f"{row}type") == destination)


def pair_sensitive(kind: str, source: Column, destination: Column) -> Column:
    """Whether a flow between assets of this sensitivity is sensitive."""
    if kind == "api-ext":
        return source | destination
    if kind in ("db-cache", "api-queue"):
        return source
    return F.lit(True)


def line_sites(assets: DataFrame) -> DataFrame:
    """Assets counted per (repo, file, line, type, sensitive), with the first ``ord``.

    At most two rows per type and line, whatever the number of assets there; all further flow work
    reads this table.  ``assets`` should be unique by id.
    """
    return assets.groupBy(*FILE, "line", "type", "sensitive").agg(
        F.count("*").alias("n"), F.min("ord").alias("ord"))


def unique_placed(assets: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """The columns flow work reads of assets that may repeat an id, unique by id; ``repeated`` as in ``unique_by_id``."""
    return unique_by_id(assets.select("repo_id", "id", "ord", "file", "line", "type", "sensitive"), repeated)


def unique_sites(assets: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """``line_sites`` of assets that may repeat an id.  Only the columns that count travel through the removal of repeats.

    The rows go to their file's share at once, where they are counted; a stage table of them is written by file, without another move.
    """
    return line_sites(by_file(unique_placed(assets, repeated).drop("id")))


def line_counts(sites: DataFrame) -> DataFrame:
    """Per line the counts the bands and rules look at."""
    count = lambda t: F.sum(F.when(F.col("type") == t, F.col("n")).otherwise(0))
    return sites.groupBy(*FILE, "line").agg(
        count("authentication").alias("n_auth"), count("api").alias("n_api"),
        count("cryptography").alias("n_crypto"), count("network").alias("n_network"))


def _bands(lines: DataFrame, marks: DataFrame, how: str = "inner") -> DataFrame:
    """Pairs of lines of one file less than WINDOW apart.

    Equi-join on (file, line window); the marks visit the two neighbour windows as well, so at most
    WINDOW x 3*WINDOW line pairs meet per key, however many assets stand on them.
    """
    # Never null, so that no test for null goes down to the sites and makes another reading of them; rows without a line are near none.
    window = F.coalesce(F.floor(F.col("line") / WINDOW), F.lit(0))
    left = lines.withColumn("window", window)
    visited = marks.withColumn("window", F.explode(F.array(window - 1, window, window + 1)))
    names = {c: F.col(c).alias(f"m_{c}") for c in visited.columns}
    right = visited.select(*names.values())
    same = F.lit(True)
    for key in (*FILE, "window"):
        same = same & (F.col(key) == F.col(f"m_{key}"))
    near = F.abs(F.col("line") - F.col("m_line")) < WINDOW
    return left.join(right, same & near, how).drop(*[f"m_{key}" for key in (*FILE, "window")])


def by_file(sites: DataFrame) -> DataFrame:
    """Sites dealt out once by their file: what is grouped by the file, or by the file and more, is not moved again.

    A file has at most two sites per type and line, so no task gets more than the lines of its files.
    """
    return sites.repartition(*FILE)


def is_placed() -> Column:
    """A row without repository, file or line stands near nothing."""
    return F.col("repo_id").isNotNull() & F.col("file").isNotNull() & F.col("line").isNotNull()


def near_sum(value: Column, width: int) -> Column:
    """Sum over the rows of the file less than ``width`` lines away, of whole numbers.

    What stands up to the last such line less what stands before the first one: running sums take every row once, where a
    range that slides along would add up all its rows again for each line.
    """
    lines = Window.partitionBy(*FILE).orderBy("line")
    up_to = lambda end: F.coalesce(F.sum(value).over(lines.rangeBetween(Window.unboundedPreceding, end)), F.lit(0))
    return F.when(is_placed(), up_to(width - 1) - up_to(-width)).otherwise(0)


def neighbourhood(sites: DataFrame) -> DataFrame:
    """Per line: what stands on it and how much auth / api / crypto stands near it in its file."""
    counts = line_counts(by_file(sites.select(*FILE, "line", "type", "n")))
    near = lambda column, width: near_sum(F.col(column), width)
    return counts.select(
        *FILE, "line", "n_auth", "n_api", "n_crypto", "n_network",
        near("n_auth", 50).alias("auth_50"), near("n_api", 50).alias("api_50"),
        near("n_auth", 10).alias("auth_10"), near("n_api", 10).alias("api_10"),
        near("n_crypto", 20).alias("crypto_20"))


def product_ends(sites: DataFrame) -> DataFrame:
    """Site rows once per flow kind, role and scope they are an end of; the banded kind is left out.

    Flows of a kind are the product of sources and destinations that share a ``scope``: the file, or
    "*" for the secrets of a repository and the assets of its config files.
    """
    config = is_config_file(F.col("file"))
    ends = []
    for kind, *_ in code.FLOW_KINDS:
        if kind == "auth-api":
            continue
        end = lambda role, scope: F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), scope.alias("scope"))
        if kind == "env-svc":
            ends += [
                F.when(is_source(kind), end("src", F.lit("*"))),
                F.when(is_source(kind) & ~config, end("src", F.col("file"))),
                F.when(is_destination(kind), end("dst", F.when(config, "*").otherwise(F.col("file")))),
            ]
        else:
            ends += [F.when(is_source(kind), end("src", F.col("file"))),
                     F.when(is_destination(kind), end("dst", F.col("file")))]
    return sites.withColumn("end", F.explode(F.array_compact(F.array(*ends)))).select("*", "end.*").drop("end")


def product_pairs(ends: DataFrame, carried: list[str], fold) -> DataFrame:
    """Each folded source with each folded destination of its kind and scope, as structs ``s`` and ``d``.

    ``ends`` are the rows of ``product_ends`` of sites dealt out by file; ``fold(rows, keys)`` makes them few per key.  Inside a file
    the pairs are made where the ends are; only the repository-wide part is moved, folded.
    """
    side = lambda role: F.collect_list(F.when(F.col("role") == role, F.struct(*carried)))
    # Few per key once folded, so both sides come from one reading and no side is joined.
    pairs = lambda rows, keys: fold(rows, [*keys, "kind", "role"]).groupBy(*keys, "kind").agg(
        side("src").alias("sources"), side("dst").alias("destinations")).select(
        "repo_id", "kind", F.explode("sources").alias("s"), "destinations").select(
        "repo_id", "kind", "s", F.explode("destinations").alias("d"))
    # A row without repository shares no scope with any other.
    wide = ends.where((F.col("scope") == "*") & F.col("repo_id").isNotNull())
    return pairs(ends.where(F.col("scope") != "*"), FILE).unionByName(pairs(wide, ["repo_id"]))


def _end_sums() -> list[Column]:
    """Sources and destinations of every kind, with the sensitive ones apart."""
    measures = []
    for kind, *_ in code.FLOW_KINDS:
        for role, test in (("src", is_source(kind)), ("dst", is_destination(kind))):
            name = f"{kind.replace('-', '_')}_{role}"
            measures.append(F.sum(F.when(test, F.col("n")).otherwise(0)).alias(name))
            if kind in ("api-ext", "db-cache", "api-queue"):
                measures.append(F.sum(F.when(test & F.col("sensitive"), F.col("n")).otherwise(0)).alias(f"{name}_s"))
    return measures


def file_counts(sites: DataFrame) -> DataFrame:
    """Sources and destinations of every kind per file, with the sensitive ones apart."""
    return sites.groupBy(*FILE).agg(*_end_sums())


def repo_config_counts(per_file: DataFrame) -> DataFrame:
    """Per repository: secrets in all, and non-secret assets standing in config files."""
    config = is_config_file(F.col("file"))
    return per_file.groupBy("repo_id").agg(
        F.sum("env_svc_src").alias("repo_secrets"),
        F.sum(F.when(config, F.col("env_svc_dst")).otherwise(0)).alias("repo_config_assets"),
    )


def flow_summary(sites: DataFrame) -> DataFrame:
    """Flows per (repo, source file, kind): how many, how many sensitive.

    The sites are read once, where their files are: what stands near them and the sums of their file come from one pass.
    Only the sums are written, one row per file, for the part that counts over a repository.
    """
    near = near_sum(F.when(F.col("type") == "api", F.col("n")).otherwise(0), WINDOW)
    banded = F.sum(F.when(F.col("type") == "authentication", F.col("n") * F.col("api_50")).otherwise(0)).alias("auth_api")
    placed = sites.select(*FILE, "line", "type", "sensitive", "n").withColumn("api_50", near)
    per_file = checkpointed(placed.groupBy(*FILE).agg(*_end_sums(), banded))
    full = salted_join(per_file, repo_config_counts(per_file), ["repo_id"], ["file"])
    cells = []
    for kind, *_ in code.FLOW_KINDS:
        c = lambda role: F.col(f"{kind.replace('-', '_')}_{role}")
        total = F.col("auth_api") if kind == "auth-api" else c("src") * c("dst")
        if kind == "env-svc":
            total = c("src") * (
                F.col("repo_config_assets") + F.when(is_config_file(F.col("file")), 0).otherwise(c("dst"))
            )
        sensitive = total
        if kind == "api-ext":
            sensitive = total - (c("src") - c("src_s")) * (c("dst") - c("dst_s"))
        elif kind in ("db-cache", "api-queue"):
            sensitive = c("src_s") * c("dst")
        cells.append(F.struct(F.lit(kind).alias("kind"), total.cast("bigint").alias("n_flows"),
                              sensitive.cast("bigint").alias("n_sensitive")))
    return full.select(*FILE, F.explode(F.array(*cells)).alias("f")).select(*FILE, "f.*").where(F.col("n_flows") > 0)


def banded_files(sites: DataFrame) -> DataFrame:
    """Files with at least one flow of the banded kind."""
    near = neighbourhood(sites).where((F.col("n_auth") > 0) & (F.col("api_50") > 0))
    return near.select(*FILE).distinct()


def flow_endpoints(assets: DataFrame, sites: DataFrame) -> DataFrame:
    """Each asset's part in the flows: kind, role and number of flows it is an end of.

    The flows of a kind and file are the product of its source rows and destination rows (for
    ``auth-api``: of those less than 50 lines apart), so this table is the whole flow set.
    """
    per_file = file_counts(sites)
    per_file = per_file.select(*[c for c in per_file.columns if not c.endswith("_s")])
    # One row per file, so it is this table that visits the repositories and comes back to the files; the assets stay.
    per_file = salted_join(per_file, repo_config_counts(per_file), ["repo_id"], ["file"])
    near = lambda kind: near_sum(F.when(F.col("type") == kind, 1).otherwise(0), WINDOW)
    placed = by_file(assets.select("repo_id", "id", "ord", "type", "file", "line", "sensitive").where(is_placed()))
    full = placed.withColumns({"auth_50": near("authentication"), "api_50": near("api")}).join(per_file.hint("merge"), FILE)
    config = is_config_file(F.col("file"))
    cells = []
    for kind, *_ in code.FLOW_KINDS:
        c = lambda role: F.col(f"{kind.replace('-', '_')}_{role}")
        partners = {"source": c("dst"), "destination": c("src")}
        if kind == "auth-api":
            partners = {"source": F.col("api_50"), "destination": F.col("auth_50")}
        if kind == "env-svc":
            partners = {
                "source": F.col("repo_config_assets") + F.when(config, 0).otherwise(c("dst")),
                "destination": F.when(config, F.col("repo_secrets")).otherwise(c("src")),
            }
        for role, test in (("source", is_source(kind)), ("destination", is_destination(kind))):
            cells.append(F.when(test & (partners[role] > 0), F.struct(
                F.lit(kind).alias("kind"), F.lit(role).alias("role"),
                partners[role].cast("bigint").alias("n_flows"))))
    return (
        full.select("repo_id", "id", "ord", "type", "file", "line", "sensitive",
                    F.explode(F.array_compact(F.array(*cells))).alias("e"))
        .select("repo_id", "id", "ord", "type", "file", "line", "sensitive", "e.*")
    )


def flows_of_assets(assets: DataFrame, chosen: DataFrame, kind: str) -> DataFrame:
    """Drill-down: the flows of one kind that start at the chosen assets (repo_id, id).

    For a handful of chosen assets; the output has one row per partner.
    """
    data_type, threats = next(k[3:] for k in code.FLOW_KINDS if k[0] == kind)
    starts = assets.where(is_source(kind)).join(
        chosen.select("repo_id", "id").distinct(), ["repo_id", "id"], "left_semi")
    ends = assets.where(is_destination(kind)).select(
        "repo_id", F.col("file").alias("dst_file"), F.col("line").alias("dst_line"),
        F.col("id").alias("dst_id"), F.col("sensitive").alias("dst_sensitive"))
    same_file = F.col("file") == F.col("dst_file")
    if kind == "env-svc":
        same_file = same_file | is_config_file(F.col("dst_file"))
    if kind == "auth-api":
        same_file = same_file & (F.abs(F.col("line") - F.col("dst_line")) < WINDOW)
    return starts.join(ends, "repo_id").where(same_file).select(
        "repo_id", F.concat(F.lit(f"flow-{kind}-"), F.col("id"), F.lit("-"), F.col("dst_id")).alias("id"),
        F.col("file").alias("src_file"), F.col("line").alias("src_line"), "dst_file", "dst_line",
        F.lit(data_type).alias("data_type"),
        pair_sensitive(kind, F.col("sensitive"), F.col("dst_sensitive")).alias("sensitive"),
        F.array(*[F.lit(t) for t in threats]).alias("threats"),
    )
