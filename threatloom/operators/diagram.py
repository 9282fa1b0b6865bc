"""Data-flow diagram: asset groups as nodes, first flows as edges, trust zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.catalogs import code
from threatloom.functions import scores
from threatloom.functions.text import lookup, strings
from threatloom.operators import flows
from threatloom.operators.classify import profile_text

NODE = ["repo_id", "node_id"]


def top_directory(file: Column) -> Column:
    return F.split_part(file, F.lit("/"), F.lit(1))


def link_mask(text: Column) -> Column:
    """Which link words occur, one bit per word."""
    mask = F.lit(0)
    for bit, word in enumerate(code.LINK_WORDS):
        mask = mask.bitwiseOR(F.when(text.contains(word), 1 << bit).otherwise(0))
    return mask


def threats_by_mask(threats: DataFrame) -> DataFrame:
    """Threats summed per (repo, link words): at most 31 rows per repository."""
    text = F.lower(F.concat("title", F.lit(" "), "description"))
    severe = F.struct(
        (-scores.severity_rank(F.col("severity"))).alias("minus"), "ord", "title",
        F.coalesce(profile_text(F.col("stride_primary"), F.col("stride_secondary")), F.lit("")).alias("stride"))
    count = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}")
    return (
        threats.withColumn("mask", link_mask(text)).where(F.col("mask") > 0).groupBy("repo_id", "mask")
        .agg(F.count("*").alias("n_findings"), *[count(s) for s in ("critical", "high", "medium", "low")],
             F.count_if(F.size("mitre_ids") > 0).alias("n_with_techniques"),
             F.min(F.when(F.col("severity") != "info", severe)).alias("worst"))
    )


def node_label(asset_type: Column, n: Column, name: Column) -> Column:
    head = F.coalesce(lookup(code.NODE_LABELS, asset_type), asset_type)
    counted = F.concat(head, F.lit(" ("), n.cast("string"), F.lit(")"))
    return F.when((asset_type == "api") & (n == 1), name).otherwise(counted)


def nodes(assets: DataFrame, threats: DataFrame) -> DataFrame:
    """One node per (repo, asset type, top directory) with risk and what threatens it.

    Assets fold to files and files to nodes; threats fold to word masks, and a node visits the masks
    that share a word with it.  No (asset, threat) pair is ever made.
    """
    link = link_mask(F.lower(F.concat("name", F.lit(" "), "type")))
    base = F.when(F.col("sensitive") & F.col("exposed"), 7).when(F.col("sensitive") | F.col("exposed"), 5).otherwise(3)
    # What one asset says of its node; the rows go to their file's share as they are, narrow, and are folded there.
    told = assets.select("repo_id", "type", "file", link.alias("mask"), base.alias("base"), "name", "description")
    only = F.when(F.count("*") == 1, F.first(F.struct("name", "description")))
    per_file = told.repartition("repo_id", "type", "file").groupBy("repo_id", "type", "file").agg(
        F.count("*").alias("n"), F.bit_or("mask").alias("mask"), F.max("base").alias("base"), only.alias("only"))
    grouped = per_file.groupBy("repo_id", F.concat("type", F.lit("-"), top_directory(F.col("file"))).alias("node_id"), "type").agg(
        F.sum("n").alias("n_assets"), F.count("*").alias("n_files"), F.bit_or("mask").alias("mask"),
        F.max("base").alias("base"), F.first("only", ignorenulls=True).alias("only"))
    counts = ["n_findings", "n_critical", "n_high", "n_medium", "n_low", "n_with_techniques"]
    # At most 31 entries per repository, so the assets are read and folded once.
    masks = threats_by_mask(threats).groupBy("repo_id").agg(F.collect_list(F.struct("mask", *counts, "worst")).alias("masks"))
    linked = F.filter("masks", lambda m: m["mask"].bitwiseAND(F.col("mask")) != 0)
    total = lambda name: F.aggregate("linked", F.lit(0).cast("bigint"), lambda acc, m: acc + m[name])
    joined = grouped.join(masks, "repo_id", "left").withColumn("linked", F.coalesce(linked, F.array())).withColumns({
        **{name: total(name) for name in counts}, "worst": F.array_min(F.transform("linked", lambda m: m["worst"]))})
    rank = F.greatest("base", F.when(F.col("n_critical") > 0, 10).when(F.col("n_high") > 0, 7).when(
        F.col("n_medium") > 0, 5).otherwise(0))
    description = F.when(F.col("n_assets") == 1, F.col("only.description")).otherwise(F.concat(
        F.col("n_assets").cast("string"), F.lit(" assets across "), F.col("n_files").cast("string"), F.lit(" files")))
    return joined.select(
        *NODE, node_label(F.col("type"), F.col("n_assets"), F.col("only.name")).alias("label"),
        F.coalesce(lookup(code.NODE_TYPES, F.col("type")), F.lit("service")).alias("node_type"),
        scores.severity_from_rank(rank).alias("risk_level"), description.alias("description"),
        "n_assets", "n_files", *counts, F.col("worst.title").alias("worst_title"),
        F.col("worst.stride").alias("worst_stride"))


def protocols(data_type: Column) -> Column:
    low = F.lower(data_type)
    return F.array_compact(F.array(
        F.when(low.contains("http") | low.contains("api"), "HTTP"),
        F.when(low.contains("sql") | low.contains("database"), "SQL"),
        F.when(low.contains("queue") | low.contains("message"), "AMQP")))


def _located(sites: DataFrame) -> DataFrame:
    """Sites, dealt out by file, with the node of the first asset on their line and whether crypto stands there."""
    line = Window.partitionBy("repo_id", "file", "line")
    first = F.min(F.struct("ord", "type")).over(line)
    rows = flows.by_file(sites.select("repo_id", "file", "line", "type", "sensitive", "ord").where(flows.is_placed()))
    return rows.withColumns({"first": first, "encrypted": F.bool_or(F.col("type") == "cryptography").over(line)}).select(
        "repo_id", "file", "line", "type", "sensitive", "ord", "encrypted",
        F.concat("first.type", F.lit("-"), top_directory(F.col("file"))).alias("node_id"))


def _folded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First ``ord`` of the sites that are alike in all an edge looks at; a missing one comes first."""
    first = F.when(~F.bool_or(F.col("ord").isNull()), F.min("ord"))
    return rows.groupBy(*keys, "node_id", "type", "sensitive", "encrypted").agg(first.alias("ord"))


def _file_pairs(located: DataFrame) -> DataFrame:
    """Pairs of folded sites of one file, by the first kind that links them.

    Later kinds of the same two sites cannot give the first flow of their nodes.  Folded, a file has a handful of sites per pair of
    types.  The banded kind keeps lines apart: a source meets the lines of its window, which destinations of the two neighbour windows
    visit.  So the sites are read once, and none leaves its file.
    """
    own = F.floor(F.col("line") / flows.WINDOW)
    whole = F.lit(None).cast("bigint")
    seen = F.when(flows.is_source("auth-api"), F.array(whole, own)).when(
        flows.is_destination("auth-api"), F.array(whole, own - 1, own, own + 1)).otherwise(F.array(whole))
    placed = located.withColumn("window", F.explode(seen)).withColumn("line", F.when(F.col("window").isNotNull(), F.col("line")))
    folded = _folded(placed, [*flows.FILE, "window", "line"]).withColumns({
        "starts": _kinds(flows.is_source), "ends": _kinds(flows.is_destination)})
    end = F.struct("line", "sensitive", "ord", "encrypted", "node_id", "starts", "ends")
    listed = folded.groupBy(*flows.FILE, "window").agg(
        F.collect_list(F.when(F.col("starts") != 0, end)).alias("sources"),
        F.collect_list(F.when(F.col("ends") != 0, end)).alias("destinations"))
    both = F.col("s.starts").bitwiseAND(F.col("d.ends"))
    # Lines are told apart for the banded kind alone, and it alone looks at them.
    near = F.coalesce(F.abs(F.col("s.line") - F.col("d.line")) < flows.WINDOW, F.lit(True))
    return (
        listed.select("repo_id", F.explode("sources").alias("s"), "destinations")
        .select("repo_id", "s", F.explode("destinations").alias("d")).where((both != 0) & near)
        # The place of the lowest bit.
        .select("repo_id", F.bit_count(both.bitwiseAND(-both) - 1).alias("kind_order"), "s", "d")
    )


def _kinds(is_end) -> Column:
    """The flow kinds a folded site is a source (or destination) of in its file, one bit per kind in their order; the banded kind
    inside line windows alone.  Secrets of config files are linked with the whole repository."""
    bits = F.lit(0)
    for place, (name, *_) in enumerate(code.FLOW_KINDS):
        test = is_end(name) & (F.col("window").isNotNull() if name == "auth-api" else F.col("window").isNull())
        if name == "env-svc":
            test = test & ~flows.is_config_file(F.col("file"))
        bits = bits.bitwiseOR(F.when(test, 1 << place).otherwise(0))
    return bits


def _config_pairs(located: DataFrame) -> DataFrame:
    """The secrets of a repository with the other assets of its config files, both folded to nodes before they are moved."""
    secret = flows.is_source("env-svc")
    ends = located.where(secret | (flows.is_destination("env-svc") & flows.is_config_file(F.col("file")))).where(
        F.col("repo_id").isNotNull())
    folded = _folded(ends, ["repo_id"])
    row = F.struct("type", "sensitive", "ord", "encrypted", "node_id")
    place = [name for name, *_ in code.FLOW_KINDS].index("env-svc")
    return (
        folded.groupBy("repo_id").agg(
            F.collect_list(F.when(secret, row)).alias("sources"), F.collect_list(F.when(~secret, row)).alias("destinations"))
        .select("repo_id", F.explode("sources").alias("s"), "destinations")
        .select("repo_id", F.lit(place).alias("kind_order"), "s", F.explode("destinations").alias("d"))
    )


def edges(sites: DataFrame) -> DataFrame:
    """The first flow between each pair of nodes, by kind, source and destination order.

    Sites fold inside their file first, so a file meets at most (types x types) node pairs; the banded kind meets lines inside line
    windows.  All of it reads the sites dealt out once by file.
    """
    located = _located(sites)
    ends = lambda pairs: pairs.select(
        "repo_id", F.col("s.node_id").alias("source"), F.col("d.node_id").alias("target"), F.struct(
            "kind_order", F.col("s.ord").alias("s_ord"), F.col("d.ord").alias("d_ord"),
            F.col("s.sensitive").alias("s_sensitive"), F.col("d.sensitive").alias("d_sensitive"),
            (F.col("s.encrypted") | F.col("d.encrypted")).alias("encrypted")).alias("f"))
    picked = ends(_file_pairs(located)).unionByName(ends(_config_pairs(located))).groupBy("repo_id", "source", "target").agg(
        F.min("f").alias("f")).select(
        "repo_id", "source", "target", "f.*").withColumn("kind", F.get(strings([k[0] for k in code.FLOW_KINDS]), F.col("kind_order")))
    sensitive = F.when(F.col("kind") == "api-ext", F.col("s_sensitive") | F.col("d_sensitive")).when(
        F.col("kind").isin("db-cache", "api-queue"), F.col("s_sensitive")).otherwise(True)
    data_type = lookup({k[0]: k[3] for k in code.FLOW_KINDS}, F.col("kind"))
    threats = lookup({k[0]: strings(k[4]) for k in code.FLOW_KINDS}, F.col("kind"))
    listed = picked.select("repo_id", "source", "target", data_type.alias("data_type"), sensitive.alias("sensitive"),
                           "encrypted", threats.alias("threats"))
    label = F.concat(F.when(F.col("sensitive"), "\U0001f512 ").otherwise(""), "data_type", F.lit(" ("),
                     F.size("threats").cast("string"), F.lit(" threats)"))
    return listed.withColumns({"protocols": protocols(F.col("data_type")), "label": label})


def trust_zones(node_rows: DataFrame) -> DataFrame:
    """Zone membership by node type, one row per node."""
    order = F.when(F.col("node_type").isin("external", "api"), 0).when(
        F.col("node_type").isin("database", "cache", "queue"), 2).otherwise(1)
    name = F.get(strings(["Internet-Facing", "Internal Services", "Data Layer"]), F.col("zone_order"))
    zone = F.get(strings(["internet", "internal", "secure"]), F.col("zone_order"))
    return node_rows.select(*NODE, order.alias("zone_order")).select(
        *NODE, "zone_order", name.alias("zone_name"), zone.alias("zone"))


def zone_of_nodes(node_rows: DataFrame, zones: DataFrame, first_wins: bool = False) -> DataFrame:
    """Zone of each node; the last zone that lists it wins (or the first), none means internal."""
    pick = F.min_by if first_wins else F.max_by
    chosen = zones.groupBy(*NODE).agg(pick("zone", "zone_order").alias("zone"))
    return node_rows.join(chosen, NODE, "left").withColumn("zone", F.coalesce("zone", F.lit("internal")))


def flow_locations(endpoints: DataFrame) -> DataFrame:
    """Distinct "file:line" ends of the flows with the first role seen there and whether any is sensitive."""
    return endpoints.groupBy("repo_id", "file", "line").agg(
        F.min_by("role", F.struct("ord", "role")).alias("role"), F.sum("n_flows").alias("n_flows")).select(
        "repo_id", F.concat("file", F.lit(":"), F.col("line").cast("string")).alias("location"), "file", "line",
        "role", "n_flows")


def node_search(node_rows: DataFrame, query: str) -> DataFrame:
    q = query.lower()
    hit = F.lower("label").contains(q) | F.lower("node_type").contains(q) | F.lower(
        F.coalesce("worst_stride", F.lit(""))).contains(q)
    return node_rows.where(hit)


def payload(node_rows: DataFrame, edge_rows: DataFrame, zones: DataFrame) -> DataFrame:
    """Diagram as JSON lines, one per node, edge and zone entry: written per repository, never
    gathered into one document."""
    as_json = lambda rows, kind: rows.select(
        "repo_id", F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in rows.columns if c != "repo_id"])).alias("json"))
    return as_json(node_rows, "node").unionByName(as_json(edge_rows, "edge")).unionByName(as_json(zones, "zone"))
