"""What is moved: stage tables, halves of paths, sites dealt out once."""

import itertools
import random
import re

from pyspark.sql import functions as F

from helpers import AS_OF, asset, assets, threat, threats
from threatloom.catalogs import code
from threatloom.operators import assets as found_assets
from threatloom.operators import best_paths as bp
from threatloom.operators import diagram as dg
from threatloom.operators import flows as fl
from threatloom.operators import mapping as mp
from threatloom.operators import paths as pt
from threatloom.operators import reports as rp
from threatloom.operators import rules as ru
from threatloom.operators import techniques as te
from threatloom.operators import triage as tr
from threatloom.session import checkpointed
from threatloom.sources import sample_views as views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stage_tables_do_not_travel_through_the_driver(spark):
    stage = checkpointed(spark.range(10).withColumn("name", F.lit("n")))
    joined = stage.join(checkpointed(spark.range(5)), "id")
    assert "Broadcast" not in plan(joined)
    assert joined.count() == 5


def random_graph(spark, n=8, seed=3):
    dice = random.Random(seed)
    names = [f"n{i}" for i in range(n)]
    edges = [(a, b) for a, b in itertools.product(names, names) if dice.random() < 0.35]
    nodes = spark.createDataFrame(
        [("r", x, i % 3 == 0, i % 2 == 1, 0.1 * i, 1.0 + i) for i, x in enumerate(names)],
        "repo_id string, node_id string, is_entry boolean, is_jewel boolean, exposure double, jewel_value double")
    rows = spark.createDataFrame(
        [("r", a, b, "t", "", 0.5, "internal", "secure", True) for a, b in edges],
        "repo_id string, source string, target string, technique string, mitre_id string, difficulty double, source_zone string, "
        "target_zone string, source_has_techniques boolean")
    return names, edges, nodes, rows


def walks(edges, path, longest):
    if len(path) > 1:
        yield path
    if len(path) <= longest:
        for a, b in edges:
            if a == path[-1] and b not in path:
                yield from walks(edges, [*path, b], longest)


def test_halves_meet_in_all_simple_paths_and_carry_the_scores_of_their_ends(spark):
    names, edges, nodes, rows = random_graph(spark)
    for longest in (1, 2, 3, 5, 6):
        expected = sorted(p for i, x in enumerate(names) if i % 3 == 0 for p in walks(edges, [x], longest) if int(p[-1][1:]) % 2 == 1)
        found = pt.attack_paths(nodes, rows, longest).collect()
        assert sorted(r.visited for r in found) == expected
        for r in found:
            assert [s["to"] for s in r.steps] == r.visited[1:]
            assert (r.exposure, r.jewel_value) == (0.1 * int(r.entry[1:]), 1.0 + int(r.target[1:]))


def test_scores_do_not_join_the_nodes_again(spark):
    _, _, nodes, rows = random_graph(spark)
    listed = checkpointed(pt.attack_paths(nodes, rows, 3))
    assert "Join" not in plan(pt.score_paths(listed, nodes))


def sites_of(spark):
    dice = random.Random(1)
    kinds = ["api", "authentication", "cryptography", "network", "secret", "database", "filesystem", "cache", "queue"]
    rows = [asset(i, dice.choice(kinds), file=dice.choice(["a/x.go", "b/config.go", "b/y.go"]), line=dice.randrange(1, 120),
                  sensitive=dice.random() < 0.5) for i in range(150)]
    return rows, fl.unique_sites(assets(spark, *rows))


def test_neighbourhood_is_a_sum_over_lines_without_a_join(spark):
    rows, sites = sites_of(spark)
    near = fl.neighbourhood(sites)
    assert "Join" not in plan(near)
    for r in near.collect():
        count = lambda kind, width: sum(x[3] == kind and x[5] == r.file and abs(x[6] - r.line) < width for x in rows)
        assert (r.auth_50, r.api_50, r.auth_10, r.api_10, r.crypto_20) == (
            count("authentication", 50), count("api", 50), count("authentication", 10), count("api", 10), count("cryptography", 20))


def test_rows_without_a_place_are_near_nothing(spark):
    sites = spark.createDataFrame(
        [("r", "a", None, "api", False, 1, 1), ("r", None, 3, "api", False, 1, 2), (None, "a", 3, "api", False, 1, 3)],
        "repo_id string, file string, line bigint, type string, sensitive boolean, n bigint, ord bigint")
    assert [r.api_50 for r in fl.neighbourhood(sites).collect()] == [0, 0, 0]


def test_edges_and_rules_read_the_sites_without_writing_stages(spark):
    _, sites = sites_of(spark)
    assert "parquet" not in plan(dg.edges(sites)).lower()
    assert "parquet" not in plan(ru.flow_rule_counts(sites)).lower()


def moves(df):
    """Hash exchanges of a plan, by the columns they deal out by."""
    return [re.sub(r"#\d+L?", "", found) for found in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan(df))]


def test_sites_written_by_file_are_not_moved_by_what_reads_them_by_file(spark):
    rows, sites = sites_of(spark)
    stage = checkpointed(sites, by=fl.FILE)
    assert sorted(moves(sites)) == ["repo_id, file", "repo_id, id"]
    assert moves(fl.neighbourhood(stage)) == moves(fl.file_counts(stage)) == []
    assert "repo_id, file" not in moves(ru.flow_rule_counts(stage)) + moves(dg.edges(stage))
    key = lambda r: [str(x) for x in r]
    for job in (lambda s: s, fl.neighbourhood, fl.flow_summary, ru.flow_rule_counts):
        assert sorted(job(stage).collect(), key=key) == sorted(job(sites).collect(), key=key)


def test_stage_tables_by_column_keep_nulls_and_leave_no_table(spark):
    rows = [("r", "a", 1), ("r", None, 2), (None, None, 3), ("s", "b", None)]
    counted = {}
    stage = checkpointed(spark.createDataFrame(rows, "repo_id string, file string, n bigint"), counted, "n", by=fl.FILE)
    assert sorted(map(tuple, stage.collect()), key=str) == sorted(rows, key=str) and counted == {"n": 4}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stage_")]


def test_flow_ends_stay_in_their_file(spark):
    rows, _ = sites_of(spark)
    rows.append(asset(200, "api", file="c/no.go", line=None))
    placed = checkpointed(fl.unique_placed(assets(spark, *rows)), by=fl.FILE)
    ends = fl.flow_endpoints(placed, fl.line_sites(placed))
    # One row per file goes to its repository and comes back; the assets lie where they are.
    assert all("id" not in keys.split(", ") and "line" not in keys.split(", ") for keys in moves(ends))
    assert moves(ends).count("repo_id, file") <= 1
    found = {(r.id, r.kind, r.role): r.n_flows for r in ends.collect()}
    ids = {}
    for x in rows:
        ids.setdefault(x[2], x)
    for r in (r for r in ends.collect() if r.kind == "auth-api"):
        other = "api" if r.role == "source" else "authentication"
        assert found[r.id, r.kind, r.role] == sum(
            x[3] == other and x[5] == r.file and x[6] is not None and abs(x[6] - r.line) < 50 for x in ids.values())
    assert not any(r.line is None for r in ends.collect())


def test_nodes_read_the_assets_once(spark):
    found = assets(spark, *[asset(i, "database", file="a/x.go", line=i) for i in range(3)]).withColumn("name", F.lit("Database Insert"))
    told = te.with_technique_ids(tr.triage(threats(spark, threat(1, "database open", "high"), threat(2, "the database", "low")), AS_OF))
    nodes = dg.nodes(checkpointed(found), told)
    assert plan(nodes).count("FileScan") == 1
    row = nodes.first()
    assert (row.n_assets, row.n_files, row.n_findings, row.n_high, row.n_low, row.worst_title) == (3, 1, 2, 1, 1, "database open")


def test_scan_statistics_read_the_listed_paths_once(spark):
    empty = lambda ddl: spark.createDataFrame([], ddl)
    listed = checkpointed(spark.createDataFrame([("r", 4.0), ("r", 8.0)], "repo_id string, composite_risk double"))
    stats = rp.scan_stats(
        empty("repo_id string"), empty("repo_id string, n_flows bigint"), empty("repo_id string, severity string"),
        spark.createDataFrame([("r", 0.3), ("s", 0.2)], "repo_id string, risk double"), listed)
    assert plan(stats).count("FileScan") == 1
    rows = {r.repo_id: (r.total_paths, round(r.max_risk, 6), round(r.avg_risk, 6)) for r in stats.collect()}
    assert rows == {"r": (2, 0.8, 0.5), "s": (0, 0.2, 0.2)}


def test_flow_summary_reads_its_sites_once(spark):
    rows, sites = sites_of(spark)
    stage = checkpointed(sites, by=fl.FILE)
    # What is left to read is one row of sums per file.
    assert "Window" not in plan(fl.flow_summary(stage)) and "line" not in plan(fl.flow_summary(stage))
    sensitive = {(r.file, r.kind): r.n_sensitive for r in fl.flow_summary(stage).collect()}
    ids = {}
    for x in rows:
        ids.setdefault(x[2], x)
    near = lambda a, b: a[3] == "authentication" and b[3] == "api" and a[5] == b[5] and abs(a[6] - b[6]) < 50
    for file in ("a/x.go", "b/config.go", "b/y.go"):
        want = sum(near(a, b) for a in ids.values() for b in ids.values() if a[5] == file)
        assert sensitive.get((file, "auth-api"), 0) == want


def test_sums_near_a_line_take_each_row_once(spark):
    _, sites = sites_of(spark)
    frames = re.findall(r"RangeFrame, (\S+), ", plan(fl.neighbourhood(sites)))
    assert frames and set(frames) == {"unboundedpreceding$()"}


def test_first_of_an_id_travels_with_its_order_once(spark):
    rows = [asset(3, "api", file="late.go", id_="x"), asset(2, "secret", file="first.go", line=9, id_="x"), asset(None, "api", file="a.go", id_="x"),
            asset(None, "api", file="b.go", id_="y"), asset(5, "queue", file="c.go", id_=None, sensitive=True)]
    found = fl.unique_placed(assets(spark, *rows))
    assert "min_by" not in plan(found)
    got = {r.id: (r.ord, r.file, r.line, r.type, r.sensitive) for r in found.collect()}
    assert got == {"x": (2, "first.go", 9, "secret", False), "y": (None,) * 5, "queue-5": (5, "c.go", 1, "queue", True)}


def test_list_values_of_threats_are_found_once(spark):
    rows = threats(spark, threat(1, "a", "low", ["1", "2"], ["x"], ["f"], cves=["C"]), threat(2, "b", "high", ["2", "3"], ["y", "x"], ["f"], cves=["C"]),
                   threat(3, "c", "critical", [], ["code-analysis"], primary="T"))
    plain = tr.triage(rows, AS_OF)
    values = checkpointed(tr.first_appearances(tr.with_key(tr.normalize(rows, AS_OF))), by=tr.KEY)
    shared = tr.triage(rows, AS_OF, values=values)
    assert "Generate" in plan(plain) and "Generate" not in plan(shared)
    key = lambda r: r.dedup_key
    assert sorted(shared.collect(), key=key) == sorted(plain.collect(), key=key)
    listed = lambda found: sorted(map(tuple, found.collect()))
    assert listed(tr.indicator_rows(values)) == listed(tr.merged_indicators(tr.normalize(rows, AS_OF)))


def test_detection_rules_do_not_travel(spark):
    rows = threats(spark, threat(2, "t", "high", primary="T"), threat(1, "t", "low", primary="S"))
    told = tr.triage(rows, AS_OF)
    assert all("detection_rules" not in line for line in plan(told).splitlines() if "partial_min_by" in line)
    first = told.first()
    assert first.affects_known_assets is False and first.severity == "high"
    assert first.detection_rules == tr.enrich(rows).where("ord = 1").first().detection_rules


def test_locations_of_types_that_no_threat_touches_are_not_moved(spark):
    kinds = ["api", "cache", "queue", "database", "authentication", "cryptography"]
    rows = checkpointed(assets(spark, *[asset(i, kinds[i % 6], file=f"f{i % 4}.go", line=i) for i in range(60)]))
    mapped = spark.createDataFrame([("r", "t1", "I"), ("r", "t2", "S"), ("r", "t3", "R")], "repo_id string, id string, stride_primary string")
    found = mp.top_locations(rows, mapped, 3)
    assert re.search(r"PushedFilters: \[[^]]*In\(type, ", plan(found))
    assert sorted((r.threat_id, r.rank, r.line) for r in found.collect()) == [
        ("t1", 1, 0), ("t1", 2, 3), ("t1", 3, 6), ("t2", 1, 4), ("t2", 2, 10), ("t2", 3, 16)]


def test_edges_pair_the_sites_of_a_file_without_a_join(spark):
    rows, sites = sites_of(spark)
    stage = checkpointed(sites, by=fl.FILE)
    shown = plan(dg.edges(stage))
    assert "Join" not in shown and shown.count("Window [") == 2
    ids = {}
    for x in sorted(rows, key=lambda x: x[1]):
        ids.setdefault(x[2], x)
    lines = {}
    for _, ord_, _, kind, _, file, line, *_ in ids.values():
        lines.setdefault((file, line), []).append((ord_, kind))
    placed = []
    for r in stage.collect():
        found = lines[r.file, r.line]
        placed.append((r, f"{min(found)[1]}-{r.file.split('/')[0]}", any(kind == "cryptography" for _, kind in found)))
    want = {}
    config = lambda r: "config" in r.file
    for (s, s_node, s_enc), (d, d_node, d_enc) in itertools.product(placed, placed):
        for place, (kind, source, target, *_) in enumerate(code.FLOW_KINDS):
            starts = s.sensitive and s.type != "cryptography" if source == "+" else s.type == source
            ends = d.type != "secret" if target == "*" else d.type == target
            near = s.file == d.file and (kind != "auth-api" or abs(s.line - d.line) < 50)
            if starts and ends and (near or (kind == "env-svc" and config(d))):
                flow = (place, s.ord, d.ord, s.sensitive, d.sensitive, s_enc or d_enc)
                want[s_node, d_node] = min(want.get((s_node, d_node), flow), flow)
    types = {k[0]: k[3] for k in code.FLOW_KINDS}
    order = [k[0] for k in code.FLOW_KINDS]
    got = {(r.source, r.target): (r.data_type, r.encrypted) for r in dg.edges(stage).collect()}
    assert got == {pair: (types[order[flow[0]]], flow[5]) for pair, flow in want.items()}


def test_sites_without_order_come_first_in_edges(spark):
    sites = spark.createDataFrame(
        [("r", "a/x", 1, "api", False, 1, 5), ("r", "a/x", 1, "cryptography", False, 1, 9), ("r", "a/x", 2, "api", False, 1, None),
         ("r", "a/x", 3, "database", False, 1, 7)],
        "repo_id string, file string, line bigint, type string, sensitive boolean, n bigint, ord bigint")
    assert [(r.source, r.target, r.encrypted) for r in dg.edges(sites).collect()] == [("api-a", "database-a", False)]


def test_steps_of_easiest_paths_are_not_moved_every_round(spark, monkeypatch):
    names, edges, nodes, rows = random_graph(spark)
    written = []
    monkeypatch.setattr(pt, "checkpointed", lambda df, **kept: written.append((df.columns, kept)) or checkpointed(df, **kept))
    found = {(r.entry, r.target): r.total_cost for r in pt.easiest_paths(nodes, rows).collect()}
    assert (["repo_id", "node", "target", "difficulty"], {"by": ["repo_id", "node"]}) in written
    want = {}
    for i, x in enumerate(names):
        for path in walks(edges, [x], len(names)) if i % 3 == 0 else ():
            if int(path[-1][1:]) % 2 == 1:
                want[x, path[-1]] = min(want.get((x, path[-1]), 99), 0.5 * (len(path) - 1))
    assert found == want


def test_tables_in_shares_are_read_where_they_lie(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("k"))
    rows.repartition(16).write.parquet(str(tmp_path / "shares"))
    rows.repartition(1).write.parquet(str(tmp_path / "one"))
    rows.where("k < 0").write.parquet(str(tmp_path / "none"))
    assert "REPARTITION" not in views.dealt(spark, str(tmp_path / "shares"))
    assert "REPARTITION" in views.dealt(spark, str(tmp_path / "one")) and "REPARTITION" in views.dealt(spark, str(tmp_path / "none"))
    assert spark.sql(f"SELECT k FROM {views.dealt(spark, str(tmp_path / 'shares'))} t").count() == 4000


def test_only_rows_of_repeated_ids_are_moved_by_id(spark, monkeypatch):
    rows = [asset(i, "api", file=f"f{i % 7}.go", line=i, id_=f"x{i % 90}") for i in range(100)]
    rows += [asset(None, "api", id_="y"), asset(None, "queue", id_="z"), asset(200, "queue", id_="z")]
    rows += [(None, 300, "x1", *rows[0][3:]), ("r", 301, None, *rows[0][3:]), ("r", 302, None, *rows[1][3:]), (None, 303, None, *rows[1][3:])]
    table = checkpointed(assets(spark, *rows).drop("tags"))
    told = found_assets.repeated_ids(table)
    assert told.count() >= 12
    split = found_assets.unique_by_id(table, told)
    shown = plan(split)
    assert "Union" in shown and "LeftAnti" in shown and moves(split) == ["repo_id, id"]
    key = lambda r: [str(x) for x in r]
    want = sorted(found_assets.unique_by_id(table).collect(), key=key)
    assert sorted(split.collect(), key=key) == want
    monkeypatch.setattr(found_assets, "TOLD_IDS", 3)
    assert found_assets.repeated_ids(table) is None


def test_order_of_assets_does_not_travel_to_their_nodes(spark):
    rows = [asset(2, "api", file="a/x.go", name="/b", description="second"), asset(3, "database", file="b/x.go", name="db", description="only"),
            asset(4, "database", file="c/x.go"), asset(5, "database", file="c/y.go"), asset(1, "api", file="d/x.go", name="/d", description="one")]
    table = checkpointed(assets(spark, *rows))
    none = te.with_technique_ids(tr.triage(threats(spark, threat(1, "t")), AS_OF))
    nodes = dg.nodes(table, none)
    scan = next(line for line in plan(nodes).splitlines() if "FileScan" in line)
    assert "ord#" not in scan
    got = {r.node_id: (r.label, r.description, r.n_files) for r in nodes.collect()}
    assert got["api-a"] == ("/b", "second", 1) and got["api-d"] == ("/d", "one", 1)
    assert got["database-b"][1:] == ("only", 1) and got["database-c"][1:] == ("2 assets across 2 files", 2)


def test_stage_tables_that_lie_in_their_shares_are_not_moved(spark):
    key = ["a", "b"]
    known = checkpointed(spark.createDataFrame([(1, 1, 5), (2, 2, 6), (None, 2, 7)], "a int, b int, n int"), by=key)
    offers = spark.createDataFrame([(2, 2, 1), (3, 3, 2)], "a int, b int, m int").groupBy(*key).agg(F.min("m").alias("m"))
    joined = known.join(offers, key, "full_outer")
    assert moves(joined) == ["a, b"]
    stage = checkpointed(joined, by=key, placed=True)
    assert moves(stage.groupBy(*key).count()) == []
    assert sorted(map(tuple, stage.collect()), key=str) == sorted([(1, 1, 5, None), (2, 2, 6, 1), (3, 3, None, 2), (None, 2, 7, None)], key=str)
    assert sorted(map(tuple, stage.groupBy(*key).count().collect()), key=str) == sorted([(1, 1, 1), (2, 2, 1), (3, 3, 1), (None, 2, 1)], key=str)


def test_known_ways_are_written_where_they_lie(spark, monkeypatch):
    names, edges, nodes, rows = random_graph(spark)
    written = []
    monkeypatch.setattr(pt, "checkpointed", lambda df, **kept: written.append((df, kept)) or checkpointed(df, **kept))
    pt.easiest_paths(nodes, rows)
    rounds = [(df, kept) for df, kept in written if kept.get("placed")]
    assert len(rounds) > 1 and all(kept["by"] == ["repo_id", "entry", "node"] for _, kept in rounds)
    # The ways known before come into the join without a move; the fresh ones go to their node and come back as offers.
    assert all(moves(df).count("repo_id, entry, node") == 1 for df, _ in rounds)


def test_steps_of_the_best_paths_are_not_moved_every_round(spark, monkeypatch):
    names, edges, nodes, rows = random_graph(spark)
    written = []
    monkeypatch.setattr(bp, "checkpointed_by", lambda df, by: written.append((df.columns, by)) or checkpointed(df, by=by))
    best = bp.best_paths(nodes, rows, 3).collect()
    by = [by for columns, by in written if "success_step" in columns]
    assert by == [["repo_id", "node"], ["repo_id", "next"]]
    scored = pt.critical_paths(pt.score_paths(pt.attack_paths(nodes, rows), nodes), 3)
    assert sorted(r.visited for r in best) == sorted(r.visited for r in scored.collect())


def test_asset_rules_read_the_assets_once_and_pair_no_lines(spark):
    dice = random.Random(5)
    kinds = ["api", "authentication", "secret", "cryptography", "queue"]
    rows = [asset(i, dice.choice(kinds), file=dice.choice(["a.go", "b.env", "c.go"]), line=dice.choice([None, *range(1, 400)]),
                  description=dice.choice(["", "save to localStorage"])) for i in range(120)]
    table = checkpointed(assets(spark, *rows))
    hits = ru.asset_rule_hits(table)
    assert plan(hits).count("FileScan") == 1 and "Join" not in plan(hits) and moves(hits) == ["repo_id, file"]
    assert "Join" not in plan(ru.unguarded_apis(table))
    guarded = lambda x: any(y[3] == "authentication" and y[5] == x[5] and None not in (x[6], y[6]) and abs(x[6] - y[6]) < 50 for y in rows)
    open_ = {x[2] for x in rows if x[3] == "api" and not guarded(x)}
    assert {r.id for r in ru.unguarded_apis(table).collect()} == open_
    want = {}
    for x in rows:
        rule = 1 if x[2] in open_ else 3 if x[3] == "secret" and ".env" not in x[5] else 6 if x[3] == "cryptography" else 7 if (
            x[3] == "authentication" and x[7]) else 0
        if rule:
            want.setdefault((x[5], x[6]), (rule, x[2]))
    assert {(r.file, r.line): (r.rule, r.id) for r in hits.collect()} == want
    assert set(hits.columns) == {*table.columns, "rule"}
    assert set(ru.asset_rule_hits(table, ru.TOLD).columns) == {*ru.TOLD, "rule"}
