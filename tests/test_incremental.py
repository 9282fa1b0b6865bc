"""Merged threats as state of a stream, and the best paths by bound, each against the plain way."""

import random

import pytest
from helpers import AS_OF, threat, threats
from pyspark.sql import functions as F
from threatloom.operators import best_paths as bp
from threatloom.operators import paths as pt
from threatloom.operators import reports as rp
from threatloom.operators import triage as t
from threatloom.streaming import intake as st
from threatloom.streaming import log, merge

NODES = ("repo_id string, node_id string, is_entry boolean, is_jewel boolean, exposure double, jewel_value double")
EDGES = ("repo_id string, source string, target string, technique string, mitre_id string, difficulty double, source_zone string, "
         "target_zone string, source_has_techniques boolean")


def some_threats(seed, first, count):
    rng = random.Random(seed)
    return [threat(first + i, title=f"title {rng.randrange(6)}", severity=rng.choice(["low", "high", "critical"]), repo=rng.choice(["r", "s"]),
                   indicators=[f"i{rng.randrange(5)}" for _ in range(rng.randrange(3))], tags=[f"t{rng.randrange(4)}" for _ in range(rng.randrange(3))]
                   + (["code-analysis"] if rng.random() < 0.4 else []), feeds=[f"f{rng.randrange(3)}"], count=rng.randrange(4),
                   description="text (2 instances across 1 files)") for i in range(count)]


def as_rows(frame):
    return sorted(str(r) for r in frame.select(*sorted(frame.columns)).collect())


def test_stream_state_equals_the_merge_of_all_rows(spark, tmp_path):
    """Five runs of a stream that is stopped and started again, with folds in between; after each the lists are those of the batch."""
    folder, rows, schema = str(tmp_path / "in"), [], threats(spark).schema
    for run in range(5):
        fresh = some_threats(run, 100 * (5 - run), 25)  # later batches hold earlier rows of the order
        rows += fresh
        threats(spark, *fresh).coalesce(1).write.mode("append").parquet(folder)
        merge.start(st.read_stream(spark, folder, schema), str(tmp_path / "out"), str(tmp_path / "state"), fold=2).awaitTermination()
        whole = threats(spark, *rows)
        if run in (0, 3, 4):
            assert as_rows(merge.merged(spark, str(tmp_path / "out"), AS_OF, fold=2)) == as_rows(t.merge_duplicates(whole, AS_OF))
    assert as_rows(merge.merged_indicators(spark, str(tmp_path / "out"), fold=2)) == as_rows(t.merged_indicators(whole))
    assert len(log.live_parts(spark, str(tmp_path / "out"), 2)) <= 3


def test_a_batch_writes_what_it_changes_and_can_run_again(spark, tmp_path):
    folder = str(tmp_path / "out")
    put = log.writer_to(folder, merge.ENTRY, 3)
    batches = [merge.entries(threats(spark, threat(i, title=f"t{i}"))) for i in range(9)]
    for epoch, batch in enumerate(batches):
        put(batch, epoch)
        before = as_rows(merge.state(spark, folder, 3))
        put(batch, epoch)
        assert as_rows(merge.state(spark, folder, 3)) == before
        assert spark.read.parquet(f"{folder}/level=0/part={epoch}").count() == batch.count()
    assert log.live_parts(spark, folder, 3) == [f"{folder}/level=2/part=0"]
    assert merge.heads(merge.state(spark, folder, 3)).count() == 9
    # A reader between a batch and its fold takes the parts below.
    put(batches[0], 9)
    put(batches[1], 10)
    assert log.live_parts(spark, folder, 3) == [f"{folder}/level=2/part=0", f"{folder}/level=0/part=9", f"{folder}/level=0/part=10"]


def test_titles_can_be_merged_whole(spark):
    long = "x" * 100
    rows = threats(spark, threat(1, title=long + "a"), threat(2, title=long + "b"))
    assert t.triage(rows, AS_OF).count() == 1
    assert {r.title for r in t.triage(rows, AS_OF, key_chars=None).collect()} == {long + "a", long + "b"}


def test_threats_by_severity(spark):
    rows = threats(spark, threat(1, severity="low"), threat(2, severity="critical"), threat(3, severity="info"), threat(4, severity="critical"),
                   threat(5, severity="high", repo="a"))
    order = [("a", 5), ("r", 2), ("r", 4), ("r", 1), ("r", 3)]
    assert [(r.repo_id, r.ord) for r in rp.by_severity(rows).collect()] == order
    assert {(r.repo_id, r.rank, r.ord) for r in rp.top_by_severity(rows, 2).collect()} == {("a", 1, 5), ("r", 1, 2), ("r", 2, 4)}


def random_graph(seed, nodes, density, repos=("r", "s")):
    rng = random.Random(seed)
    node_rows, edge_rows = [], []
    for repo in repos:
        zones = {i: rng.choice(["internet", "internal", "secure"]) for i in range(nodes)}
        hints = {i: rng.random() < 0.3 for i in range(nodes)}
        for i in range(nodes):
            node_rows.append((repo, f"n{i}", rng.random() < 0.4, rng.random() < 0.4, rng.choice([0.1, 0.3, 1.0]), rng.choice([1.0, 2.0, 2.3])))
            for j in range(nodes):
                if i != j and rng.random() < density:
                    edge_rows.append((repo, f"n{i}", f"n{j}", "Lateral Movement", rng.choice(["T1190", "T1212", "T1021", ""]),
                                      rng.choice([0.05, 0.2, 0.3, 0.5, 0.8, 1.0]), zones[i], zones[j], hints[i]))
    return node_rows, edge_rows


@pytest.mark.parametrize(("seed", "nodes", "density", "limit"), [(1, 7, 0.4, 5), (2, 9, 0.25, 10), (3, 6, 0.9, 3)])
def test_best_paths_equal_the_listing(spark, seed, nodes, density, limit):
    node_rows, edge_rows = random_graph(seed, nodes, density)
    n, e = spark.createDataFrame(node_rows, NODES), spark.createDataFrame(edge_rows, EDGES)
    listed = pt.critical_paths(pt.score_paths(pt.attack_paths(n, e), n), limit)
    columns = ["repo_id", "rank", "path_key", "composite_risk", "steps", "tactics", "total_difficulty"]
    assert as_rows(bp.top_scored(n, e, limit).select(columns)) == as_rows(listed.select(columns))


def test_best_paths_odd_graphs(spark):
    n = spark.createDataFrame([("r", "a", True, False, 1.0, 1.0), ("r", "b", False, True, 0.1, 2.0), ("r", "c", True, True, 0.1, 3.0)], NODES)
    none = spark.createDataFrame([], EDGES)
    assert bp.best_paths(n, none).count() == 0
    loops = spark.createDataFrame([("r", s, d, "", "", 0.2, "x", "x", False) for s, d in (("a", "b"), ("b", "a"), ("a", "a"), ("b", "c"))], EDGES)
    assert {r.path_key for r in bp.top_scored(n, loops).collect()} == {"a>b", "a>b>c"}
    assert {r.path_key for r in bp.top_scored(n, loops, max_depth=1).collect()} == {"a>b"}


def test_dense_repository_keeps_a_small_frontier(spark, monkeypatch):
    """Two hundred nodes with an edge each way: some 10^13 paths; what is kept per round stays near limit x nodes."""
    nodes = 200
    node_rows = [("r", f"n{i:03}", i < 20, i >= 180, 0.5 + (i % 3) / 10, 1.0 + (i % 5) / 2) for i in range(nodes)]
    pairs = spark.range(nodes).select(F.col("id").alias("i")).join(spark.range(nodes).select(F.col("id").alias("j")), F.expr("i <> j"))
    name = lambda c: F.format_string("n%03d", c)
    edges = pairs.select(
        F.lit("r").alias("repo_id"), name("i").alias("source"), name("j").alias("target"), F.lit("Lateral Movement").alias("technique"),
        F.lit("T1021").alias("mitre_id"), ((F.col("i") * 7 + F.col("j") * 3) % 5 / 10 + 0.2).alias("difficulty"),
        F.when(F.col("i") % 2 == 0, "internal").otherwise("secure").alias("source_zone"),
        F.when(F.col("j") % 2 == 0, "internal").otherwise("secure").alias("target_zone"), (F.col("i") % 4 == 0).alias("source_has_techniques"))
    sizes, kept = [], bp.checkpointed

    def counted(frame):
        out = kept(frame)
        if "visited" in out.columns and "success" in out.columns and "most" not in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(bp, "checkpointed", counted)
    top = bp.top_scored(spark.createDataFrame(node_rows, NODES), edges, 10).collect()
    assert len(top) == 10 and max(sizes) <= 10 * nodes
