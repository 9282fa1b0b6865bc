"""Scans after an earlier one against full scans."""

import os

from pyspark.sql import functions as F
from threatloom.operators import incremental as inc
from threatloom.plans import jobs
from threatloom.sources import files as fs

AS_OF = "2024-02-01 00:00:00"
FILES = "repo_id string, path string, content string"


def as_rows(frame):
    return sorted(str(r) for r in frame.select(*sorted(frame.columns)).collect())


def nothing(spark):
    none = spark.createDataFrame([], FILES)
    return inc.file_index(none), jobs.detected(none)


def test_changed_added_deleted_and_renamed_files(spark):
    api, secret = 'router.GET("/a", h)\n', 'password = "x"\n'
    before = [("r", "same.go", api + secret), ("r", "edit.go", api), ("r", "gone.go", secret), ("r", "old.go", secret), ("q", "same.go", api),
              ("q", "twice.go", api), ("q", "twice.go", secret), (None, "n.go", api), ("q", None, api), ("q", "null.go", None), ("q", "back.go", api)]
    after = [("r", "same.go", api + secret), ("r", "edit.go", secret + api), ("r", "new.go", secret), ("q", "same.go", api), ("q", "add.go", api),
             ("q", "twice.go", secret), ("q", "twice.go", secret), (None, "n.go", secret), ("q", None, secret), ("q", "null.go", "")]
    old, new = (spark.createDataFrame(rows, FILES).withColumn("digest", F.lit("clash")) for rows in (before, after))
    first = jobs.rescan(old, *nothing(spark))
    assert as_rows(first["assets"]) == as_rows(jobs.detected(old)) and {r.change for r in first["changes"].collect()} == {"added"}
    second = jobs.rescan(new, first["index"], first["assets"])
    assert as_rows(second["assets"]) == as_rows(jobs.detected(new))
    assert {(r.repo_id, r.path): r.change for r in second["changes"].collect()} == {
        ("r", "edit.go"): "modified", ("r", "gone.go"): "removed", ("r", "old.go"): "removed", ("r", "new.go"): "added", ("q", "add.go"): "added",
        ("q", "twice.go"): "modified", (None, "n.go"): "modified", ("q", None): "modified", ("q", "back.go"): "removed"}
    assert as_rows(second["index"]) == as_rows(inc.file_index(new))
    third = jobs.rescan(new, second["index"], second["assets"])
    assert third["changes"].count() == 0 and as_rows(third["assets"]) == as_rows(second["assets"])
    emptied = jobs.rescan(new.limit(0), second["index"], second["assets"])
    assert emptied["assets"].count() == 0 and emptied["index"].count() == 0
    whole, part = jobs.scan(new.where("path IS NOT NULL AND repo_id IS NOT NULL"), AS_OF), jobs.scan(
        new.where("path IS NOT NULL AND repo_id IS NOT NULL"), AS_OF, found=second["assets"].where("repo_id IS NOT NULL"))
    assert as_rows(whole["threats"].drop("id")) == as_rows(part["threats"].drop("id"))


def first_index(spark):
    index, found = nothing(spark)
    return index.withColumns({"size": F.lit(0).cast("bigint"), "modified": F.current_timestamp()}), found


def test_only_changed_files_of_a_tree_are_opened(spark, tmp_path, monkeypatch):
    repo = tmp_path / "trees" / "shop"
    (repo / "in ner").mkdir(parents=True)
    (repo / ".github" / "workflows").mkdir(parents=True)
    (repo / ".github" / "workflows" / "ci.yml").write_text("run: deploy")
    for name in ("same", "edit", "gone", "old", "touch", "in ner/x"):
        (repo / f"{name}.go").write_text(f'router.GET("/{name}", h)\npassword = "x"\n')
    root = str(tmp_path / "trees")
    first = jobs.rescan_trees(spark, root, *first_index(spark))
    assert as_rows(first["assets"]) == as_rows(jobs.detected(fs.read_trees(spark, root))) and first["index"].count() == 7
    (repo / "edit.go").write_text("redis.get(k)\n")
    (repo / "new.go").write_text('fetch("http://a")\n')
    os.remove(repo / "gone.go")
    os.rename(repo / "old.go", repo / "moved.go")  # keeps its time
    os.utime(repo / "touch.go", (1, 1))
    opened = []
    read = fs.read_listed
    monkeypatch.setattr(fs, "read_listed", lambda *a: opened.append(read(*a)) or opened[-1])
    second = jobs.rescan_trees(spark, root, first["index"], first["assets"])
    assert {r.path for r in opened[0].collect()} == {"edit.go", "new.go", "moved.go", "touch.go"}
    assert {r.path: r.change for r in second["changes"].collect()} == {
        "edit.go": "modified", "new.go": "added", "moved.go": "added", "gone.go": "removed", "old.go": "removed"}
    assert as_rows(second["assets"]) == as_rows(jobs.detected(fs.read_trees(spark, root)))
    assert as_rows(second["index"]) == as_rows(first_index(spark)[0].limit(0).unionByName(
        fs.list_trees(spark, root).join(inc.file_index(fs.read_trees(spark, root)), ["repo_id", "path"])))
    # A file that cannot be opened is no matter as long as it does not change.
    third = jobs.rescan_trees(spark, root, second["index"], second["assets"])
    assert third["changes"].count() == 0 and opened[1].count() == 0 and as_rows(third["assets"]) == as_rows(second["assets"])


def test_many_changed_files_are_joined(spark, tmp_path):
    repo = tmp_path / "trees" / "shop"
    repo.mkdir(parents=True)
    for n in range(5):
        (repo / f"f{n}.go").write_text(f"fetch({n})")
    listed = fs.list_trees(spark, str(tmp_path / "trees")).where("path <> 'f3.go'")
    few, many = (fs.read_listed(spark, str(tmp_path / "trees"), listed, most) for most in (4, 3))
    assert as_rows(few) == as_rows(many) and few.count() == 4
