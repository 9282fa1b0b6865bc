"""The pipeline stage by stage against brute force, and the entry module with and without it."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from threatloom.llm import queries

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    seen, tables = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).persist()
        tables[name] = docs.toPandas()
        assert docs.columns == seen
    kept = set(tables["quality"].doc_id)
    known = [(i in kept, q == 1) for i, q in labels.items()]
    assert sum(a == b for a, b in known) / len(known) > 0.95
    assert tables["near duplicates"].text.is_unique and set(tables["near duplicates"].doc_id) < kept
    assert len(tables["pii"]) == len(tables["near duplicates"]) and (tables["pii"].n_chars == tables["pii"].text.map(len)).all()
    words = lambda t: t.text.map(lambda x: len(x.split())).sum()
    assert abs(words(tables["mixing"]) - words(tables["pii"])) < 0.2 * words(tables["pii"])
    assert tables["mixing"].groupby("doc_id").size().max() <= 3


def test_rows_without_id_go_with_their_group(spark):
    words = [f"w{i}" for i in range(60)]
    base, near, other, free = (" ".join(w) for w in (words, [*words[:-1], "end"], words[::-1], [*words[20:], *words[:20], *"abcdefghijklmnopqrstuvwxyz"]))
    rows = [(1, base), (None, base), (None, near), (None, other), (None, other), (None, other + " more"), (5, None), (None, None), (None, None), (6, free), (6, free)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.keep_one_of_each(spark, docs, SMALL)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    others = [t for i, t in got if i is None and t]
    assert len(others) == 1 and others[0].startswith(other)
    assert sorted((str(x) for x in got if x[1] not in others)) == sorted(map(str, [(1, base), (5, None), (None, None), (6, free)]))
    assert corpus_pipeline.keep_one_of_each(spark, docs.where("false"), SMALL).count() == 0


def test_run_gives_packed_pieces(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_entry_works_without_the_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("threatloom.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 100 and "pipeline" not in e.queries() and not [n for n in e.oracle_sql() if n.startswith("op")]
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)
