"""Whitening, group join and phrase mining against brute force, and their odd cases."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threatloom.llm import groupjoin, phrases, queries, whitening

VECTORS = "vec_id long, embedding array<float>, copies int, x string"
DOCS = "doc_id long, text string, lang string, rep int, label string, tokens int"
SMALL = "/root/testdata/sf0.001"


def plain_whitening(rows, components):
    """Components by a fit over every row, one after another."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows])
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    y = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:components]
    deviations = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviations, values[order], y @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_against_a_fit_over_all_rows(spark):
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6))).astype(np.float32)
    rows = [(i, base[i % 40 if i < 100 else i % 60].tolist()) for i in range(160)]
    got = whitening.whitened(spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS).repartition(3), components=4).collect()
    n, deviations, values, z, shares = plain_whitening(rows, 4)
    assert len(got) == 160 * 4 and {r.n for r in got} == {n}
    signs = {}
    for r in got:
        expected = z[r.vec_id][r.component - 1]
        sign = signs.setdefault(r.component, np.sign(r.whitened * expected))
        assert r.whitened * sign == pytest.approx(expected, abs=1e-9)
        assert int(r.deviation) == deviations[r.vec_id]
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_weights_and_wide_numbers(spark):
    """With weights of one, copies do not pull the mean; sums beyond 64 bits stay exact."""
    rows = [(i, [float(2**40 * (i % 3)), float(i % 2), 1.0], 1, "x") for i in range(12)] + [(99, [0.0, 0.0, 1.0], 1, "x")] * 50
    frame = spark.createDataFrame(rows, VECTORS)
    one = {(r.vec_id, r.component): r for r in whitening.whitened(frame, components=3, weights="one").collect()}
    assert {r.n for r in one.values()} == {6} and one[99, 1].copies == 52
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v, *_ in rows[:6]]
    sums = [sum(c) for c in zip(*x)]
    assert int(one[2, 1].deviation) == sum((6 * a - s) ** 2 for a, s in zip(x[2], sums)) > 2**63
    assert one[1, 3].whitened is None and one[1, 1].identity_error < 1e-6  # no variance in the third direction
    with pytest.raises(ValueError):
        whitening.whitened(frame, weights="none")


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0, ""), (1, [1.0, 2.0], 0, ""), (None, [3.0, 5.0], 0, ""), (4, None, 0, ""), (5, [1.0, None], 0, ""), (6, [nan, 1.0], 0, ""),
            (7, [inf, 1.0], 0, ""), (8, [], 0, ""), (9, [3e38, 1.0], 0, ""), (10, [7.0], 0, ""), (11, [0.0, -9.0], 0, "")]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect()
    assert Counter((r.vec_id, r.component) for r in got) == {(1, 1): 2, (1, 2): 2, (None, 1): 1, (None, 2): 1, (11, 1): 1, (11, 2): 1, (10, 1): 1}
    assert {r.n for r in got if r.vec_id != 10} == {4}
    lone = next(r for r in got if r.vec_id == 10)
    assert (lone.n, int(lone.deviation), lone.whitened, lone.explained, lone.identity_error) == (1, 0, None, None, None)
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).count() == 0


def test_whitening_query(spark):
    got = queries.op11_whitening(spark, SMALL).toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    n, deviations, values, z, shares = plain_whitening(rows, 32)
    at = {vec_id: i for i, (vec_id, _) in enumerate(rows)}
    assert len(got) == 32 * len(rows) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-4
    assert all(int(d) == deviations[at[v]] for v, d in zip(got.vec_id, got.deviation))
    mine = np.zeros((len(rows), 32))
    mine[[at[v] for v in got.vec_id], got.component - 1] = got.whitened
    assert np.allclose(np.abs(mine), np.abs(z), atol=1e-6)
    assert np.allclose(got.explained, shares[got.component - 1], rtol=1e-6)


def shingles(text, words):
    found = re.findall("[^ \t-\r]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)} if len(found) >= words else ({tuple(found)} if found else set())


def plain_components(rows, words, percent):
    sets = [(i, shingles(t, words)) for i, t in rows]
    label = {i: i for i, _ in sets if i is not None}
    links = [(a, b) for (a, s), (b, t) in itertools.combinations(sets, 2)
             if None not in (a, b) and s and t and 100 * len(s & t) >= percent * len(s | t)]
    for _ in range(len(label)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label, sets


@pytest.mark.parametrize("seed", [1, 2])
def test_group_join_against_all_pairs(spark, seed, monkeypatch):
    """Chains of edited copies, documents alike just below the bound, and a passage that many share."""
    monkeypatch.setattr(groupjoin, "MEMBERS", 3)
    monkeypatch.setattr(groupjoin, "ASKING", 2)
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for _ in range(6):
        text = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 20, 60, 150]))]
        for _ in range(12):
            edited = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                edited[rng.randrange(len(edited))] = f"w{rng.randrange(400)}"
            rows.append(" ".join(edited))
            if rng.random() < 0.4:
                text = edited
    rows += [" ".join([*passage, *(f"u{rng.randrange(9)}" for _ in range(rng.randrange(4)))]) for _ in range(20)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    label, sets = plain_components(rows, 3, 90)
    assert 1 < len(set(label.values())) < len(rows)
    frame = spark.createDataFrame([(i, t, "en", 0, "", 0) for i, t in rows], DOCS).repartition(3)
    got = {r.doc_id: r for r in groupjoin.set_links(frame).collect()}
    assert {i: r.component_id for i, r in got.items()} == label
    assert all(got[i].n_shingles == len(s) for i, s in sets)


def test_groups_alone_find_every_link(spark, monkeypatch):
    """Without the central pairs the groups must find the same components."""
    rng = random.Random(9)
    text = [f"w{rng.randrange(300)}" for _ in range(90)]
    rows = []
    for i in range(40):
        edited = list(text)
        edited[rng.randrange(90)] = f"x{i}"
        rows.append((i, " ".join(edited if i else text)))
    monkeypatch.setattr(groupjoin, "_hub_pairs", lambda spots, percent: spots.sparkSession.createDataFrame([], "a long, b long"))
    frame = spark.createDataFrame([(i, t, "en", 0, "", 0) for i, t in rows], DOCS)
    got = {r.doc_id: r.component_id for r in groupjoin.set_links(frame).collect()}
    assert got == plain_components(rows, 3, 90)[0]


def test_group_join_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, "A b C d"), (3, "a B c d"), (3, "a B c d"), (7, None), (8, ""), (9, " \t\n"), (10, "one"), (11, "ONE"), (12, "one two"), (None, "a b c d"),
            (None, "nobody else"), (None, None), (20, long), (21, long + " end"), (30, "x y z q r"), (30, "k l m n o"), (31, "X y z q r"), (32, "K l m n o")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in groupjoin.set_links(
        spark.createDataFrame([(i, t, "en", 0, "", 0) for i, t in rows], DOCS)).collect())
    assert got == Counter([
        (5, 2, 3), (3, 2, 3), (3, 2, 3), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 1, 10), (11, 1, 10), (12, 1, 12), (None, 2, 3), (None, 1, None), (None, 0, None),
        (20, 29_998, 20), (21, 29_999, 20), (30, 3, 30), (30, 3, 30), (31, 3, 30), (32, 3, 30)])
    assert groupjoin.set_links(spark.createDataFrame([], DOCS)).count() == 0


def plain_collocations(rows, longest, least, top, covered=80):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        known = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows_of = []
        for p, a in known.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            inside = (b for q, b in known.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not any(100 * b >= covered * a for b in inside):
                rows_of.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -score) for rank, (score, a, p, l, r) in enumerate(sorted(rows_of)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard_bytes", "least", "top"), [(1, 10, 2000), (700, 3, 7), (1 << 20, 10, 2000)])
def test_collocations_against_plain_counts(spark, shard_bytes, least, top, monkeypatch):
    """Shards of one text each, a few, and one; languages, cuts at signs, words with accents, overlaps."""
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard_bytes)
    rng = random.Random(shard_bytes)
    vocabulary = ["New", "york", "Üben", "é", "a", "b", "c", "tail-end", "x y", "zz"]
    rows = []
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 25)):
            words += rng.choice([["new", "York", "city"], ["a", "a", "a"], [rng.choice(vocabulary)], [rng.choice(vocabulary)]])
            words += rng.choice([["."], [], [], [], ["\n"], ["\t"]])
        rows.append((" ".join(words), rng.choice(["en", "en", "de", None])))
    rows += [(None, "en"), ("", "de"), (" .,\n", None), (rows[0][0], rows[0][1])]
    frame = spark.createDataFrame([(i % 5, t, lang, 0, "", 0) for i, (t, lang) in enumerate(rows)], DOCS).repartition(4)
    got = [tuple(r) for r in phrases.collocations(frame, least=least, top=top).collect()]
    assert sorted(got) == plain_collocations(rows, 4, least, top)


def test_collocations_odd_tables(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    blank = spark.createDataFrame([(1, None, "en", 0, "", 0), (2, " ", None, 0, "", 0)], DOCS)
    assert phrases.collocations(blank).count() == 0
    long = spark.createDataFrame([(1, "go on " * 200_000, "en", 0, "", 0)], DOCS).withColumn("count", F.lit(1)).withColumn("key", F.lit("k"))
    got = [tuple(r) for r in phrases.collocations(long).collect()]
    assert got == plain_collocations([("go on " * 200_000, "en")], 4, 30, 2000)


def test_slack_of_other_shards_is_mended(spark, monkeypatch):
    """If a scan sees other shards than the count of the words did, what they allow unreported still counts."""
    rows = [("p q r s. " * 20 if i % 3 else "p q. t u v", "en") for i in range(30)]
    frame = spark.createDataFrame([(i, t, lang, 0, "", 0) for i, (t, lang) in enumerate(rows)], DOCS).coalesce(1)
    kept, seen = phrases._mined, []

    def too_low(base, sizes, totals, least, slack, frequent, pairs):
        seen.append((tuple(sizes), dict(slack)))
        first = [x for x, _ in seen].count(tuple(sizes)) == 1
        return kept(base, sizes, totals, least, dict.fromkeys(slack, 0) if first else slack, frequent, pairs)

    monkeypatch.setattr(phrases, "SHARD_BYTES", 600)
    monkeypatch.setattr(phrases, "_mined", too_low)
    assert sorted(tuple(r) for r in phrases.collocations(frame, least=25).collect()) == plain_collocations(rows, 4, 25, 2000)
    assert len(seen) == 4 and seen[0][1]["en"] == seen[1][1]["en"] > 0


def test_phrases_are_cut_out_as_they_are_joined(monkeypatch):
    texts = ["Big\tRED dog  runs Über ÄÖ x", "", "a B c. d e\x0bF", " lone ", "one two   three FOUR\tfive"]
    words = phrases.Words(pa.array(texts), ["en", "en", "de", "de", "fr"])
    for size in range(1, 5):
        first, _ = words.phrases(size)
        assert words.strings(first, size).to_pylist() == [words.string(place, size) for place in first.tolist()]
    assert words.strings(np.zeros(0, np.int64), 2).to_pylist() == []
    # Phrases whose words have one sign between them are not joined one at a time.
    monkeypatch.setattr(phrases.Words, "string", None)
    plain = phrases.Words(pa.array(["A b\tC"]), ["en"])
    assert plain.strings(np.array([0]), 3).to_pylist() == ["a b c"]
