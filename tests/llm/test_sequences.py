"""Chat, packing, mixing, token counts, media, vectors: small tables against brute force, and the odd cases."""

import io
import itertools
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threatloom.llm import ann, chat, media, mixing, packing, tokencount
from threatloom.llm.tokens import byte_bpe, default_path

SCHEMA = "doc_id bigint, text string, source string, size bigint, draw string, ids string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "d", "x") for i, t, s in rows], SCHEMA)


TRICKY = ["", None, "<|turn|>", "<\\|turn|>", "<\\\\|end|><|end|>", "a<|says|>b<|and|>", "<<|and|>", "$1 \\ \\1 é\U0001f600\n", "|>", "<|"]


def test_chat_round_trip_and_loss(spark):
    rows = []
    for conv, roles in enumerate(itertools.product(["user", "assistant", "<|end|>", None], repeat=3)):
        rows += [(conv, turn, role, TRICKY[(conv * 3 + turn) % len(TRICKY)], "x") for turn, role in enumerate(roles)]
    rows += [(500, 0, "assistant", "same", "x")] * 2 + [(None, 1, "user", "no id", "x"), (501, None, "assistant", "first", "x"), (501, 0, "user", "u", "x")]
    random.Random(0).shuffle(rows)
    talks = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    done = chat.formatted(talks)
    got = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = {}
    for conv, turn, role, text, _ in rows:
        want.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got} == {c: [t[1:] for t in sorted(ts)] for c, ts in want.items()}
    assert {r.conv_id: r.loss for r in got} == {c: "".join(t[2] for t in sorted(ts) if t[1] == "assistant") for c, ts in want.items()}
    merged = next(r.formatted for r in got if r.conv_id == 500)
    assert merged == "<|turn|>assistant<|says|>same<|and|>same<|end|>"
    assert chat.formatted(talks.where("false")).count() == 0


def brute_cost(places, penalties, length):
    best = [0] + [None] * (len(places) - 1)
    for i in range(1, len(places)):
        best[i] = min(best[j] + length - (places[i] - places[j]) + penalties[i] for j in range(i) if places[i] - places[j] <= length)
    return best[-1]


def test_cuts_are_the_cheapest():
    rng = random.Random(2)
    for _ in range(300):
        length = rng.randrange(4, 30)
        places = [0]
        while len(places) < 40:
            places.append(places[-1] + rng.randrange(1, length + 1))
        penalties = [rng.choice([0, 2, 24]) for _ in places]
        cuts, cost = packing.best_cuts(places, penalties, length)
        assert cost == brute_cost(places, penalties, length) and cuts[-1] == 39


def test_packing_covers_every_token_once(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta.", "gamma\n", "δέλτα", "日本"]) for _ in range(rng.randrange(0, 700))) for _ in range(40)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(50, None, "s"), (51, "", "s"), (52, "x" * 60_000, "s"), (None, "no id", "s"), (0, texts[0], "s")]
    pieces = packing.pack(docs(spark, rows).coalesce(1)).toPandas()
    bpe = byte_bpe(default_path())
    pieces["length"] = pieces.ids.map(len) // 4
    for number, text in [(i, t) for i, t, _ in rows if i not in (0, None)]:
        mine = pieces[pieces.doc_id == number].sort_values("start")
        want = [*bpe._exact.encode(text or "", add_special_tokens=False).ids, 0]
        assert np.concatenate([np.frombuffer(x, "<u4") for x in mine.ids]).tolist() == want
        assert mine.start.tolist() == np.cumsum([0, *mine.length])[:-1].tolist() and set(mine.doc_tokens) == {len(want)}
    filled = pieces.sort_values(["sequence_id", "offset"])
    assert (filled.offset == filled.groupby("sequence_id").length.cumsum() - filled.length).all()
    sums = filled.groupby("sequence_id").length.sum()
    padding = sum(1024 - s for s in sums if s & (s - 1))
    assert sums.max() <= 1024 and padding < 0.03 * sums.sum()
    assert packing.pack(docs(spark, [])).count() == 0


def test_fast_merging_gives_the_ids_of_the_file():
    bpe, plain = byte_bpe(default_path()), Tokenizer.from_file(default_path())
    more = ["<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftext|", "\u6f22 <|endoftext|> y"]
    for text in [*more, "", " ", "a  b c d\x85e", "It's <|endoftext|> don't", "\t\n  x\r\n", "1234 ½ ²", "ﬁ 漢字 \U0001f600", "a" * 5000]:
        ids = bpe.ids(text).tolist()
        assert ids == plain.encode(text, add_special_tokens=False).ids
        assert bpe.byte_length[ids].sum() == len(text.encode())
    assert bpe.ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def brute_targets(sizes, weights=(5, 2, 1), epochs=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(full.values())
        level = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > epochs * sizes[s]]
        if not over:
            return {s: full.get(s, level * weight[s]) for s in names}
        full.update({s: epochs * sizes[s] for s in over})


def test_mix_fills_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice(["a", "b", "B", "é", None, "z", "hot", "hot", "hot"])) for i in range(600)]
    rows += [(700, None, "empty"), (701, "", "empty"), (702, "x", "tiny"), (0, "w w w", "a"), (None, "w w", "a"), (None, "w", "b")]
    got = mixing.mix(docs(spark, rows)).collect()
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    targets = brute_targets(sizes)
    for source, target in targets.items():
        mine = [r for r in got if r.source == source]
        assert all(abs(r.target - target) < 1e-6 and r.source_size == sizes[source] for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= max(r.size for r in mine) / 2 + 1
        assert all(r.taken <= 3 * r.size for r in mine)
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [(1, None, "s"), (2, "", None)])).collect()] == [0, 0]


@pytest.mark.parametrize("rule", ["first", "most"])
def test_section_tokens_match_brute_force(spark, rule):
    texts = ["one\ntwo\n\n\nthree", "", None, "\n\n", "é日本\n\U0001f600 x\n", "word " * 500 + "\n" + "tail", "....\n\n....\n"]
    rows = [(i, t, "src\n") for i, t in enumerate(texts)] + [(0, texts[0], "src\n")]
    got = tokencount.section_tokens(docs(spark, rows), fields=("source", "text"), rule=rule)
    bpe = byte_bpe(default_path())
    for row in got.collect():
        whole = "src\n" + "\n\n" + (texts[row.doc_id] or "")
        encoded = bpe._exact.encode(whole, add_special_tokens=False)
        assert row.n_tokens == len(encoded.ids) == sum(s.tokens for s in row.sections)
        assert [s.start for s in row.sections] == [0, *[s.end for s in row.sections][:-1]] and row.sections[-1].end == len(whole)
        ends, at = [], 0
        for s in row.sections:
            ends.append(len(whole[: s.end].encode()))
        counts = [0] * len(ends)
        for number in encoded.ids:
            low, at = at, at + int(bpe.byte_length[number])
            shares = [max(0, min(at, e) - max(low, b)) for b, e in zip([0, *ends[:-1]], ends, strict=True)]
            counts[shares.index(max(shares)) if rule == "most" else next(k for k, x in enumerate(shares) if x)] += 1
        assert counts == [s.tokens for s in row.sections]
    assert tokencount.section_tokens(docs(spark, []), fields=("text",)).count() == 0
    assert tokencount.exploded(tokencount.section_tokens(docs(spark, rows))).where("doc_id = 1").count() == 1


def test_media_round_trip(spark):
    texts = ["", None, "abc", "x" * 576, "é" * 3000, "tone " * 5000, "tone " * 5000]
    table = docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).select("doc_id", media.stored(F.col("text")).alias("media"))
    rows = table.select("doc_id", "media", media.features(F.col("media")).alias("f")).orderBy("doc_id").collect()
    for row, text in zip(rows, texts, strict=True):
        raw = (text or "").encode()
        with wave.open(io.BytesIO(bytes(row.media))) as file:
            assert file.readframes(file.getnframes()) == bytes(row.f.payload)
        assert bytes(row.f.payload)[: len(raw)] == raw and set(bytes(row.f.payload)[len(raw) :]) <= {255}
        assert len(row.f.payload) % 576 == 0 and len(row.f.payload) > 0
        assert row.f.pairs == sorted(row.f.pairs)
    assert rows[5].f == rows[6].f and rows[0].f == rows[1].f and rows[4].f.pairs != rows[5].f.pairs
    assert spark.sql("SELECT CAST(NULL AS BINARY) AS m").select(media.features(F.col("m")).alias("f")).first().f is None
    assert table.where("false").select(media.features(F.col("media"))).count() == 0


def test_fingerprint_finds_a_tone():
    time = np.arange(576 * 20)
    tone = (128 + 100 * np.sin(2 * np.pi * 40 * time / 576)).astype(np.uint8)
    bins, strong = media.peaks(tone)
    band = int(np.searchsorted(media._EDGES, 40, "right")) - 1
    assert (bins[:, band] == 40).all() and strong[:, band].any()


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, code string")


def exact(rows, queries, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in queries:
        if q in good:
            scored = sorted((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = [i for _, i in scored[:k]]
    return out


def test_all_axes_give_the_exact_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(10) * rng.choice([0.1, 1, 30])).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]
    rows += [(300, None), (301, [0.0] * 10), (302, [float("nan")] * 10), (303, [None] * 10), (304, []), (None, [1.0] * 10), (305, [1.0, 2.0, 3.0]),
             (306, [2.0, 1.0, 0.5]), (307, [float("inf")] * 10), (5, rows[5][1])]
    table = vectors(spark, rows)
    asked = [0, 5, 20, 300, 301, 302, 305]
    got = {}
    for r in ann.nearest(table.where(F.col("vec_id").isin(asked)), table, k=7, probes=64, tables=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == exact(rows, asked, 7)
    assert ann.nearest(table.where("false"), table).count() == 0 and ann.nearest(table, table.where("false")).count() == 0


def test_blocks_change_nothing_and_recall_is_high(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(rng.standard_normal((600, 64)))]
    table, asked = vectors(spark, rows), list(range(0, 600, 20))
    query = lambda: {(r.query_id, r.rank): r.vec_id for r in ann.nearest(table.where("vec_id % 20 = 0"), table).collect()}
    whole = query()
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    assert query() == whole
    right = exact(rows, asked, 20)
    found = sum(len(set(right[q]) & {whole[q, r] for r in range(1, 21)}) for q in asked)
    assert found / (20 * len(asked)) >= 0.9


@pytest.mark.parametrize("count", [16, 21])
def test_few_candidates_are_all_found(spark, count):
    rows = [(i, x.tolist()) for i, x in enumerate(np.random.default_rng(count).standard_normal((count, 64)))]
    got = {}
    for r in ann.nearest(vectors(spark, rows), vectors(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == exact(rows, list(range(count)), 20)


def test_wide_vectors_are_found_too(spark):
    x = np.random.default_rng(8).standard_normal((2000, 384))
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1)[:, None])]
    table, asked = vectors(spark, rows), list(range(0, 2000, 100))
    right = exact(rows, asked, 20)
    got = ann.nearest(table.where("vec_id % 100 = 0"), table).collect()
    assert sum(r.vec_id in right[r.query_id] for r in got) / (20 * len(asked)) >= 0.9


def test_long_conversations_go_in_shares(spark):
    """Lengths around the borders of the shares, neighbours of one role across them, and one conversation of 60,000 turns."""
    share = chat.SHARE
    sizes = {1: 1, 2: share - 1, 3: share, 4: share + 1, 5: 2 * share + 1, 6: 60_000}
    roles = ["user", "assistant", "assistant", "tool", "assistant", "user", "user"]
    rows = spark.createDataFrame([(i, n) for i, n in sizes.items()], "conv_id bigint, n int").select("conv_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("turn"))
    role = F.when(F.col("conv_id") == 4, "user").otherwise(F.element_at(F.array(*[F.lit(r) for r in roles]), F.col("turn") % len(roles) + 1))
    text = F.when(F.col("turn") % 11 == 3, "").otherwise(F.concat(F.lit("é<|end|>"), F.col("turn").cast("string")))
    done = chat.formatted(rows.withColumns({"role": role, "text": text}))
    got = done.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted").collect()
    assert sorted(r.conv_id for r in got) == sorted(sizes)
    for r in got:
        says = lambda n: "" if n % 11 == 3 else f"é<|end|>{n}"
        is_role = lambda n: "user" if r.conv_id == 4 else roles[n % len(roles)]
        want = [(is_role(n), says(n)) for n in range(sizes[r.conv_id])]
        assert [tuple(t) for t in r.turns] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")
        assert r.formatted.count(chat.START) == 1 + sum(a[0] != b[0] for a, b in zip(want, want[1:]))
