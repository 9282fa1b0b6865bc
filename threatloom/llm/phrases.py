"""Phrase collocation mining in shards: local candidates, their union, then exact counts of all candidates.

1. Words are counted exactly per language.  A phrase is as frequent as its rarest word at most, so other words cut the text.
2. Shards, bounded stretches of rows, are mined completely for pairs and then for longer phrases: a phrase counted in all
   at least ``least`` times reaches ceil(least * share) in a shard that holds this share of its language's words, so what
   stays below that everywhere is no candidate.  Of the union, a candidate stays if its reported counts, and one less than
   the local support for every shard that did not report it, can reach ``least``.
3. All candidates are counted exactly, as strings, over all texts.

Sets of words, pairs and candidates go to the scans as bit tables; a false hit there costs a row and changes no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threatloom.llm.common import byte_view, mixed, row_chunks, stage, word_hashes

LONGEST, LEAST, TOP = 4, 30, 2000
SHARD_BYTES = 2 << 20
FLUSH_KEYS, FLUSH_STRINGS = 1 << 18, 1 << 16  # a task reports when it holds so many
BITS_LEAST, BITS_MOST = 20, 28  # a bit table has 2^20 to 2^28 bits: 32 MB at most
_PROBES = 2
_SPACE, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)  # of a phrase: A-Z in lower case, a tab between words as a blank
_LOWER[0x41:0x5B] += 32
_LOWER[0x09] = 0x20
_PLACE = mixed(np.arange(11, 11 + LONGEST, dtype=np.uint64)) | np.uint64(1)
UNKNOWN = "und"


class Words:
    """Words of some texts in a row: their bytes, hash with the language, and the piece each lies in."""

    def __init__(self, texts: pa.Array, langs: list[str]) -> None:
        self.data, offsets = byte_view(texts)
        kind = np.append(_KIND[self.data], _BREAK)
        inside = kind == 0
        opens = inside.copy()
        opens[1:] = inside[1:] & ~inside[:-1]
        firsts = offsets[:-1][offsets[:-1] < len(self.data)]
        opens[firsts] = inside[firsts]
        shuts = inside.copy()
        shuts[:-1] = inside[:-1] & ~inside[1:]
        lasts = offsets[1:][offsets[1:] > 0] - 1
        shuts[lasts] = inside[lasts]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
        text = np.searchsorted(offsets, self.starts, "right") - 1
        self.piece = np.cumsum(kind == _BREAK, dtype=np.int32)[self.starts] + text.astype(np.int32)
        names = sorted(set(langs))
        number = {name: i for i, name in enumerate(names)}
        self.names = names
        self.lang = np.array([number[x] for x in langs], np.int32)[text] if len(text) else np.zeros(0, np.int32)
        seeds = word_hashes(*_joined([n.encode() for n in names]))
        self.seeds = mixed(seeds)
        self.hash = word_hashes(self.data, self.starts, self.ends)
        self.keys = mixed(self.hash ^ self.seeds[self.lang]) if len(text) else np.zeros(0, np.uint64)
        self.starts, self.ends = self.starts.astype(np.int32), self.ends.astype(np.int32)

    def phrases(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and key of every run of ``size`` words of one piece."""
        count = max(0, len(self.hash) - size + 1)
        if not count:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = self.seeds[self.lang[:count]]
        for j in range(size):
            total += self.hash[j : j + count] * _PLACE[j]
        whole = np.flatnonzero(self.piece[:count] == self.piece[size - 1 :])
        return whole, mixed(total[whole])

    def string(self, first: int, size: int) -> str:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[first : first + size].tolist(), self.ends[first : first + size].tolist(), strict=True)).lower().decode()

    def strings(self, first: np.ndarray, size: int) -> pa.Array:
        """The phrases of ``size`` words that start at these words: cut out at once, if single signs stand between their words."""
        first = first.astype(np.int64)
        opens, length = self.starts[first].astype(np.int64), (self.ends[first + size - 1] - self.starts[first]).astype(np.int64)
        letters = sum((self.ends[first + j] - self.starts[first + j]).astype(np.int64) for j in range(size))
        plain = length == letters + (size - 1)
        parts = []
        at = np.flatnonzero(plain)
        for low in range(0, len(at), 1 << 14):
            some = at[low : low + (1 << 14)]
            offsets = np.concatenate([[0], np.cumsum(length[some])])
            text = _LOWER[self.data[np.repeat(opens[some] - offsets[:-1], length[some]) + np.arange(offsets[-1])]]
            parts.append(pa.StringArray.from_buffers(len(some), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(text)))
        odd = np.flatnonzero(~plain)
        parts.append(pa.array([self.string(place, size) for place in first[odd].tolist()], pa.string()))
        places = np.empty(len(first), np.int64)
        places[np.concatenate([at, odd])] = np.arange(len(first))
        return pa.concat_arrays(parts).take(pa.array(places)) if len(odd) else pa.concat_arrays(parts)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), ends - np.array([len(p) for p in parts], np.int64), ends


class Bits:
    """Set of keys as a table of bits, with false hits."""

    def __init__(self, table: bytes) -> None:
        self.table = np.frombuffer(table, np.uint8)
        self.size = np.uint64(8 * len(table))

    @staticmethod
    def places(keys: np.ndarray, size: np.uint64) -> list[np.ndarray]:
        return [mixed(keys + np.uint64(probe)) % size for probe in range(1, _PROBES + 1)]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for place in self.places(keys, self.size):
            out &= (self.table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def bits_of(keys: DataFrame, column: str) -> Bits:
    """Bit table of a column of keys, sized to their number up to 32 MB.  Only the bytes in use pass through the driver."""
    exponent = min(BITS_MOST, max(BITS_LEAST, math.ceil(math.log2(16 * keys.count() + 1))))
    size = np.uint64(1 << exponent)

    def places(batches):
        for batch in batches:
            found = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate(Bits.places(found, size)))
            byte, first = np.unique(at >> np.uint64(3), return_index=True)
            values = np.bitwise_or.reduceat(np.uint8(1) << (at & np.uint64(7)).astype(np.uint8), first) if len(at) else np.zeros(0, np.uint8)
            yield pa.RecordBatch.from_pydict({"byte": pa.array(byte.astype(np.int32)), "value": pa.array(values.astype(np.int32))})

    used = keys.select(F.col(column)).mapInArrow(places, "byte int, value int").groupBy("byte").agg(F.bit_or("value").alias("value")).toArrow()
    table = np.zeros(1 << (exponent - 3), np.uint8)
    table[used.column("byte").to_numpy()] = used.column("value").to_numpy()
    return Bits(table.tobytes())


def _shards(batches, shard_bytes: int) -> Iterator[list[Words]]:
    """Stretches of rows of about ``shard_bytes``, one row at least, each as a few smaller stretches."""
    held, size = [], 0
    for batch in batches:
        texts, langs = batch.column("text"), batch.column("lang").to_pylist()
        _, offsets = byte_view(texts)
        for first, last in row_chunks(offsets):
            length = int(offsets[last] - offsets[first])
            if held and size + length > shard_bytes:
                yield held
                held, size = [], 0
            held.append(Words(texts.slice(first, last - first), langs[first:last]))
            size += length
    if held:
        yield held


def _strings(base: DataFrame, wanted) -> DataFrame:
    """Exact counts of phrases as strings: ``lang, phrase, size, key, count``; and per shard size a row without phrase.

    ``wanted`` gives (words in a phrase, first words, keys) of the phrases of a stretch of texts.  Tasks add up before they report.
    """
    def count(batches):
        shares: list[tuple[str, int]] = []  # language and its words in a shard
        held: list = []  # keys, counts, sizes, languages and phrases, one row per key

        def out() -> pa.RecordBatch:
            none = pa.nulls(len(shares), pa.string())
            keys, counts, sizes, langs, names = held or [np.zeros(0, np.int64)] * 3 + [none[:0]] * 2
            return pa.RecordBatch.from_pydict({
                "lang": pa.concat_arrays([langs, pa.array([lang for lang, _ in shares], pa.string())]), "phrase": pa.concat_arrays([names, none]),
                "size": pa.array(np.append(sizes, np.array([n for _, n in shares], np.int64)).astype(np.int32)),
                "key": pa.array(np.append(keys, np.zeros(len(shares), np.int64))), "count": pa.array(np.append(counts, np.ones(len(shares), np.int64)))})

        for shard in _shards(batches, SHARD_BYTES):
            shares += _sizes(shard).items()
            found = [(words, size, *phrases) for words in shard for size, *phrases in wanted(words)]
            if found:
                held = _added(held, _distinct(found))
                if len(held[0]) > FLUSH_STRINGS:
                    yield out()
                    shares, held = [], []
        yield out()

    parts = base.mapInArrow(count, "lang string, phrase string, size int, key bigint, count bigint")
    return parts.groupBy("lang", "phrase", "size").agg(F.min("key").alias("key"), F.sum("count").alias("count"))


def _distinct(found: list) -> list:
    """The phrases of a shard, one row per key: keys, counts, sizes, languages and phrases."""
    keys, at, counts = np.unique(np.concatenate([f[3] for f in found]), return_index=True, return_counts=True)
    order = np.argsort(at)  # by the part a phrase is taken from
    keys, at, counts = keys[order].view(np.int64), at[order], counts[order]
    ends = np.cumsum([len(f[3]) for f in found])
    cuts = np.searchsorted(at, np.append(0, ends))
    sizes, langs, names = [], [pa.array([], pa.string())], [pa.array([], pa.string())]
    for (words, size, first, part), end, low, high in zip(found, ends.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        chosen = first[at[low:high] - (end - len(part))]
        sizes.append(np.full(high - low, size, np.int64))
        langs.append(pa.array(words.names, pa.string()).take(pa.array(words.lang[chosen])))
        names.append(words.strings(chosen, size))
    return [keys, counts.astype(np.int64), np.concatenate(sizes), pa.concat_arrays(langs), pa.concat_arrays(names)]


def _added(held: list, more: list) -> list:
    """Rows of both, added up by key."""
    if not held:
        return more
    keys, at, row = np.unique(np.concatenate([held[0], more[0]]), return_index=True, return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, row, np.concatenate([held[1], more[1]]))
    langs, names = (pa.concat_arrays([held[i], more[i]]).take(pa.array(at)) for i in (3, 4))
    return [keys, counts, np.concatenate([held[2], more[2]])[at], langs, names]


def _sizes(shard: list[Words]) -> dict[str, int]:
    """Words of each language in a shard."""
    out: dict[str, int] = {}
    for words in shard:
        for number, count in enumerate(np.bincount(words.lang, minlength=len(words.names)).tolist()):
            if count:
                out[words.names[number]] = out.get(words.names[number], 0) + count
    return out


def _single_words(words: Words):
    yield 1, np.arange(len(words.keys)), words.keys


def _phrases_of(words: Words, size: int, frequent: Bits, pairs: Bits | None) -> tuple[np.ndarray, np.ndarray]:
    """First words and keys of the phrases whose words, and pairs if a table of them is given, are all frequent."""
    first, keys = words.phrases(size)
    known = frequent.holds(words.keys)
    fit = np.ones(len(first), bool)
    for j in range(size):
        fit &= known[first + j]
    if pairs is not None and size > 2:
        starts, two = words.phrases(2)
        good = np.zeros(len(words.keys), bool)
        good[starts] = pairs.holds(two)
        for j in range(size - 1):
            fit &= good[first + j]
    return first[fit], keys[fit]


_MINED = "key bigint, lang int, count bigint, spare bigint"


def _mined(base: DataFrame, sizes: list[int], totals: dict[str, int], least: int, slack: dict[str, int], frequent: Bits, pairs: Bits | None) -> DataFrame:
    """Keys of the phrases that can occur ``least`` times, from the complete local counts of every shard.

    ``slack`` is how often a phrase that no shard reports may occur.  It follows from the sizes of the shards, which
    the count of the words has found; should the shards of this scan be others, it is run again with what they allow.
    """
    number_of = {name: i for i, name in enumerate(sorted(totals))}

    def mine(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        allowed = np.zeros(len(number_of), np.int64)
        for shard in _shards(batches, SHARD_BYTES):
            support = np.ones(len(number_of), np.int64)
            for name, n in _sizes(shard).items():
                support[number_of[name]] = -(-least * n // totals[name])
            allowed += support - 1
            for size in sizes:
                found = [(w, *_phrases_of(w, size, frequent, pairs)) for w in shard]
                keys = np.concatenate([k for _, _, k in found])
                langs = np.concatenate([np.array([number_of.get(n, 0) for n in w.names], np.int32)[w.lang[first]] for w, first, _ in found])
                keys, at, counts = np.unique(keys, return_index=True, return_counts=True)
                langs = langs[at]
                kept = counts >= support[langs]
                held.append((keys[kept], langs[kept], counts[kept], support[langs[kept]] - 1))
            if sum(len(h[0]) for h in held) > FLUSH_KEYS:
                yield from _merged(held)
                held = []
        yield from _merged(held)
        yield _rows_of(None, np.arange(len(allowed)), np.zeros(len(allowed)), allowed)

    table = F.create_map(*[c for name, i in number_of.items() for c in (F.lit(i), F.lit(slack[name]).cast("bigint"))])
    reach = F.col("count") + F.element_at(table, F.col("lang")) - F.col("spare")
    summed = base.mapInArrow(mine, _MINED).groupBy("key", "lang").agg(F.sum("count").alias("count"), F.sum("spare").alias("spare"))
    found = stage(summed.where(F.col("key").isNull() | (reach >= least)))
    names = sorted(totals)
    seen = {names[r.lang]: r.spare for r in found.where("key IS NULL").collect()}
    if any(seen[name] > slack[name] for name in seen):
        return _mined(base, sizes, totals, least, {name: max(slack[name], seen.get(name, 0)) for name in slack}, frequent, pairs)
    return found.where("key IS NOT NULL").select("key")


def _merged(held) -> Iterator[pa.RecordBatch]:
    """What the shards of a task report, added up by key."""
    if not held:
        return
    keys, langs, counts, spare = (np.concatenate(column) for column in zip(*held, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return
    keys, langs = keys[first], langs[order][first]
    counts, spare = np.add.reduceat(counts[order], first), np.add.reduceat(spare[order], first)
    for low in range(0, len(keys), 1 << 16):
        part = slice(low, low + (1 << 16))
        yield _rows_of(keys[part], langs[part], counts[part], spare[part])


def _rows_of(keys: np.ndarray | None, langs, counts, spare) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "key": pa.nulls(len(langs), pa.int64()) if keys is None else pa.array(keys.view(np.int64)), "lang": pa.array(np.asarray(langs, np.int32)),
        "count": pa.array(np.asarray(counts, np.int64)), "spare": pa.array(np.asarray(spare, np.int64))})


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, dict[str, int]]:
    """Exact counts of all phrases of 1 to ``longest`` words that occur ``least`` times in their language; words per language."""
    base = docs.select(
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    counted = stage(_strings(base, _single_words))
    shards = counted.where("phrase IS NULL")
    totals = {r.lang: r.n for r in shards.groupBy("lang").agg(F.sum(F.col("size") * F.col("count")).alias("n")).collect()}
    words = counted.where((F.col("phrase").isNotNull()) & (F.col("count") >= least))
    if not totals or longest < 2:
        return words.select("lang", "phrase", "size", "count"), totals
    n = F.element_at(F.create_map(*[c for name, total in totals.items() for c in (F.lit(name), F.lit(total).cast("bigint"))]), F.col("lang"))
    unseen = F.col("count") * F.floor((F.col("size").cast("bigint") * least - 1) / n)  # ceil(x / n) - 1
    slack = {r.lang: r.slack for r in shards.groupBy("lang").agg(F.sum(unseen).cast("bigint").alias("slack")).collect()}
    frequent = bits_of(words, "key")
    pairs = _mined(base, [2], totals, least, slack, frequent, None)
    two = bits_of(pairs, "key")
    candidates = pairs
    if longest > 2:
        candidates = pairs.union(_mined(base, list(range(3, longest + 1)), totals, least, slack, frequent, two))
    chosen = bits_of(candidates, "key")

    def wanted(words: Words):
        for size in range(2, longest + 1):
            first, keys = _phrases_of(words, size, frequent, two)
            kept = chosen.holds(keys)
            yield size, first[kept], keys[kept]

    exact = _strings(base, wanted).where((F.col("phrase").isNotNull()) & (F.col("count") >= least))
    return stage(words.unionByName(exact).select("lang", "phrase", "size", "count")), totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP,
                 scale: int = 2_000_000, covered: int = 80) -> DataFrame:
    """Best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` and split at blanks and tabs.  A candidate has 2 to ``longest`` words
    and occurs at least ``least`` times (``a``) in its language.  Its score is ``floor(scale * a / (l + r))`` for the cut into a first
    part (``l`` occurrences) and a rest (``r``) that scores lowest, the first such cut.  Candidates inside a longer one that
    has ``covered`` percent of their occurrences are dropped.  Ranked by score, a, phrase in UTF-8 order.  ``n`` counts all words.
    Null and empty texts have no words; a null language counts as ``und``; repeated rows count as often as they
    are there; no ids are read and other columns are ignored.  All counts are exact, over whole texts.
    """
    known, totals = frequent_phrases(docs, text_col, lang_col, longest, least)
    words = F.split("phrase", " ")

    def part(first, length):
        return F.array_join(F.slice(words, first, length), " ")

    found = known.where("size > 1").select("lang", "phrase", "size", F.col("count").alias("a"))
    cut = found.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cut = cut.withColumn("head", part(F.lit(1), F.col("k"))).withColumn("rest", part(F.col("k") + 1, F.col("size") - F.col("k")))
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("count").alias("l"))
    rests = known.select("lang", F.col("phrase").alias("rest"), F.col("count").alias("r"))
    cut = cut.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    cut = cut.withColumn("score", F.expr(f"(cast({scale} as decimal(20,0)) * cast(a as decimal(18,0))) div (cast(l as decimal(20,0)) + r)"))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.*")
    spans = F.expr("flatten(transform(sequence(2, size - 1), w -> transform(sequence(1, size - w + 1), s -> struct(s, w))))")
    inner = found.where("size > 2").withColumn("span", F.explode(spans)).withColumn("phrase", part(F.col("span.s"), F.col("span.w")))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = "decimal(38,0)"
    free = F.col("longer").isNull() | (F.col("longer").cast(wide) * 100 < F.col("a").cast(wide) * covered)
    left = best.join(inner, ["lang", "phrase"], "left").where(free)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    pairs = [c for name, total in totals.items() for c in (F.lit(name), F.lit(total).cast("bigint"))] or [F.lit(""), F.lit(0).cast("bigint")]
    n = F.element_at(F.create_map(*pairs), F.col("lang"))
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", n.alias("n"), "score")
