"""MinHash near-duplicates: b-bit signatures, band candidates, exact confirmation, connected components.

1. One scan of the texts gives each document its shingle count, a 128-bit fingerprint of its shingle *set*, one key per
   band of full minima, and the packed low bits of all minima.
2. Documents with equal sets form a class; only its smallest id goes on, so exact copies never meet in pairs.
3. Band keys shared by several classes are candidate buckets.  A bucket is first compared with its most central member only, so
   a group of n near copies costs about n comparisons.  Buckets that still hold documents of different components are then
   compared in blocks of bounded size, pairs of one component being skipped: no link between components is lost.
4. Pairs whose collision-corrected bit estimate lies more than ``SLACK`` standard deviations below the threshold are left;
   the others are confirmed on the full shingle sets.

Recall: with 32 bands of 4 minima a pair at similarity 0.8 is missed with probability 5e-8; the estimate leaves out such a
pair when more than 50 of its 128 four-bit minima differ, with binomial probability 2.5e-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import components, mixed, shingle_sets, stage

BANDS, ROWS, BITS = 32, 4, 4
HASHES = BANDS * ROWS
SLACK = 6.0
BLOCK = 1024
_LANES = 64 // BITS
_TYPE = pa.struct([("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])
_SQL_TYPE = "struct<n: bigint, set_a: bigint, set_b: bigint, bands: array<bigint>, bits: array<bigint>>"
_random = np.random.default_rng(20_240_601)
_FACTORS = _random.integers(0, 1 << 32, (HASHES, 1), np.uint32) | np.uint32(1)
_TERMS = _random.integers(0, 1 << 32, (HASHES, 1), np.uint32)
_BAND_FACTORS = mixed(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_BAND_NUMBERS = mixed(np.arange(101, 101 + BANDS, dtype=np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over a set of shingle hashes."""
    narrow = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for first in range(0, len(narrow), 2048):
        np.minimum(out, (_FACTORS * narrow[first : first + 2048] + _TERMS).min(axis=1), out=out)
    return out


def packed_bits(values: np.ndarray) -> np.ndarray:
    """Low bits of the minima, several to a 64-bit lane; the last axis holds the minima."""
    low = (values & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(*values.shape[:-1], -1, _LANES)
    return (low << (np.arange(_LANES, dtype=np.uint64) * np.uint64(BITS))).sum(axis=-1, dtype=np.uint64)


def signatures(texts: pa.Array, words: int) -> pa.Array:
    counts, sums, mins = [], [], []
    for found in shingle_sets(texts, words):
        counts.append(len(found))
        sums.append((found.sum(dtype=np.uint64), mixed(found * np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)))
        mins.append(minima(found))
    rows = len(counts)
    mins = np.array(mins, np.uint32).reshape(rows, HASHES)
    bands = mixed((mins.reshape(rows, BANDS, ROWS).astype(np.uint64) * _BAND_FACTORS).sum(axis=2, dtype=np.uint64) + _BAND_NUMBERS)
    bits = packed_bits(mins)
    sums = np.array(sums, np.uint64).reshape(rows, 2).view(np.int64)

    def lists(values: np.ndarray) -> pa.Array:
        width = values.shape[1]
        return pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * width, width, dtype=np.int32)), pa.array(values.reshape(-1).view(np.int64)))

    columns = [pa.array(counts, pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), lists(bands), lists(bits)]
    return pa.StructArray.from_arrays(columns, fields=list(_TYPE))


def estimate(left: Column, right: Column) -> Column:
    """Similarity from the share of equal low bits, corrected for bits that agree by chance."""
    lanes = HASHES * BITS // 64
    ones = F.lit(0)
    mask = F.lit(int("1" * _LANES, 16))
    for lane in range(lanes):
        x = F.element_at(left, lane + 1).bitwiseXOR(F.element_at(right, lane + 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(mask)
        ones = ones + F.bit_count(x)
    chance = 1.0 / (1 << BITS)
    return ((1.0 - ones / float(HASHES)) - chance) / (1.0 - chance)


def least_estimate(threshold: float) -> float:
    """Estimate below which a pair is left without confirmation."""
    chance = 1.0 / (1 << BITS)
    agree = chance + (1.0 - chance) * threshold
    return threshold - SLACK * (agree * (1.0 - agree) / HASHES) ** 0.5 / (1.0 - chance)


def _linked(percent: int, words: int):
    @F.arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(_sets_once(left, words), shingle_sets(right, words), strict=True):
            both = len(np.intersect1d(a, b, assume_unique=True)) if len(a) and len(b) else 0
            out.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    return linked


def _sets_once(texts: pa.Array, words: int):
    """Shingle sets where neighbouring rows often repeat a text."""
    coded = texts.run_end_encode() if hasattr(texts, "run_end_encode") else None
    if coded is None:
        yield from shingle_sets(texts, words)
        return
    before = 0
    for end, found in zip(coded.run_ends.to_pylist(), shingle_sets(coded.values, words), strict=True):
        for _ in range(end - before):
            yield found
        before = end


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked when 100 * intersection >= ``percent`` * union of their sets of ``words``-word shingles;
    ``component_id`` is the smallest id reachable.  A null or word-free text has an empty set and no link.  Repeated
    rows come out as often as they came in, each with its own row; equal ids are one node.  A row without id belongs to
    the class of its text, and to a component of its own (null) if no row with an id has that text.  Other columns are
    ignored.  Texts are read whole, whatever their length.
    """
    sign = F.arrow_udf(lambda texts: signatures(texts, words), _SQL_TYPE)
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stage(base.select("doc_id", sign("text").alias("s")).select("doc_id", "s.*"))
    reps = stage(
        signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b")
        .agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"),
             F.any_value("bits").alias("bits"), F.any_value("n").alias("n")))
    labels = _labels(base, reps, words, percent)
    classes = reps.join(labels, reps.rep == labels.node, "left").select("set_a", "set_b", F.coalesce("label", "rep").alias("label"))
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("label"))
    return (
        signed.select("doc_id", "n", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def _labels(base: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """Component label of every class that is linked with another, as ``(node, label)``."""
    spots = reps.select("rep", F.explode("bands").alias("key"))
    shared = spots.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = stage(spots.join(shared, "key").select("key", "rep", "size"))
    # A text from which others were made meets more of them than they meet each other: it is the best hub.
    central = buckets.groupBy("rep").agg(F.sum("size").alias("meets"))
    nodes = stage(central.join(reps, "rep").select("rep", "meets", "n", "bits", "bands"))
    texts = stage(base.join(nodes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"))
    tested = stage(_hub_pairs(buckets.join(nodes.drop("bands"), "rep"), percent))
    links = stage(_confirmed(tested, texts, words, percent))
    labels = components(links)
    members = buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    # Buckets whose documents are all of one component have nothing left to say.
    spread = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    members = stage(members.join(spread, "key", "left_semi"))
    found = stage(_block_links(members, nodes, texts, words, percent))
    return labels if found.isEmpty() else components(links.union(found))


def _hub_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Every member of a bucket with the bucket's most central one, if plausible.

    Plausible by size first: the similarity is at most the smaller set size over the larger.
    """
    hubs = members.groupBy("key").agg(F.max_by(F.struct(F.col("rep").alias("hub"), "n", "bits"), F.struct("meets", -F.col("rep"))).alias("h"))
    sizes = 100 * F.least("n", "h.n") >= percent * F.greatest("n", "h.n")
    near = estimate(F.col("bits"), F.col("h.bits")) >= least_estimate(percent / 100.0)
    pairs = members.join(hubs, "key").where((F.col("rep") != F.col("h.hub")) & sizes & near)
    return pairs.select(F.least("rep", "h.hub").alias("a"), F.greatest("rep", "h.hub").alias("b")).distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    linked = _linked(percent, words)
    right = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.where(linked("text_a", "text_b")).select("a", "b")


def _block_links(members: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between members of a bucket that are still of different components.

    A bucket is dealt into blocks of about ``BLOCK`` members, and each pair of blocks is one group, so no task ever holds a
    whole large bucket.  Inside a group bit counts leave the plausible pairs; a pair is taken up in its first common band
    only, and skipped once its documents are connected; the rest is confirmed on the full sets.
    """
    wide = members.join(nodes.select("rep", "n", "bits", "bands"), "rep").join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    blocks = F.ceil(F.col("size") / BLOCK)
    dealt = (
        wide.withColumn("block", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "size"))
    limit = int((1.0 - (1.0 / (1 << BITS) + (1.0 - 1.0 / (1 << BITS)) * least_estimate(percent / 100.0))) * HASHES)
    mask = np.uint64(int("1" * _LANES, 16))

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column = {name: group.column(name).to_numpy() for name in ("key", "rep", "label", "n", "block", "low", "high")}
        count = len(group)
        bits = group.column("bits").combine_chunks().flatten().to_numpy().reshape(count, -1).view(np.uint64)
        bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(count, -1)
        key, same = column["key"][0], column["low"][0] == column["high"][0]
        left = np.flatnonzero(column["block"] == column["low"])
        right = left if same else np.flatnonzero(column["block"] == column["high"])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        sets: dict[int, np.ndarray] = {}
        texts_here = group.column("text").combine_chunks()
        out_a, out_b = [], []
        for first in range(0, len(left), 128):
            mine = left[first : first + 128]
            x = bits[mine][:, None, :] ^ bits[right][None, :, :]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            apart = np.bitwise_count(x & mask).sum(axis=2, dtype=np.int64)
            n_a, n_b = column["n"][mine][:, None], column["n"][right][None, :]
            open_ = (apart <= limit) & (column["label"][mine][:, None] != column["label"][right][None, :])
            open_ &= 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
            i, j = np.nonzero(open_)
            order = np.argsort(apart[i, j], kind="stable")
            i, j = mine[i[order]], right[j[order]]
            if same:
                i, j = i[i < j], j[i < j]
            first_common = bands[i, (bands[i] == bands[j]).argmax(axis=1)] if len(i) else i
            i, j = i[first_common == key], j[first_common == key]
            fresh = [r for r in np.union1d(i, j).tolist() if r not in sets]
            sets.update(zip(fresh, shingle_sets(texts_here.take(pa.array(fresh, pa.int64())), words), strict=True))
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                root_a, root_b = find(int(column["label"][a])), find(int(column["label"][b]))
                if root_a == root_b:
                    continue
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    root[root_a] = root_b
                    out_a.append(int(column["rep"][a]))
                    out_b.append(int(column["rep"][b]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return dealt.groupBy("key", "low", "high").applyInArrow(compare, "a bigint, b bigint").distinct()
