"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threatloom.llm.common import stage

TABLES, PROBES, ROTATIONS = 4, 36, 3
# Share of the signed axes that is probed more with every doubling of the width above 64: neighbours at random get less distinct.
PROBE_GROWTH = 0.06
BLOCK, QUERY_BLOCK = 32768, 1024
_SEED = 77


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised fast Walsh-Hadamard transform of every row; the width is a power of two."""
    rows, width = x.shape
    half = 1
    while half < width:
        x = x.reshape(rows, -1, 2, half)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
        half *= 2
    return x.reshape(rows, width) / np.sqrt(width)


def rotated(x: np.ndarray, number: int) -> np.ndarray:
    """Pseudo-rotation of a table: random signs and a Hadamard transform, three times; short rows are filled with zeros."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng((_SEED, number, width)).choice((-1.0, 1.0), (ROTATIONS, width))
    for row in signs:
        x = hadamard(x * row)
    return x


def axes(x: np.ndarray, number: int, count: int) -> np.ndarray:
    """The ``count`` nearest signed axes of every row in a table, nearest first: twice the axis, plus one if negative."""
    y = rotated(x, number)
    scores = np.stack([y, -y], axis=2).reshape(len(y), -1)
    count = min(count, scores.shape[1])
    if count == 1:
        return scores.argmax(axis=1)[:, None]
    return np.argsort(-scores, axis=1, kind="stable")[:, :count]


def probes_of(width: int) -> int:
    """Probed axes of a table for vectors of a width: 36 of the 128 of 64 dimensions, a growing share of wider ones."""
    signed = 2 << max(0, width - 1).bit_length()
    share = PROBES / 128 + PROBE_GROWTH * max(0.0, np.log2(signed / 128))
    return max(PROBES, int(np.ceil(signed * min(1.0, share))))


def _rows_of(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def codes_of(vector: Column, count: int | None, tables: int = TABLES) -> Column:
    """Codes of a vector in every table, ``array<array<int>>``; as many as suit its width if ``count`` is None."""
    @F.arrow_udf("array<array<int>>")
    def codes(vectors: pa.Array) -> pa.Array:
        out: list = [None] * len(vectors)
        lengths = np.diff(vectors.offsets.to_numpy())
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            x = _rows_of(vectors.take(pa.array(at)))
            found = np.stack([axes(x, number, probes_of(int(length)) if count is None else count) for number in range(tables)], axis=1)
            for row, value in zip(at.tolist(), found.tolist(), strict=True):
                out[row] = value
        return pa.array(out, pa.list_(pa.list_(pa.int32())))

    return codes(vector)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part: no null, zero or non-finite vector; with their width and their band of norms.

    Within a band norms differ by at most a factor of 1.42, so a large inner product means a small angle.
    """
    v = F.col(vector_col).cast("array<double>")
    base = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("vec")).where("vec_id IS NOT NULL AND size(vec) > 0")
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x))
    return base.where(F.coalesce(sound, F.lit(False))).withColumn("width", F.size("vec")).withColumn(
        "band", F.when(norm > 0, F.floor(F.log2(norm) * 2 + 0.5)).otherwise(-10_000).cast("int"))


def _best(queries: pa.Table, found: pa.Table, k: int) -> pa.Table:
    """Nearest ``k`` candidates of each query of a group among those in its probed cells."""
    q_ids, c_ids = queries.column("query_id").to_numpy(), found.column("vec_id").to_numpy()
    q, c = _rows_of(queries.column("vec").combine_chunks()), _rows_of(found.column("vec").combine_chunks())
    order = np.argsort(found.column("code").to_numpy(), kind="stable")
    c, c_ids, codes = c[order], c_ids[order], found.column("code").to_numpy()[order]
    probes = queries.column("codes").combine_chunks()
    probe_rows = np.repeat(np.arange(len(q)), np.diff(probes.offsets.to_numpy()))
    probe_codes = probes.flatten().to_numpy()
    rows, places = [], []
    edges = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    for low, high in zip(edges.tolist(), [*edges[1:].tolist(), len(codes)], strict=True):
        asking = probe_rows[probe_codes == codes[low]]
        for first in range(0, len(asking), 256):
            mine = asking[first : first + 256]
            near = q[mine] @ c[low:high].T
            near[q_ids[mine][:, None] == c_ids[low:high][None, :]] = -np.inf
            if high - low > k:
                # Ties with the k-th stay in; the slack is for products that round apart.
                least = np.partition(near, high - low - k, axis=1)[:, high - low - k]
                i, j = np.nonzero((near >= (least - 1e-9 * np.abs(least))[:, None]) & (near > -np.inf))
            else:
                i, j = np.nonzero(near > -np.inf)
            rows.append(mine[i])
            places.append(j + low)
    rows, places = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, places))
    scores = np.concatenate([(q[rows[s : s + 65536]] * c[places[s : s + 65536]]).sum(axis=1) for s in range(0, len(rows), 65536)] or [np.zeros(0)])
    order = np.lexsort((c_ids[places], -scores, rows))
    rows, places, scores = rows[order], places[order], scores[order]
    starts = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - starts < k
    return pa.table({"query_id": pa.array(q_ids[rows[keep]]), "vec_id": pa.array(c_ids[places[keep]]), "score": pa.array(scores[keep])})


def _looks(asked: DataFrame, bands: DataFrame, groups: Column, probes: int | None, tables: int) -> DataFrame:
    """Every query with its codes in each table and band, once for each group of cells that can hold one of them."""
    return stage(
        asked.join(bands, "width").select("query_id", "vec", "width", "band", F.posexplode(codes_of(F.col("vec"), probes, tables)).alias("table", "codes"))
        .withColumn("part", F.explode(F.array_distinct(F.transform("codes", lambda c: F.pmod(c, groups))))))


def _found(cells: DataFrame, looks: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the best ``k`` of each query in each group of cells."""
    keys = ["width", "band", "table", "part"]
    sizes = cells.groupBy(*keys).agg(F.count("*").alias("held")).join(looks.groupBy(*keys).agg(F.count("*").alias("asking")), keys)
    sizes = stage(sizes.select(*keys, F.ceil(F.col("held") / BLOCK).alias("c_parts"), F.ceil(F.col("asking") / QUERY_BLOCK).alias("q_parts")))

    def dealt(df: DataFrame, own: str, own_parts: str, other: str, other_parts: str, by: str) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other_parts) - 1))
        return df.join(sizes, keys).withColumn(own, F.pmod(F.xxhash64(by), F.col(own_parts))).withColumn(other, copies).drop("c_parts", "q_parts")

    left = dealt(cells, "c_part", "c_parts", "q_part", "q_parts", "vec_id")
    right = dealt(looks, "q_part", "q_parts", "c_part", "c_parts", "query_id")
    both = [*keys, "c_part", "q_part"]

    def rank(found: pa.Table, asking: pa.Table) -> pa.Table:
        if not len(found) or not len(asking):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return _best(asking, found, k)

    return left.groupBy(*both).cogroup(right.groupBy(*both)).applyInArrow(rank, "query_id bigint, vec_id bigint, score double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            tables: int = TABLES, probes: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found for each query, its own id left out.

    Every vector is indexed in ``tables`` tables under its nearest signed axis; a query looks into its ``probes`` nearest axes of
    every table (by width if None, see ``probes_of``) and every band of norms; one that found fewer than ``k`` ids, or than there are
    of its width, looks into all cells of its width as well.  All vectors found are ranked by the exact inner product in double precision,
    ties to the smaller id.  Cells are dealt into groups, and queries as well, of bounded size; no pair leaves a group
    but the best ``k`` of each query.  Of equal vectors only the ``k + 1`` smallest ids can be among the nearest, so only these are
    compared.  Vectors that are null, empty, zero, or hold a null or non-finite number take no part, nor do rows without
    id; vectors of different width are never compared.  Repeated rows count once.  Other columns are ignored.
    """
    base = stage(usable(vectors, id_col, vector_col).dropDuplicates(["vec_id", "vec"]))
    twins = Window.partitionBy("vec").orderBy("vec_id")
    kept = base.withColumn("twin", F.row_number().over(twins)).where(F.col("twin") <= k + 1).drop("twin")
    cells = stage(
        kept.select("vec_id", "vec", "width", "band", F.posexplode(codes_of(F.col("vec"), 1, tables)).alias("table", "one"))
        .withColumn("code", F.element_at("one", 1)).drop("one"))
    groups = F.lit(max(1, -(-cells.where("table = 0").count() // BLOCK)))
    cells = cells.withColumn("part", F.pmod(F.col("code"), groups))
    bands = cells.select("width", "band").distinct()
    asked = usable(queries, id_col, vector_col).dropDuplicates(["vec_id", "vec"]).withColumnRenamed("vec_id", "query_id").drop("band")
    best = stage(_found(cells, _looks(asked, bands, groups, probes, tables), k))
    held = cells.where("table = 0").groupBy("width").agg(F.countDistinct("vec_id").alias("held"))
    wanted = asked.select("query_id", "width").distinct().join(held, "width").groupBy("query_id").agg(F.least(F.lit(k), F.sum("held")).alias("wanted"))
    had = best.groupBy("query_id").agg(F.countDistinct("vec_id").alias("had"))
    short = stage(wanted.join(had, "query_id", "left").where("coalesce(had, 0) < wanted").select("query_id"))
    if not short.isEmpty():
        # Every vector stands once in the first table.
        again = asked.join(short, "query_id", "left_semi")
        best = best.union(_found(cells.where("table = 0"), _looks(again, bands, groups, 1 << 30, 1), k))
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
