"""Embedding whitening: covariance over distinct vectors with their multiplicities, each distinct vector whitened once.

1. One scan turns each vector into fixed-point numbers x, packed as the bytes of 64-bit integers.
2. Rows of one x are grouped: a distinct vector and how often it occurs.  All later work is on distinct vectors.
3. Exact integer sums give the means; weighted, centred products are added up per partition as one matrix product, then
   summed in Spark.  One task per width, bounded by the width squared, takes the eigenvectors.
4. Distinct vectors are projected once and joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import stage

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
_LIMIT = float(1 << 62)
_EXACT = pa.decimal128(38, 0)


def packed(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """``floor(scale * c) + shift`` of every entry as little-endian 64-bit integers in one binary.

    Null for a null or empty vector, one with null or non-finite entries, and one whose numbers do not fit 62 bits.
    """
    @F.arrow_udf("binary")
    def pack(vectors: pa.Array) -> pa.Array:
        lengths = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), vectors.value_lengths().fill_null(0).to_numpy(), 0)
        # Null entries become NaN; flatten() leaves out what null vectors hold.
        entries = np.floor(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        with np.errstate(invalid="ignore"):
            sound = np.abs(entries) < _LIMIT
        ends = np.cumsum(lengths)
        bad = np.concatenate([[0], np.cumsum(~sound)])
        good = (lengths > 0) & (bad[ends] == bad[ends - lengths])
        values = (np.where(sound, entries, 0).astype("<i8") + np.int64(shift)).tobytes()
        return pa.array([values[8 * (end - length) : 8 * end] if ok else None for end, length, ok in zip(ends.tolist(), lengths.tolist(), good.tolist(), strict=True)],
                        pa.binary())

    return pack(vector)


def _by_width(binaries: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Width, row numbers and integer matrix of the vectors of each width."""
    sizes = np.array([len(x) for x in binaries.to_pylist()], np.int64) // 8
    for width in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == width)
        yield width, at, np.frombuffer(b"".join(binaries.take(pa.array(at)).to_pylist()), "<i8").reshape(len(at), width)


def _weighted_sums(weights: np.ndarray, x: np.ndarray) -> list[int]:
    """Exact column sums: in 64 bits where they surely fit, else in Python's integers."""
    if float(np.abs(x).max()) * float(weights.sum()) < _LIMIT:
        return (weights @ x).tolist()
    return (weights.astype(object) @ x.astype(object)).tolist()


def sums_of(distinct: DataFrame) -> DataFrame:
    """Exact weighted sum of every dimension: ``width, dim, n, total``."""
    def add(batches):
        found: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            weights = batch.column("weight").to_numpy()
            for width, at, x in _by_width(batch.column("x")):
                n, before = found.get(width, (0, [0] * width))
                found[width] = n + int(weights[at].sum()), [a + b for a, b in zip(before, _weighted_sums(weights[at], x), strict=True)]
        for width, (n, totals) in found.items():
            yield pa.RecordBatch.from_pydict({
                "width": pa.array([width] * width, pa.int32()), "dim": pa.array(range(width), pa.int32()), "n": pa.array([n] * width, pa.int64()),
                "total": pa.array([_decimal(t) for t in totals], _EXACT)})

    parts = distinct.select("x", "weight").mapInArrow(add, "width int, dim int, n bigint, total decimal(38,0)")
    return parts.groupBy("width", "dim").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))


def _decimal(value: int):
    from decimal import Decimal

    return Decimal(value)


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` without rounding, in 64 bits where it fits, else as Python's integers."""
    if n * (int(np.abs(x).max()) + 1) + max(abs(s) for s in sums) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _products(frames: DataFrame, rows_of) -> DataFrame:
    """Weighted products of all pairs of columns, ``width, i, j, v`` with i <= j; ``rows_of`` gives (width, weights, centred rows)."""
    def multiply(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, weights, y in rows_of(batch):
                found[width] = found.get(width, 0.0) + (y * weights[:, None]).T @ y
        for width, matrix in found.items():
            i, j = np.triu_indices(len(matrix))
            yield pa.RecordBatch.from_pydict({
                "width": pa.array(np.full(len(i), width, np.int32)), "i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)),
                "v": pa.array(matrix[i, j])})

    return frames.mapInArrow(multiply, "width int, i int, j int, v double").groupBy("width", "i", "j").agg(F.sum("v").alias("v"))


def _axes(products: DataFrame, n_of: dict[int, int], components: int) -> DataFrame:
    """Leading eigenvalues and unit eigenvectors of every width, with their share of the trace."""
    def solve(group: pa.Table) -> pa.Table:
        width = group.column("width")[0].as_py()
        i, j = group.column("i").to_numpy(), group.column("j").to_numpy()
        v = np.zeros((width, width))
        v[i, j] = v[j, i] = group.column("v").to_numpy() / n_of[width]
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        trace = float(np.trace(v))
        # An eigenvalue that is only rounding is no direction of the data.
        least = max(trace, 0.0) * width * np.finfo(float).eps
        kept = np.where(values > least, values, 0.0)
        return pa.table({
            "width": pa.array([width] * len(values), pa.int32()), "component": pa.array(range(1, len(values) + 1), pa.int32()),
            "value": pa.array(kept), "explained": pa.array([x / trace if trace > 0 else None for x in values.tolist()], pa.float64()),
            "axis": pa.array(list(vectors.T.copy()), pa.list_(pa.float64()))})

    return products.groupBy("width").applyInArrow(solve, "width int, component int, value double, explained double, axis array<double>")


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
             scale: int = SCALE, shift: int = SHIFT, weights: str = "counts") -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error, copies``.

    ``weights`` is ``counts`` (each row counts in the fit) or ``one`` (each distinct vector counts once).  Dropped: rows whose
    vector is null, empty, holds null or non-finite entries, or entries beyond 2^62 after scaling.  Vectors of another width
    are another space with a fit of its own; a vector narrower than ``components`` has as many components as entries.
    A component without variance (equal vectors, fewer vectors than entries) has a null ``whitened`` and stays out of
    ``identity_error``; without any variance ``explained`` and ``identity_error`` are null.  ``deviation`` is exact, decimal(38, 0),
    null beyond that.
    Rows with a null or repeated id come out as often as they came in.  Other columns are ignored.

    What passes through the driver is per width: its sums and at most ``components`` axes.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights is 'counts' or 'one'")
    rows = stage(vectors.select(F.col(id_col).alias("vec_id"), packed(F.col(vector_col), scale, shift).alias("x")).where("x IS NOT NULL"))
    weight = F.col("copies") if weights == "counts" else F.lit(1).cast("bigint")
    distinct = stage(rows.groupBy("x").agg(F.count("*").alias("copies")).withColumn("weight", weight))
    n_of: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for r in sums_of(distinct).orderBy("width", "dim").collect():
        n_of[r.width] = r.n
        sums.setdefault(r.width, []).append(int(r.total))

    def centred(batch):
        weight = batch.column("weight").to_numpy()
        for width, at, x in _by_width(batch.column("x")):
            yield width, weight[at].astype(float), _offsets(x, n_of[width], sums[width]).astype(float) / n_of[width]

    axes, values, shares = {}, {}, {}
    for r in _axes(_products(distinct.select("x", "weight"), centred), n_of, components).orderBy("width", "component").collect():
        axes.setdefault(r.width, []).append(r.axis)
        values.setdefault(r.width, []).append(r.value)
        shares.setdefault(r.width, []).append(r.explained)
    frames = {w: (np.array(axes[w]).T, np.array(values[w])) for w in axes}

    @F.arrow_udf("struct<deviation: decimal(38,0), z: array<double>>")
    def project(x: pa.Array) -> pa.Array:
        deviation: list = [None] * len(x)
        z: list = [None] * len(x)
        for width, at, ints in _by_width(x):
            offsets = _offsets(ints, n_of[width], sums[width])
            if offsets.dtype != object and float(np.abs(offsets).max()) ** 2 * width >= _LIMIT:
                squares = (offsets.astype(object) ** 2).sum(axis=1)
            else:
                squares = (offsets**2).sum(axis=1)
            axis, value = frames[width]
            found = (offsets.astype(float) / n_of[width]) @ axis / np.sqrt(np.where(value > 0, value, 1.0))
            for place, square, row in zip(at.tolist(), squares.tolist(), found.tolist(), strict=True):
                deviation[place] = _decimal(square) if square < 10**38 else None
                z[place] = [v if e > 0 else None for v, e in zip(row, value.tolist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(deviation, _EXACT), pa.array(z, pa.list_(pa.float64()))], names=["deviation", "z"])

    width = (F.octet_length("x") / 8).cast("int")
    done = stage(distinct.select("x", "copies", "weight", width.alias("width"), project("x").alias("p")).select("x", "copies", "weight", "width", "p.*"))
    errors = _identity_errors(done, n_of)
    per_width = {w: F.struct(F.lit(n_of[w]).cast("bigint").alias("n"), F.array(*[F.lit(s).cast("double") for s in shares[w]]).alias("explained"),
                             F.lit(errors.get(w)).cast("double").alias("identity_error")) for w in frames}
    if not per_width:
        per_width = {-1: F.struct(F.lit(0).cast("bigint").alias("n"), F.array(F.lit(0.0)).alias("explained"), F.lit(None).cast("double").alias("identity_error"))}
    model = F.element_at(F.create_map(*[c for w, s in per_width.items() for c in (F.lit(w).cast("int"), s)]), F.col("width"))
    back = rows.join(done.drop("weight"), "x").withColumn("model", model)
    spread = back.select("vec_id", "copies", "deviation", "model", F.posexplode("z").alias("place", "whitened"))
    return spread.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.col("model.n").alias("n"), "deviation", "whitened",
        F.element_at("model.explained", F.col("place") + 1).alias("explained"), F.col("model.identity_error").alias("identity_error"), "copies")


def _identity_errors(done: DataFrame, n_of: dict[int, int]) -> dict[int, float]:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, per width, as measured."""
    parts = done.select("width", "weight", F.posexplode("z").alias("place", "v")).where("v IS NOT NULL")
    means: dict[int, dict[int, float]] = {}
    for r in parts.groupBy("width", "place").agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("mean")).collect():
        means.setdefault(r.width, {})[r.place] = r.mean

    def centred(batch):
        widths, weight = batch.column("width").to_numpy(), batch.column("weight").to_numpy().astype(float)
        for width in np.unique(widths).tolist():
            if width not in means:
                continue
            at = np.flatnonzero(widths == width)
            z = np.array(batch.column("z").take(pa.array(at)).to_pylist(), float)
            places = sorted(means[width])
            yield width, weight[at], z[:, places] - np.array([means[width][p] for p in places])

    out: dict[int, float] = {}
    for r in _products(done.select("width", "weight", "z"), centred).groupBy("width").agg(
            F.collect_list(F.struct("i", "j", "v")).alias("entries")).collect():
        out[r.width] = max(abs(e.v / n_of[r.width] - (e.i == e.j)) for e in r.entries)
    return out
