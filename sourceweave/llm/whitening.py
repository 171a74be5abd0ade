"""Embedding whitening by upper-triangle column aggregates.

Every entry c becomes the integer x = floor(64 c) + 1000000, so all sums are exact. One aggregation with a generated expression for
each pair of dimensions sums the products of the entries centred at their rounded means; what the rounding leaves is taken off exactly.
The covariance, d x d, is decomposed by LAPACK on the driver, and rows are projected by one matrix product an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceweave.llm.common import materialise, small_batches

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Pairs of dimensions in one aggregation: all pairs of up to 90 dimensions; wider vectors take several.
PAIRS = 4096
_LONG = 2**63


@dataclass(frozen=True)
class Whitening:
    """What the fit list determines: its size, sums, covariance and components, eigenvalues falling."""

    n: int
    sums: list[int]
    reach: int
    covariance: np.ndarray
    vectors: np.ndarray
    values: np.ndarray

    @property
    def trace(self) -> float:
        return float(np.trace(self.covariance))

    @property
    def rank(self) -> int:
        """Components whose eigenvalue stands above rounding."""
        floor = len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)
        return int((self.values > floor).sum())


def grid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x: array<bigint>): the rows whose vector holds a finite number in every dimension, on the integer grid.

    The dimensions are those of the longest such vector; a shorter vector lacks entries, which count as null ones, so its row goes.
    """
    v = F.col(vector).cast("array<double>")
    number = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("v")).where(F.coalesce(F.forall("v", number) & (F.size("v") > 0), F.lit(False)))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.where(F.size("v") == width).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def triangle(rows: DataFrame, columns: list[Column], kind: str = "bigint") -> list:
    """The sums of the products of all pairs (i <= j) of ``columns``, in the order of the upper triangle."""
    centred = rows.select(*[c.alias(f"z{i}") for i, c in enumerate(columns)])
    pairs, out = _pairs(len(columns)), []
    conf, name = rows.sparkSession.conf, "spark.sql.subexpressionElimination.enabled"
    before = conf.get(name, "true")
    conf.set(name, "false")  # thousands of sums have nothing in common, and the search for it takes longer than the sums
    try:
        for at in range(0, len(pairs), PAIRS):
            sums = [f"sum(cast(z{i} as {kind}) * z{j}) as p{i}_{j}" for i, j in pairs[at : at + PAIRS]]
            out += list(centred.selectExpr(*sums).first())
    finally:
        conf.set(name, before)
    return out


def fit(rows: DataFrame) -> Whitening | None:
    """Covariance (divisor n) of the x-vectors of ``rows`` and its components; None where there are no rows."""
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    x = [F.col("x")[i] for i in range(d)]
    facts = rows.agg(F.count(F.lit(1)), *[F.sum(c.cast("decimal(20,0)")) for c in x], *[F.min(c) for c in x], *[F.max(c) for c in x]).first()
    n, sums, low, high = facts[0], [int(s) for s in facts[1 : d + 1]], facts[d + 1 : 2 * d + 1], facts[2 * d + 1 :]
    middle = [(2 * s + n) // (2 * n) for s in sums]
    reach = max(max(abs(a - m), abs(b - m)) for a, b, m in zip(low, high, middle))
    kind = "bigint" if n * reach * reach < _LONG else "decimal(19,0)"
    products = [int(p) for p in triangle(rows, [c - F.lit(m).cast("bigint") for c, m in zip(x, middle)], kind)]
    rest = [s - n * m for s, m in zip(sums, middle)]
    covariance = np.zeros((d, d))
    for (i, j), p in zip(_pairs(d), products):
        covariance[i, j] = covariance[j, i] = (n * p - rest[i] * rest[j]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    heaviest = vectors[np.abs(vectors).argmax(axis=0), np.arange(d)]
    return Whitening(n, sums, reach, covariance, vectors * np.where(heaviest < 0, -1.0, 1.0), values)


def project(rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, deviation, whitened: array<double>) of each row; a component beyond the rank has no scale, and a null."""
    n, sums, rank = model.n, np.array(model.sums, dtype=object), min(model.rank, components)
    d, most = len(sums), min(components, len(sums))
    turn = model.vectors[:, :rank] / np.sqrt(model.values[:rank])
    exact = np.int64 if n * (abs(max(model.sums, key=abs)) // n + model.reach + 2) < _LONG and d * (n * (model.reach + 1)) ** 2 < _LONG else object

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(exact)
            away = n * x - sums.astype(exact)
            total = [int(t) if t < _LONG else None for t in (away * away).sum(axis=1)]
            white = np.full((len(x), most), np.nan)
            white[:, :rank] = (away.astype(float) / n) @ turn
            flat = pa.array(white.reshape(-1), mask=np.isnan(white.reshape(-1)))
            lists = pa.ListArray.from_arrays(np.arange(0, white.size + 1, most, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(total, pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(apply, "vec_id bigint, deviation bigint, whitened array<double>")


def identity_error(projected: DataFrame, n: int, rank: int) -> float | None:
    """The largest entry by which the covariance of the whitened values is off the identity."""
    if not rank:
        return None
    w = [F.col("whitened")[k] for k in range(rank)]
    means = [m or 0.0 for m in projected.agg(*[F.avg(c) for c in w]).first()]
    sums = triangle(projected, [c - F.lit(m) for c, m in zip(w, means)], "double")
    return max(abs(s / n - (i == j)) for (i, j), s in zip(_pairs(rank), sums))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each remaining vector and component.

    Rows whose vector is null, empty, or holds a null, a NaN or an infinity go, and so do vectors shorter than the longest (see
    :func:`grid`); repeated rows and null identifiers stay, each by itself. Components are as many as dimensions, ``components`` at
    most; one whose eigenvalue is zero within rounding has a null ``whitened`` and takes no part in ``identity_error``, and where all vectors are equal
    ``explained`` is null too. A deviation beyond 64 bits is null. An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = grid(vectors)
    model = fit(rows)
    if model is None:
        return spark.createDataFrame([], schema)
    projected = materialise(project(rows, model, components), "whitened")
    rank, trace = min(model.rank, components), model.trace
    error = identity_error(projected, model.n, rank)
    shares = F.array(*[F.lit(float(e) / trace if trace > 0 else None).cast("double") for e in model.values[:components]])
    long = projected.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return long.select(
        "vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        shares[F.col("_at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
