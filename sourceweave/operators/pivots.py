"""An exact join of vectors by a least cosine, in metric space.

Angles obey the triangle inequality. Vectors are dealt to the nearest of a set of pivots, and visit another pivot's cell only if the angles
to the two pivots and the radius of the cell leave room for a vector within the angle that is asked for. Inside a cell, angles to the
pivot rule out most of the rest before anything is multiplied. On clustered vectors that leaves little more than the clusters; on
vectors without any structure it is the dense comparison of all blocks, which an exact join of these can't avoid.

Results are links counted by vector and a spanning forest, not pairs: a clump of m near vectors gives m counts and m - 1 edges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceweave.shared import stored

#: Pivots at most: they travel to all tasks.
MOST_PIVOTS = 1024
#: Bytes of the vectors of either side that one task multiplies, and rows of it at a time; cells beyond that are dealt into parts that meet pairwise.
BLOCK_BYTES, STRIP = 16 << 20, 128
#: Visits in one batch.
VISITS = 4096
#: Copies of a row, on average, that are dealt to products at a time; a join with more of them takes several turns.
COPIES = 4
#: Spark's setting by which the shuffle files of a query go when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Room for rounding when an angle is ruled out.
SLACK = 1e-6


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column at length one; none of them is zero."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def choose_pivots(rows: DataFrame, share: int, most: int = MOST_PIVOTS) -> np.ndarray:
    """Vectors of ``rows`` (id, v) drawn by a hash, so that dense regions get more of them; one for each ``share`` rows."""
    n = rows.count()
    drawn = rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(min(most, max(1, -(-n // share)))).collect()
    m = np.array([r.v for r in drawn], dtype=float) if drawn else np.zeros((0, 1))
    return m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m


def _homes(pivots: np.ndarray):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = _angles(_matrix(batch.column("v")), pivots)
            home = angle.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(angle[np.arange(len(home)), home])], names=[*batch.schema.names, "home", "angle"])

    return apply


def _visits(pivots: np.ndarray, radius: np.ndarray, theta: float, parts: np.ndarray | None = None, turn: int = 0, turns: int = 1):
    """Rows (cell, q, id, v, weight, angle) of the visits of each vector in a turn, or, without ``parts``, (cell, n) by batch.

    ``parts`` has the parts of each cell's visitors; q is a visitor's. A part has its turn, so other visits are not even made.

    Of two cells one visits the other, by the parity of their numbers, so each pair of vectors meets once.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = _angles(_matrix(batch.column("v")), pivots)
            home = batch.column("home").to_numpy()[:, None]
            cell = np.arange(len(pivots))[None, :]
            own = batch.column("angle").to_numpy()[:, None]
            may = (angle <= radius[None, :] + theta + SLACK) & (angle <= own + 2 * theta + SLACK) & (cell != home) & (((cell + home) % 2 == 1) == (home < cell))
            row, to = np.nonzero(may)
            if parts is None:
                found, n = np.unique(to, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n, pa.int64())], names=["cell", "n"])
                continue
            mixed = (batch.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            part = (mixed[row] % parts[to].astype(np.uint64)).astype(np.int32)
            now = (to + part) % turns == turn
            row, to, part = row[now], to[now], part[now]
            for at in range(0, len(row), VISITS):
                r, c, q = (x[at : at + VISITS] for x in (row, to, part))
                take = pa.array(r)
                columns = [pa.array(c, pa.int32()), pa.array(q, pa.int32()), *(batch.column(x).take(take) for x in ("id", "v", "weight")), pa.array(angle[r, c])]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "q", "id", "v", "weight", "angle"])

    return apply


def _products(a: pd.DataFrame, b: pd.DataFrame | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in a, places in b) of the pairs whose cosine exceeds ``threshold``, a strip at a time; ``b`` None: pairs within a.

    Both sides are ordered by their angle to the pivot; a strip is multiplied with those rows only whose angle is near enough.
    """
    theta = math.acos(threshold) + SLACK
    other = a if b is None else b
    m = np.stack(a["v"].to_numpy())
    m /= np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    k = m if b is None else np.stack(b["v"].to_numpy())
    if b is not None:
        k /= np.sqrt(np.einsum("ij,ij->i", k, k))[:, None]
    at_a, at_b = a["angle"].to_numpy(), other["angle"].to_numpy()
    for start in range(0, len(m), STRIP):
        stop = min(start + STRIP, len(m))
        low = start if b is None else int(np.searchsorted(at_b, at_a[start] - theta))
        high = int(np.searchsorted(at_b, at_a[stop - 1] + theta, side="right"))
        if high > low:
            i, j = np.nonzero(m[start:stop] @ k[low:high].T > threshold)
            i, j = i + start, j + low
            if b is None:
                i, j = i[i < j], j[i < j]
            yield i, j


def _compare(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one product (columns side, id, v, weight, angle): a row (id, links, None) for each linked row, (a, None, b) for each edge of a spanning forest."""
    sides = [pdf[pdf["side"] == s].sort_values("angle", kind="stable") for s in (0, 1)]
    a, b = sides
    same = bool(pdf["own"].iloc[0]) and pdf["p"].iloc[0] == pdf["q"].iloc[0]
    empty = pd.DataFrame({"id": pd.Series(dtype="int64"), "links": pd.Series(dtype="Int64"), "other": pd.Series(dtype="Int64")})
    if a.empty or b.empty and not same:
        return empty
    ids = a["id"].to_numpy() if same else np.concatenate([a["id"].to_numpy(), b["id"].to_numpy()])
    weight = a["weight"].to_numpy() if same else np.concatenate([a["weight"].to_numpy(), b["weight"].to_numpy()])
    shift = 0 if same else len(a)
    links, top, edges = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids)), []

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for i, j in _products(a, None if same else b, threshold):
        j = j + shift
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        labels = np.array([root(x) for x in range(len(ids))]) if len(i) > len(ids) else None
        if labels is not None:  # many pairs: drop those that are together already, and repeats of two groups
            apart = labels[i] != labels[j]
            pair = np.unique(np.stack([labels[i[apart]], labels[j[apart]]], axis=1), axis=0) if apart.any() else np.zeros((0, 2), int)
            i, j = pair[:, 0], pair[:, 1]
        for x, y in zip(i.tolist(), j.tolist()):
            x, y = root(x), root(y)
            if x != y:
                top[y] = x
                edges.append((x, y))
    some = np.flatnonzero(links)
    counted = pd.DataFrame({"id": ids[some], "links": links[some], "other": pd.NA})
    joined = pd.DataFrame({"id": ids[[x for x, _ in edges]], "links": pd.NA, "other": ids[[y for _, y in edges]]}) if edges else empty
    return pd.concat([counted, joined], ignore_index=True).astype({"id": "int64", "links": "Int64", "other": "Int64"})


def _dealer(rows: DataFrame, threshold: float, share: int | None, block: int | None) -> tuple[Callable[[int, int], DataFrame], DataFrame, int]:
    """(the rows dealt to the products of a turn of so many, the plan, the copies of a row on average), see :func:`products`."""
    theta = math.acos(threshold)
    first = rows.select(F.size("v").alias("d")).first()
    block = block or max(512, BLOCK_BYTES // (8 * max(1, first.d if first else 1)))
    pivots = choose_pivots(rows, share or block)
    homed = stored(rows.mapInArrow(_homes(pivots), "id bigint, v array<double>, weight bigint, home int, angle double"), "homes") if len(pivots) else rows.withColumns({"home": F.lit(0), "angle": F.lit(0.0)})
    cells = homed.groupBy("home").agg(F.count(F.lit(1)).alias("homes"), F.max("angle").alias("radius"))
    facts = {r.home: r for r in cells.collect()}  # a row a pivot
    radius = np.array([facts[c].radius if c in facts else -10.0 for c in range(len(pivots))])
    counted = homed.mapInArrow(_visits(pivots, radius, theta), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("visitors"))
    visitors = {r.cell: r.visitors for r in counted.collect()} if len(pivots) > 1 else {}
    spark = rows.sparkSession
    plan = spark.createDataFrame([(c, int(f.homes), int(visitors.get(c, 0))) for c, f in sorted(facts.items())], "cell int, homes bigint, visitors bigint")
    parts = plan.select("cell", F.ceil(F.col("homes") / block).cast("int").alias("hp"), F.ceil(F.col("visitors") / block).cast("int").alias("vp"))
    visiting = np.array([max(1, -(-int(visitors.get(c, 0)) // block)) for c in range(len(pivots))])
    # of a cell every home goes to all parts of homes and of visitors, every visitor to all parts of homes
    copies = sum(f.homes * (-(-f.homes // block) + -(-visitors.get(c, 0) // block)) + visitors.get(c, 0) * -(-f.homes // block) for c, f in facts.items())
    columns = ["cell", "p", "q", "own", "side", "id", "v", "weight", "angle"]

    def deal(turn: int, turns: int) -> DataFrame:
        # the plan has a row a pivot, MOST_PIVOTS at most
        home = homed.withColumnRenamed("home", "cell").join(F.broadcast(parts), "cell").withColumn("p", F.expr("cast(pmod(xxhash64(id), hp) as int)"))
        inside = home.withColumn("other", F.explode(F.expr(f"filter(sequence(0, hp - 1), o -> pmod(cell + p + o, {turns}) = {turn})")))
        inside = inside.select("cell", F.least("p", "other").alias("_p"), F.greatest("p", "other").alias("q"), F.lit(True).alias("own"), F.when((F.col("p") > F.col("other")), 1).otherwise(0).alias("side"), "id", "v", "weight", "angle").withColumnRenamed("_p", "p")
        if len(pivots) < 2:
            return inside.select(*columns)
        hosts = home.where("vp > 0").withColumn("q", F.explode(F.expr(f"filter(sequence(0, vp - 1), o -> pmod(cell + o, {turns}) = {turn})"))).withColumns({"own": F.lit(False), "side": F.lit(0)})
        came = homed.mapInArrow(_visits(pivots, radius, theta, visiting, turn, turns), "cell int, q int, id bigint, v array<double>, weight bigint, angle double").join(F.broadcast(parts), "cell")
        guests = came.withColumns({"p": F.explode(F.expr("sequence(0, hp - 1)")), "own": F.lit(False), "side": F.lit(1)})
        return inside.select(*columns).union(hosts.select(*columns)).union(guests.select(*columns))

    return deal, plan, -(-copies // max(1, sum(f.homes for f in facts.values())))


def products(rows: DataFrame, threshold: float, share: int | None = None, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The products of the join over ``rows`` (id: bigint, v: array<double>, not zero, weight: bigint).

    Returns the rows dealt to products (cell, p, q, own, side, id, v, weight, angle), and the plan: (cell, homes, visitors). A product has at most
    ``block`` rows a side, in expectation, by default BLOCK_BYTES of vectors: homes of a cell are dealt into parts by a hash, as are its
    visitors, and all parts meet. A pivot stands for about ``share`` rows, by default a block.
    """
    deal, plan, _ = _dealer(rows, threshold, share, block)
    return deal(0, 1), plan


def linked(rows: DataFrame, threshold: float, share: int | None = None, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, edges) of ``rows`` (id, v, weight): (id, links: the weight of all other rows whose cosine exceeds ``threshold``, zero or
    more), rows without a link left out, and (a, b), edges with the same components as the links: a forest for each product.

    Products take turns, of about COPIES copies of the rows each, and what a turn has shuffled goes when it ends: on vectors without
    structure the copies of all products grow with the square of the rows, and must not lie on disk at once.
    """
    deal, _, copies = _dealer(rows, threshold, share, block)
    turns, spark, found = max(1, -(-copies // COPIES)), rows.sparkSession, []

    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        for turn in range(turns):
            found.append(stored(deal(turn, turns).groupBy("cell", "p", "q", "own").applyInPandas(lambda pdf: _compare(pdf, threshold), "id bigint, links bigint, other bigint"), "links"))
    finally:
        spark.conf.set(CLEAN_UP, before)
    every = reduce(DataFrame.union, found)
    links = every.where("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    return links, every.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
