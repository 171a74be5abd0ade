"""Keep-first, semantic and either-key deduplication.

The greedy rules are sequential, but a drop only touches rows that share an edge or a key with it. Rows with a key in common are
settled in DataFrame rounds. By similarity rows are held against those that are left before them, in rounds of their order; given links
decompose over their connected components, each settled by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceweave.functions import vectors
from sourceweave.operators import pivots
from sourceweave.shared import components, drop_scratch, lookup, numbered, stored, write_scratch

#: Vectors in one block of the pair comparison, and rows of it that are multiplied with the other block at a time.
BLOCK, STRIP = 4096, 512
#: Rows that are multiplied at a time with those that are left.
CHUNK = 256
#: Bytes of the vectors of one block, blocks that one round of the greedy rule settles, and bytes of the vectors left that one task holds against them.
BLOCK_BYTES, BLOCKS, SHARE_BYTES = 2 << 20, 16, 8 << 20
#: Near pairs of a round's rows and those left before it that the round's task takes; a round with more of them is halved.
MOST_HITS = 4_000_000


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row by ``order`` of each key."""
    first = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def first_appearance(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first, nth): each value once with the row it first appears in; nth counts them in that order, from 0."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first"))
    return numbered(first, ["first"], "nth").select(key, "first", F.col("nth").cast("int").alias("nth"))


def _compare(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(i, j, similarity) of the pairs i < j of one pair of blocks (columns id, v, b, p, q) whose cosine exceeds ``threshold``."""
    p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])

    def part(b: int) -> tuple[np.ndarray, np.ndarray]:
        rows = pdf[pdf["b"] == b]
        m = np.stack(rows["v"].to_numpy()) if len(rows) else np.zeros((0, 1))
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return rows["id"].to_numpy(), m / np.where(length > 0, length, 1)

    (ids, a), (others, b) = part(p), part(q)
    if not len(ids) or not len(others):
        return pd.DataFrame({"i": np.zeros(0, np.int64), "j": np.zeros(0, np.int64), "similarity": np.zeros(0)})
    parts = []
    for at in range(0, len(a), STRIP):
        found = a[at : at + STRIP] @ b.T
        row, column = np.nonzero(found > threshold)
        i, j = ids[at + row], others[column]
        keep = i < j if p == q else i != j
        parts.append(pd.DataFrame({"i": np.minimum(i, j)[keep], "j": np.maximum(i, j)[keep], "similarity": found[row, column][keep]}))
    return pd.concat(parts, ignore_index=True)


def cosine_edges(df: DataFrame, order: str, vector: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """(i, j, similarity) for the pairs i < j (by ``order``) whose cosine exceeds ``threshold``.

    Vectors are dealt into blocks, and each pair of blocks is multiplied once, densely: exact, in bounded memory, with
    each vector sent once a block. Work grows with the square of the rows, as an exact comparison must.
    """
    n = df.count()
    blocks = max(1, -(-n // block))
    side = df.select(F.col(order).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(order), F.lit(blocks)).cast("int").alias("b"))
    meets = side.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("id", "v", "b", F.least("b", "other").alias("p"), F.greatest("b", "other").alias("q"))

    return meets.groupBy("p", "q").applyInPandas(lambda pdf: _compare(pdf, threshold), "i bigint, j bigint, similarity double")


def cosine_pairs(df: DataFrame, key: str, order: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(key, i, j, cosine) for all pairs i < j (by ``order``) within each ``key``, compared as in :func:`cosine_edges`."""
    sizes = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    rows = df.select(key, F.col(order).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).join(F.broadcast(sizes), key)
    side = rows.withColumn("b", F.expr("pmod(xxhash64(id), _blocks)").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, _blocks - 1)")))
    meets = side.select(key, "id", "v", "b", F.least("b", "other").alias("p"), F.greatest("b", "other").alias("q"))
    kind = df.schema[key].dataType.simpleString()

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _compare(pdf, -np.inf).rename(columns={"similarity": "cosine"})
        found.insert(0, key, pdf[key].iloc[0])
        return found

    return meets.groupBy(key, "p", "q").applyInPandas(compare, f"{key} {kind}, i bigint, j bigint, cosine double")


def greedy_drops(pairs: list[tuple[int, int]], length: dict[int, int]) -> set[int]:
    """Rows dropped by going through the pairs in order: of two that are both left the shorter goes, the later if equal."""
    gone: set[int] = set()
    for i, j in sorted(pairs):
        if i not in gone and j not in gone:
            gone.add(i if length[i] < length[j] else j)
    return gone


def semantic_dedup(df: DataFrame, order: str, text: str, edges: DataFrame) -> DataFrame:
    """``df`` without the rows that the greedy rule drops over ``edges`` (i, j)."""
    edges = stored(edges.select("i", "j").distinct(), "pairs")
    roots = components(edges.select(F.col("i").alias("a"), F.col("j").alias("b")))
    lengths = df.select(F.col(order).cast("bigint").alias("id"), F.length(F.coalesce(text, F.lit(""))).alias("n"))
    sized = edges.join(roots.withColumnRenamed("node", "i"), "i", "left").withColumn("root", F.coalesce("root", "i"))
    sized = sized.join(lengths.select(F.col("id").alias("i"), F.col("n").alias("ni")), "i").join(lengths.select(F.col("id").alias("j"), F.col("n").alias("nj")), "j")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        length = dict(zip(pdf["i"], pdf["ni"])) | dict(zip(pdf["j"], pdf["nj"]))
        return pd.DataFrame({"dropped": sorted(greedy_drops(list(zip(pdf["i"], pdf["j"])), length))}, dtype="int64")

    drops = sized.groupBy("root").applyInPandas(settle, "dropped bigint")
    return df.join(drops, df[order] == drops["dropped"], "left_anti")


def online_survivors(ids: np.ndarray, of: np.ndarray, unit: np.ndarray, length: np.ndarray, threshold: float) -> list[int]:
    """The rows that :func:`greedy_drops` leaves, without the pairs: :func:`online_round` with no rows before."""
    none = np.zeros(0, dtype=np.int64)
    return online_round(ids, of, unit, length, threshold, none, none, none)[0]


def online_round(
    ids: np.ndarray, of: np.ndarray, unit: np.ndarray, length: np.ndarray, threshold: float, row_of: np.ndarray, before: np.ndarray, before_length: np.ndarray
) -> tuple[list[int], list[int]]:
    """(rows left of ``ids``, rows before them that go) by the rule of :func:`greedy_drops`: rows ``ids``, ascending, of the classes ``of``,
    with a vector of length one and a length of text for each class.

    Rows that earlier rounds left come as the near pairs (``row_of``: the place in ``ids``, ``before``: the earlier row, less than all
    ``ids``, ``before_length``), ordered by both.

    A pair changes nothing but its two rows, and matters only while both are there. So the pairs may be gone through by their later
    row: it meets the earlier ones that are left, in order, takes the shorter ones, and goes with the first that is as long or
    longer. Only rows that are left are held, and none of these is near another; a copy of one goes at once. Rows come in chunks,
    which are multiplied with the rows left in one go.
    """
    left = np.zeros(0, dtype=np.int64)  # places in ``ids`` of the rows that are left, ascending
    there = np.zeros(len(length), dtype=bool)
    earlier, first, place_of = np.unique(before, return_index=True, return_inverse=True)
    earlier_length, still = before_length[first], np.ones(len(earlier), dtype=bool)
    starts = np.searchsorted(row_of, np.arange(len(ids) + 1))
    at = 0
    while at < len(ids):
        fresh, stop = {}, at
        while stop < len(ids) and len(fresh) < CHUNK:
            if not there[of[stop]]:
                fresh.setdefault(int(of[stop]), len(fresh))
            stop += 1
        held, alive = unit[of[left]], np.ones(len(left), dtype=bool)
        near = unit[list(fresh)] @ held.T > threshold
        new: list[int] = []
        for row in range(at, stop):
            own = int(of[row])
            if there[own]:
                continue
            if starts[row] < starts[row + 1]:
                met = place_of[starts[row] : starts[row + 1]]
                met = met[still[met]]
                longer = np.flatnonzero(earlier_length[met] >= length[own])
                still[met[: longer[0]] if len(longer) else met] = False
                if len(longer):
                    continue
            hits = np.flatnonzero((near[fresh[own]] if own in fresh else unit[own] @ held.T > threshold) & alive)
            longer = np.flatnonzero(length[of[left[hits]]] >= length[own])
            if len(longer):
                hits = hits[: longer[0]]
            alive[hits] = False
            there[of[left[hits]]] = False
            if len(longer):
                continue
            taken = False
            for place, other in enumerate(new):
                if other >= 0 and unit[own] @ unit[of[other]] > threshold:
                    if length[of[other]] >= length[own]:
                        taken = True
                        break
                    there[of[other]], new[place] = False, -1
            if not taken:
                new.append(row)
                there[own] = True
        left = np.concatenate([left[alive], np.array([r for r in new if r >= 0], dtype=np.int64)])
        at = stop
    return [int(ids[r]) for r in left], earlier[~still].tolist()


def _unit_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, v) with v, none of them zero, at length one and as the bytes of its numbers, which pass between tasks as they are."""
    for batch in batches:
        m = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        v = pa.array([row.tobytes() for row in m], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), v], names=["id", "n", "v"])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=float).reshape(len(column), -1)


def _near(fresh: pd.DataFrame, left: pd.DataFrame, threshold: float, most: int) -> pd.DataFrame:
    """(id, before, n): the pairs of ``fresh`` and ``left`` (id, n, v) whose cosine exceeds ``threshold``; not all if there are more than ``most``.

    Products are made in single precision; what may exceed the threshold for all its rounding is multiplied again in double precision.
    """
    found, many = [], 0
    if len(fresh) and len(left):
        a, b = _matrix(fresh["v"]), _matrix(left["v"])
        least, single = threshold - (a.shape[1] + 4) * 2.0**-23, b.astype(np.float32).T
        ids, others, n = fresh["id"].to_numpy(), left["id"].to_numpy(), left["n"].to_numpy()
        for at in range(0, len(a), STRIP):
            i, j = np.divmod(np.flatnonzero(a[at : at + STRIP].astype(np.float32) @ single > least), len(b))
            i += at
            exact = np.concatenate([np.einsum("ij,ij->i", a[i[k : k + 65536]], b[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)]) > threshold
            found.append(pd.DataFrame({"id": ids[i[exact]], "before": others[j[exact]], "n": n[j[exact]]}))
            many += len(found[-1])
            if many > most:
                break
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"id": np.zeros(0, np.int64), "before": np.zeros(0, np.int64), "n": np.zeros(0, np.int32)})


def _settle(rows: pd.DataFrame, hits: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(id, stays) of a round: its rows (id, n, v) that stay, and rows before it that go, by its near pairs (id, before, n)."""
    if rows.empty:
        return pd.DataFrame({"id": np.zeros(0, np.int64), "stays": np.zeros(0, bool)})
    rows, hits = rows.sort_values("id"), hits.sort_values(["id", "before"])
    ids, classes = rows["id"].to_numpy(), {}
    of = np.array([classes.setdefault(key, len(classes)) for key in zip(rows["v"], rows["n"])])
    _, one = np.unique(of, return_index=True)
    stay, go = online_round(ids, of, _matrix(rows["v"])[one], rows["n"].to_numpy()[one], threshold, np.searchsorted(ids, hits["id"].to_numpy()), hits["before"].to_numpy(), hits["n"].to_numpy())
    return pd.DataFrame({"id": np.array(stay + go, dtype=np.int64), "stays": np.arange(len(stay) + len(go)) < len(stay)})


def greedy_left(rows: DataFrame, threshold: float, share: int | None = None, block: int | None = None, most_hits: int = MOST_HITS) -> DataFrame:
    """(id) of ``rows`` (id, n: a length, v: array<double>, not zero) that the greedy rule leaves over all pairs whose cosine exceeds ``threshold``.

    Rows are settled in rounds of BLOCKS blocks, in their order. All tasks hold a round's rows against those that are left of the rounds before,
    ``share`` of them each, and one task settles the round from these pairs and its own rows. What is gone is never compared again, and those
    left are never near each other, so copies and clumps make few pairs. A task's size is that of a round, however many rows there are.
    """
    spark = rows.sparkSession
    width = rows.select(F.size("v").alias("d")).first()
    bytes_ = 8 * max(1, width.d if width else 1)
    full = BLOCKS * (block or min(4096, max(1, BLOCK_BYTES // bytes_)))
    share = share or max(1, SHARE_BYTES // bytes_)
    packed = rows.select("id", "n", "v").mapInArrow(_unit_bytes, "id bigint, n int, v binary")
    placed, placed_path = write_scratch(numbered(packed, ["id"], "at"), "in-order")
    total, cores = placed.count(), spark.sparkContext.defaultParallelism
    left, path = write_scratch(packed.limit(0), "left")
    at, size, many = 0, full, 0
    before = spark.conf.get(pivots.CLEAN_UP, "false")
    spark.conf.set(pivots.CLEAN_UP, "true")  # what a round has shuffled goes when it ends
    try:
        while at < total:
            fresh = placed.where(F.col("at").between(at, at + size - 1)).select("id", "n", "v")
            # no more than share rows a part, and as many parts as can be worked on at once if they are worth it
            parts = max(-(-many // share), min(cores, many // max(1, share // 8)), 1)
            dealt = left.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
            copies = fresh.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
            hits = copies.groupBy("part").cogroup(dealt.groupBy("part")).applyInPandas(lambda a, b: _near(a, b, threshold, most_hits), "id bigint, before bigint, n int")
            hits, hits_path = write_scratch(hits, "hits")
            if size > 1 and hits.count() > most_hits:
                drop_scratch(spark, hits_path)
                size = -(-size // 2)
                continue
            one = F.lit(0).alias("round")
            settled, settled_path = write_scratch(fresh.groupBy(one).cogroup(hits.groupBy(one)).applyInPandas(lambda a, b: _settle(a, b, threshold), "id bigint, stays boolean"), "settled")
            after, after_path = write_scratch(left.join(settled.where("not stays"), "id", "left_anti").union(fresh.join(settled.where("stays"), "id", "left_semi")), "left")
            for old in (hits_path, settled_path, path):
                drop_scratch(spark, old)
            left, path, at, size = after, after_path, at + size, min(full, 2 * size)
            many = left.count()
    finally:
        spark.conf.set(pivots.CLEAN_UP, before)
    drop_scratch(spark, placed_path)
    return left.select("id")


def _classes(df: DataFrame, order: str, vector: str, length: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows without a vector, rows with their class's key, classes): a class has the same vector and length; copies meet by a digest."""
    v = vectors.doubles(F.col(vector))
    rows = df.select(F.col(order).cast("bigint").alias("id"), v.alias("v"), length.alias("n"))
    some = F.coalesce(vectors.norm(F.col("v")) > 0, F.lit(False))
    keyed = rows.where(some).withColumn("key", F.unhex(F.sha2(F.concat_ws(":", "n", F.col("v").cast("string")), 256)))
    classes = keyed.groupBy("key").agg(F.min("id").alias("rep"), F.any_value("v").alias("v"), F.any_value("n").alias("n"), F.count(F.lit(1)).alias("weight"))
    return rows.where(~some).select("id"), keyed, stored(classes, "classes")


def semantic_first(df: DataFrame, order: str, text: str, vector: str, threshold: float, share: int | None = None, block: int | None = None) -> DataFrame:
    """``df`` without the rows that the greedy rule drops over all pairs whose cosine exceeds ``threshold`` (zero or more).

    Rows go by :func:`greedy_left`, which compares with the rows that are left only: no list of all pairs is made, nor all of them multiplied.
    Vectors that are null, zero or not finite are near nothing.
    """
    rows = df.select(F.col(order).cast("bigint").alias("id"), vectors.doubles(F.col(vector)).alias("v"), F.length(F.coalesce(text, F.lit(""))).alias("n"))
    length = vectors.norm(F.col("v"))
    some = F.coalesce((length > 0) & (length < float("inf")), F.lit(False))  # NaN is greater than all numbers
    kept = greedy_left(rows.where(some), threshold, share, block).union(rows.where(~some).select("id"))
    return df.join(kept, df[order] == kept["id"], "left_semi")


def semantic_links(df: DataFrame, order: str, vector: str, threshold: float, share: int | None = None, block: int | None = None) -> DataFrame:
    """(id, class_id, n_links, component_id) of each row: the first row with its vector, how many other rows are nearer than
    ``threshold`` (zero or more, below one) by the cosine, and the first row that links reach.

    Links are counted by class where the vectors are multiplied, so no pairs of rows are made, however many copies there are. A zero or
    null vector is a class by itself without links.
    """
    without, keyed, classes = _classes(df, order, vector, F.lit(0))
    links, edges = pivots.linked(classes.select(F.col("rep").alias("id"), "v", "weight"), threshold, share, block)
    roots = components(edges)
    counted = classes.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    # the root of a component is its smallest class, and a class goes by its first row
    facts = counted.select("key", F.col("rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    found = lookup(keyed.select("key", "id"), ["key"], facts, F.col("id")).drop("key")
    return found.union(without.select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")))


def unseen(batch: DataFrame, seen: DataFrame, keys: tuple[str, str], order: str, rounds: int = 1000) -> DataFrame:
    """Rows of ``batch`` with neither key in ``seen``, nor in a row of the batch that is kept before them.

    The history is an anti join a key. Inside the batch a row that is the first undecided one of each of its keys is kept, and
    what shares a key with it goes; rounds of that end with the rows that going through them in ``order`` keeps. A key that
    many rows share is a grouped minimum and a look-up by cells, so it meets in no single task. Null and empty keys
    match nothing.
    """
    fresh = batch
    for key in keys:
        known = seen.where(F.col(key).isNotNull() & (F.col(key) != "")).select(key).distinct()
        fresh = fresh.join(known, key, "left_anti")
    value = lambda k: F.concat(F.lit(f"{k}:"), F.col(k))
    own = F.array(*[F.when(F.col(k) != "", F.unhex(F.sha2(value(k), 256))) for k in keys])
    named = fresh.select(F.col(order).cast("bigint").alias("id"), F.explode(F.array_compact(own)).alias("key"))
    left, gone = _contested(stored(named.distinct(), "keys")), None
    for _ in range(rounds):
        left = stored(left, "contested")
        if left.isEmpty():
            break
        first = left.groupBy("key").agg(F.min("id").alias("first"))
        placed = lookup(left, ["key"], first, F.col("id")).withColumn("is_first", F.col("id") == F.col("first"))
        kept = placed.groupBy("id").agg(F.bool_and("is_first").alias("kept")).where("kept").select("id")
        taken = left.join(kept, "id", "left_semi").select("key", F.lit(True).alias("taken"))
        lost = stored(lookup(left, ["key"], taken, F.col("id")).where("taken").select("id").distinct().join(kept, "id", "left_anti"), "lost")
        gone = lost if gone is None else gone.union(lost)
        left = _contested(left.join(kept.union(lost), "id", "left_anti"))
    else:
        raise RuntimeError(f"rows did not settle in {rounds} rounds")
    out = fresh if gone is None else fresh.join(gone, fresh[order] == gone["id"], "left_anti")
    return out.select(*batch.columns)


def _contested(named: DataFrame) -> DataFrame:
    """The rows (id, key) of ids that share a key; a lone id is kept without another look."""
    shared = named.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key", F.lit(True).alias("_shared"))
    ids = lookup(named, ["key"], shared, F.col("id")).where("_shared").select("id").distinct()
    return named.join(ids, "id", "left_semi")
