"""Bootstrap intervals and permutation tests of the AUC.

Samples are drawn by counts, at every size. Rows are combined to a row a score with its ones and zeros; these lie in blocks in order
of score. A draw deals its rows over the blocks (multinomial for the bootstrap; for shuffled labels the ones, without
replacement) and, in a task a block, over the block's scores. That is the law of drawing rows, from numpy's generator, and
no task holds more than a block's scores, and the driver two numbers a block.

Studies that are to agree with draws made row by row ask for ``draws="rows"``: Python's generator, all groups in one pass, a task
a group and kind with the group's rows, which makes the draws from the seed and holds one at a time.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourceweave.shared import stored
from sourceweave.operators.metrics import known

#: Distinct scores in a block, about, and the tasks over which the draws of a block are dealt.
LEVELS = 50_000
PARTS = 16
#: Words that are asked of the generator at a time, at least.
WORDS = 1 << 16


def _midranks(values: np.ndarray) -> np.ndarray:
    _, at, n = np.unique(values, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def auc(scores: np.ndarray, labels: np.ndarray) -> float:
    ones = int(labels.sum())
    return float((_midranks(scores)[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones)))


def _positions(n: int, samples: int, seed: int) -> Iterator[np.ndarray]:
    """``samples`` draws of n positions, as Python's generator draws them one after the other for a seed.

    That generator is the Mersenne twister: a position below ``n`` is the top bits of a 32-bit word, and words that give too
    large a number are passed over. The words come in stretches of a draw, or of WORDS if that is more, so no more is held.
    """
    kind, state, _ = random.Random(seed).getstate()
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], dtype=np.uint32), "pos": state[-1]}}
    bits, held, at = n.bit_length(), np.zeros(0, dtype=np.int64), 0
    for _ in range(samples):
        while len(held) - at < n:
            missing = n - (len(held) - at)
            some = words.random_raw(max(WORDS, int(missing * (1 << bits) / n * 1.02) + 64)) >> np.uint64(32 - bits)
            held, at = np.concatenate([held[at:], some[some < n].astype(np.int64)]), 0
        yield held[at : at + n]
        at += n


def bootstrap_draws(n: int, samples: int, seed: int) -> np.ndarray:
    """(samples, n) positions of :func:`_positions`, all at once: for small samples."""
    return np.array(list(_positions(n, samples, seed)), dtype=np.int64).reshape(samples, n)


def permutation_draws(labels: list[int], samples: int, seed: int) -> list[list[int]]:
    """Each draw shuffles the one before."""
    rng, now, out = random.Random(seed), list(labels), []
    for _ in range(samples):
        rng.shuffle(now)
        out.append(list(now))
    return out


def _choose(counts: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``k`` rows picked without replacement fall on each count.

    Each row is picked by itself first; rows at random then go or are added until there are ``k``, which leaves all sets of
    ``k`` rows equally likely. numpy's own law takes fewer than 10^9 rows.
    """
    total = int(counts.sum())
    found = rng.binomial(counts, k / total) if total else np.zeros_like(counts)
    over = int(found.sum()) - k
    if over:
        pool = found if over > 0 else counts - found
        at = np.searchsorted(np.cumsum(pool), rng.choice(int(pool.sum()), abs(over), replace=False, shuffle=False), side="right")
        found = found - np.sign(over) * np.bincount(at, minlength=len(counts))
    return found


def _blocks(df: DataFrame) -> DataFrame:
    """(block, score, ones, zeros): a row a score, blocks of about LEVELS scores in order of score."""
    spark = df.sparkSession
    label = F.col("label").cast("bigint")
    levels = stored(known(df).groupBy("score").agg(F.sum(label).alias("ones"), F.sum(1 - label).alias("zeros")), "levels")
    if levels.count() <= LEVELS:
        return levels.withColumn("block", F.lit(0))
    some = levels.where(F.pmod(F.xxhash64("score"), F.lit(max(1, LEVELS // 64))) == 0).select("score").toPandas()["score"]  # 64 a block
    sent = spark.sparkContext.broadcast(np.sort(some.to_numpy(float))[63::64])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(block=np.searchsorted(sent.value, batch["score"].to_numpy(), side="left").astype(np.int32))

    return stored(levels.mapInPandas(place, "score double, ones bigint, zeros bigint, block int"), "blocks")


def _drawn_aucs(df: DataFrame, samples: int, seed: int, shuffled: bool) -> DataFrame | None:
    """(draw, auc) of draws by counts, and of the sample itself as draw -1; None with one class."""
    spark = df.sparkSession
    levels = _blocks(df)
    totals = levels.groupBy("block").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).toPandas().sort_values("block")
    ones, rows = int(totals["ones"].sum()), (totals["ones"] + totals["zeros"]).to_numpy(np.int64)
    if not 0 < ones < rows.sum():
        return None
    sent = spark.sparkContext.broadcast((totals["block"].to_numpy(), rows))  # two numbers a block of LEVELS scores

    def share(draw: int, at: int) -> int:
        """Rows (ones, if shuffled) that a draw deals to a block; every task works it out from the seed."""
        rng, sizes = np.random.default_rng([seed, draw]), sent.value[1]
        return int((_choose(sizes, ones, rng) if shuffled else rng.multinomial(int(sizes.sum()), sizes / sizes.sum()))[at])

    def rate(pdf: pd.DataFrame) -> pd.DataFrame:
        block, part = int(pdf["block"].iloc[0]), int(pdf["part"].iloc[0])
        at = int(np.searchsorted(sent.value[0], block))
        pdf = pdf.sort_values("score")
        own = pdf[["ones", "zeros"]].to_numpy(np.int64).T
        n, cells, out = own.sum(axis=0), own.ravel() / own.sum(), []
        for draw in [-1, *range(samples)]:
            if draw % PARTS != part:
                continue
            rng = np.random.default_rng([seed, draw + 1, block + 1])
            if draw < 0:
                y, z = own
            elif shuffled:
                y = _choose(n, share(draw, at), rng)
                z = n - y
            else:
                y, z = rng.multinomial(share(draw, at), cells).reshape(2, -1)
            below = np.cumsum(z) - z
            out.append((draw, block, int(y.sum()), int(z.sum()), float((y * (below + z / 2)).sum())))
        return pd.DataFrame(out, columns=["draw", "block", "ones", "zeros", "won"])

    copies = levels.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rated = copies.groupBy("block", "part").applyInPandas(rate, "draw int, block int, ones bigint, zeros bigint, won double")
    before = F.coalesce(F.sum("zeros").over(Window.partitionBy("draw").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = rated.withColumn("won", F.col("won") + F.col("ones").cast("double") * before).groupBy("draw").agg(F.sum("won").alias("won"), F.sum("ones").cast("double").alias("ones"), F.sum("zeros").cast("double").alias("zeros"))
    return summed.where("ones > 0 and zeros > 0").select("draw", (F.col("won") / (F.col("ones") * F.col("zeros"))).alias("auc"))


def _bounds(rated: DataFrame) -> DataFrame:
    """(auc_lo, auc_hi) of a table of aucs, as many as draws."""
    ordered = rated.agg(F.sort_array(F.collect_list("auc")).alias("a"), F.count("auc").alias("n"))
    at = lambda q: F.round(F.get("a", F.floor(F.lit(q) * F.col("n")).cast("int")), 4)
    return ordered.select(at(0.025).alias("auc_lo"), at(0.975).alias("auc_hi"))


def _rated(scores: np.ndarray, labels: np.ndarray, samples: int, seed: int, kind: str) -> pd.DataFrame:
    """(kind, value) of the draws of a sample: the AUC of a bootstrap draw, or whether a shuffled one is as far from one half. One draw is held at a time."""
    values, n = [], len(scores)
    if kind == "bootstrap":
        distinct, level = np.unique(scores, return_inverse=True)
        for picked in _positions(n, samples, seed):
            at, y = level[picked], labels[picked] == 1
            ones, rows = np.bincount(at[y], minlength=len(distinct)), np.bincount(at, minlength=len(distinct))
            p = int(ones.sum())
            if 0 < p < n:
                values.append(float(((ones * (np.cumsum(rows) - (rows - 1) / 2)).sum() - p * (p + 1) / 2) / (p * (n - p))))
    else:
        ranks, ones = _midranks(scores), int(labels.sum())
        seen = abs(auc(scores, labels) - 0.5)
        rng, now = random.Random(seed), bytearray(labels.astype(np.uint8))
        for _ in range(samples):
            rng.shuffle(now)
            found = (ranks[np.frombuffer(now, dtype=np.uint8) == 1].sum() - ones * (ones + 1) / 2) / (ones * (n - ones))
            values.append(float(abs(found - 0.5) >= seen))
    return pd.DataFrame({"kind": pd.Series([kind] * len(values), dtype=object), "value": np.array(values, dtype=float)})


def _small(df: DataFrame, key: str, order: str, samples: int, seed: int, kinds: tuple[str, ...]) -> DataFrame:
    """(key, auc_lo, auc_hi, auc_p) of samples that are drawn row by row, all groups at once.

    A task has a sample and a kind of draws, each of which begins where the one before ended: it makes them itself from the seed, so
    nothing but the rows is sent, and holds one at a time. Groups below four rows or with one class are left out.
    """
    rows = known(df).select(F.col(key).alias("_key"), "score", F.col("label").cast("int").alias("label"), F.col(order).alias("_order"))
    # by a fixed number, or small tables would meet in a few tasks, and their draws take long
    dealt = rows.withColumn("_kind", F.explode(F.array(*map(F.lit, kinds)))).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key", "_kind")

    def rate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_order")
        scores, labels = pdf["score"].to_numpy(float), pdf["label"].to_numpy(int)
        if len(scores) < 4 or len(set(labels.tolist())) < 2 or not samples:
            return pd.DataFrame({"_key": pd.Series([], dtype=object), "kind": pd.Series([], dtype=object), "value": np.zeros(0)})
        found = _rated(scores, labels, samples, seed, pdf["_kind"].iloc[0])
        found.insert(0, "_key", pdf["_key"].iloc[0])
        return found

    rated = dealt.groupBy("_key", "_kind").applyInPandas(rate, f"_key {df.schema[key].dataType.simpleString()}, kind string, value double")
    booted = F.sort_array(F.collect_list(F.when(F.col("kind") == "bootstrap", F.col("value"))))
    at = lambda q: F.round(F.get("_a", F.floor(F.lit(q) * F.size("_a")).cast("int")), 4)
    summed = rated.groupBy(F.col("_key").alias(key)).agg(booted.alias("_a"), F.round(F.avg(F.when(F.col("kind") == "permutation", F.col("value"))), 4).alias("auc_p"))
    return summed.select(key, at(0.025).alias("auc_lo"), at(0.975).alias("auc_hi"), "auc_p")


def _counted(df: DataFrame, samples: int, seed: int, kinds: tuple[str, ...]) -> DataFrame:
    """(auc_lo, auc_hi, auc_p) of one sample that is drawn by counts."""
    spark = df.sparkSession
    none = spark.range(1).select(*[F.lit(None).cast("double").alias(c) for c in ("auc_lo", "auc_hi", "auc_p")])
    booted = _drawn_aucs(df, samples, seed, shuffled=False) if "bootstrap" in kinds else None
    out = none.drop("auc_p") if booted is None else _bounds(booted.where("draw >= 0"))
    shuffled = _drawn_aucs(df, samples, seed, shuffled=True) if "permutation" in kinds else None
    if shuffled is None:
        return out.crossJoin(none.select("auc_p"))
    far = F.abs(F.col("auc") - 0.5)
    both = shuffled.agg(F.collect_list(F.when(F.col("draw") >= 0, far)).alias("far"), F.max(F.when(F.col("draw") < 0, far)).alias("seen"))
    return out.crossJoin(both.select(F.explode("far").alias("far"), "seen").agg(F.round(F.avg((F.col("far") >= F.col("seen")).cast("double")), 4).alias("auc_p")))


def resampled(df: DataFrame, key: str, order: str, samples: int = 2000, seed: int = 7, kinds: tuple[str, ...] = ("bootstrap", "permutation"), draws: str = "counts") -> DataFrame:
    """(key, auc_lo, auc_hi, auc_p) for each of a few groups: the 2.5 % and 97.5 % draws of the AUC, and the share of
    shuffled labels whose AUC is as far from one half. Null below four rows or with one class; bootstrap draws that hold one class are left out.

    ``draws``: "counts", the same at every size, or "rows", Python's generator row by row, for studies that are to agree with draws made
    that way; a group's rows then go to a task for each kind.
    """
    groups = df.select(key).distinct()
    if draws == "rows":
        return groups.join(_small(df, key, order, samples, seed, kinds), key, "left")
    sizes = known(df).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n >= 4").collect()  # a row a group
    parts = [_counted(df.where(F.col(key).eqNullSafe(k)), samples, seed, kinds).select(F.lit(k).cast(df.schema[key].dataType).alias(key), "auc_lo", "auc_hi", "auc_p") for k, _ in sizes]
    return groups.join(reduce(DataFrame.union, parts), key, "left") if parts else groups.withColumns({c: F.lit(None).cast("double") for c in ("auc_lo", "auc_hi", "auc_p")})


def _one(df: DataFrame, order: str, samples: int, seed: int, kind: str, draws: str, columns: list[str]) -> DataFrame:
    """:func:`resampled` of a single sample: one row, of nulls where there is nothing to draw from."""
    found = resampled(df.withColumn("_all", F.lit(0)), "_all", order, samples, seed, (kind,), draws)
    return df.sparkSession.range(1).select(F.lit(0).alias("_all")).join(found, "_all", "left").select(*columns)


def bootstrap_interval(df: DataFrame, order: str, samples: int = 2000, seed: int = 7, draws: str = "counts") -> DataFrame:
    """(auc_lo, auc_hi): the 2.5 % and 97.5 % draws of the AUC of one sample, as in :func:`resampled`."""
    return _one(df, order, samples, seed, "bootstrap", draws, ["auc_lo", "auc_hi"])


def permutation_test(df: DataFrame, order: str, samples: int = 2000, seed: int = 7, draws: str = "counts") -> DataFrame:
    """(auc_p): the share of shuffled labels of one sample whose AUC is as far from one half, as in :func:`resampled`."""
    return _one(df, order, samples, seed, "permutation", draws, ["auc_p"])
