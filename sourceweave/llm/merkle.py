"""A Merkle manifest of the documents, its proofs, and what tampering does to them.

Each language has a tree of arity eight over its documents in order; the roots of these, in order of the language, are the leaves of a
last tree. Nodes rise by events: a parent gathers the indexed digests of its children until it has as many as the sizes say, and then
is itself an event one level up. What a task can't complete is its frontier, which ``combineByKey`` brings together, round by round.
Proofs go the other way: a node links to its parent, whose path to the root it goes on with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceweave.llm.common import id_crc, materialise, numbered, shuffle_partitions, small_batches

ARITY = 8
#: Levels whose proofs are worked out within a block of ARITY ** LOW consecutive leaves; one block meets one task.
LOW = 4
#: Levels that a frontier rises in one round: parents with a common ancestor so far up share a partition.
RISE = 3
#: The tree over the roots of the languages.
TOP = -1

#: (tree, size of the tree, number of trees, level of the parent, place of the parent).
Key = tuple[int, int, int, int, int]
Found = tuple[Key, dict[int, str], "str | None"]


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def width(size: int, level: int) -> int:
    """Nodes of a level of a tree of ``size`` leaves."""
    for _ in range(level):
        size = -(-size // ARITY)
    return size


def height(size: int) -> int:
    """The level of a tree's root."""
    level = 0
    while size > 1:
        size, level = -(-size // ARITY), level + 1
    return level


def arity(key: Key) -> int:
    """Children that a parent has, from the size of its tree."""
    _, size, _, level, at = key
    return min(ARITY, width(size, level - 1) - ARITY * at)


def node_above(tree: int, size: int, trees: int, level: int, at: int) -> tuple[Key, int] | None:
    """The parent of a node and the node's place in it; None for the root of all."""
    if level == height(size):
        return None if tree == TOP or trees == 1 else node_above(TOP, trees, trees, 0, tree)
    return (tree, size, trees, level + 1, at // ARITY), at % ARITY


def rise(events: Iterable[tuple[Key, dict[int, str]]]) -> Iterator[Found]:
    """(parent, children by place, digest) of every parent that the events complete, and, without a digest, of the rest.

    A completed parent is an event of its own parent at once, so whole subtrees rise in one go; of events in order only the parents
    at their borders stay open.
    """
    pending: dict[Key, dict[int, str]] = {}
    for key, children in events:
        while True:
            held = pending.setdefault(key, {})
            held.update(children)
            if len(held) < arity(key):
                break
            del pending[key]
            own = digest(held[slot] for slot in sorted(held))
            yield key, held, own
            above = node_above(*key)
            if above is None:
                break
            key, children = above[0], {above[1]: own}
    for key, held in pending.items():
        yield key, held, None


_NODES = "tree bigint, size bigint, trees bigint, level int, at bigint, slots array<int>, kids array<string>, own string, depth int, up_tree bigint, up_level int, up_at bigint"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]


def _rows(found: Iterable[Found]) -> Iterator[tuple]:
    """Rows of open parents, and of the closed ones above the blocks; those below are worked out again where they are needed.

    ``depth`` counts from the root of all; the root of a language's tree goes by its name in the last tree (``up_``).
    """
    for key, held, own in found:
        tree, size, trees, level, at = key
        if own is None or level > LOW or tree == TOP:
            slots = sorted(held)
            tall = height(size)
            name = (TOP, 0, tree) if level == tall and tree != TOP else (tree, level, at)
            yield (*key, slots, [held[s] for s in slots], own, tall - level + (0 if tree == TOP else height(trees)), *name)


def _first_rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def events():
        for batch in batches:
            for tree, size, trees, at, leaf in zip(*(batch.column(c).to_pylist() for c in ("tree", "size", "trees", "at", "leaf"))):
                above = node_above(tree, size, trees, 0, at)
                if above:
                    yield above[0], {above[1]: leaf.hex()}

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_KINDS)], names=[c.split()[0] for c in _NODES.split(", ")])

    held: list[tuple] = []
    for row in _rows(rise(events())):
        held.append(row)
        if len(held) == 4096:
            yield batch(held)
            held = []
    yield batch(held)


def _home(key: Key) -> int:
    """One partition for the parents that have a common ancestor within RISE levels."""
    tree, _, _, level, at = key
    up = -(-level // RISE) * RISE
    return hash((tree, up, at // ARITY ** (up - level)))


def _merge(a: dict[int, str], b: dict[int, str]) -> dict[int, str]:
    a.update(b)
    return a


def tree_nodes(leaves: DataFrame, rounds: int) -> DataFrame:
    """All parents above the blocks with their children and digests, from ``leaves`` (tree, size, trees, at, leaf: binary).

    The first rise happens where the leaves lie; rounds of ``combineByKey`` then bring the open parents of all tasks together, and
    every round's rows are written to the shared folder.
    """
    spark = leaves.sparkSession
    now = materialise(leaves.select("tree", "size", "trees", "at", "leaf").mapInArrow(_first_rise, _NODES), "merkle-rise")
    done, parts = now.where("own is not null"), shuffle_partitions(spark)
    for _ in range(rounds):
        opened = now.where("own is null")
        if opened.isEmpty():
            return done
        events = opened.rdd.map(lambda r: ((r["tree"], r["size"], r["trees"], r["level"], r["at"]), dict(zip(r["slots"], r["kids"]))))
        combined = events.combineByKey(dict, _merge, _merge, parts, _home)
        now = materialise(spark.createDataFrame(combined.mapPartitions(lambda part: _rows(rise(part))), _NODES, verifySchema=False), "merkle-rise")
        done = done.union(now.where("own is not null"))
    if not now.where("own is null").isEmpty():
        raise RuntimeError("parents without all their children are left")
    return done


def block_paths(nodes: DataFrame, deepest: int) -> DataFrame:
    """(tree, block, path): the steps from each block's node to the root of all, each its place and the digests of its run.

    Reverse links: children go on with the path of their parent, one small join a level from the root down. A block
    without a row is the root of all.
    """
    step = F.array(F.concat(F.col("slot").cast("string"), F.lit(":"), F.array_join("kids", "")))
    up = ["up_tree", "up_level", "up_at"]
    links = nodes.select("depth", *up, "tree", (F.col("level") - 1).alias("level"), "at", "kids", F.posexplode("kids").alias("slot", "_kid"))
    links = links.select("depth", *up, "tree", "level", (F.col("at") * ARITY + F.col("slot")).alias("at"), step.alias("path"))
    known, found = None, nodes.sparkSession.createDataFrame([], "tree bigint, level int, at bigint, path array<string>")
    for depth in range(deepest):
        here = links.where(F.col("depth") == depth)
        if known is not None:
            here = here.join(known.toDF(*up, "more"), up).withColumn("path", F.concat("path", "more"))
        known = materialise(here.select("tree", "level", "at", "path"), "merkle-paths")
        found = found.union(known)
    tall = nodes.where((F.col("tree") != TOP) & (F.col("level") > LOW)).select(F.col("tree").alias("at")).distinct()
    small = found.where((F.col("tree") == TOP) & (F.col("level") == 0)).join(tall, "at", "left_anti")
    blocks = found.where((F.col("tree") != TOP) & (F.col("level") == LOW))
    return blocks.select("tree", F.col("at").alias("block"), "path").union(small.select(F.col("at").alias("tree"), F.lit(0).cast("bigint").alias("block"), "path"))


def _settle(leaves: pd.DataFrame, paths: pd.DataFrame) -> pd.DataFrame:
    """Proofs and folded roots of the leaves of one block."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    if leaves.empty:
        return pd.DataFrame({c: pd.Series(dtype=object) for c in names})
    leaves = leaves.sort_values("at")
    size, path = int(leaves["size"].iloc[0]), list(paths["path"].iloc[0]) if len(paths) else []
    steps = [(int(slot), [kids[i : i + 64] for i in range(0, len(kids), 64)]) for slot, kids in (s.split(":") for s in path)]
    own = [x.hex() for x in leaves["leaf"]]
    levels = [own]
    for _ in range(min(LOW, height(size))):
        levels.append([digest(levels[-1][i : i + ARITY]) for i in range(0, len(levels[-1]), ARITY)])
    roots = [levels[-1][0], *(digest(kids) for _, kids in steps)]
    if any(kids[slot] != node for (slot, kids), node in zip(steps, roots)):
        raise ValueError("a node's digest isn't the one that its parent has")
    root = roots[-1]

    beside = ["".join(k for _i, k in enumerate(kids) if _i != slot) for slot, kids in steps]
    proofs = ["".join(beside)]
    for level in reversed(levels[:-1]):  # each node goes on with its parent's proof
        proofs = ["".join(level[at - at % ARITY : at] + level[at + 1 : at - at % ARITY + ARITY]) + proofs[at // ARITY] for at in range(len(level))]

    def folded(at: int, node: str) -> str:
        runs = []
        for level in levels[:-1]:
            runs.append((at % ARITY, level[at - at % ARITY : at - at % ARITY + ARITY]))
            at //= ARITY
        for slot, kids in runs + steps:
            if kids[slot] == node:
                return root  # from here on the original nodes
            node = digest([*kids[:slot], node, *kids[slot + 1 :]])
        return node

    ends = [folded(at, bad.hex()) for at, bad in enumerate(leaves["tampered"])]
    return pd.DataFrame({
        "doc_id": leaves["doc_id"].to_numpy(), "leaf": own, "subroot": roots[height(size) - len(levels) + 1], "root": root,
        "proof_sha256": [hashlib.sha256(p.encode("ascii")).hexdigest() for p in proofs], "folded_root": ends, "verified": [e == root for e in ends],
    })


def _part(column: Column) -> Column:
    """A value as it enters a leaf: `-` if null, else its length in bytes, a colon, and itself."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, key, leaf, tampered) of each row; ``key`` orders the languages, null first."""
    tampers = id_crc() % 3 == 0
    text = F.col("text").cast("string")
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    head = F.concat(*[_part(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")])
    leaf = lambda body: F.unhex(F.sha2(F.concat(head, _part(body)).cast("binary"), 256))
    key = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("key"), leaf(text).alias("leaf"), F.when(tampers, leaf(lowered)).alias("tampered"))


def placed_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, tampered, tree, size, trees, at) of each row: its tree, and its place in it.

    Digests, not texts, are dealt into ranges; a place is that in the range and the sizes of the language's ranges before.
    Rows alike in everything follow one another, so no key, however hot, must stay together.
    """
    order = ["doc_id", "leaf", "_row"]
    rows = materialise(leaf_digests(docs).withColumn("_row", F.monotonically_increasing_id()), "merkle-digests")  # texts are read once
    dealt = materialise(rows.repartitionByRange("key", *order).withColumn("_part", F.spark_partition_id()), "merkle-leaves")
    ranges = dealt.groupBy("key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    own, whole = Window.partitionBy("key").orderBy("_part"), Window.partitionBy("key")  # a row a range
    ranges = materialise(ranges.withColumns({"_before": F.sum("_n").over(own) - F.col("_n"), "size": F.sum("_n").over(whole)}), "merkle-ranges")
    trees = numbered(ranges.select("key").distinct(), ["key"], "tree")
    known = ranges.join(trees, "key").withColumn("trees", F.lit(trees.count()).cast("bigint")).drop("_n")
    at = F.row_number().over(Window.partitionBy("key", "_part").orderBy(*order)) - 1
    found = dealt.withColumn("_at", at).join(known, ["key", "_part"])
    return found.select("doc_id", "leaf", F.coalesce("tampered", "leaf").alias("tampered"), F.col("tree").cast("bigint"), "size", "trees", (F.col("_at") + F.col("_before")).alias("at"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row for each row of ``docs``.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Tampering lower-cases A-Z of the texts whose identifier's crc32
    three divides (a null identifier counts as the empty text), and the folded root is what such a text's leaf and the original siblings give.
    Nulls are `-` in a leaf; null identifiers come first in their language, as the null language does; rows that repeat an identifier are
    ordered by their digest, and those alike in all follow one another. A long text is one value to the built-in digest. An empty table gives an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    leaves = materialise(placed_leaves(docs), "merkle-placed")
    facts = leaves.agg(F.max("size"), F.max("trees")).first()
    tallest, top = height(facts[0] or 0), height(facts[1] or 0)
    nodes = tree_nodes(leaves, -(-tallest // RISE) + -(-top // RISE) + 2)
    paths = block_paths(nodes, top + max(0, tallest - LOW))
    blocks = leaves.withColumn("block", F.floor(F.col("at") / ARITY**LOW).cast("bigint")).drop("trees")
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocks.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInPandas(_settle, schema)
