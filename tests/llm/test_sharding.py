from __future__ import annotations

import random
import zlib

from sourceweave.llm import sharding
from tests.llm.conftest import documents, words


def check(spark, rows):
    found = sharding.assign(documents(spark, rows).repartition(3)).collect()
    assert len(found) == len(rows)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    ordered = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows), key=key)
    total, at, slots, want = sum(s for _, s, _ in ordered), 0, {}, []
    for doc, size, crc in ordered:
        shard = (2 * at + size) * 16 // (2 * total)
        at += size
        want.append((doc, size, crc, "bytes", shard, slots.get(shard, 0), None))
        slots[shard] = slots.get(shard, 0) + 1
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_shards(spark, edge_rows):
    rng = random.Random(1)
    check(spark, edge_rows)
    check(spark, [(i, words(rng, rng.randint(0, 50))) for i in range(400)])
    check(spark, [(7, "same")] * 50)
    check(spark, [(1, None)])
    assert sharding.assign(documents(spark, [])).count() == 0


def test_bytes_are_near_equal(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 200)) for i in range(1000)]
    sizes = [0] * 16
    for r in sharding.assign(documents(spark, rows)).collect():
        sizes[r.shard] += r.size
    assert max(sizes) - min(sizes) <= 2 * 201


def test_write(spark, tmp_path):
    sharding.write_shards(documents(spark, [(i, "t" * i) for i in range(64)]), str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 64 and back.select("shard").distinct().count() == 4
