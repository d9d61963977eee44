import random
import zlib

from bazaar.llm.sharding import choose_splitters, range_of, shard_by_bytes

from .data import odd_rows, prose, row, table

import numpy as np


def test_range_of_counts_splitters():
    rng = random.Random(1)
    cuts = sorted({(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(12)})
    keys, ids = np.array([rng.randint(-1, 11) for _ in range(300)]), np.array([rng.randint(-1, 11) for _ in range(300)])
    got = range_of(keys, ids, cuts)
    assert got.tolist() == [sum(c <= (k, i) for c in cuts) for k, i in zip(keys.tolist(), ids.tolist())]


def test_splitters_cut_inside_hot_keys_only():
    cuts = choose_splitters([(k, i, 1.0) for k in range(100) for i in range(900 if k == 50 else 1)], 10.0)
    inside = [c for c in cuts if abs(c[1]) < 1 << 62]
    assert inside and {k for k, _ in inside} == {50}


def check(rows, got, shards):
    assert len(got) == len(rows)
    raw = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == raw
    assert {r.law for r in got} <= {"bytes"} and {r.grown_shard for r in got} <= {None}
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


def test_near_equal_bytes_with_a_hot_text(spark):
    rng = random.Random(2)
    rows = [row(i, prose(rng, rng.randint(1, 120))) for i in range(1500)]
    rows += [row(5000 + i, rows[0][1]) for i in range(900)]
    got = shard_by_bytes(table(spark, rows)).collect()
    check(rows, got, 16)
    load = [sum(r.size for r in got if r.shard == s) for s in range(16)]
    assert max(load) < 1.1 * sum(load) / 16 and min(load) > .9 * sum(load) / 16
    again = shard_by_bytes(table(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in again)


def test_copies_share_a_shard(spark):
    rng = random.Random(3)
    texts = [prose(rng, 60) for _ in range(600)]
    rows = [row(i, texts[i % 600]) for i in range(1800)]
    got = shard_by_bytes(table(spark, rows), ranges_per_shard=4).collect()
    check(rows, got, 16)
    where = {}
    for r in got:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 16


def test_odd_rows_and_empty(spark):
    rows = odd_rows()
    check(rows, shard_by_bytes(table(spark, rows)).collect(), 16)
    assert shard_by_bytes(table(spark, [])).count() == 0
