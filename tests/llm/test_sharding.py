"""Sharding: the tree against a linear scan, runs against single groups, the law of even sizes, gapless slots, edges."""

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import sharding as s
from bazaarlens.llm.queries import SHARDS, op7_sharding
from conftest import DATA


def best_fit_one_by_one(sizes, capacity):
    """Room left in each bin, by a linear scan for the tightest bin (ties: the first)."""
    rooms = []
    for size in sizes:
        open_bins = [(room, n) for n, room in enumerate(rooms) if room >= size]
        if open_bins:
            rooms[min(open_bins)[1]] -= size
        else:
            rooms.append(max(capacity, size) - size)
    return rooms


@pytest.mark.parametrize("seed", range(30))
def test_runs_equal_single_groups(seed):
    rng = random.Random(seed)
    capacity = rng.randint(20, 300)
    counts = {rng.randint(1, capacity + 5): rng.randint(1, 9) for _ in range(rng.randint(1, 40))}
    sizes = sorted(counts.items(), reverse=True)
    placed, opened = s.best_fit_decreasing(sizes, capacity)
    loads, groups = defaultdict(int), defaultdict(int)
    for size, bin_, n in placed:
        loads[bin_] += size * n
        groups[size] += n
    rooms = best_fit_one_by_one([x for x, n in sizes for _ in range(n)], capacity)
    assert dict(groups) == counts and opened == len(rooms) == len(loads)
    # Loads of bins are alike, bin by bin: both open bins in the same order.
    room = {n: max(capacity, max(size for size, b, _ in placed if b == n)) for n in loads}
    assert [room[n] - loads[n] for n in range(opened)] == rooms
    assert all(load <= max(capacity, max(counts)) for load in loads.values())


def test_tree_is_balanced_and_takes_the_tightest():
    rng, bins, plain = random.Random(3), s.BalancedBins(), []
    for n in range(3000):
        if rng.random() < 0.6 or not plain:
            key = (rng.randint(0, 500), n)
            bins.add(key)
            plain.append(key)
        else:
            least = rng.randint(0, 520)
            want = min((k for k in plain if k[0] >= least), default=None)
            assert bins.take(least) == want
            if want:
                plain.remove(want)
    assert bins.root is None or bins.root[3] <= 1.45 * (len(plain) + 2).bit_length()


@pytest.mark.parametrize("seed", range(10))
def test_pack_is_even(seed):
    rng = random.Random(seed)
    sizes = [(size, rng.randint(1, 30)) for size in rng.sample(range(8, 4000), 200)]
    runs = s.pack(sizes, 24)
    loads = defaultdict(int)
    for size, own in runs.items():
        for shard, n in own:
            loads[shard] += size * n
    assert {size: sum(n for _, n in own) for size, own in runs.items()} == dict(sizes)
    assert set(loads) == set(range(24))
    assert max(loads.values()) <= 1.01 * sum(loads.values()) / 24


def test_giant_and_few_groups():
    assert s.pack([(1000, 1), (1, 3)], 4)[1000] == [(0, 1)]
    assert sorted(shard for own in s.pack([(5, 1), (4, 1)], 24).values() for shard, _ in own) == [0, 1]
    assert s.pack([], 24) == {} == s.pack_by_capacity([], 10)
    assert s.pack([(7, 5)], 1) == {7: [(0, 5)]}


def test_query(spark):
    folder = f"{DATA}/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op7_sharding(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    slots, loads, shard_of = defaultdict(list), defaultdict(int), {}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
        assert shard_of.setdefault(data, r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(SHARDS))
    assert max(loads.values()) <= 1.02 * max(sum(loads.values()) / SHARDS, max(len(t.encode()) for t in texts.values()))


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(s, "NUMBERED_ROWS", 3)  # several parts a shard
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, None), (3, ""), (4, "ab"), (5, "é"), (6, "x" * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(9)).withColumn("bytes", F.lit(1))
    for done in (s.shard_documents(df, 3).collect(), s.shard_by_capacity(df, 40).collect()):
        assert len(done) == len(rows)
        slots = defaultdict(list)
        for r in done:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        assert len({r["shard"] for r in done if r["text_crc32"] == zlib.crc32(b"a")}) == 1
        assert len({r["shard"] for r in done if r["doc_id"] in (2, 3)}) == 1
        big = next(r["shard"] for r in done if r["doc_id"] == 6)
        assert slots[big] == [0]
    assert s.shard_documents(df.limit(0), 3).count() == 0
