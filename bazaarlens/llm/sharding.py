"""Sharding: best-fit-decreasing packing of indivisible groups into bins of one fixed capacity.

Groups of equal texts stay together. Spark sizes all groups and counts them by size.
Groups of one size are interchangeable, so the packing sees only (size, number of
groups): a run of one size goes into the tightest bin that takes it, as many as fit, then
into the next. This equals best fit of the groups one by one. Every group is packed by its own
size, at every size of the input; the driver holds one row for each *different* size, which are
at most sqrt(2 x bytes) and in practice no more than there are lengths of texts. Groups are dealt to the runs by
their rank within their size.

``shard_documents`` fills a given number of shards evenly; ``shard_by_capacity`` opens as few shards of a
given capacity as best fit needs.

Defined results: null text counts as empty (size is the overhead alone) and groups
with it; a repeated row gets a slot of its own; groups of one size are ranked by hash
of the text; no rows give no rows; a group larger than a fair share (or the capacity) has a
shard of its own; a null doc_id is a value like any other, ordered first.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bazaarlens.session import cut_lineage

# Capacities are tried in steps of the fair share by this.
GRID = 10_000
# Rows or groups that are numbered by one task, about.
NUMBERED_ROWS = 100_000


class BalancedBins:
    """Bins by remaining room in an AVL tree, for the tightest bin that still takes an item."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, left, right, height], key = (room, bin)

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._add(self.root, key)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns the smallest (room, bin) with room of ``least`` or more."""
        found, node = None, self.root
        while node:
            if node[0][0] >= least:
                found, node = node[0], node[1]
            else:
                node = node[2]
        if found is not None:
            self.root = self._drop(self.root, found)
        return found

    @staticmethod
    def _height(node) -> int:
        return node[3] if node else 0

    def _even(self, node):
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        lean = self._height(node[1]) - self._height(node[2])
        if lean > 1:
            if self._height(node[1][1]) < self._height(node[1][2]):
                node[1] = self._turn(node[1], 2)
            return self._turn(node, 1)
        if lean < -1:
            if self._height(node[2][2]) < self._height(node[2][1]):
                node[2] = self._turn(node[2], 1)
            return self._turn(node, 2)
        return node

    def _turn(self, node, side: int):
        """Lifts the child on ``side`` (1 left, 2 right) above ``node``."""
        up, other = node[side], 3 - side
        node[side], up[other] = up[other], node
        for x in (node, up):
            x[3] = 1 + max(self._height(x[1]), self._height(x[2]))
        return up

    def _add(self, node, key):
        if node is None:
            return [key, None, None, 1]
        side = 1 if key < node[0] else 2
        node[side] = self._add(node[side], key)
        return self._even(node)

    def _drop(self, node, key):
        if key == node[0]:
            if not node[1] or not node[2]:
                return node[1] or node[2]
            least = node[2]
            while least[1]:
                least = least[1]
            node[0], node[2] = least[0], self._drop(node[2], least[0])
        else:
            side = 1 if key < node[0] else 2
            node[side] = self._drop(node[side], key)
        return self._even(node)


Runs = dict[int, list[tuple[int, int]]]


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int]], int]:
    """((size, bin, groups), ...) and the number of bins for ``sizes``, pairs (size, groups) in falling order of size.

    A new bin opens where no open one has room. The tightest bin that takes one group of a run stays the
    tightest until it takes no more, so a run enters it at once. A size above ``capacity`` fills a bin by itself.
    """
    bins, placed, opened = BalancedBins(), [], 0
    for size, groups in sizes:
        while groups:
            found = bins.take(size)
            if found is None:
                found, opened = (max(size, capacity), opened), opened + 1
            fits = min(groups, found[0] // size) if size else groups
            bins.add((found[0] - fits * size, found[1]))
            placed.append((size, found[1], fits))
            groups -= fits
    return placed, opened


def pack(sizes: list[tuple[int, int]], shards: int) -> Runs:
    """For each size of ``sizes`` (size, groups) its runs (shard, groups), at the smallest capacity found at which best fit
    needs ``shards`` bins or fewer.

    Groups above the fair share of what is left are set alone first. The capacity is sought between the fair share and
    the fair share plus the largest group, at which best fit always does with the bins there are: in doubling steps, then by halving.
    """
    sizes = sorted(((s, n) for s, n in sizes if n), reverse=True)
    runs: Runs = {s: [] for s, _ in sizes}
    total, free = sum(s * n for s, n in sizes), shards
    while free > 1 and sizes and sizes[0][0] * free > total:
        size, groups = sizes[0]
        runs[size].append((shards - free, 1))
        total, free = total - size, free - 1
        sizes[:1] = [(size, groups - 1)] if groups > 1 else []
    if not sizes:
        return runs
    low = max(sizes[0][0], -(-total // free))
    tried = range(low, low + sizes[0][0], 1 + low // GRID)
    fits = lambda capacity: best_fit_decreasing(sizes, capacity)[1] <= free
    bound, failed = 0, -1
    while bound < len(tried) and not fits(tried[bound]):
        failed, bound = bound, 2 * bound + 1
    at = bisect.bisect_left(tried, True, failed + 1, min(bound, len(tried)), key=fits)
    for size, n, groups in best_fit_decreasing(sizes, tried[at] if at < len(tried) else low + sizes[0][0])[0]:
        runs[size].append((shards - free + n, groups))
    return runs


def pack_by_capacity(sizes: list[tuple[int, int]], capacity: int) -> Runs:
    """For each size of ``sizes`` (size, groups) its runs (shard, groups), in bins of ``capacity``."""
    sizes = sorted(((s, n) for s, n in sizes if n), reverse=True)
    runs: Runs = {s: [] for s, _ in sizes}
    for size, n, groups in best_fit_decreasing(sizes, capacity)[0]:
        runs[size].append((n, groups))
    return runs


def size_of(text: Column, overhead: int) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + overhead).cast("long")


def ranked(df: DataFrame, key: str, order: list[str], rows: int) -> DataFrame:
    """``df`` with _rank (long, from 0) within ``key``. A key is numbered in parts, so that a frequent one is not one task's work.

    ``order`` must tell the rows of ``df`` apart and ``df`` must be a written table, as it is read twice.
    """
    parts = max(1, -(-rows // NUMBERED_ROWS))
    df = df.withColumn("_part", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(parts)))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(key, "_part").orderBy(*order)
    return (
        df.withColumn("_at", F.row_number().over(inside) - 1)
        .join(offsets, [key, "_part"])
        .withColumn("_rank", (F.col("_offset") + F.col("_at")).cast("long"))
        .drop("_part", "_at", "_offset")
    )


def shard_documents(docs: DataFrame, shards: int, overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, group, shard and slot (from 0, without gaps) of every row, in ``shards`` even shards."""
    return _sharded(docs, overhead, lambda sizes: pack(sizes, shards))


def shard_by_capacity(docs: DataFrame, capacity: int, overhead: int = 8) -> DataFrame:
    """Like ``shard_documents``, in as few shards of at most ``capacity`` bytes as best fit needs."""
    return _sharded(docs, overhead, lambda sizes: pack_by_capacity(sizes, capacity))


def _sharded(docs: DataFrame, overhead: int, packed: Callable[[list[tuple[int, int]]], Runs]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        size_of(F.col("text"), overhead).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
    )
    # Written once without the texts; the number of a row tells repeated rows apart.
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    groups = cut_lineage(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    histogram = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n")).collect()
    runs = packed([(r["bytes"], r["groups"]) for r in histogram])
    # Of each size: the shards of its runs, and the ranks at which they end.
    placed = docs.sparkSession.createDataFrame(
        [(size, [s for s, _ in own], list(accumulate(n for _, n in own))) for size, own in runs.items()],
        "bytes long, shards array<int>, ends array<long>",
    )
    run = F.size(F.filter("ends", lambda end: end <= F.col("_rank")))
    groups = ranked(groups.select("group", "bytes"), "bytes", ["group"], sum(r["groups"] for r in histogram))
    groups = groups.join(placed, "bytes").select("group", F.col("shards")[run].alias("shard"))
    rows = cut_lineage(rows.join(groups, "group"))
    done = ranked(rows, "shard", ["doc_id", "_row"], sum(r["n"] for r in histogram))
    return done.select("doc_id", "size", "text_crc32", "group", "shard", F.col("_rank").alias("slot"))
