"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets confirm them.

1. Every text gets a MinHash signature of ``bands x rows`` values; the two numbers
   come from the threshold and the target recall. Equal texts become one class.
2. Classes are shuffled on their band hashes. A bucket is streamed: a member meets
   only the bucket's leaders, so a bucket of near copies costs about as much as it
   has members. A member that agrees with a leader in ``JOIN_SHARE`` of the signature
   follows it; others become leaders, and leaders above ``LEADER_SHARE`` are tied, by
   no more edges than members. By
   the triangle inequality of the Jaccard distance (0.1 + 0.2 + 0.1 for the threshold
   0.8, and some for the error of signatures) every similar pair that shares a bucket
   ends up tied.
3. Tied classes form candidate components. Each class's set of n-grams goes to its
   component once; components of many classes are split in blocks, every pair of
   blocks is one unit of work. There, all pairs are compared on full sets; only counts
   of links and a spanning forest of them leave the task.

Defined results: words are runs of letters and digits in lower case; a text of fewer
words than ``n`` has one n-gram of all of them; a text without words is similar only
to equal texts. Rows with a null text or null doc_id take no part: their class is
their own id and they have no links. Repeated rows are copies; two texts under one
doc_id belong to one class. The class id is the smallest doc_id of the component of
links, and a document's links are all other rows with an equal or similar text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.components import components
from bazaarlens.llm.tables import small_enough
from bazaarlens.llm.words import flat_bytes, slices, split_words, texts_of
from bazaarlens.session import cut_lineage

NGRAM = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
# Most values of a signature; the longest bands that reach the recall within it are taken.
SIGNATURE = 128
JOIN_SHARE = 0.92
LEADER_SHARE = 0.5
# Classes of a component that one unit of work holds twice.
BLOCK = 512
# Up to so many ids are sent to every task; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
NO_WORD = r"[^\pL\pN]+"


def choose_bands(threshold: float, recall: float, most: int = SIGNATURE) -> tuple[int, int]:
    """(bands, rows): the most rows for which bands enough for the recall at the threshold fit in ``most`` values."""
    for rows in range(most, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            return bands, rows
    raise ValueError(f"no bands of at most {most} values reach a recall of {recall} at {threshold}")


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each (non-empty) word: a polynomial of its bytes, mixed."""
    data, bounds = flat_bytes(words)
    if not len(words):
        return np.zeros(0, np.uint64)
    lengths = np.diff(bounds)
    place = np.arange(len(data)) - np.repeat(bounds[:-1], lengths)
    powers = np.cumprod(np.full(int(lengths.max()), 0xD6E8FEB86659FD93, np.uint64))
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers[place]
    return mix(np.add.reduceat(terms, bounds[:-1]) + lengths.astype(np.uint64))


def ngrams(texts: pa.Array, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every n-gram of every text, offsets by text)."""
    words = split_words(pc.utf8_lower(texts), NO_WORD)
    counts = np.diff(words.offsets)
    # Short texts: blanks after the last word make up for the missing ones, as hash 0.
    padded = np.where(counts > 0, np.maximum(counts, n), 0)
    starts = np.concatenate([[0], np.cumsum(padded)])
    h = np.zeros(starts[-1], np.uint64)
    place = np.arange(len(words.codes)) - np.repeat(words.offsets[:-1], counts) + np.repeat(starts[:-1], counts)
    h[place] = hash_words(words.distinct)[words.codes]
    made = np.maximum(padded - n + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(made)])
    first = np.arange(offsets[-1]) - np.repeat(offsets[:-1], made) + np.repeat(starts[:-1], made)
    code = np.zeros(len(first), np.uint64)
    for k in range(n):
        code = code * np.uint64(0xA24BAED4963EE407) + h[first + k]
    return mix(code), offsets


def signatures(codes: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """MinHash signatures (texts x size) of the non-empty texts."""
    multipliers = np.random.default_rng(2024).integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), size), np.uint64)
    for k, m in enumerate(multipliers):
        out[:, k] = np.minimum.reduceat((codes ^ m) * m, starts) if len(starts) else 0
    return out


def sign(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, bands, signature): key of the text, one hash per band, one byte per signature value; none for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                codes, offsets = ngrams(texts_of(batch, "text"), n)
                values = signatures(codes, offsets, bands * rows)
                full = np.diff(offsets) > 0
                hashes = np.zeros((len(values), bands), np.uint64)
                for k in range(rows):
                    hashes = hashes * np.uint64(0x9FB21C651E98DF25) + mix(values[:, k::rows])
                hashes = mix(hashes).view(np.int64)
                low = mix(values).astype(np.uint8)
                at = np.where(full, np.cumsum(full) - 1, -1)
                ends = np.concatenate([[0], np.cumsum(full)])
                band_lists = pa.ListArray.from_arrays(pa.array((ends * bands).astype(np.int32)), pa.array(hashes.ravel()))
                signed = pa.array([low[i].tobytes() if i >= 0 else None for i in at.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("key"), band_lists, signed], ["doc_id", "key", "bands", "signature"]
                )

    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", F.unhex(F.md5("text")).alias("key"), "text")
    return keyed.mapInArrow(run, "doc_id long, key binary, bands array<long>, signature binary")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, starts, whether each run goes on from the batch before) of rows with equal keys, for sorted input."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        goes_on = np.zeros(len(starts), bool)
        goes_on[0] = last == tuple(c[0] for c in columns)
        last = tuple(c[-1] for c in columns)
        yield batch, starts, goes_on


def tie(buckets: DataFrame, size: int) -> DataFrame:
    """Edges (a, b) among the members (rep, signature) of each bucket (band, hash), which is streamed in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders, ids = np.zeros((0, size), np.uint8), []
        tree = np.zeros(0, np.int64)  # the tree of edges that each leader is in
        held = 0
        for batch, starts, goes_on in runs(batches, ["band", "hash"]):
            reps = batch.column("rep").to_pylist()
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(-1, size)
            edges = []
            for start, stop, same in zip(starts.tolist(), [*starts[1:].tolist(), len(reps)], goes_on.tolist()):
                if not same:
                    held, ids = 0, []
                for i in range(start, stop):
                    if held:
                        share = (leaders[:held] == values[i]).mean(axis=1)
                        best = int(share.argmax())
                        if share[best] >= JOIN_SHARE:
                            edges.append((reps[i], ids[best]))
                            continue
                    if held == len(leaders):
                        leaders = np.concatenate([leaders, np.zeros((max(16, held), size), np.uint8)])
                        tree = np.concatenate([tree, np.zeros(max(16, held), np.int64)])
                    leaders[held], tree[held] = values[i], held
                    if held:
                        # One edge to each tree that it is near to; these are then one tree.
                        near = np.flatnonzero(share >= LEADER_SHARE)
                        trees, first = np.unique(tree[near], return_index=True)
                        edges += [(reps[i], ids[k]) for k in near[first].tolist()]
                        tree[:held][np.isin(tree[:held], trees)] = held
                    ids.append(reps[i])
                    held += 1
            a, b = zip(*edges) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long").distinct()


def ngram_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, key, grams): the sorted distinct n-gram hashes of each text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                codes, offsets = ngrams(texts_of(batch, "text"), n)
                grams = [np.unique(codes[a:b]).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("key"), pa.array(grams, pa.binary())], ["doc_id", "key", "grams"]
                )

    return docs.mapInArrow(run, "doc_id long, key binary, grams binary")


def shared_grams(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right``, by products of 0/1 matrices of ``width`` n-grams."""
    sets = left + right
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = seen[column] > 1  # an n-gram of one set only is in no intersection
    owner, column = owner[kept], (np.cumsum(seen > 1) - 1)[column[kept]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int((seen > 1).sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[a:b], column[a:b] - at] = 1
        out += block[: len(left)] @ block[len(left) :].T
    return out


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs (a, b)."""
    parent = list(range(size))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def confirm(units: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links) from units of work (component, i, j) with rows (block, rep, copies, grams) sorted by unit.

    A row with b null adds ``links`` to the links of a; one with b is an edge of the forest.
    """

    def work(rows: list[tuple]) -> tuple[list, list, list]:
        i, j = rows[0][0], rows[0][1]
        left = [r for r in rows if r[2] == i]
        right = left if i == j else [r for r in rows if r[2] == j]
        if not left or not right:
            return [], [], []
        grams = lambda side: [np.frombuffer(r[5], np.uint64) for r in side]
        l, r = grams(left), grams(right)
        both = shared_grams(l, r)
        sizes = lambda side: np.array([len(s) for s in side], np.float32)
        union = sizes(l)[:, None] + sizes(r)[None, :] - both
        # In whole numbers: both / union >= threshold without a rounded quotient.
        linked = both.astype(np.float64) * 1e6 >= round(threshold * 1e6) * union.astype(np.float64)
        if i == j:
            np.fill_diagonal(linked, False)
        copies = lambda side: np.array([x[4] for x in side], np.int64)
        reps = lambda side: [x[3] for x in side]
        a, b, links = [], [], []
        for side, other, table in ((left, right, linked), (right, left, linked.T)) if i != j else ((left, left, linked),):
            for rep, count in zip(reps(side), (table @ copies(other)).tolist()):
                if count:
                    a.append(rep), b.append(None), links.append(count)
        x, y = np.nonzero(np.triu(linked) if i == j else linked)
        for p, q in _forest(x, y + (0 if i == j else len(left)), len(left) + len(right)):
            a.append(left[p][3]), b.append((right[q - len(left)] if i != j else left[q])[3]), links.append(0)
        return a, b, links

    def batch_of(done: tuple[list, list, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in done], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch, starts, goes_on in runs(batches, ["component", "i", "j"]):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("i", "j", "block", "rep", "copies", "grams"))))
            for start, stop, same in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], goes_on.tolist()):
                if held and not same:
                    yield batch_of(work(held))
                    held = []
                held += rows[start:stop]
        if held:
            yield batch_of(work(held))

    return units.mapInArrow(run, "a long, b long, links long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bands, rows = choose_bands(threshold, recall)
    signed = cut_lineage(sign(docs, n, bands, rows))
    # One class for each text; min keeps map-side partial sums for a text with a third of all rows.
    classes = cut_lineage(
        signed.groupBy("key").agg(
            F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")
        )
    )
    leads = signed.join(classes, ["key"]).where("doc_id = rep").select("rep", "bands", "signature").distinct()
    # One task for each band hash: singles are dropped before any signature moves.
    members = cut_lineage(leads)
    hashes = members.select("rep", F.posexplode("bands").alias("band", "hash"))
    full = hashes.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "hash")
    met = hashes.join(full, ["band", "hash"], "left_semi").join(members.select("rep", "signature"), "rep")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = met.repartition(parts, "band", "hash").sortWithinPartitions("band", "hash", "rep").select("band", "hash", "rep", "signature")
    tied = components(tie(buckets, bands * rows))
    tied = cut_lineage(tied.withColumnsRenamed({"node": "rep"}))
    # Places of classes in blocks: by hash, as many blocks as the component's size asks for.
    sizes = tied.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = tied.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    wanted = placed.join(classes, "rep")
    texts = docs.where("doc_id is not null and text is not null").withColumn("key", F.unhex(F.md5("text")))
    ids = wanted.select("key", F.col("rep").alias("doc_id"))
    if small_enough(ids, BROADCAST_ROWS):
        ids = F.broadcast(ids)
    # Repeated rows of the leading document give one set.
    grams = ngram_sets(texts.join(ids, ["doc_id", "key"], "left_semi"), n).groupBy("doc_id", "key").agg(F.first("grams").alias("grams"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = (
        wanted.join(grams.withColumnsRenamed({"doc_id": "rep"}), ["rep", "key"])
        .select("component", "block", "rep", "copies", "grams", other.alias("other"))
        .select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "copies", "grams")
        .repartition(parts, "component", "i", "j")
        .sortWithinPartitions("component", "i", "j", "rep")
    )
    confirmed = cut_lineage(confirm(units, threshold))
    linked = components(confirmed.where("b is not null").select("a", "b"))
    links = confirmed.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    classes = (
        classes.join(links, "rep", "left")
        .join(linked.withColumnsRenamed({"node": "rep", "component": "class_id"}), "rep", "left")
        .select("key", F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    known = signed.select("doc_id", "key").join(classes, "key").select("doc_id", "class_id", "n_links")
    apart = docs.where("doc_id is null or text is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(apart)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest doc_id, once. Rows that take no part stay."""
    found = near_duplicates(docs, threshold)
    first = cut_lineage(found.where("doc_id = class_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")))
    ids = first.select("doc_id")
    if small_enough(ids, BROADCAST_ROWS):
        ids = F.broadcast(ids)
    # A semi-join by name adds no column that could clash with one of ``docs``.
    kept = docs.where("doc_id is not null and text is not null").join(ids, "doc_id", "left_semi").select(*docs.columns)
    if not first.where("rows > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null or text is null"))
