"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, rotated by a random orthogonal matrix and kept as one bit a
dimension with two scalars: the distance to the centre and the share of the unit
vector that the bits keep. From these a task estimates every inner product with a
query and an error bound, and reranks exactly the vectors whose lower bound reaches
the query's tenth-best exact distance so far. With the bound at ``EPSILON`` standard
deviations a true neighbour is passed over with negligible probability.

The query set meets all vectors in blocks: a block of queries and a block of vectors
are one unit of work of bounded size, which returns the best few of its own vectors.
Equal vectors are searched once, under their few smallest ids.

Defined results: vectors that are null, zero, or hold null or non-finite components
take no part, nor does a null id; queries meet only vectors of their own length; ties
go to the smaller id; a repeated row is one candidate for each of its rows, and a
query's own id is never a candidate; a query id on several rows asks once, with the
smallest of its vectors; with fewer candidates all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bazaarlens.session import cut_lineage

EPSILON = 5.0
VECTOR_BLOCK = 8_192
QUERY_BLOCK = 2_048
# Queries whose estimates a task holds at once.
QUERY_STEP = 64


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def rotation(dimensions: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(77).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def codes_of(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, distance to the centre, share kept by the bits) of each row."""
    rotated = (vectors - centre) @ rotation(vectors.shape[1])
    norms = np.linalg.norm(rotated, axis=1)
    unit = rotated / np.where(norms == 0, 1, norms)[:, None]
    kept = np.abs(unit).sum(axis=1) / math.sqrt(vectors.shape[1])
    return np.packbits(rotated > 0, axis=1), norms, np.where(norms == 0, 1, kept)


def estimate(bits: np.ndarray, norms: np.ndarray, kept: np.ndarray, queries: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated squared distances (queries x vectors) and their errors at ``EPSILON`` standard deviations."""
    d = queries.shape[1]
    rotated = ((queries - centre) @ rotation(d)).astype(np.float32)
    q_norm = np.linalg.norm(rotated, axis=1)
    signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
    products = (rotated @ signs.T) / math.sqrt(d) * (norms / kept).astype(np.float32)
    lost = np.sqrt(np.maximum(0, 1 - kept**2)) / kept / math.sqrt(max(1, d - 1))
    squared = q_norm[:, None] ** 2 + norms.astype(np.float32) ** 2 - 2 * products
    # The last term covers the rounding of single precision.
    error = 2 * EPSILON * q_norm[:, None] * (norms * lost).astype(np.float32) + 1e-5 * (q_norm[:, None] + norms.astype(np.float32)) ** 2
    return squared, error


def search_block(vectors: np.ndarray, codes: tuple, queries: np.ndarray, centre: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the rows of ``vectors`` that can be among its ``most`` nearest, after reranking."""
    for at in range(0, len(queries), QUERY_STEP):
        some = queries[at : at + QUERY_STEP]
        squared, error = estimate(*codes, some, centre)
        for k, query in enumerate(some):
            near = np.argpartition(squared[k], most - 1)[:most] if len(vectors) > most else np.arange(len(vectors))
            worst = ((vectors[near] - query) ** 2).sum(axis=1).max()
            chosen = np.flatnonzero(squared[k] - error[k] <= worst)
            exact = ((vectors[chosen] - query) ** 2).sum(axis=1)
            if len(chosen) > most:
                # A hair of room, so that the order of summing decides no tie here.
                limit = np.partition(exact, most - 1)[most - 1]
                chosen = chosen[exact <= limit * (1 + 1e-9)]
            yield at + k, chosen


def nearest(vectors: DataFrame, is_query: Column, most: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``most`` nearest vectors of each query; ``vectors`` has vec_id and vector.

    score is the Euclidean distance in double precision, its squares summed in the order of the components.
    """
    rows = vectors.select("vec_id", F.col("vector").cast("array<double>").alias("vector"), is_query.alias("is_query"))
    rows = cut_lineage(rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))))
    # Of equal vectors the ``most`` + 1 smallest ids (one may be the query's own); Spark limits before its shuffle.
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    classes = (
        rows.select("vec_id", "vector")
        .withColumn("at", F.row_number().over(smallest))
        .where(F.col("at") <= most + 1)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("size", F.size("vector"))
    )
    classes = cut_lineage(classes)
    centres = {
        r["size"]: np.array([x for _, x in sorted(r["centre"])])
        for r in classes.select("size", F.posexplode("vector"))
        .groupBy("size", "pos")
        .agg(F.avg("col").alias("mean"))
        .groupBy("size")
        .agg(F.collect_list(F.struct("pos", "mean")).alias("centre"))
        .collect()
    }
    counts = {r["size"]: r["n"] for r in classes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    queries = rows.where("is_query").groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("size", F.size("vector"))
    asked = {r["size"]: r["n"] for r in queries.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = F.create_map(*[F.lit(x) for s, n in counts.items() for x in (s, -(-n // VECTOR_BLOCK))]) if counts else None
    if blocks is None or not asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    query_blocks = F.create_map(*[F.lit(x) for s, n in asked.items() for x in (s, -(-n // QUERY_BLOCK))])
    placed = classes.withColumn("block", F.pmod(F.xxhash64("vector"), blocks[F.col("size")])).where(query_blocks[F.col("size")].isNotNull())
    placed = placed.withColumn("query_block", F.explode(F.sequence(F.lit(0), query_blocks[F.col("size")] - 1)))
    sent = queries.withColumn("query_block", F.pmod(F.xxhash64("vec_id"), query_blocks[F.col("size")]).cast("int"))
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (blocks[F.col("size")] - 1).cast("long"))))
    key = ["size", "query_block", "block"]

    def work(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "query": pa.array([], pa.list_(pa.float64())), "vector": pa.array([], pa.list_(pa.float64())), "ids": pa.array([], pa.list_(pa.int64()))})
        size = held.column("size")[0].as_py()
        flat = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        vectors, queries, centre = flat(held.column("vector")), flat(asked.column("vector")), centres[size]
        found = list(search_block(vectors, codes_of(vectors, centre), queries, centre, most + 1))
        which = np.repeat([k for k, _ in found], [len(c) for _, c in found]).astype(np.int64)
        chosen = np.concatenate([c for _, c in found])
        return pa.table(
            {
                "query_id": asked.column("vec_id").take(pa.array(which)),
                "query": asked.column("vector").take(pa.array(which)),
                "vector": held.column("vector").take(pa.array(chosen)),
                "ids": held.column("ids").take(pa.array(chosen)),
            }
        )

    found = (
        sent.groupBy(*key)
        .cogroup(placed.groupBy(*key))
        .applyInArrow(work, "query_id long, query array<double>, vector array<double>, ids array<long>")
    )
    squares = F.zip_with("query", "vector", lambda x, y: (x - y) * (x - y))
    score = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.select("query_id", score.alias("score"), F.explode("ids").alias("vec_id"))
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= most)
        .select("query_id", "rank", "vec_id", "score")
    )
