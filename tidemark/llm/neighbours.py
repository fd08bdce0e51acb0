"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``PREFIX`` nearest of ``PIVOTS`` pivots, in order. The index is dealt in blocks of rows; a block posts
each row in the inverted files of its pivots, with the pivot's place. A query reads only the files of its own pivots: a row that
both have at places ``a`` and ``b`` of ``L`` gains ``2 (L + 1 - max(a, b))`` against the footrule distance of two prefixes without a
common pivot, so adding up the gains ranks a block's rows by footrule distance. The best ``SHARE`` of a block (``LEAST`` at least) are
reranked by their exact inner products, and the ``k`` best of a query over all blocks are its answer. As every block gives the same
share of its rows, recall doesn't fall as the table grows.

Largest inner product is turned into nearest by angle: with ``M`` the largest norm, a row gets one more coordinate
``sqrt(M^2 - |x|^2)`` and a query 0 there; all rows then have one norm. Pivots are rows of the table, chosen by hash.

Equal vectors are one row of the index that keeps its ``k + 1`` smallest ids, enough for any query's first ``k`` besides itself;
equal query vectors are searched once. So copies of one vector cost nothing and lose nothing.

Defined cases: vectors that are null, zero or hold null or non-finite components, ids that are null, and vectors of another length
than the commonest (ties: the shorter) take no part; of rows with one id, that with the smallest vector takes part; a table
without usable rows gives no rows. Other columns take no part. Queries and rows are matched in blocks, all blocks of queries with
all blocks of rows, so work grows with queries times rows; a vector is shuffled once for each block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ShortType, StructField, StructType
from pyspark.sql.window import Window as W

from .shared import Scratch

#: Pivots, at most this many rows, chosen by hash; and how many a vector is represented by, 255 at most.
PIVOTS, PREFIX = 512, 96
#: Share of a block that is reranked, and the least number of rows.
SHARE, LEAST = 0.15, 400
#: Rows of an index block and of a query block.
BLOCK, QUERIES = 8192, 8192
SEED = 1


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, x): one row an id, vectors of the commonest length with finite components that aren't all zero."""
    x = F.col(vector).cast("array<double>")
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    fine = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(x, number) & F.exists(x, lambda v: v != 0)
    rows = vectors.where(fine).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x"))
    common = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("x") == (common["n"] if common else 0))
    return rows.groupBy("id").agg(F.min("x").alias("x"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(x, ids): each vector with its ``k`` smallest ids; a task sends on no more of a vector than that."""
    w = W.partitionBy("x").orderBy("id")
    first = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return first.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Pivots:
    """The pivots, lifted by the coordinate that makes norms equal, and the largest norm."""

    def __init__(self, vectors: DataFrame, n: int, seed: int) -> None:
        norm = F.sqrt(F.aggregate(F.col("x").cast("array<double>"), F.lit(0.0), lambda a, v: a + v * v))
        self.top = vectors.agg(F.max(norm)).first()[0]
        drawn = vectors.orderBy(F.xxhash64(F.lit(seed), "x"), F.get("ids", F.lit(0))).limit(n).select("x").collect()
        self.x = self.lifted(np.array([r["x"] for r in drawn], dtype=np.float64))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top**2 - (x * x).sum(axis=1), 0))
        return np.hstack([x, rest[:, None]])


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each row's nearest pivots, nearest first."""
    near = -(x @ pivots.T)
    if prefix < len(pivots):
        top = np.argpartition(near, prefix, axis=1)[:, :prefix]
        near = np.take_along_axis(near, top, axis=1)
        return np.take_along_axis(top, np.argsort(near, axis=1, kind="stable"), axis=1).astype(np.int16)
    return np.argsort(near, axis=1, kind="stable").astype(np.int16)


def represented(vectors: DataFrame, pivots: Pivots, prefix: int, query: bool) -> DataFrame:
    """``vectors`` with ``order``: the numbers of the nearest pivots, nearest first. A query has 0 in the added coordinate."""
    prefix = min(prefix, len(pivots.x))
    schema = StructType([*vectors.schema.fields, StructField("order", ArrayType(ShortType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            x = np.hstack([x, np.zeros((len(x), 1))]) if query else pivots.lifted(x)
            order = nearest_pivots(x, pivots.x, prefix)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * prefix)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(order.ravel()))], names=[*batch.schema.names, "order"])

    return vectors.mapInArrow(run, schema)


class Files:
    """The inverted files of a block: for each pivot what its place in each row is worth (L at the first, 1 at the last, 0 where the row
    isn't posted). With a fifth of the rows posted, a byte a row is smaller than a list of rows."""

    def __init__(self, order: np.ndarray, n_pivots: int) -> None:
        n, self.prefix = order.shape
        self.worth = np.zeros((n_pivots, n), dtype=np.uint8)
        for place in range(self.prefix):
            self.worth[order[:, place], np.arange(n)] = self.prefix - place

    def gains(self, order: np.ndarray) -> np.ndarray:
        """Half of each row's gain against the footrule distance of prefixes without a common pivot."""
        own = np.arange(self.prefix, 0, -1, dtype=np.uint8)
        return np.minimum(self.worth[order], own[:, None]).sum(axis=0, dtype=np.uint16)


def _orders(column: pa.ChunkedArray) -> np.ndarray:
    c = column.combine_chunks()
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def _search_block(rows: pa.Table, asked: pa.Table, n_pivots: int, k: int, share: float, least: int) -> pa.Table:
    """(q, score, ids) of the ``k`` best rows of a block for each of the queries."""
    found: dict[str, list] = {"q": [], "score": [], "ids": []}
    ids = rows["ids"].combine_chunks() if rows.num_rows else None
    if rows.num_rows and asked.num_rows:
        x, y = _matrix(rows["x"].combine_chunks()), _matrix(asked["x"].combine_chunks())
        files, take = Files(_orders(rows["order"]), n_pivots), min(rows.num_rows, max(least, k, int(share * rows.num_rows)))
        for q, v, order in zip(asked["q"].to_pylist(), y, _orders(asked["order"])):
            gains = files.gains(order)
            near = np.argpartition(-gains.astype(np.int32), take - 1)[:take] if take < len(gains) else np.arange(len(gains))
            rough = x[near] @ v
            best = near[np.argpartition(-rough, k - 1)[:k]] if k < len(near) else near
            # added up in order of the coordinates, so that equal vectors have equal scores wherever they stand
            found["q"].append(np.full(len(best), q, dtype=np.int64))
            found["score"].append(np.cumsum(x[best] * v, axis=1)[:, -1])
            found["ids"].append(best)
    if not found["q"]:
        return pa.table({"q": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
    return pa.table({"q": np.concatenate(found["q"]), "score": np.concatenate(found["score"]), "ids": ids.take(pa.array(np.concatenate(found["ids"])))})


def search(vectors: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """(query_id, rank, id, score): for each row for which ``asked`` (a condition on ``id``) holds, the ``k`` rows besides itself with
    the largest inner products among those found, ties by id."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = scratch.save(usable(vectors, key, vector), "rows")
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    distinct = scratch.save(distinct_vectors(rows, k + 1), "distinct")
    n = distinct.count()
    if not n:
        return empty
    queries = rows.where(asked)
    wanted = scratch.save(queries.groupBy("x").agg(F.min("id").alias("q")), "wanted")
    n_wanted = wanted.count()
    if not n_wanted:
        return empty
    chosen = Pivots(distinct, pivots, seed)
    blocks, parts = -(-n // BLOCK), -(-n_wanted // QUERIES)
    deal = lambda number, *by: F.pmod(F.xxhash64(*by), F.lit(number)).cast("int")
    all_of = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    index = scratch.save(represented(distinct, chosen, prefix, query=False).withColumn("block", deal(blocks, F.get("ids", F.lit(0)))), "index")
    probes = scratch.save(represented(wanted, chosen, prefix, query=True).withColumn("part", deal(parts, "q")), "probes")
    left = index.withColumn("part", all_of(parts)).groupBy("block", "part")
    right = probes.withColumn("block", all_of(blocks)).groupBy("block", "part")
    n_pivots = len(chosen.x)

    def one(_key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return _search_block(a, b, n_pivots, k + 1, share, least)

    near = left.cogroup(right).applyInArrow(one, "q long, score double, ids array<bigint>")
    # a query vector has k + 1 rows from each block
    near = near.select("q", "score", F.explode("ids").alias("id"))
    w = W.partitionBy("q").orderBy(F.desc("score"), "id")
    best = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
    best = best.groupBy("q").agg(F.collect_list(F.struct("_r", "id", "score")).alias("found"))
    # every query takes the answer of its vector and leaves itself out
    each = queries.join(wanted, "x").select(F.col("id").alias("query_id"), "q").join(best, "q")
    others = F.filter(F.array_sort("found"), lambda f: f["id"] != F.col("query_id"))
    return each.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "f")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("f.id").alias("id"), F.col("f.score").alias("score"))
