"""Operator 4: approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. The index posts every vector in the inverted files of its
nearest ones. A query goes to the inverted files of its own nearest pivots, ranks what is posted there by the footrule
distance of the two pivot orders, and reranks the best share of each file by the exact inner product.

An inverted file is a group of the shuffle: rows are sent to the files that post them and queries to those that they
look up, each a fixed number of times. Large files are dealt out in blocks. What the files return is merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import cut, ship_code, table

#: Pivots are drawn from the usable vectors of a length by the least id hashes: a bounded, documented sample. There are
#: so many up to GROWN vectors, and with the root of their number more beyond, but no more than MOST_PIVOTS.
PIVOTS, GROWN, MOST_PIVOTS = 256, 50_000, 4096
#: So many lengths, the most frequent ones, have pivots; vectors of other lengths are one file each, reranked whole.
LENGTHS = 8
#: In how many files a vector is posted, how many a query looks up with PIVOTS pivots, and the places of an order.
POSTED, LOOKED_UP, PREFIX = 8, 36, 128
#: The share of a file's rows that the footrule distance leaves for reranking, besides twice the wanted neighbours.
RERANKED = 0.3
NEIGHBOURS = 20
#: Rows and queries of a file in a task.
INDEX_BLOCK, QUERY_BLOCK = 4096, 2048


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles."""
    v = F.col("v")
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return whole.where(finite & F.exists(v, lambda x: x != 0))


def pivot_count(rows: int) -> int:
    return min(MOST_PIVOTS, max(PIVOTS, int(PIVOTS * sqrt(rows / GROWN))))


def looked_up(pivots: int) -> int:
    """With more pivots files are smaller, and a query looks up more of them."""
    return min(pivots, PREFIX, ceil(LOOKED_UP * (max(pivots, PIVOTS) / PIVOTS) ** 0.72))


def order_type(pivots: int) -> type:
    return np.uint8 if pivots <= 256 else np.int16


def pivot_orders(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each vector, by inner product, in order; a byte each where that names them all."""
    near = v @ pivots.T
    n = min(PREFIX, near.shape[1])
    top = np.argpartition(-near, n - 1, axis=1)[:, :n]
    order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1).astype(order_type(len(pivots)))


def packed(v: np.ndarray) -> bytes:
    """The components in four bytes each where that keeps them exactly, else in eight."""
    v = v + 0.0
    small = v.astype(np.float32)
    return small.tobytes() if np.array_equal(small, v) else v.tobytes()


def unpacked(rows: list[bytes], length: int) -> np.ndarray:
    return np.array([np.frombuffer(x, np.float32 if len(x) == 4 * length else np.float64) for x in rows], np.float64).reshape(len(rows), length)


class InvertedFile:
    """Rows of one file: their places in each pivot's column, for the footrule distance to a query's order."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, orders: np.ndarray):
        self.ids, self.v = ids, v
        rows, self.places = orders.shape
        if self.places:
            # a pivot that an order lacks counts as after its end; an even number of rows, for the sums by pairs below
            self.table = np.full((int(orders.max()) + 1, rows + rows % 2), self.places, np.uint8)
            self.table[orders.T, np.arange(rows)] = np.arange(self.places, dtype=np.uint8)[:, None]

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """The summed differences of the places of the query's pivots."""
        absent = order >= len(self.table)
        near, place = self.table[np.where(absent, 0, order)], np.arange(self.places, dtype=np.uint8)[:, None]
        near[absent] = self.places
        apart = (np.maximum(near, place) - np.minimum(near, place)).view("<u2")  # two rows in a number
        out = np.empty(self.table.shape[1], np.uint16)
        out[::2], out[1::2] = (apart & 0xFF).sum(0, dtype=np.uint16), (apart >> 8).sum(0, dtype=np.uint16)
        return out[: len(self.ids)]

    def nearest(self, query_id: int, vector: np.ndarray, order: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the file's k nearest rows to a query, of those that the footrule distance leaves."""
        keep = 2 * k + ceil(share * len(self.ids))
        found = np.argpartition(self.footrule(order), keep)[:keep] if self.places and keep < len(self.ids) else np.arange(len(self.ids))
        found = found[self.ids[found] != query_id]
        scores = (self.v[found] * vector).sum(axis=1)
        if len(found) > k:  # ties at the end stay until they are sorted by id
            best = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            found, scores = found[best], scores[best]
            nearest = np.lexsort((self.ids[found], -scores))[:k]
            found, scores = found[nearest], scores[nearest]
        return found, scores


def _search(index: DataFrame, queries: DataFrame, pivots: dict[int, int], k: int, share: float) -> DataFrame:
    """(query_id, row, vec_id, score): the nearest rows of every file that a query looks up.

    ``index`` has row, vec_id, packed, orders and posted, ``queries`` vec_id, packed, orders and posted, the files that
    they look up, and ``pivots`` the number of pivots by length. The sizes of the files, at most LENGTHS x MOST_PIVOTS and one a rare length, are joined by statistics.
    """
    file = ["length", "pivot"]
    posted = index.select("length", "row", "vec_id", "packed", "orders", F.explode("posted").alias("pivot"))
    asking = queries.select("length", "vec_id", "packed", "orders", F.explode("posted").alias("pivot"))
    blocks = lambda rows, size: rows.groupBy(*file).agg(F.ceil(F.count("*") / F.lit(float(size))).cast("int").alias("n"))
    sizes = cut(blocks(posted.select(*file), INDEX_BLOCK).withColumnRenamed("n", "row_blocks").join(blocks(asking.select(*file), QUERY_BLOCK).withColumnRenamed("n", "query_blocks"), file))
    dealt = lambda n, *by: F.pmod(F.xxhash64(F.col("pivot"), *by), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = posted.join(sizes, file).select(*file, "row", "vec_id", "packed", "orders", dealt("row_blocks", F.col("row")).alias("block"), every("query_blocks").alias("query_block"))
    asked = asking.join(sizes, file).select(*file, F.lit(-1).cast("long").alias("row"), "vec_id", "packed", "orders", every("row_blocks").alias("block"), dealt("query_blocks", F.col("vec_id"), F.col("packed")).alias("query_block"))

    def search(found: pd.DataFrame) -> pd.DataFrame:
        length = int(found["length"].iloc[0])
        asks = found["row"].to_numpy() < 0
        ids, v = found["vec_id"].to_numpy(np.int64), unpacked(found["packed"].tolist(), length)
        orders = np.frombuffer(b"".join(found["orders"]), order_type(pivots.get(length, 0))).reshape(len(found), -1)
        own = InvertedFile(ids[~asks], v[~asks], orders[~asks])
        row = found["row"].to_numpy()[~asks]
        out = [(q, *own.nearest(q, vector, order, k, share)) for q, vector, order in zip(ids[asks].tolist(), v[asks], orders[asks])] if not asks.all() else []
        at = np.concatenate([np.zeros(0, np.int64), *(x for _, x, _ in out)])
        return pd.DataFrame({"query_id": np.repeat([q for q, _, _ in out], [len(x) for _, x, _ in out]).astype(np.int64), "row": row[at], "vec_id": own.ids[at], "score": np.concatenate([np.zeros(0), *(s for *_, s in out)])})

    met = rows.unionByName(asked).groupBy(*file, "block", "query_block").applyInPandas(search, "query_id long, row long, vec_id long, score double")
    return met.groupBy("query_id", "row", "vec_id").agg(F.max("score").alias("score"))


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank from 1, vec_id, score: each query's k nearest rows found, or all if there are fewer.

    Vectors that are null, zero, hold null or non-finite components or have a null id take no part; each length is
    searched among its own rows, rare lengths exactly. Nearest first, ties to the smaller id. A repeated row is a
    neighbour of others once for each copy. Rows of one id are one query, whose neighbours are those nearest to any of
    its vectors, and no row with its id is among them. Of equal rows k are all that can be ranked, and of equal vectors
    the k + 1 least ids, so no more are indexed. A query whose files hold fewer than k rows is asked again of all files,
    exactly. An empty table gives no rows; other columns are not read.
    """
    ship_code(vectors.sparkSession)
    counted = cut(usable(vectors).withColumn("_query", F.coalesce(is_query, F.lit(False))).groupBy("vec_id", "v", "_query").agg(F.least(F.count("*"), F.lit(k)).alias("copies")))
    first = Window.partitionBy("v").orderBy("vec_id")
    kept = cut(counted.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1))
    pivots = {}
    for length in kept.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").limit(LENGTHS).collect():
        drawn = kept.where(F.size("v") == length["length"]).orderBy(F.xxhash64("vec_id"), "vec_id", "v").select("v").limit(pivot_count(length["count"])).collect()
        pivots[length["length"]] = np.unique([r["v"] for r in drawn], axis=0)

    numbers = {length: len(own) for length, own in pivots.items()}

    @F.pandas_udf("length int, packed binary, orders binary, near array<smallint>")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.tolist()
            lengths = np.fromiter(map(len, rows), np.int64, len(rows))
            orders: list[bytes] = [b""] * len(rows)
            near = [np.zeros(1, np.int16)] * len(rows)
            for length, own in pivots.items():
                at = np.flatnonzero(lengths == length)
                if len(at):
                    for i, order in zip(at.tolist(), pivot_orders(np.array([rows[i] for i in at], float), own)):
                        orders[i], near[i] = order.tobytes(), order[: looked_up(len(own))].astype(np.int16)
            yield pd.DataFrame({"length": lengths, "packed": [packed(np.asarray(x, float)) for x in rows], "orders": orders, "near": near})

    index = kept.select("vec_id", described("v").alias("d"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    index = cut(index.select("vec_id", "d.length", "d.packed", "d.orders", F.slice("d.near", 1, POSTED).alias("posted")).withColumn("row", F.monotonically_increasing_id()))
    queries = cut(counted.where("_query").select("vec_id", described("v").alias("d")).select("vec_id", "d.length", "d.packed", "d.orders", F.col("d.near").alias("posted")))
    found = cut(_search(index, queries, numbers, k, RERANKED))

    full = found.groupBy(F.col("query_id").alias("vec_id")).count().where(F.col("count") >= k)
    short = cut(queries.join(full, "vec_id", "left_anti"))
    if not short.isEmpty():
        files = index.select("length", F.explode("posted").alias("pivot")).groupBy("length").agg(F.collect_set("pivot").alias("posted"))  # at most MOST_PIVOTS
        again = _search(index, short.drop("posted").join(files, "length"), numbers, k, 1.0)
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
