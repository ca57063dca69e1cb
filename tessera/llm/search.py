"""Exact top-k by inner product.

Method: MaxScore over postings by dimension. A first pass scores a bounded seed of vectors against every query; its k-th best score is a threshold that
no answer lies below. Then shards of vectors meet blocks of queries. A query's terms are its non-zero weights. The terms whose bounds together stay below
the threshold are non-essential: the postings of the others, the essential ones, are traversed, and the non-essential ones are probed, largest bound
first, only for vectors that can still reach the threshold, which rises as vectors are scored. A set of terms is bound by the sum of its terms'
largest impacts in the chunk and by the product of the norms, whichever is less. The shards' lists are merged.

Vectors and queries are tables that meet by shard and block, so no task holds more than SHARD vectors and BLOCK queries, and the driver holds neither.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; shorter vectors count as
padded with zeros; an empty vector scores 0; ties go to the smaller id; rows that repeat an id are candidates each, but no row is a candidate
for its own id, and a repeated query is one query (its first vector in order). Products are exact integers of any size; a score beyond the
range of a long counts as that range's end, in ranks too. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Queries and vectors that a task holds at most.
BLOCK = 16_384
SHARD = 65_536
#: Vectors of the first pass; they only give a first threshold.
SEED = 1024
CHUNK = 4096
EXACT = 2.0**52
_ENDS = (-(1 << 63), (1 << 63) - 1)
FOUND = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(good).select("vec_id", F.col("embedding").alias("v"))


def quantized(rows: pa.ChunkedArray, d: int, scale: float) -> np.ndarray:
    """floor(scale * x), rows padded to d: floats where they hold the integers exactly, else Python integers."""
    flat = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    size = flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    there = np.arange(d)[None, :] < size[:, None]
    if np.abs(values).max(initial=0) * abs(scale) < EXACT:
        out = np.zeros((len(size), d))
        out[there] = np.floor(values * scale)
        return out
    up, down = float(scale).as_integer_ratio()

    def whole(x: float) -> int:
        a, b = x.as_integer_ratio()
        return a * up // (b * down)

    out = np.zeros((len(size), d), object)
    out[there] = [whole(x) for x in values.tolist()]
    return out


def fitted(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats if no sum of products can pass EXACT, else both as Python integers."""
    most = lambda a: max((abs(float(v)) for v in (a.min(initial=0), a.max(initial=0))), default=0.0)
    if x.dtype != object and q.dtype != object and most(x) * most(q) * max(1, x.shape[1]) < EXACT:
        return x, q
    whole = lambda a: a if a.dtype == object else np.array([[int(v) for v in r] for r in a.tolist()], object).reshape(a.shape)
    return whole(x), whole(q)


class Postings:
    """Some vectors by dimension: each dimension's rows with a component other than 0 (None: most rows, the column is whole), their components, and the bounds."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.low, self.high = (x.min(0), x.max(0)) if len(ids) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        self.norm = None if x.dtype == object else float(np.sqrt((x * x).sum(1).max(initial=0)))
        self.lists = []
        for column in np.ascontiguousarray(x.T):
            rows = np.flatnonzero(column)
            self.lists.append((rows, column[rows], column) if 2 * len(rows) < self.n else (None, column, column))


class Shard:
    """The best k of some queries over the chunks seen. work: postings traversed and probed."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, thresholds: list[int | None] | None = None):
        self.ids, self.q, self.k = ids, queries, k
        self.theta = list(thresholds) if thresholds else [None] * len(ids)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), in order
        self.traversed = self.probed = 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        x, queries = fitted(x, self.q)
        held = Postings(ids, x)
        for j in range(len(self.ids)):
            self._search(j, held, queries[j])

    def _search(self, j: int, held: Postings, q: np.ndarray) -> None:
        terms = np.flatnonzero(q)
        w = q[terms]
        bound = np.maximum(w * held.low[terms], w * held.high[terms])
        order = np.array(sorted(range(len(terms)), key=bound.__getitem__), np.int64)  # the least bound first
        terms, w = terms[order], w[order]
        rest = np.concatenate([[0], np.cumsum(bound[order])])  # rest[n] bounds the first n terms together
        if held.norm is not None:
            rest = np.minimum(rest, np.sqrt(np.concatenate([[0], np.cumsum(w * w)])) * held.norm * (1 + 1e-9) + 1)
        theta = self.theta[j]
        spare = 0 if theta is None else int((rest < theta).sum()) - 1  # so many terms are non-essential
        spare = max(0, spare)
        score = np.zeros(held.n, object if q.dtype == object else float)
        for t in range(len(terms) - 1, spare - 1, -1):
            rows, values, _ = held.lists[terms[t]]
            if rows is None:
                score += w[t] * values
            else:
                score[rows] += w[t] * values
            self.traversed += len(values)
        alive = held.ids != self.ids[j]
        alive = np.flatnonzero(alive if theta is None else alive & (score + rest[spare] >= theta))
        score = score[alive]
        for t in range(spare - 1, -1, -1):
            if not len(alive):
                return
            score = score + w[t] * held.lists[terms[t]][2][alive]
            self.probed += len(alive)
            going = score + rest[t] >= theta
            if not going.all():
                alive, score = alive[going], score[going]
        if len(alive) > self.k:
            least = np.sort(score)[-self.k]
            alive, score = alive[score >= least], score[score >= least]
        if len(alive):
            found = [(-min(max(int(s), _ENDS[0]), _ENDS[1]), int(i)) for s, i in zip(score, held.ids[alive], strict=True)]
            self.best[j] = sorted(self.best[j] + found)[: self.k]
            if len(self.best[j]) == self.k:
                worst = -self.best[j][-1][0]
                self.theta[j] = worst if theta is None else max(theta, worst)

    def rows(self) -> pa.Table:
        flat = [(int(q), i, -s) for q, b in zip(self.ids, self.best, strict=True) for s, i in b]
        query, ids, score = zip(*flat, strict=True) if flat else ((), (), ())
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.int64())})


def searched(rows: DataFrame, k: int, scale: float) -> DataFrame:
    """rows: shard, block, asked (whether it is a query), vec_id, v, theta. The best k of each group's queries among its vectors."""

    def run(table: pa.Table) -> pa.Table:
        asked = table["asked"].to_numpy()
        queries, vectors = table.filter(pa.array(asked)), table.filter(pa.array(~asked))
        if not len(queries):
            return Shard(np.zeros(0, np.int64), np.zeros((0, 0)), k).rows()
        d = max([0, *(max(x.combine_chunks().value_lengths().to_pylist(), default=0) for x in (queries["v"], vectors["v"]))])
        shard = Shard(queries["vec_id"].to_numpy(), quantized(queries["v"], d, scale), k, queries["theta"].to_pylist())
        for at in range(0, len(vectors), CHUNK):
            part = vectors.slice(at, CHUNK)
            shard.add(part["vec_id"].to_numpy(), quantized(part["v"], d, scale))
        return shard.rows()

    return rows.groupBy("shard", "block").applyInArrow(run, FOUND)


def top(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best for each row whose id is divisible by `every`."""
    own = common.save(usable(vectors).withColumn("row", F.monotonically_increasing_id()))
    asked = own.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = common.save(asked)
    n, m = own.count(), asked.count()
    blocks = max(1, -(-m // BLOCK))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // min(SHARD, max(CHUNK, -(-n // cores)))))
    queries = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    row = ["shard", "block", "asked", "vec_id", "v", "theta"]
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    one = F.lit(0).cast("long").alias("shard")
    none = F.lit(None).cast("long").alias("theta")
    seed = own.orderBy(F.xxhash64("row"), "row").limit(SEED).select(one, every_block, F.lit(False).alias("asked"), "vec_id", "v", none)
    first = searched(queries.select(one, "block", F.lit(True).alias("asked"), "vec_id", "v", none).unionByName(seed), k, scale)
    thresholds = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("theta"))
    queries = common.save(queries.join(common.save(thresholds), "vec_id", "left"))
    to_all = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    sides = queries.select(to_all, "block", F.lit(True).alias("asked"), "vec_id", "v", "theta")
    sides = sides.unionByName(own.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), every_block, F.lit(False).alias("asked"), "vec_id", "v", none))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = searched(sides.select(*row), k, scale)
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
