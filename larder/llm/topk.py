"""Exact search for the k best inner products: tiles of queries times shards of vectors.

Vectors are packed into blocks, queries into tiles; a tile goes to every shard of blocks by an equi-join on the shard's
number, and each pair is one matrix product with a partial selection of k. The lists are merged in two levels, by query and
branch of shards and then by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, mix, table

TILE, BLOCK, BRANCHES = 256, 4096, 16
#: Vectors to a shard at most; small tables are dealt into as many shards as there are cores.
SHARD_ROWS = 1 << 18


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 x), as whole doubles."""
    return np.floor(x.astype(np.float64) * 1024.0)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: by doubles where no sum can pass 2^53, else exactly with Python's integers, held to 64 bits."""
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1]
    if most < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in queries], object) @ np.array([[int(x) for x in r] for r in vectors], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best_of_block(q_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of scores and places of the k best per query; ids ascend, so equal scores fall to the smaller id. Rows of a query's own id take no part."""
    rows, places = [], []
    lo, hi = np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right")
    for r in range(len(q_ids)):
        line = scores[r]
        n_own = hi[r] - lo[r]
        least = None
        if len(line) > k + n_own:
            least = np.partition(line, len(line) - k - n_own)[len(line) - k - n_own]
        at = np.arange(len(line)) if least is None else np.flatnonzero(line >= least)
        if n_own:
            at = at[(at < lo[r]) | (at >= hi[r])]
        at = at[np.argsort(-line[at].astype(np.float64) if abs(line[at]).max(initial=0) < 2**53 else ~line[at], kind="stable")][:k]
        rows.append(np.full(len(at), r))
        places.append(at)
    return (np.concatenate(rows), np.concatenate(places)) if rows else (np.zeros(0, int), np.zeros(0, int))


_PACKED = "dim int, ids binary, tags binary, data binary"


def _pack(df: DataFrame, size: int) -> DataFrame:
    """Rows (id, v) to blocks of `size` vectors of one dimension, sorted by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, data = (np.concatenate([x[i] for x in waiting[dim]]) for i in (0, 1))
            order = np.argsort(ids, kind="stable")
            ids, data = ids[order], np.ascontiguousarray(data[order])
            rest = [(ids[size:], data[size:])] if len(ids) > size else []
            ids, data = ids[:size], data[:size]
            waiting[dim] = rest
            tags = np.zeros(len(ids), np.uint64)
            for c in range(dim):
                tags = mix(tags * np.uint64(3) + np.ascontiguousarray(data[:, c]).view(np.uint64))
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": [ids.tobytes()], "tags": [tags.tobytes()], "data": [data.tobytes()]})

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            bounds = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            length = np.diff(bounds)
            for dim in np.unique(length).tolist():
                at = np.flatnonzero(length == dim)
                waiting.setdefault(dim, []).append((ids[at], whole(flat[bounds[at][:, None] + np.arange(dim)])))
                while sum(len(x[0]) for x in waiting[dim]) >= size:
                    yield out(dim)
        for dim in list(waiting):
            while sum(len(x[0]) for x in waiting[dim]):
                yield out(dim)

    return df.mapInArrow(run, _PACKED)


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row of vectors for which is_query holds, its k best rows: query_id, rank from 1, vec_id, score.

    Vectors that are null or hold null, NaN or infinite components take no part, nor do rows without an id; vectors of
    another dimension than the query's have no product with it. A query that is repeated with the same vector counts once;
    repeated candidate rows count each. Ties fall to the smaller id. Fewer candidates than k give fewer rows; none give none.
    """
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col("id").isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q")).filter(sound)
    n = rows.count()
    shards = max(1, -(-n // SHARD_ROWS), min(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCK)))
    packed = materialize(_pack(rows.select("id", "v"), BLOCK))
    packed = packed.withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)))
    # the stated queries, whole, in tiles: each goes to every shard
    tiles = materialize(_pack(rows.filter("q").select("id", "v").distinct(), TILE))
    tiles = tiles.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("tags").alias("q_tags"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    pairs = tiles.join(packed, (tiles["shard"] == packed["shard"]) & (tiles["q_dim"] == packed["dim"])).select("q_dim", "q_ids", "q_tags", "q_data", "ids", "data", (packed["shard"] % BRANCHES).alias("branch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q_tags, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_tags"], np.int64), np.frombuffer(r["ids"], np.int64)
                q = np.frombuffer(r["q_data"], np.float64).reshape(len(q_ids), r["q_dim"])
                scores = products(q, np.frombuffer(r["data"], np.float64).reshape(len(ids), r["q_dim"]))
                at, place = best_of_block(q_ids, scores, ids, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[at]), pa.array(q_tags[at]), pa.array(ids[place]), pa.array(scores[at, place]), pa.array(np.full(len(at), r["branch"], np.int64))],
                    ["query_id", "tag", "vec_id", "score", "branch"],
                )

    lists = pairs.mapInArrow(run, "query_id long, tag long, vec_id long, score long, branch long")
    order = [F.col("score").desc(), F.col("vec_id")]
    one = lists.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "tag", "branch").orderBy(*order))).filter(F.col("n") <= k)
    two = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "tag").orderBy(*order))).filter(F.col("rank") <= k)
    return two.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE_SQL = {
    "op9_top_k": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) w
  from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id query_id, c.vec_id, cast(list_inner_product(list_transform(q.w, lambda x: cast(x as double)), list_transform(c.w, lambda x: cast(x as double))) as bigint) score
  from v q join v c on c.vec_id <> q.vec_id and len(q.w) = len(c.w) where q.vec_id % 100 = 0
), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank from s)
select query_id, rank, vec_id, score from r where rank <= 10"""
}
