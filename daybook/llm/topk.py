"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN_IN = 16


def usable(vector: Column) -> Column:
    """The vector is not null and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: by BLAS where no sum can leave a double's integers."""
    bound = max(1, q.shape[1]) * np.abs(q).max(initial=0) * np.abs(c).max(initial=0)
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def tile_top_k(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, at_once: int = 512) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per query its k best (scores, ids) of one shard, a query's own id left out; ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, c = ids[order], c[order]
    out = []
    for s in range(0, len(q), at_once):
        scores = _products(q[s : s + at_once], c)
        for query, row in zip(query_ids[s : s + at_once], scores, strict=True):
            lo, hi = np.searchsorted(ids, query, "left"), np.searchsorted(ids, query, "right")
            if hi > lo:
                row, others = np.delete(row, slice(lo, hi)), np.delete(ids, slice(lo, hi))
            else:
                others = ids
            if len(row) > k:
                least = np.partition(row, len(row) - k)[len(row) - k]
                above = np.flatnonzero(row > least)
                level = np.flatnonzero(row == least)[: k - len(above)]  # ids ascend, so the first are the smallest
                chosen = np.concatenate([above, level])
            else:
                chosen = np.arange(len(row))
            chosen = chosen[np.lexsort((others[chosen], -row[chosen]))]
            out.append((int(query), row[chosen], others[chosen]))
    return out


def exact_top_k(queries: DataFrame, candidates: DataFrame, id_col: str, vector_col: str, k: int, scale: int = 64, shard_rows: int = 4096, query_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates by integer inner product.

    Components x become floor(scale * x), x as double. Null ids, null vectors and vectors
    with null or non-finite components take no part; vectors meet only vectors of their own
    length. A query id that repeats is asked once (with its smallest vector); a candidate
    that repeats may take several ranks. Scores beyond 64 bits are held at the ends.

    Queries and candidates are dealt by hash into blocks of about ``query_rows`` and
    ``shard_rows``; a tile, one block of each, is one cogroup and its memory is bounded by
    the two numbers. A tile returns one list per query; lists are merged by a tree of fan-in 16,
    so no task sees more than 16 k entries of a query.
    """
    vec = F.col(vector_col)
    deal = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(n)).cast("int")
    cand = candidates.select(F.col(id_col).cast("long").alias("vec_id"), vec.cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id"), vec.cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    shards = max(1, math.ceil(cand.count() / shard_rows))
    blocks = max(1, math.ceil(asked.count() / query_rows))
    cand = cand.select("vec_id", "v", F.size("v").alias("dim"), deal(shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = asked.select("vec_id", "v", F.size("v").alias("dim"), deal(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def tile(key, qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or cs.empty:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("query_id", "shard", "scores", "ids")})
        whole = lambda f: np.floor(np.stack(f["v"].to_numpy()).astype(np.float64).reshape(len(f), -1) * scale)
        got = tile_top_k(qs["vec_id"].to_numpy(), whole(qs), cs["vec_id"].to_numpy(), whole(cs), k)
        return pd.DataFrame({"query_id": [x[0] for x in got], "shard": int(key[0]), "scores": [x[1] for x in got], "ids": [x[2] for x in got]})

    keys = ["shard", "block", "dim"]
    lists = asked.groupBy(keys).cogroup(cand.groupBy(keys)).applyInPandas(tile, "query_id long, shard int, scores array<long>, ids array<long>")
    lists = lists.select("query_id", "shard", F.transform(F.arrays_zip("scores", "ids"), lambda x: F.struct((-x["scores"]).alias("neg"), x["ids"].alias("id"))).alias("best"))
    while True:
        shards = math.ceil(shards / FAN_IN)
        lists = lists.groupBy("query_id", F.floor(F.col("shard") / FAN_IN).cast("int").alias("shard")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        if shards == 1:
            break
    return lists.select("query_id", F.posexplode("best").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.neg")).alias("score"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other vectors for every ``embeddings`` row whose vec_id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_top_k(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", k=20)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s
)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= 20
"""
