"""Hard-negative mining with one candidate list for each cluster of anchors, walked until certified termination."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import stage
from daybook.llm.topk import FAN_IN, _products, usable
from daybook.llm.vector_dedup import k_means, nearest, unit

#: Cluster centres are fitted on so many anchors at most, and there are so many of them at most.
FIT_ANCHORS, MAX_CENTRES = 4096, 256
#: Anchors that share a list, on the average.
CLUSTER = 64
#: Candidates are scored so many at once.
STRIDE = 256
LOWEST = -(2**63) + 1


def angular_bounds(members: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """For each candidate x a number b with u . x <= |u| b for every member u of the cluster.

    The angle between u and x is at least that of x and the centre less the largest of a member and the centre.
    Zero members have score 0 with everything and b may be below 0, so with them the bound is at least 0.
    """
    long_ = np.linalg.norm(members, axis=1)
    sizes = np.linalg.norm(candidates, axis=1)
    directions = members[long_ > 0] / long_[long_ > 0, None]
    centre = directions.sum(axis=0)
    if not len(directions) or np.linalg.norm(centre) == 0:
        return sizes
    centre = centre / np.linalg.norm(centre)
    widest = np.arccos(np.clip(directions @ centre, -1, 1)).max()
    angle = np.arccos(np.clip(candidates @ centre / np.where(sizes > 0, sizes, 1), -1, 1))
    bound = sizes * np.cos(np.maximum(0, angle - widest - 1e-7))  # 1e-7: what rounding may do to an arc cosine
    return bound if len(directions) == len(members) else np.maximum(bound, 0)


def walk(member: np.ndarray, lo: np.ndarray, hi: np.ndarray, own: np.ndarray, label: np.ndarray, same: bool, members: np.ndarray, ids: np.ndarray, labels: np.ndarray, candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best candidates of each asker, and how many products were formed.

    Asker i stands for the vector ``members[member[i]]`` and takes candidates of its own label (``same``) or of others, but not the
    id ``own[i]``, with lo <= score <= hi. Candidates are sorted by their bound once; an asker stops where its k-th score is
    above, or its ``lo`` below nothing that can follow. Returns (asker, score, id), best first, ties to smaller ids.
    """
    bound = angular_bounds(members, candidates)
    order = np.argsort(-bound, kind="stable")
    bound, ids, labels, candidates = bound[order], ids[order], labels[order], candidates[order]
    size = np.linalg.norm(members, axis=1)[member]
    kth = np.full(len(member), LOWEST, dtype=np.int64)
    full = np.zeros(len(member), dtype=bool)
    at = np.zeros(0, dtype=np.int64)
    score, name, formed = at.copy(), at.copy(), 0
    for s in range(0, len(ids), STRIDE):
        # one unit and a part in 10^12 more than rounding can take
        most = size * bound[s] + np.abs(size * bound[s]) * 1e-12 + 1e-6
        live = np.flatnonzero((most >= lo) & ~(full & (kth > most)))
        if not len(live):
            break
        asked, back = np.unique(member[live], return_inverse=True)
        part = slice(s, s + STRIDE)
        products = _products(members[asked], candidates[part])
        formed += products.size
        got = products[back]
        fits = (got >= np.maximum(lo, kth)[live, None]) & (got <= hi[live, None]) & (ids[part][None, :] != own[live, None])
        fits &= (labels[part][None, :] == label[live, None]) == same
        r, c = np.nonzero(fits)
        at, score, name = np.concatenate([at, live[r]]), np.concatenate([score, got[r, c]]), np.concatenate([name, ids[part][c]])
        by = np.lexsort((name, -score, at))
        at, score, name = at[by], score[by], name[by]
        place = np.arange(len(at)) - np.searchsorted(at, at, "left")
        last = np.flatnonzero(place == k - 1)
        full[at[last]], kth[at[last]] = True, score[last]
        at, score, name = at[place < k], score[place < k], name[place < k]
    return at, score, name, formed


def _merged(lists: DataFrame, keys: list[str], shards: int, k: int) -> DataFrame:
    """The k best of each key's lists (negated score, id), by a tree of fan-in 16."""
    while True:
        shards = math.ceil(shards / FAN_IN)
        lists = lists.groupBy(*keys, F.floor(F.col("shard") / FAN_IN).cast("int").alias("shard")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        if shards == 1:
            return lists.drop("shard")


def _centres(anchors: DataFrame, dim: int, count: int) -> np.ndarray:
    sample = anchors.where(F.col("dim") == dim).orderBy(F.xxhash64("anchor_id", F.lit(23)), "anchor_id").select("v").limit(FIT_ANCHORS).collect()
    x = np.array([r["v"] for r in sample], dtype=np.float64).reshape(len(sample), dim)
    x = x[x.any(axis=1)]
    return k_means(unit(x), min(len(x), MAX_CENTRES, max(1, math.ceil(count / CLUSTER)))) if len(x) else np.zeros((1, dim))


def _tiles(asking: DataFrame, rows: DataFrame, shards: int, blocks: int, k: int, second: bool) -> DataFrame:
    """(anchor_id, place, shard, best): lists of each tile of a block of anchor clusters and a shard of candidates."""
    cand = rows.select("vec_id", "label", "v", "dim", F.pmod(F.xxhash64("row", F.lit(17)), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asking = asking.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def tile(key, qs, cs):
        out = []
        if len(qs) and len(cs):
            ids, labels, dim = cs["vec_id"].to_numpy(np.int64), cs["label"].to_numpy(np.int64), int(key[2])
            candidates = np.stack(cs["v"].to_numpy()).astype(np.float64).reshape(len(cs), dim)
            for _, group in qs.groupby("cluster", sort=True):
                members = np.stack(group["v"].to_numpy()).astype(np.float64).reshape(len(group), dim)
                anchors, label = group["anchor_id"].to_numpy(np.int64), group["label"].to_numpy(np.int64)
                if second:
                    scores = [np.asarray(x, dtype=np.int64) for x in group["scores"]]
                    member = np.repeat(np.arange(len(group)), [len(x) for x in scores])
                    ps = np.concatenate(scores) if scores else np.zeros(0, np.int64)
                    place = np.concatenate([np.arange(len(x)) for x in scores]).astype(np.int64)
                    lo, hi = -(-ps // 2), _share(ps)
                else:
                    member, place = np.arange(len(group)), np.zeros(len(group), dtype=np.int64)
                    lo, hi = np.full(len(group), LOWEST), np.full(len(group), 2**63 - 1)
                at, score, name, _ = walk(member, lo, hi, anchors[member], label[member], not second, members, ids, labels, candidates, k)
                cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
                out += [(int(anchors[member[a[0]]]), int(place[a[0]]), s, n) for a, s, n in zip(np.split(at, cut[1:]), np.split(score, cut[1:]), np.split(name, cut[1:]), strict=True) if len(a)]
        return pd.DataFrame([(x[0], x[1], int(key[0]), x[2], x[3]) for x in out], columns=["anchor_id", "place", "shard", "scores", "ids"], dtype=object)

    keys = ["shard", "block", "dim"]
    lists = asking.groupBy(keys).cogroup(cand.groupBy(keys)).applyInPandas(tile, "anchor_id long, place int, shard int, scores array<long>, ids array<long>")
    best = F.transform(F.arrays_zip("scores", "ids"), lambda x: F.struct((-x["scores"]).alias("neg"), x["ids"].alias("id")))
    return lists.select("anchor_id", "place", "shard", best.alias("best"))


def _share(ps: np.ndarray) -> np.ndarray:
    """floor(95 ps / 100) without passing 64 bits."""
    return ps // 20 * 19 + ps % 20 * 19 // 20


def hard_negatives(anchors: DataFrame, rows: DataFrame, id_col: str, vector_col: str, label_col: str, positives: int = 5, negatives: int = 3, scale: int = 256, shard_rows: int = 4096, anchor_rows: int = 4096) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its ``positives``
    best rows of its own label, the ``negatives`` best rows of other labels with 50 ps <= 100 ns <= 95 ps.

    Components x become floor(scale * x), x as double, held at the ends of 64 bits; a score is their integer inner product, ties go to smaller ids.
    Rows with a null id, label or vector, or a null or non-finite component, take no part; vectors meet only those of their own
    length. An anchor id that repeats is asked once (its smallest vector, then label); other rows that repeat
    may take several ranks, as anchors' positives too. Rows with the anchor's own id are not its candidates.
    Other columns are left alone. No anchors or no rows give no result.

    Anchors are put to the nearest of a bounded number of centres (fitted on ``FIT_ANCHORS`` anchors at most; which centre only
    decides how long lists are walked). A tile is a block of some ``anchor_rows`` anchors and a shard of some ``shard_rows`` candidates,
    so a task's memory is bounded by the two numbers. In a tile each cluster sorts the shard by its angular bound once and all its
    members walk that list, each until nothing that follows can enter its list. Lists of shards are merged by a tree.
    The first walk finds positives, the second the negatives in the windows that these set.
    """
    read = lambda df, name: df.select(F.col(id_col).cast("long").alias(name), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col(name).isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double"))).withColumn("dim", F.size("v"))
    cand = stage(read(rows, "vec_id").withColumn("row", F.monotonically_increasing_id()), "candidates")  # copies of one id are dealt over shards too
    asked = stage(read(anchors, "anchor_id").groupBy("anchor_id").agg(F.min(F.struct("v", "label", "dim")).alias("x")).select("anchor_id", "x.*"), "anchors")
    shards = max(1, math.ceil(cand.count() / shard_rows))
    dims = {r["dim"]: r["count"] for r in asked.groupBy("dim").count().collect()}
    blocks = max(1, math.ceil(sum(dims.values()) / anchor_rows))
    centres = {d: _centres(asked, d, n) for d, n in dims.items()}

    def place(frames):
        for f in frames:
            f = f.reset_index(drop=True)
            f["cluster"] = 0
            for d, part in f.groupby("dim"):
                x = np.stack(part["v"].to_numpy()).reshape(len(part), d)
                there = x.any(axis=1)  # zero vectors have no direction and stay in cluster 0
                if there.any():
                    f.loc[part.index[there], "cluster"] = nearest(unit(x[there]), centres[d], 1)[:, 0]
            yield f

    # clusters stay together, but one of more than a block's anchors is dealt into parts
    put = asked.mapInPandas(place, "anchor_id long, v array<double>, label long, dim int, cluster int")
    whole = put.groupBy("dim", "cluster").agg(F.count("*").alias("n"))
    whole = whole.withColumn("parts", F.ceil(F.col("n") / anchor_rows))
    put = put.join(whole, ["dim", "cluster"]).withColumn("part", F.pmod(F.xxhash64("anchor_id", F.lit(29)), F.col("parts")))
    put = stage(put.withColumn("block", F.pmod(F.xxhash64("cluster", "part"), F.lit(blocks)).cast("int")).select("anchor_id", "label", "v", "dim", "cluster", "block"), "clusters")
    first = _merged(_tiles(put, cand, shards, blocks, positives, second=False), ["anchor_id"], shards, positives)
    found = first.select("anchor_id", F.transform("best", lambda x: -x["neg"]).alias("scores"), F.transform("best", lambda x: x["id"]).alias("ids"))
    found = stage(found, "positives")
    again = put.join(found.select("anchor_id", "scores"), "anchor_id")
    second = _merged(_tiles(again, cand, shards, blocks, negatives, second=True), ["anchor_id", "place"], shards, negatives)
    rows_ = second.join(found, "anchor_id").select("anchor_id", F.get("ids", F.col("place")).alias("positive_id"), F.get("scores", F.col("place")).alias("positive_score"), F.posexplode("best").alias("pos", "x"))
    return rows_.select("anchor_id", "positive_id", (F.col("pos") + 1).cast("long").alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.neg")).alias("negative_score"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every ``embeddings`` row whose vec_id is divisible by 50; labels of every seventh id are one further."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", "label")


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS a, c.vec_id AS c, q.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), p AS (
  SELECT a, c AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5
), n AS (
  SELECT p.a, p.p, p.ps, s.c AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.c) AS rk
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.ps <= 100 * s.score AND 100 * s.score <= 95 * p.ps
)
SELECT a AS anchor_id, p AS positive_id, rk AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rk <= 3
"""
