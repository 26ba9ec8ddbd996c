"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, exact rerank."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import connected_components, stage
from daybook.llm.topk import usable

#: The index is fitted on at most so many vectors, or FIT_ROWS for each list, chosen by a hash; every vector is indexed.
FIT_SAMPLE, FIT_ROWS = 20_000, 16
#: Bounds of that sample in rows and in bytes of doubles, and so of the lists (16,384 at 64 components: from some 67 million vectors on they grow longer).
FIT_MOST, FIT_BYTES = 1 << 18, 1 << 27
#: Rows of a list, while the lists are few; least number of lists that is probed.
LIST_ROWS, PROBES = 256, 8
SUBSPACES, WORDS = 8, 256
TILE_ROWS = 2048


def how_many(count: int) -> tuple[int, int]:
    """Lists, and lists to probe, of an index of so many vectors.

    Beyond 1,024 lists, their number grows with the root of the rows, so that finding the nearest
    lists costs no more than probing them. Probes follow the root of the lists: so recall stays.
    """
    lists = max(1, min(count // LIST_ROWS, max(1024, 2 * math.isqrt(count))))
    return lists, min(lists, max(PROBES, math.isqrt(lists)))


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest centres of each row, nearest first."""
    out = []
    for s in range(0, len(x), 4096):
        d = (centres**2).sum(1) - 2 * (x[s : s + 4096] @ centres.T)
        few = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(few, np.argsort(np.take_along_axis(d, few, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.empty((0, min(k, len(centres))), int)


@dataclass
class Index:
    """Coarse centres and, for each subspace of the residuals, its code words."""

    centres: np.ndarray
    words: np.ndarray  # subspaces x words x width
    probes: int

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, probes: int) -> Index:
        centres = k_means(x, lists)
        residuals = cls.split(x - centres[nearest(x, centres, 1)[:, 0]])
        k = min(WORDS, len(x))
        return cls(centres, np.stack([k_means(r, k) for r in residuals]), min(probes, len(centres)))

    @staticmethod
    def split(x: np.ndarray) -> np.ndarray:
        """subspaces x rows x width; the last subspace is filled up with zeros."""
        width = max(1, math.ceil(x.shape[1] / SUBSPACES))
        padded = np.zeros((len(x), SUBSPACES * width))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), SUBSPACES, width).transpose(1, 0, 2)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probed lists (the first is the own one), residual codes and the codes' errors."""
        lists = nearest(x, self.centres, self.probes)
        parts = self.split(x - self.centres[lists[:, 0]])
        codes = np.stack([nearest(p, w, 1)[:, 0] for p, w in zip(parts, self.words, strict=True)], axis=1).astype(np.uint8)
        error = np.sqrt(sum(((p - w[c]) ** 2).sum(1) for p, w, c in zip(parts, self.words, codes.T, strict=True)))
        return lists, codes, error

    def distances(self, x: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of rows x from the coded members of a list, by table look-ups."""
        total = np.zeros((len(x), len(codes)))
        for part, words, code in zip(self.split(x - self.centres[centre]), self.words, codes.T, strict=True):
            table = ((part[:, None, :] - words[None]) ** 2).sum(2)
            total += table[:, code]
        return np.sqrt(total)


def unpack(column, dim: int) -> np.ndarray:
    """Vectors as doubles, from bytes of single or double precision."""
    return np.stack([np.frombuffer(b, "<f4" if len(b) == 4 * dim else "<f8").astype(np.float64) for b in column]) if len(column) else np.empty((0, dim))


def pack(x: np.ndarray) -> list[bytes]:
    """Rows as bytes, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        single = x.astype("<f4")
    return [s.tobytes() if (s == d).all() else d.tobytes() for s, d in zip(single, x.astype("<f8"), strict=True)]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tile_links(index: Index, centre: int, dim: int, threshold: float, probers: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """(id, n, root) for vectors linked in one tile: weights of the links counted here, and the smallest id
    they lead to within the tile.

    A link of prober q and member x adds x's weight to q. It adds q's weight to x here only where x
    does not probe q's own list: else it is added there.
    """
    q, x = unit(unpack(probers["v"], dim)), unit(unpack(members["v"], dim))
    codes = np.frombuffer(b"".join(members["code"]), np.uint8).reshape(len(members), -1)
    limit = math.sqrt(max(0.0, 2 - 2 * threshold)) + members["error"].to_numpy() + 1e-9
    qi, xi = probers["id"].to_numpy(), members["id"].to_numpy()
    qo = probers["own"].to_numpy()
    probed = np.zeros((len(members), len(index.centres)), dtype=bool)
    for k, lists in enumerate(members["lists"]):
        probed[k, lists] = True
    a, b = [], []
    for s in range(0, len(q), 256):
        at, to = np.nonzero(index.distances(q[s : s + 256], centre, codes) <= limit)
        at += s
        keep = qi[at] != xi[to]
        at, to = at[keep], to[keep]
        if len(at) > 0.2 * len(x) * 256:
            cosine = (q[s : s + 256] @ x.T)[at - s, to]
        else:
            cosine = np.concatenate([np.einsum("ij,ij->i", q[at[k : k + 65536]], x[to[k : k + 65536]]) for k in range(0, len(at), 65536)] or [np.empty(0)])
        a.append(at[cosine >= threshold])
        b.append(to[cosine >= threshold])
    a, b = np.concatenate(a or [np.empty(0, int)]), np.concatenate(b or [np.empty(0, int)])
    qn, xn = np.zeros(len(q), np.int64), np.zeros(len(x), np.int64)
    np.add.at(qn, a, members["w"].to_numpy()[b])
    alone = ~probed[b, qo[a]]
    np.add.at(xn, b[alone], probers["w"].to_numpy()[a[alone]])
    qr, xr = qi.copy(), xi.copy()
    if (same := np.isin(qi, xi)).any():
        order = np.argsort(xi)
        twin = order[np.searchsorted(xi, qi[same], sorter=order)]
    while len(a):
        old = qr.sum() + xr.sum()
        np.minimum.at(qr, a, xr[b])
        np.minimum.at(xr, b, qr[a])
        if same.any():
            low = np.minimum(qr[same], xr[twin])
            qr[same], xr[twin] = low, low
        if qr.sum() + xr.sum() == old:
            break
    out = pd.DataFrame({"id": np.concatenate([qi, xi]), "n": np.concatenate([qn, xn]), "root": np.concatenate([qr, xr])})
    return out[(out["n"] > 0) | (out["root"] != out["id"])]


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, probes: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: cosine links found, and where they lead.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    id, link with nothing. Vectors link only with vectors of their own length. Equal vectors are one
    vector with a weight until the end. Lists are fitted on a bounded sample; every vector is in the
    list of its nearest centre and probes the ``probes`` nearest lists (``how_many``); codes never lose a pair of
    a probed list, since their own errors widen the limit; links are decided by exact cosines. A list
    meets its probers in tiles of at most about TILE_ROWS on either side, each of which returns a
    row per linked vector, so a group of near copies costs no rows for its pairs.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0))
    key = [F.xxhash64("v").alias("k1"), F.hash("v").alias("k2"), F.size("v").alias("dim")]
    classes = stage(fine.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("w")), "classes")
    many = stage(classes.where("w > 1").select("id", "w", *key), "repeated")
    keyed = fine.select("vec_id", *key).join(many.withColumnRenamed("id", "rep"), ["k1", "k2", "dim"], "left")
    member = stage(keyed.select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("w", F.lit(1)).alias("w")), "member")
    linked = None
    for r in classes.groupBy(F.size("v").alias("dim")).count().collect():
        part = _links_of(classes.where(F.size("v") == r["dim"]), r["dim"], r["count"], threshold, probes)
        linked = part if linked is None else linked.unionByName(part)
    if linked is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    linked = stage(linked, "linked")
    found = linked.groupBy("id").agg(F.sum("n").alias("n")).select(F.col("id").alias("rep"), "n")
    components = connected_components(linked.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "component")
    per_rep = stage(found.join(components, "rep", "full"), "found")
    full = member.join(per_rep, "rep", "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    lost = rows.where(~(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("v")), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))))
    lost = lost.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.unionByName(lost).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links_of(classes: DataFrame, dim: int, count: int, threshold: float, probes: int | None) -> DataFrame:
    spark = classes.sparkSession
    lists, follow = how_many(count)
    most = max(FIT_ROWS, min(FIT_MOST, FIT_BYTES // (8 * dim)))
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(min(most, max(FIT_SAMPLE, FIT_ROWS * lists))).select("v").toArrow().column("v").combine_chunks()
    index = Index.fit(unit(sample.flatten().to_numpy().reshape(len(sample), dim)), min(lists, most // FIT_ROWS), probes or follow)

    def encode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, dim)
            lists, codes, error = index.encode(unit(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pack(x), pa.binary()), pa.array(lists.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(lists[:, 0].astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=["id", "w", "v", "lists", "own", "code", "error"])

    coded = stage(classes.select("id", "w", "v").mapInArrow(encode, "id long, w long, v binary, lists array<int>, own int, code binary, error double"), "coded")
    wide = coded.withColumn("list", F.explode("lists"))
    blocks = lambda c: F.ceil(F.col(c) / TILE_ROWS).cast("int")
    sizes = wide.groupBy("list").agg(F.count_if(F.col("list") == F.col("own")).alias("m"), F.count("*").alias("p")).where("m > 0")
    sizes = F.broadcast(stage(sizes.select("list", blocks("m").alias("ms"), blocks("p").alias("ps")), "sizes"))  # a row for each list
    deal = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    members = coded.join(sizes, coded["own"] == sizes["list"]).withColumn("mb", deal("ms")).withColumn("pb", upto("ps")).select("list", "mb", "pb", "id", "w", "v", "lists", "code", "error")
    members = members.toDF(*members.columns)  # columns of its own, as both sides come from one table
    probers = wide.join(sizes, "list").withColumn("pb", deal("ps")).withColumn("mb", upto("ms")).select("list", "mb", "pb", "id", "w", "v", "own")
    keys = ["list", "mb", "pb"]

    def tile(key, p, m):
        if p.empty or m.empty:
            return pd.DataFrame({"id": [], "n": [], "root": []})
        return tile_links(index, int(key[0]), dim, threshold, p, m)

    return probers.groupBy(keys).cogroup(members.groupBy(keys)).applyInPandas(tile, "id long, n long, root long")


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` linked at a cosine of 0.9."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
