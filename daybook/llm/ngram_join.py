"""Exact Jaccard self-join of word-shingle sets, filtered under several global token orders.

Sets A and B with J(A, B) >= t share a token among the first n - ceil(t n) + 1 of either,
in any global order. Order 0 makes candidates by a join on those prefix tokens; candidates
must then share prefix tokens under orders 1 and 2 also before their whole sets are compared.
In all three, tokens that many documents share come last, so a passage that is found
everywhere makes few candidates; in which order tokens stand never changes the result. A last
filter compares parity bitmaps, whose Hamming distance never exceeds the sets' symmetric difference.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import connected_components, forget, lean, stage
from daybook.llm.shingles import ODD, mix, shingle_sets

#: At most so many tokens are known as frequent; they only come last in the orders.
FREQUENT_TOKENS = 1 << 18
#: A task reports tokens that it meets twice among COUNTED; reported FREQUENT times, a token is frequent.
COUNTED, FREQUENT = 2_000_000, 16
#: Larger buckets are compared in tiles of numpy arrays, smaller ones by a join.
SMALL_BUCKET = 64
HALF = np.uint64(1 << 63)
TILE_ROWS = 1024
BLOOM_BITS = 1 << 25


def ceil_share(n: np.ndarray, t: Fraction) -> np.ndarray:
    return -((-n * t.numerator) // t.denominator)


def is_near(inter: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, t: Fraction):
    """J >= t for sets of sizes a and b, in whole numbers."""
    return t.denominator * inter >= t.numerator * (a + b - inter)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, the same in any order."""
    return tuple(int(mix(x).sum(dtype=np.uint64).view(np.int64)) for x in (s * ODD[3], s ^ ODD[4]))


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """kind 0: (id, n, fp1, fp2) of every document; kind 1: (fp1 = token, n = its local count)."""
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64())])

    def frequent(held):
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        many = counts >= 2
        k = int(many.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.array(counts[many].astype(np.int64)), pa.array(tokens[many].view(np.int64)), pa.array(np.zeros(k, np.int64))], schema=schema)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            n, fp1, fp2 = [], [], []
            for s in shingle_sets(batch.column(1), words):
                n.append(len(s))
                x, y = fingerprint(s)
                fp1.append(x)
                fp2.append(y)
                held.append(s[: np.searchsorted(s, HALF)])  # where order 0 finds its prefixes
                size += len(held[-1])
                if size >= COUNTED:
                    yield frequent(held)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0), pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64())], schema=schema)
        if held:
            yield frequent(held)

    return docs.mapInArrow(lean(run), "kind int, id long, n long, fp1 long, fp2 long")


def frequent_tokens(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT_TOKENS most frequent of the reported tokens, sorted, and their counts."""
    top = counted.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(FREQUENT_TOKENS).toPandas()
    tokens = top["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], top["n"].to_numpy(dtype=np.int64)[order]


def parity(tokens: np.ndarray) -> bytes:
    """A bitmap of about one bit a token, each the parity of the tokens that fall there."""
    bits = max(64, 1 << (len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((mix(tokens ^ ODD[10]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference; the larger bitmap is folded to the smaller's size."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def late_places(tokens: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Each frequent token's place behind all others, for the three orders: by count, then by its rank there."""
    out = []
    for rank in (tokens, mix(tokens ^ ODD[5]), mix(tokens ^ ODD[6])):
        place = np.empty(len(tokens), dtype=np.int64)
        place[np.lexsort((rank, counts))] = np.arange(len(tokens))
        out.append(place)
    return out


def first_of(rank: np.ndarray, at: np.ndarray, late: np.ndarray, length: int) -> np.ndarray:
    """Places of the ``length`` first tokens of a set, those at ``at`` come behind all others, by ``late``.

    Ranks are one-to-one images of the tokens, so the order is strict: all sets agree on it.
    """
    if not len(at):
        return np.argpartition(rank, length - 1)[:length] if length < len(rank) else np.arange(len(rank))
    early = np.ones(len(rank), dtype=bool)
    early[at] = False
    early = np.flatnonzero(early)
    if length <= len(early):
        return early[np.argpartition(rank[early], length - 1)[:length]]
    return np.concatenate([early, at[np.argsort(late)[: length - len(early)]]])


def prefixes(docs: DataFrame, words: int, t: Fraction, frequent: tuple[np.ndarray, np.ndarray], copies: np.ndarray) -> DataFrame:
    """(id, n, fp1, fp2, maybe, p0, p1, p2, parity): each set's prefix under the three orders; p1 and p2 as
    16-bit digests. maybe: the id may be in ``copies``, a packed bit array."""
    tokens, counts = frequent
    late = late_places(tokens, counts)
    mask = np.uint64((1 << 22) - 1)
    listed = np.zeros(1 << 22, dtype=bool)
    listed[(tokens & mask).astype(np.int64)] = True
    known = np.packbits(listed)
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("maybe", pa.bool_()), ("p0", pa.list_(pa.int64())), ("p1", pa.binary()), ("p2", pa.binary()), ("parity", pa.binary())])

    def run(batches):
        for batch in batches:
            rows, ids = [], batch.column(0).to_numpy(zero_copy_only=False)
            for i, m, s in zip(ids.tolist(), in_bloom(copies, ids).tolist(), shingle_sets(batch.column(1), words), strict=True):
                if not len(s):
                    continue
                length = len(s) - int(ceil_share(np.int64(len(s)), t)) + 1
                at, where = np.flatnonzero(bit_at(known, (s & mask).astype(np.int64))), np.empty(0, np.int64)
                if len(at):
                    where = np.minimum(np.searchsorted(tokens, s[at]), len(tokens) - 1)
                    hit = tokens[where] == s[at]
                    at, where = at[hit], where[hit]
                first = [first_of(rank, at, places[where], length) for rank, places in zip((s, mix(s ^ ODD[5]), mix(s ^ ODD[6])), late, strict=True)]
                behind = np.full(len(s), -1, dtype=np.int64)
                behind[at] = late[0][where]
                p0 = first[0][np.lexsort((s[first[0]], behind[first[0]]))]
                rows.append((i, len(s), *fingerprint(s), m, s[p0].view(np.int64), *((mix(s[f]) >> np.uint64(48)).astype("<u2").tobytes() for f in first[1:]), parity(s)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(lean(run, 1 << 20), "id long, n int, fp1 long, fp2 long, maybe boolean, p0 array<long>, p1 binary, p2 binary, parity binary")


def _fits(na, pa_, nb, pb, t: Fraction):
    """Columns or arrays: sizes are near enough, and a common prefix token at these places leaves
    enough of both sets before and behind it."""
    num, den = t.numerator, t.denominator
    low = F.least if not isinstance(na, np.ndarray) else np.minimum
    high = F.greatest if not isinstance(na, np.ndarray) else np.maximum
    most = low(pa_, pb) + low(na - pa_, nb - pb)
    return (low(na, nb) * den >= high(na, nb) * num) & (most * (den + num) >= (na + nb) * num)


def share_prefixes(pairs: DataFrame, digests: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) that have common prefix tokens under orders 1 and 2 also, and whose parity
    bitmaps allow the similarity."""

    def run(batches):
        for batch in batches:
            keep = []
            for n, m, x, y, x1, x2, y1, y2 in zip(*(batch.column(c).to_pylist() for c in ("xn", "yn", "x", "y", "x1", "x2", "y1", "y2")), strict=True):
                read = lambda v: np.frombuffer(v, dtype="<u2")
                near = least_difference(x, y) * (t.denominator + t.numerator) <= (n + m) * (t.denominator - t.numerator)
                keep.append(bool(near and np.isin(read(x1), read(y1)).any() and np.isin(read(x2), read(y2)).any()))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda k, v: digests.select(F.col("id").alias(k), F.col("n").alias(f"{v}n"), F.col("parity").alias(v), F.col("p1").alias(f"{v}1"), F.col("p2").alias(f"{v}2"))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    return both.select("a", "b", "xn", "yn", "x", "y", "x1", "x2", "y1", "y2").mapInArrow(lean(run, 1 << 20), "a long, b long")


def places(x: np.ndarray) -> list[np.ndarray]:
    return [(mix(x.view(np.uint64) ^ ODD[k]) & np.uint64(BLOOM_BITS - 1)).astype(np.int64) for k in (7, 8, 9)]


def bit_at(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bits of a packed array at these places."""
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def bloom_of(ids: DataFrame) -> np.ndarray:
    """A packed bit array of fixed size that holds all ids; partial ones are joined chunk by chunk."""
    chunk = BLOOM_BITS // 8 // 64

    def run(batches):
        bits = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)
        for batch in batches:
            for at in places(batch.column(0).to_numpy(zero_copy_only=False)) if batch.num_rows else ():
                np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        parts = [(k, bits[k * chunk : (k + 1) * chunk].tobytes()) for k in range(64) if bits[k * chunk : (k + 1) * chunk].any()]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=["chunk", "bits"])

    def either(key, frames):
        bits = np.zeros(chunk, dtype=np.uint8)
        for data in frames["bits"]:
            bits |= np.frombuffer(data, dtype=np.uint8)
        frames = frames.head(1).copy()
        frames["bits"] = [bits.tobytes()]
        return frames

    parts = ids.mapInArrow(lean(run), "chunk int, bits binary").groupBy("chunk").applyInPandas(either, "chunk int, bits binary").collect()
    bits = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)
    for r in parts:
        bits[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.frombuffer(r["bits"], np.uint8)
    return bits


def in_bloom(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([bit_at(packed, at) for at in places(ids)])


def verify(pairs: DataFrame, docs: DataFrame, words: int, t: Fraction) -> DataFrame:
    """The pairs (a, b), staged, whose whole sets have J >= t. Only texts of their ids, found by a bit
    array of fixed size before any shuffle, become sets again."""
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    packed = bloom_of(ids)

    def sets(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_bloom(packed, batch.column(0).to_numpy(zero_copy_only=False))))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shingle_sets(batch.column(1), words)], pa.binary())], names=["id", "tokens"])

    whole = stage(docs.mapInArrow(lean(sets, 1 << 20), "id long, tokens binary").join(ids, "id", "left_semi").distinct(), "sets")

    def tokens_of(column):
        offsets, data = np.frombuffer(column.buffers()[1], np.int32)[column.offset :], np.frombuffer(column.buffers()[2] or b"", np.uint8)
        return [data[a:b].view(np.uint64) for a, b in zip(offsets[: len(column)].tolist(), offsets[1 : len(column) + 1].tolist(), strict=True)]

    def near(batches):
        for batch in batches:
            keep = []
            for x, y in zip(tokens_of(batch.column("x")), tokens_of(batch.column("y")), strict=True):
                both = np.sort(np.concatenate([x, y]))
                keep.append(bool(is_near(int((both[1:] == both[:-1]).sum()), len(x), len(y), t)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda k, v: whole.select(F.col("id").alias(k), F.col("tokens").alias(v))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y")
    found = stage(both.mapInArrow(lean(near), "a long, b long"), "links")
    forget(ids, whole)
    return found


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: str = "0.8") -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    Two documents link when the Jaccard similarity of their shingle sets is at least ``threshold``
    (decided in whole numbers); component_id is the smallest id that links lead to. Null and
    blank texts have empty sets and link with nothing; a row with a null id has a null
    component and links with nothing. Rows that repeat an id count as one document, of all their
    texts' links; each row has its own text's n_shingles.

    Equal sets fall together first, by a 128-bit fingerprint. Then each bucket of documents with a
    common prefix token is compared with its smallest id only: in a large group of near copies, that
    alone joins almost all. Pairs in a bucket that are still in different components
    are compared in a second round, so no link between components is lost, while the number of
    pairs stays near the number of rows. Buckets above SMALL_BUCKET go by tiles of
    bounded size, over as many tasks as they need.
    """
    t = Fraction(threshold)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    both = stage(profiles(rows, words), "profiles")
    every = both.where("kind = 0").select("id", "n", "fp1", "fp2")
    frequent = frequent_tokens(both.where("kind = 1").select(F.col("fp1").alias("token"), "n"))
    fp = ["n", "fp1", "fp2"]
    classes = stage(every.where("n > 0 AND id IS NOT NULL").groupBy(fp).agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").select(*fp, "rep"), "classes")
    member = stage(every.join(classes, fp, "left").select("id", *fp, F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")), "member")
    copies = stage(member.where("id <> rep").select("id", "fp1", "fp2"), "copies")
    # ids of several texts tie the texts' classes together
    several = stage(member.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("c"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("c > 1").select("id", "lo", "hi"), "several")
    ties = stage(member.join(several.where("lo <> hi").select("id", "lo"), "id").where("rep <> lo").select(F.col("rep").alias("a"), F.col("lo").alias("b")).distinct(), "ties")
    named = rows.where("id IS NOT NULL")
    made = stage(prefixes(named, words, t, frequent, bloom_of(copies)), "digests")
    if not several.isEmpty():
        made = stage(made.dropDuplicates(["id", "fp1", "fp2"]), "digests")
    digests = made.where("NOT maybe").unionByName(made.where("maybe").join(copies, ["id", "fp1", "fp2"], "left_anti"))

    entries = digests.select("id", "n", F.posexplode("p0").alias("pos", "token"))
    common = stage(entries.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "common")
    buckets = stage(_held(entries, "token", bloom_of(common.select("token"))).join(common, "token"), "entries")
    pivots = stage(buckets.groupBy("token").agg(F.min(F.struct("id", "n", "pos")).alias("least")).select("token", F.col("least.id").alias("pid"), F.col("least.n").alias("pn"), F.col("least.pos").alias("ppos")), "pivots")
    stars = (
        buckets.join(pivots, "token")
        .where(F.col("id") != F.col("pid"))
        .where(_fits(F.col("n"), F.col("pos"), F.col("pn"), F.col("ppos"), t))
        .select(F.col("id").alias("a"), F.col("pid").alias("b"))
        .distinct()
    )
    stars = stage(stars, "stars")
    candidates = stage(share_prefixes(stars, made, t).distinct(), "candidates")
    found = verify(candidates, named, words, t)
    components = connected_components(found.unionByName(ties))
    forget(both, classes, copies, several, common, pivots, candidates)

    label = components.select(F.col("node").alias("id"), "component")
    labelled = stage(buckets.join(label, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component"), "labelled")
    open_ = stage(labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token"), "open")
    live = labelled.join(open_, "token", "left_semi")
    x, y = live.where(F.col("c") <= SMALL_BUCKET).alias("x"), live.where(F.col("c") <= SMALL_BUCKET).alias("y")
    few = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.id") > F.col("y.id")) & (F.col("x.label") != F.col("y.label")) & _fits(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), t)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    many = _tiled_pairs(live.where(F.col("c") > SMALL_BUCKET), made.select("id", "parity"), t)
    rest = stage(few.unionByName(many).distinct().join(stars, ["a", "b"], "left_anti"), "rest")
    forget(buckets, labelled, open_, stars)
    if not rest.isEmpty():
        candidates = stage(share_prefixes(rest, made, t).distinct(), "candidates")
        more = verify(candidates, named, words, t)
        if not more.isEmpty():
            forget(components)
            components = connected_components(found.unionByName(more).unionByName(ties))
        forget(candidates, more)
    forget(made, rest, found, ties)
    to = components.select(F.col("node").alias("rep"), "component")
    return member.join(to, "rep", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def _held(df: DataFrame, col: str, packed: np.ndarray) -> DataFrame:
    """The rows whose ``col`` may be in the bit array: what a join would drop goes before its shuffle."""
    at = df.columns.index(col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bloom(packed, batch.column(at).to_numpy(zero_copy_only=False))))

    return df.mapInArrow(lean(run), df.schema)


def _tiled_pairs(live: DataFrame, bitmaps: DataFrame, t: Fraction) -> DataFrame:
    """Pairs of different labels in large buckets: blocks of about TILE_ROWS rows meet in tiles, and only
    pairs whose parity bitmaps allow the similarity leave them."""
    blocks = F.ceil(F.col("c") / TILE_ROWS).cast("int")
    dealt = live.join(bitmaps, "id").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def tile(f):
        i, j = int(f["i"].iloc[0]), int(f["j"].iloc[0])
        left, right = f[f["own"] == i], f[f["own"] == j]
        out = [np.empty((0, 2), np.int64)]
        for _, some in right.groupby(right["parity"].map(len)):
            rn, rp, rl, ri = (some[c].to_numpy(dtype=np.int64) for c in ("n", "pos", "label", "id"))
            whole = np.frombuffer(b"".join(some["parity"]), np.uint8).reshape(len(some), -1)
            folded = {whole.shape[1]: whole}
            for n, p, lab, k, mine in left[["n", "pos", "label", "id", "parity"]].itertuples(index=False):
                ok = np.flatnonzero((rl != lab) & (ri < k if i == j else ri != k) & _fits(np.full(len(rn), n), np.full(len(rn), p), rn, rp, t))
                if not len(ok):
                    continue
                own, size = np.frombuffer(mine, np.uint8), whole.shape[1]
                while len(own) > size:
                    own = own[: len(own) // 2] ^ own[len(own) // 2 :]
                while size > len(own):
                    if size // 2 not in folded:
                        folded[size // 2] = folded[size][:, : size // 2] ^ folded[size][:, size // 2 :]
                    size //= 2
                apart = np.bitwise_count(folded[size][ok] ^ own).sum(axis=1, dtype=np.int64)
                ok = ok[apart * (t.denominator + t.numerator) <= (rn[ok] + n) * (t.denominator - t.numerator)]
                out.append(np.stack([np.maximum(k, ri[ok]), np.minimum(k, ri[ok])], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    return tiles.groupBy("token", "i", "j").applyInPandas(tile, "a long, b long")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` linked at a Jaccard similarity of 0.9 of their 3-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, words=3, threshold="0.9").withColumnRenamed("id", "doc_id")
