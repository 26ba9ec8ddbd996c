"""Hard negatives, phrases and resharding against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.llm import collocations, negatives, resharding

# ---------------------------------------------------------------- 11

VECTORS = "vec_id long, embedding array<double>, label int, shard int, score long"


def hard_brute(rows, every, k=5, m=3, scale=256):
    there = [(i, [int(np.floor(scale * x)) for x in v], lab) for i, v, lab, *_ in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, v, lab in there:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (v, lab)), (v, lab))
    out = []
    for a, (v, lab) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, g) for i, w, g in there if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == lab][:k]:
            fits = [(n, i) for n, i, g in scored if g != lab and 50 * -s <= 100 * -n <= 95 * -s]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(fits[:m])]
    return sorted(out)


def vectors(n, dim, seed, near=0.6):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(12, dim))
    rows = [(i, [float(x) for x in near * heads[i % 12] + rng.normal(size=dim) * (1 - near)], int(rng.integers(3)), 7, 8) for i in range(n)]
    rows += [(30, None, 1, 0, 0), (None, [1.0] * dim, 1, 0, 0), (31, [float("nan")] * dim, 1, 0, 0), (40, [0.0] * dim, 1, 0, 0), (41, [0.0] * dim, 0, 0, 0), (32, [1.0] * dim, None, 0, 0), (33, [None] * dim, 1, 0, 0), (35, [], 1, 0, 0), (36, [], 2, 0, 0), (37, [1.0, 2.0], 2, 0, 0)]
    return rows + rows[5:9] * 3 + [rows[3]] * 30  # repeated rows, and ties of equal vectors with other ids


@pytest.mark.parametrize("shard_rows,anchor_rows", [(4096, 4096), (40, 7)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, shard_rows, anchor_rows):
    monkeypatch.setattr(negatives, "CLUSTER", 6)
    monkeypatch.setattr(negatives, "STRIDE", 16)
    rows = vectors(260, 8, 3)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = negatives.hard_negatives(df.where("vec_id % 5 = 0"), df, "vec_id", "embedding", "label", shard_rows=shard_rows, anchor_rows=anchor_rows)
    assert sorted(map(tuple, got.collect())) == hard_brute(rows, 5)
    none = df.limit(0)
    assert negatives.hard_negatives(none, df, "vec_id", "embedding", "label").isEmpty() and negatives.hard_negatives(df, none, "vec_id", "embedding", "label").isEmpty()


def test_walks_end_early_and_bounds_hold():
    rng = np.random.default_rng(1)
    heads = rng.normal(size=(40, 16)) * 100
    x = np.floor(heads[np.arange(4000) % 40] + rng.normal(size=(4000, 16)))
    members = x[:6] * 0 + np.floor(heads[3] + rng.normal(size=(6, 16)))
    bound = negatives.angular_bounds(members, x)
    assert (members @ x.T <= np.linalg.norm(members, axis=1)[:, None] * bound[None] * (1 + 1e-9) + 1e-6).all()
    member = np.arange(6)
    args = (member, np.full(6, negatives.LOWEST), np.full(6, 2**63 - 1), np.full(6, -1), np.zeros(6, int), True, members, np.arange(4000), np.zeros(4000, int), x, 5)
    at, score, name, formed = negatives.walk(*args)
    want = np.lexsort((np.broadcast_to(np.arange(4000), (6, 4000)), -(members @ x.T)), axis=1)[:, :5]
    assert (name.reshape(6, 5) == want).all() and formed < 6 * 4000 / 4


# ---------------------------------------------------------------- 12


def phrases_brute(rows, least, top=2000):
    counts = {}
    for lang, text, *_ in rows:
        c = counts.setdefault("und" if lang is None else lang, Counter())
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    c[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        n = sum(v for t, v in c.items() if len(t) == 1)
        longer = Counter()
        for t, v in c.items():
            if len(t) == 3 and v >= least:
                longer[t[:2]], longer[t[1:]] = max(longer[t[:2]], v), max(longer[t[1:]], v)
        found = []
        for t, a in c.items():
            if len(t) > 1 and a >= least and not (len(t) == 2 and 100 * longer[t] >= 50 * a):
                s, _, left, right = min((10**6 * a * a // (c[t[:k]] * c[t[k:]]), k, c[t[:k]], c[t[k:]]) for k in range(1, len(t)))
                found.append((s, a, " ".join(t), left, right))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, x[2], x[1], x[3], x[4], n, x[0]) for i, x in enumerate(found[:top])]
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    words = ["the", "The", "de", "été", "ÉTÉ", "a\x1cb", "x y", "new", "york", "city", "w" * 90, "don't", "日本", "-", "\x85"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "; "]
    rows = [(rng.choice(["en", "en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.choice([0, 1, 2, 5, 60, 200]))), i, "x") for i in range(80)]
    rows += [("en", None, 1, None), ("en", "", 2, None), (None, "  ,, ", 3, None), ("en", "x x x x x x x x x x x x x x", 4, None), ("fr", "New York City " * 12, 5, None), ("zz", None, 6, None)]
    return rows + rows[5:25] * 3


@pytest.mark.parametrize("ranked,side,slice_", [(1 << 17, 1024, 1 << 20), (3, 2, 50), (0, 2, 7), (8, 4, 64)])
def test_phrases_equal_brute_force(spark, monkeypatch, ranked, side, slice_):
    for name, value in {"RANKED": ranked, "SIDE": side, "SLICE": slice_, "GATHERED": 500}.items():
        monkeypatch.setattr(collocations, name, value)
    rows = texts(5)
    df = spark.createDataFrame(rows, "lang string, text string, a long, phrase string").repartition(3)
    assert sorted(map(tuple, collocations.phrases(df, least=4).collect())) == phrases_brute(rows, 4)


def test_phrases_of_nothing_and_of_few_places(spark):
    rows = texts(6)
    df = spark.createDataFrame(rows, "lang string, text string, a long, phrase string")
    assert sorted(map(tuple, collocations.phrases(df, least=3, top=4).collect())) == phrases_brute(rows, 3, 4)
    assert collocations.phrases(df.limit(0)).isEmpty()


def test_scores_beyond_64_bits_are_exact(spark):
    rows = [(10**13 + 7, 10**13 + 9, 3 * 10**13 + 1), (4 * 10**12, 4 * 10**12, 4 * 10**12), (11, 13, 17)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(collocations.score_of("a", "l", "r")).collect()
    assert [r[0] for r in got] == [10**6 * a * a // (x * y) for a, x, y in rows]


def test_tiles_count_pairs():
    rng = np.random.default_rng(2)
    a, b = rng.zipf(1.2, 300_000) % 3000, rng.zipf(1.2, 300_000) % 3000
    a[:9], b[5:20] = collocations.HASHED + 5, collocations.HASHED + 9
    want, got = Counter(zip(a.tolist(), b.tolist(), strict=True)), Counter()
    for x, y, n in collocations.count_tiles(a, b):
        for p, q, m in zip(x.tolist(), y.tolist(), n.tolist(), strict=True):
            got[p, q] += m
    assert got == want


# ---------------------------------------------------------------- 13


def test_flow_is_the_cheapest():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.choice([2, 3, 4])
        supply = [1] * n
        cost = [[rng.randint(0, 6) for _ in range(n)] for _ in range(n)]
        flow = resharding.min_cost_flow(supply, [1] * n, cost)
        assert [sum(x) for x in flow] == supply and [sum(x) for x in zip(*flow, strict=True)] == [1] * n
        assert sum(f * c for x, y in zip(flow, cost, strict=True) for f, c in zip(x, y, strict=True)) == min(sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(n)))
    for _ in range(40):  # unit costs: all that exceeds a shard's goal moves, and nothing else
        supply = [rng.choice([0, 5, 1000, 12345]) for _ in range(6)]
        goal = resharding.shares_of(sum(supply), [1] * 9)
        flow = resharding.min_cost_flow(supply, goal, [[float(i != j) for j in range(9)] for i in range(6)])
        assert [sum(x) for x in flow] == supply and sum(goal) == sum(supply) and max(goal) - min(goal) <= 1
        assert sum(f for i, x in enumerate(flow) for j, f in enumerate(x) if i != j) == sum(max(0, s - goal[i]) for i, s in enumerate(supply))
    with pytest.raises(ValueError):
        resharding.min_cost_flow([5], [4], [[0.0]])


def layout(table):
    return {(r["shard"], r["file"], r["place"]): tuple(r["row"]) for r in table.read().collect()}


def test_resharding_moves_the_least_and_keeps_all_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(resharding, "FILE_ROWS", 40)
    rng = random.Random(9)
    rows = [(i, None if i % 50 == 0 else "" if i % 33 == 0 else "é" * rng.randint(1, 60) + "x" * (i % 7), i % 3, "s", "f") for i in range(900)] + [(5, "same", 1, "s", "f")] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, row string, file string").repartition(7)
    table = resharding.ShardedTable(spark, f"{tmp_path}/t")
    table.write(df, "octet_length(coalesce(text, '')) + 8", 5)
    bag = Counter(tuple(r) for r in df.collect())
    old, before, old_version = layout(table), table.sizes(table.version()), table.version()
    for weights in ([1] * 8, [1, 2, 3], [1] * 3, [1] * 12):
        was, from_ = table.version(), layout(table)
        start = table.sizes(was)
        v = table.reshard(weights)
        now = layout(table)
        assert Counter(now.values()) == bag
        goal, sizes = resharding.shares_of(sum(before), weights), table.sizes(v)
        assert max(abs(a - b) for a, b in zip(goal, sizes, strict=True)) < 3 * 130
        stay = sum(n for n in (Counter((k[0], r) for k, r in from_.items()) & Counter((k[0], r) for k, r in now.items())).values())
        weight = lambda c: sum(n * (len((r[1] or "").encode()) + 8) for (_, r), n in c.items())
        kept = weight(Counter((k[0], r) for k, r in from_.items()) & Counter((k[0], r) for k, r in now.items()))
        least = sum(max(0, s - (goal[i] if i < len(goal) else 0)) for i, s in enumerate(start))
        assert stay and sum(start) - kept <= least + 130 * len(goal)
        slots = {}
        for r in table.slots(F.col("row.doc_id").alias("d")).collect():
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(len(weights)))
    assert layout_of(table, old_version) == old  # an older version is there until its files are deleted
    assert table.vacuum() > 0 and Counter(layout(table).values()) == bag


def layout_of(table, version):
    return {(r["shard"], r["file"], r["place"]): tuple(r["row"]) for r in table.read(version).collect()}


def test_a_reshard_that_dies_leaves_the_old_shards(spark, tmp_path, monkeypatch):
    table = resharding.ShardedTable(spark, f"{tmp_path}/t")
    table.write(spark.range(300).selectExpr("id AS doc_id", "repeat('x', CAST(id AS INT)) AS text"), "length(text) + 8", 4)
    old = layout(table)
    monkeypatch.setattr(table, "_commit", lambda v: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.reshard([1] * 6)
    assert layout(table) == old
    again = resharding.ShardedTable(spark, f"{tmp_path}/t")
    again.reshard([1] * 6)
    sizes = again.sizes(again.version())
    assert len(sizes) == 6 and max(sizes) - min(sizes) < 310 and Counter(layout(again).values()) == Counter(old.values())


def test_resharding_of_nothing_and_of_one_huge_row(spark, tmp_path):
    empty = resharding.ShardedTable(spark, f"{tmp_path}/e")
    empty.write(spark.createDataFrame([], "doc_id long, text string"), "8", 4)
    empty.reshard([1] * 6)
    assert empty.slots(F.col("row.doc_id")).isEmpty()
    one = resharding.ShardedTable(spark, f"{tmp_path}/o")
    one.write(spark.createDataFrame([(1, "y" * 3_000_000), (2, "a"), (3, "b")], "doc_id long, text string").coalesce(1), "length(text) + 8", 2)
    one.reshard([1] * 3)
    got = {r["doc_id"]: r["shard"] for r in one.slots(F.col("row.doc_id")).collect()}
    assert len(got) == 3 and got[1] not in (got[2], got[3])


# ---------------------------------------------------------------- the queries themselves, on tables as they are registered


def test_queries_return_what_they_promise(spark, tmp_path):
    docs = [(i, t, lang, "s", None) for i, (lang, t, *_) in enumerate(texts(8))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([r[:3] for r in vectors(120, 8, 5)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = negatives.op11_negatives(spark, str(tmp_path))
    rows = [(i, v, None if lab is None else (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for i, v, lab, *_ in vectors(120, 8, 5)]
    assert sorted(map(tuple, got.collect())) == hard_brute(rows, 50)
    assert sorted(map(tuple, collocations.op12_collocations(spark, str(tmp_path)).collect())) == phrases_brute([(r[2], r[1]) for r in docs], 10)
    put = resharding.op13_resharding(spark, str(tmp_path)).collect()
    want = {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "bytes", None) for i, t, *_ in docs}
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in put} == want and len(put) == len(docs)
    for s in {r["shard"] for r in put}:
        assert sorted(r["slot"] for r in put if r["shard"] == s) == list(range(sum(r["shard"] == s for r in put)))
