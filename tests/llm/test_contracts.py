"""The queries of the earlier operators on small tables of the driver's kind: columns, rows and values against plain code."""

import base64
import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from daybook.llm import html_text, ngram_join, packing, toxicity, vector_dedup, warc

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Some rows of each table, with copies and nulls."""
    folder = tmp_path_factory.mktemp("small")

    def put(name, rows, more):
        t = pq.read_table(f"{SF}/{name}.parquet")
        kept = t.slice(0, rows).to_pylist()
        pq.write_table(pa.Table.from_pylist(kept + more(kept), schema=t.schema.remove_metadata()), f"{folder}/{name}.parquet")

    put("documents", 80, lambda k: [{**k[3], "doc_id": 9001}, {**k[4], "doc_id": 9002, "text": None}, {**k[5], "doc_id": 9003, "text": ""}, {**k[6], "doc_id": 9004, "text": "two words", "lang": None}])
    put("pages", 30, lambda k: [{**k[1], "page_id": 9001}, {**k[2], "page_id": 9002, "html": None}, {**k[2], "page_id": 9003, "html": None}])
    put("embeddings", 120, lambda k: [{**k[0], "vec_id": 9001}, {**k[1], "vec_id": 9002, "embedding": None}, {**k[2], "vec_id": 9003, "embedding": [x * 2 for x in k[2]["embedding"]]}, {**k[2], "vec_id": 9004, "embedding": [0.0] * 64}])
    put("labels", 10_000, lambda k: [])
    return str(folder)


def rows(small, name):
    return pq.read_table(f"{small}/{name}.parquet").to_pylist()


def least(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_op1(spark, small):
    got = {r["page_id"]: r for r in warc.op1_warc(spark, small).collect()}
    pages = {p["page_id"]: (p["html"] or "").encode() for p in rows(small, "pages")}
    assert set(got) == set(pages)
    for i, body in pages.items():
        first = min(j for j, b in pages.items() if b == body)
        want = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first == i else "revisit", None if first == i else first)
        assert tuple(got[i][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want


def test_op3(spark, small):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.op3_ngram_join(spark, small).collect()}
    sets = {}
    for d in rows(small, "documents"):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d["text"] or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets[d["doc_id"]] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    root = least(ids, links)
    assert links and got == {i: (len(sets[i]), root[i]) for i in ids}


def test_op4(spark, small):
    got = {r["page_id"]: r for r in html_text.op4_html_text(spark, small).collect()}
    assert set(got) == {p["page_id"] for p in rows(small, "pages")}
    assert all(r["n_chars"] == len(r["text"]) and r["text"] == r["text"].strip() and "<p" not in r["text"] for r in got.values()) and got[9002]["text"] == ""
    assert sum(r["n_chars"] > 100 for r in got.values()) > 20


def test_op5(spark, small):
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.op5_vector_dedup(spark, small).collect()}
    vectors = {e["vec_id"]: np.array(e["embedding"], dtype=np.float64) for e in rows(small, "embeddings") if e["embedding"] is not None and any(e["embedding"])}
    ids = [e["vec_id"] for e in rows(small, "embeddings")]
    links = [(a, b) for a in vectors for b in vectors if a < b and vectors[a] @ vectors[b] >= 0.9 * np.linalg.norm(vectors[a]) * np.linalg.norm(vectors[b])]
    root = least(ids, links)
    assert len(links) >= 2 and got == {i: (sum(i in p for p in links), root[i], root[i] == i) for i in ids}


def test_op6(spark, small):
    got = toxicity.op6_toxicity(spark, small).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d["doc_id"] for d in rows(small, "documents"))
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op8(spark, small):
    bins, pieces = {}, {}
    for r in packing.op8_packing(spark, small).collect():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    assert set(pieces) == {d["doc_id"] for d in rows(small, "documents")} and pieces[9002] == [(0, 0, 1)]
    for places in bins.values():
        ends = np.cumsum([0, *(n for _, n in sorted(places))])
        assert [o for o, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= 4096
    for of in pieces.values():
        assert all(n == 4096 for _, _, n in sorted(of)[:-1]) and [p for p, _, _ in sorted(of)] == list(range(len(of)))
    total = sum(n for p in bins.values() for _, n in p)
    assert len(bins) <= -(-total // 4096) + 1
