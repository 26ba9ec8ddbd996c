"""Each operator against brute force, exact round trips or held-out accuracy, on small inputs with
nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from daybook.llm import html_text, line_dedup, ngram_join, packing, pieces, token_ledger, topk, toxicity, vector_dedup, warc
from daybook.llm.common import connected_components, stage

DOCS = "doc_id long, text string"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (300, 301), (301, 300), (None, 3)]
    got = dict(rows_of(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    nodes = {x for e in edges for x in e if x is not None} - {7} | {7}
    want = union_find(nodes, [e for e in edges if None not in e])
    assert got == {n: want[n] for n in got} and set(got) == {n for n in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1


def test_warc_round_trip(spark, tmp_path):
    pages = [(3, "http://a", "<p>x</p>", "e"), (1, "http://b\r\nX: y", "<p>x</p>", "e"), (2, None, None, None), (5, "u", "", "e"), (4, "v", "é" * 9000 + "\r\n\r\nWARC/1.1\r\n", "e"), (None, "w", "<p>x</p>", "e"), (1, "http://b", "<p>x</p>", "e")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, record string")
    warc.write_warc(df, f"{tmp_path}/w", "page_id", "url", "html", records_per_file=2)
    back = warc.read_warc(spark, f"{tmp_path}/w", with_payload=True).collect()
    assert {r["kind"] for r in back} == {"record"} and len(back) == len(pages)
    for r in back:
        mine = next(p for p in pages if str(p[0]) == r["row_id"] or p[0] is None and r["row_id"] == "none")
        body = (mine[2] or "").encode()
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = min((p[0] for p in pages if (p[2] or "") == (mine[2] or "") and p[0] is not None))
        assert (r["warc_type"], r["refers_to"]) == (("response", None) if mine[0] == first else ("revisit", str(first)))
        if r["warc_type"] == "response":
            assert r["payload"] == body
    marked = warc.mark_revisits(df, "page_id", "html", min_bytes=9).where("page_id = 3").first()
    assert marked["refers_to"] is None


def _record(n: int, body: bytes) -> bytes:
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    digest = base64.b32encode(hashlib.sha1(body).digest())
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:row:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, digest, len(block), block)


def test_salvage_recovers_later_records_and_reports_gaps():
    whole = [_record(i, b"body %d" % i) for i in range(4)]
    broken = whole[1].replace(b"body 1", b"bodX 1")
    data = whole[0] + broken + b"junk\n" + whole[2] + whole[3][:-9]
    got = list(warc.salvage(data))
    assert [h["warc-record-id"] for kind, *_, h, _ in got if kind == "record"] == ["<urn:row:0>", "<urn:row:2>"]
    gaps = [(a, b) for kind, a, b, *_ in got if kind == "gap"]
    assert gaps[0][0] == len(whole[0]) and gaps[-1][1] == len(data)
    assert sum(b - a for _, a, b, *_ in got) == len(data)


def test_salvage_of_gzip_members():
    members = [gzip.compress(_record(i, b"x" * 500 + b"%d" % i)) for i in range(3)]
    bad = bytearray(members[1])
    bad[len(bad) // 2] ^= 255
    got = list(warc.salvage(members[0] + bytes(bad) + members[2]))
    assert [h["warc-record-id"] for kind, *_, h, _ in got if kind == "record"][0] == "<urn:row:0>"
    assert "<urn:row:2>" in [h["warc-record-id"] for kind, *_, h, _ in got if kind == "record"]
    assert [a for kind, a, *_ in got if kind == "gap"] == [len(members[0])]
    assert list(warc.salvage(b"")) == []


def test_salvage_goes_on_across_members_and_plain_parts():
    ids = lambda data: [h["warc-record-id"][9:-1] for kind, *_, h, _ in warc.salvage(data) if kind == "record"]
    plain = [_record(i, b"body %d" % i) for i in range(6)]
    members = [gzip.compress(x) for x in plain]
    assert ids(b"\0" + members[0][1:] + members[1] + members[2]) == ["1", "2"]
    assert ids(b"junk" + members[0] + members[1]) == ["0", "1"]
    mixed = plain[0] + members[1] + plain[2].replace(b"body", b"bodX") + members[3] + b"junk\n" + plain[4] + members[5]
    assert ids(mixed) == ["0", "1", "3", "4", "5"]
    two = gzip.compress(plain[0].replace(b"body", b"bodX") + plain[1])
    gap = next(x for x in warc.salvage(two) if x[0] == "gap")
    assert f"bytes 0 to {len(plain[0])} of" in gap[3] and ids(two) == ["1"]


def test_damage_in_a_written_archive_costs_one_record(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://{i}", f"<p>{i}</p>" * 50) for i in range(9)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(df, f"{tmp_path}/w", "page_id", "url", "html")
    found = [f for f in (tmp_path / "w").glob("part-*")]
    data = max((f.read_bytes() for f in found), key=len)
    whole = [x for x in warc.salvage(data) if x[0] == "record"]
    assert gzip.decompress(data).count(b"WARC/1.1") == len(whole) > 1
    at = (whole[0][1] + whole[0][2]) // 2
    left = [x for x in warc.salvage(data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :]) if x[0] == "record"]
    assert [x[4]["warc-record-id"] for x in left][-len(whole) + 1 :] == [x[4]["warc-record-id"] for x in whole[1:]]


# ---------------------------------------------------------------- 2


def test_ledger_is_additive_and_idempotent(spark, tmp_path):
    ledger = token_ledger.TokenLedger(spark, f"{tmp_path}/l")
    assert ledger.totals().count() == 0
    schema = "op string, doc_id long, tokenizer_version string, source string, lang string, tokens long"
    one = spark.createDataFrame([("insert", 1, "v", "s", "en", 10), ("insert", 2, "v", "s", "en", 5), ("insert", 3, "v", None, None, None), ("insert", None, "v", "s", "en", 9)], schema)
    two = spark.createDataFrame([("revise", 1, "v", "t", "en", 7), ("delete", 2, "v", None, None, None), ("delete", 9, "v", None, None, None), ("bad", 1, "v", "s", "en", 1)], schema)
    assert ledger.commit("a", one) and ledger.commit("b", two) and not ledger.commit("a", one)
    want = {(None, None, "v", 1, 0), ("t", "en", "v", 1, 7)}
    assert set(rows_of(ledger.totals().select("source", "lang", "tokenizer_version", "documents", "tokens"))) == want
    again = token_ledger.TokenLedger(spark, f"{tmp_path}/l")
    assert not again.commit("b", two) and set(rows_of(again.totals().select("source", "lang", "tokenizer_version", "documents", "tokens"))) == want


def test_ledger_follows_a_dictionary_through_merges_and_rivals(spark, tmp_path):
    schema = "op string, doc_id long, tokenizer_version string, source string, lang string, tokens long"
    ledger, state = token_ledger.TokenLedger(spark, f"{tmp_path}/l", buckets=4, merge_after=3), {}
    rival = token_ledger.TokenLedger(spark, f"{tmp_path}/l", buckets=4)
    for n in range(5):
        rows = [("delete" if (i + n) % 4 == 0 else "revise", i, f"v{i % 2}", f"s{(i + n) % 3}", "en", 10 * i + n) for i in range(n, 12, 2)]
        assert ledger.commit(f"b{n}", spark.createDataFrame(rows, schema))
        for op, i, v, s, la, t in rows:
            state.pop((i, v), None) if op == "delete" else state.update({(i, v): (s, la, t)})
    # a rival whose number has been taken starts anew, over the newer state
    load, rival._load = rival._load, lambda: None
    rival._commits = []
    assert not rival._record("late", [], [])
    rival._load = load
    assert rival.commit("late", spark.createDataFrame([("insert", 99, "v0", "s9", "en", 3)], schema)) and not ledger.commit("late", spark.createDataFrame([], schema))
    state[(99, "v0")] = ("s9", "en", 3)
    got = {(r["doc_id"], r["tokenizer_version"]): (r["source"], r["lang"], r["tokens"]) for r in ledger.counts().collect()}
    assert got == state
    sums = {}
    for (_, v), (s, la, t) in state.items():
        d, k = sums.get((s, la, v), (0, 0))
        sums[(s, la, v)] = (d + 1, k + t)
    assert {(r["source"], r["lang"], r["tokenizer_version"]): (r["documents"], r["tokens"]) for r in ledger.totals().collect()} == sums
    assert len(ledger._commits[-1]["segments"]) < 6


def test_tokens_are_counted_as_the_libraries_do(spark):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    word, piece = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    texts = [None, "", " ", "a  b ", "Hello, World!  don't", "x\ty\nz", "été 漢字 ▁ ▁x", "🙂🙂", "word " * 5000, "trailing   "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "'s' AS source", "text", "1 AS tokens")
    got = {(r["doc_id"], r["tokenizer_version"]): r["tokens"] for r in token_ledger.count_tokens(docs, {"w": word, "p": piece}, ("source",)).collect()}
    t, sp = Tokenizer.from_file(word), sentencepiece.SentencePieceProcessor(model_file=piece)
    assert got == {(i, v): len(n) for i, x in enumerate(texts) for v, n in (("w", t.encode(x or "", add_special_tokens=False).ids), ("p", sp.encode(x or "")))}
    empty = token_ledger.count_tokens(docs.where("doc_id < 0"), {"w": word})
    assert empty.count() == 0


# ---------------------------------------------------------------- 3


def brute_jaccard(rows, k, num, den):
    sets = {}
    for i, text in rows:
        w = text.encode().lower().split() if text else []
        sets[i] = set() if not w else {tuple(w)} if len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    ids = sorted(sets, key=lambda i: len(sets[i]))
    links = []
    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            if len(sets[a]) * den < num * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if sets[a] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    comp = union_find(sets, links)
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize(("k", "t"), [(3, "0.9"), (5, "0.8")])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, k, t):
    monkeypatch.setattr(ngram_join, "SMALL_BUCKET", 8)
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 50)
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    r = random.Random(1)
    base = [f"w{r.randrange(4000)}" for _ in range(100)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
            w[r.randrange(100)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"q{r.randrange(3000)}" for _ in range(r.randrange(20, 50))) + " " + passage for _ in range(150)]
    texts += [r.choice(texts).upper() for _ in range(60)]
    texts += [" ".join(r.choice("abc") for _ in range(r.randrange(0, 7))) for _ in range(60)]
    texts += [None, "", " \t\n", "long " * 20000, "a b c", "  a\x1cb"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    num, den = {"0.9": (9, 10), "0.8": (4, 5)}[t]
    want = brute_jaccard(rows, k, num, den)
    df = spark.createDataFrame([(i, x, "e") for i, x in rows], DOCS + ", component string").repartition(5)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df, words=k, threshold=t).collect()}
    assert got == want
    odd = ngram_join.jaccard_components(spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d")], DOCS), words=3, threshold="0.9")
    assert sorted((r["id"] or 0, r["component_id"] or 0) for r in odd.collect()) == [(0, 0), (1, 1), (1, 1)]
    a, b, c = ("x y z " * 9 + w for w in ("one two three", "four five six seven", "eight nine"))
    several = ngram_join.jaccard_components(spark.createDataFrame([(0, a), (1, a), (1, b), (2, b), (3, c), (4, c), (1, b)], DOCS), words=3, threshold="0.9")
    assert sorted((r["id"], r["component_id"]) for r in several.collect()) == [(0, 0), (1, 0), (1, 0), (1, 0), (2, 0), (3, 3), (4, 3)]
    assert ngram_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_shingle_sets_of_texts_longer_than_a_part(monkeypatch):
    import pyarrow as pa

    from daybook.llm import shingles

    r = random.Random(12)
    texts = [" ".join("w" * r.randint(1, 9) + str(r.randrange(50)) for _ in range(400)), None, "x" * 700 + " y\tz", "", "a b"]
    whole = [s.tolist() for s in shingles.shingle_sets(pa.array(texts), 3)]
    monkeypatch.setattr(shingles, "AT_ONCE", 64)
    monkeypatch.setattr(shingles, "_POWERS", {})
    assert [s.tolist() for s in shingles.shingle_sets(pa.array(["zz", *texts]).slice(1), 3)] == whole
    assert [len(s) for s in whole[1:]] == [0, 1, 0, 1]


def test_orders_are_strict_whatever_is_frequent():
    rng = np.random.default_rng(5)
    s = np.unique(rng.integers(0, 2**63, 50, dtype=np.uint64))
    tokens, counts = s[::2], np.full(len(s[::2]), 7)
    late = ngram_join.late_places(tokens, counts)
    assert all(sorted(x) == list(range(len(tokens))) for x in late)
    at = np.arange(0, len(s), 2)
    for length in (3, 25, 30, len(s)):
        want = sorted(range(len(s)), key=lambda k: (k % 2 == 0, late[1][k // 2] if k % 2 == 0 else s[k]))[:length]
        assert set(ngram_join.first_of(s, at, late[1], length).tolist()) == set(want)


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 5, 70, 900, 3000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) * 9 // 10], rng.integers(0, 2**63, n // 7 + 1, dtype=np.uint64)]))
        assert ngram_join.least_difference(ngram_join.parity(a), ngram_join.parity(b)) <= len(np.setxor1d(a, b))


# ---------------------------------------------------------------- 4


def test_main_text(spark):
    model = html_text.TreeModel.fit(html_text.labelled_pages(200))
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/'>home</a></li></ul></nav><div class=ad>buy now.</div><article><h1>A  title &amp; more</h1><p><b>First&nbsp;one.<br><p>Second <i>one</i> is &lt;here&gt;, and it goes on a bit.</p><script>x='<p>no</p>'</script></article><div class=comments><h3>Comments</h3><div class=comment><p>Nice text, thanks.</p></div></div><footer>&copy; us</footer>"
    assert html_text.main_text(page, model) == "A title & more\nFirst one.\nSecond one is <here>, and it goes on a bit."
    df = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 5), (3, "v", "", 5), (4, "w", "<<p <!-- unclosed", 5), (4, "w", "plain", 5)], "page_id long, url string, html string, n_chars int")
    got = {r["page_id"]: r for r in html_text.extract_text(df, model=model).collect()}
    assert got[2]["text"] == "" and got[2]["n_chars"] == 0 and got[1]["n_chars"] == len(got[1]["text"])
    assert html_text.extract_text(df.limit(0), model=model).count() == 0


def test_stray_quotes_and_missing_end_tags_lose_no_text():
    blocks = lambda page: [t for n in html_text.parse(page) for _, t in n.blocks]
    assert blocks("<p class=x it's>One.</p><p>Two's \"here\".</p><p title=\"a>b\" id='c>d'>Three.</p><p a=\"open>Four.</p>") == ["One.", "Two's \"here\".", "Three.", "Four."]
    assert blocks("<head><title>x</title><meta a><body><p>One.") == ["One."]
    assert blocks("<head><title>x</title></head><p>One.<datalist><option>a<option>b</datalist><p>Two.") == ["One.", "Two."]


def test_tree_marginals_are_exact():
    model = html_text.TreeModel.fit(html_text.labelled_pages(60))
    nodes = html_text.parse("<body><nav><ul><li><a>x</a></li></ul></nav><div><p>Some words here.</p><p>More.</p></div>")
    own = [[sum((model.node.get(f) or (0.0, 0.0))[y] for f in html_text.features(n)) for y in (0, 1)] for n in nodes]
    total, content = 0.0, [0.0] * len(nodes)
    for bits in range(2 ** len(nodes)):
        y = [bits >> k & 1 for k in range(len(nodes))]
        p = np.exp(model.root[y[0]] + sum(own[k][y[k]] for k in range(len(nodes))) + sum(model.pair[y[n.parent]][y[k]] for k, n in enumerate(nodes) if k))
        total += p
        for k, v in enumerate(y):
            content[k] += p * v
    assert np.allclose(model.marginals(nodes), [c / total for c in content])


def test_held_out_pages_are_labelled_well():
    model = html_text.TreeModel.fit(html_text.labelled_pages())
    seen = [(p >= 0.5) == n.label for nodes in html_text.labelled_pages(100, seed=77) for n, p in zip(nodes, model.marginals(nodes), strict=True) if n.blocks]
    assert sum(seen) / len(seen) > 0.88


# ---------------------------------------------------------------- 5


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base[:80] + 0.05 * rng.normal(size=(80, 16)), np.repeat(base[:1], 100, 0) + 0.08 * rng.normal(size=(100, 16)), base[100:130] * 3, base[:40]]).astype(np.float32)
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(-1, None), (-2, [0.0] * 16), (-3, [float("nan")] * 16), (-4, [1.0, 2.0]), (-5, [2.0, 4.0]), (-6, []), (-7, [None] * 16), (-8, [float("inf")] * 16)]
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    found, there = sum(got[i]["n_links"] for i in range(len(x))), near.sum()
    assert 0.97 * there <= found <= there
    comp = union_find(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)])
    assert sum(comp[i] == got[i]["component_id"] for i in range(len(x))) > 0.97 * len(x)
    assert (got[-4]["n_links"], got[-4]["component_id"], got[-4]["kept"]) == (1, -5, False)
    assert all((got[i]["n_links"], got[i]["component_id"]) == (0, i) for i in (-1, -2, -3, -6, -7, -8))
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("count", [200 * 256, 1024 * 256])
def test_recall_of_many_lists(count):
    lists, probes = vector_dedup.how_many(count)
    assert lists == count // 256
    rng = np.random.default_rng(1)
    x = vector_dedup.unit(rng.normal(size=(vector_dedup.FIT_SAMPLE, 64)))
    index = vector_dedup.Index(vector_dedup.k_means(x, lists, rounds=4), np.zeros((1, 1, 1)), probes)
    a = x[:3000]
    side = rng.normal(size=a.shape)
    side = vector_dedup.unit(side - (side * a).sum(1)[:, None] * a)
    b = 0.905 * a + np.sqrt(1 - 0.905**2) * side
    near_a, near_b = (vector_dedup.nearest(v, index.centres, probes) for v in (a, b))
    met = (near_a == near_b[:, :1]).any(1) | (near_b == near_a[:, :1]).any(1)
    assert met.mean() > 0.97


# ---------------------------------------------------------------- 6


def test_automaton_over_trie_equals_edit_distance():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(2)
    terms = ["".join(r.choice("abcde") for _ in range(r.randint(3, 9))) for _ in range(40)]
    trie = toxicity.LexiconTrie(terms)
    for _ in range(3000):
        w = "".join(r.choice("abcde") for _ in range(r.randint(1, 10)))
        near = [(edits(w, t), t) for t in terms if edits(w, t) <= toxicity.most_errors(len(t))]
        got = trie.match(w)
        assert (got is None) == (not near) and (not near or got == (min(near)[1], min(near)[0]))


def test_quotation_is_told_from_abuse():
    words = 'he said "you idiot" and left'.split()
    assert toxicity.is_quoted(words, 3) and not toxicity.is_quoted("you are an idiot and more".split(), 3)


def test_toxicity_learns_and_catches_misspellings(spark):
    r = random.Random(3)
    clean = lambda: " ".join(f"w{r.randrange(300)}" for _ in range(30))
    rows = [(i, clean() + (f" you {r.choice(['blockhead', 'dimwit', 'nitwit'])} " + clean() if i % 5 == 0 else " " + clean()), int(i % 5 == 0)) for i in range(600)]
    docs = spark.createDataFrame([x[:2] for x in rows] + [(1000, None), (1001, ""), (1002, clean() + " blockhaed blokhead nitwt " + clean()), (None, "x")], DOCS)
    labels = spark.createDataFrame([(x[0], 1, x[2]) for x in rows] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert {"blockhead", "dimwit", "nitwit"} <= {t for t, _ in model.terms}
    got = {x["doc_id"]: x["score"] for x in model.score(docs).collect()}
    assert [i for i, _, y in rows if (got[i] >= 0.3) != bool(y)] == [] and got[1000] == got[1001] < 0.3 <= got[1002]
    none = toxicity.train(docs, labels.limit(0))
    assert max(x["score"] for x in none.score(docs).collect()) < 0.3


# ---------------------------------------------------------------- 7


def test_ids_are_the_models_own_and_decoding_returns_the_text(spark):
    import pyarrow.parquet as pq
    import sentencepiece

    m = pieces.PieceModel(P.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    r = random.Random(11)
    texts = ["  two  blanks", "naïve café 日本 ✈ \U0001f600", "\n\tx", " ", "unbelievable antidisestablishmentarianism", "a" * 3000, "aaa aaaa aaaaa abababab", "­﻿x"]
    texts += [" ".join("".join(r.choice("abcdeéintosr漢▁'-._,);²…0123") for _ in range(r.randint(1, 14))) for _ in range(30)) for _ in range(200)]
    texts += [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t]
    ids = m.encode(texts)
    assert m.decode(ids) == [t.replace("▁", " ") for t in texts]
    assert m.decode([]) == [] and m.decode([None, b"", ids[0]]) == [None, "", texts[0].replace("▁", " ")]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [sp.encode(t) for t in texts]
    empty = pieces.encode_pieces(spark.createDataFrame([], DOCS), P.path("piece_bpe_32k.model"))
    assert pieces.decode_pieces(empty, P.path("piece_bpe_32k.model")).count() == 0
    df = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (None, "x"), (1, "one two")], DOCS)
    enc = pieces.encode_pieces(df, P.path("piece_bpe_32k.model"))
    assert {(r["id"], r["text"]) for r in pieces.decode_pieces(enc, P.path("piece_bpe_32k.model")).collect()} == {(1, "one two"), (2, ""), (3, ""), (None, "x")}


# ---------------------------------------------------------------- 8


def optimal_bins(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_texts_without_blanks_take_seconds_and_equal_the_model():
    import time

    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    r = random.Random(3)
    made = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    parts = ["".join(r.choice(["the", "hand", "ing", "Xq", "ß", "er", "日本", "\U0001f600"]) for _ in range(3000)), made("abcdefghijklmnopqrstuvwxyz", 9000), made("aé", 5000), "a" * 7001, "ha" * 3001, "-" * 5003, "hahaho" * 900, made("日本語中文字", 6000), "aaaaaaab" * 700, "x" + "\u0000\ufffe" * 2000]
    for text in [*parts, "".join(parts), "y" * 1281, "y" * 1280, "lo" * 640 + "z"]:
        assert np.frombuffer(model.encode([text])[0], "<u4").tolist() == sp.encode(text, out_type=int)
    began = time.time()
    model.encode([made("abcdefghijklmnopqrstuvwxyz", 300_000)])
    assert time.time() - began < 60


def test_reduction_never_loses_the_optimum():
    r = random.Random(4)
    for _ in range(150):
        sizes = [r.randint(1, 20) for _ in range(r.randint(1, 9))]
        patterns, fixed = packing.pack_counts(Counter(sizes), 20)
        assert Counter(w for p, m in patterns for w in p for _ in range(m)) == Counter(sizes) and all(sum(p) <= 20 for p, _ in patterns)
        done = Counter(w for p, m in patterns[:0] for w in p)
        reduced, left, stock = 0, Counter(sizes), patterns
        for p, m in stock:
            if reduced >= fixed:
                break
            for w in p:
                left[w] -= m
            reduced += m
        assert not done and reduced + optimal_bins(list(left.elements()), 20) == optimal_bins(sizes, 20)


def test_reduction_of_many_equal_items_keeps_the_optimum_and_few_patterns():
    r = random.Random(9)
    for _ in range(300):
        capacity = r.choice([8, 10, 13, 20, 30])
        pool = [r.randint(1, capacity) for _ in range(r.randint(1, 5))]
        sizes = [r.choice(pool) for _ in range(r.randint(1, 11))]
        patterns, fixed = packing.pack_counts(Counter(sizes), capacity)
        left, reduced = Counter(sizes), 0
        for p, m in patterns:
            if reduced >= fixed:
                break
            for w in p:
                left[w] -= m
            reduced += m
        assert reduced + optimal_bins(list(left.elements()), capacity) == optimal_bins(sizes, capacity)
    for first, step in ((1, 3), (400, 7), (1000, 7), (1400, 1)):
        sizes = range(first, 4097, step)
        found = [packing.pack_counts(dict.fromkeys(sizes, m), 4096)[0] for m in (100, 1000, 100_000)]
        assert len({len(patterns) for patterns in found}) == 1 and len(found[0]) < 2 * len(sizes)


def test_words_are_encoded_without_offsets_and_as_in_their_text():
    coder = packing.CachedEncoder(P.path("word_bpe_49k.json"), keep=20)
    texts = ["Ab, ab abc123 (x) \u00c9t\u00e9! \u00c9T\u00c9 ...", None, "", "x1 , 9. Ab,ab a\x1cb \u6f22\u5b57. Stra\u00dfe's", " ".join(f"w{chr(97 + n % 26) * (n // 26 + 1)}{',.'[n % 2]}" for n in range(90)), "ab Ab,"]
    want = [np.asarray(coder.tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]

    class Fast:
        def __init__(self, inner):
            self.encode_batch_fast = inner.encode_batch_fast

    coder.tokenizer = Fast(coder.tokenizer)
    assert [coder.encode([t])[0] for t in texts] == want and coder.encode(texts) == want


def test_packing_places_every_piece_gaplessly(spark):
    from tokenizers import Tokenizer

    r = random.Random(5)
    rows = [(i, " ".join(f"word{r.randrange(50)}," for _ in range(r.choice([0, 1, 5, 40, 200])))) for i in range(300)] + [(900, None), (901, ""), (7, "twice"), (7, "twice"), (902, "x\x1cy <|endoftext|> It's É")]
    path = P.path("word_bpe_49k.json")
    got = packing.best_fit_pack(spark.createDataFrame(rows, DOCS), path, capacity=256, rows_per_part=20).collect()
    bins = {}
    for x in got:
        bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    t = Tokenizer.from_file(path)
    want = Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.update((i, n, a, len(ids[a : a + 256]), __import__("zlib").crc32(np.asarray(ids[a : a + 256], "<u4").tobytes())) for n, a in enumerate(range(0, len(ids), 256)))
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == want
    assert packing.best_fit_pack(spark.createDataFrame([], DOCS), path).count() == 0


# ---------------------------------------------------------------- 9


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(120, 6)), 1)
    x[50:90] = x[50]
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)] + [(200, None), (201, [float("nan")] * 6), (202, [1.0, 2.0]), (None, [1.0] * 6), (203, [1e18] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(topk.exact_top_k(df.where("vec_id % 10 = 0"), df, "vec_id", "embedding", 7, shard_rows=5, query_rows=4))
    q = np.floor(64 * x).astype(np.int64)
    want = []
    for i in range(0, 120, 10):
        scores = [(-int(q[i] @ q[j]), j) for j in range(120) if j != i] + [(-int(sum(int(v) for v in q[i]) * 64 * 10**18), 203)]
        scores = [(max(-(2**63) + 1, min(2**63 - 1, s)), j) for s, j in scores]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:7])]
    assert sorted(got) == sorted(want)
    assert topk.exact_top_k(df.limit(0), df, "vec_id", "embedding", 7).count() == 0


# ---------------------------------------------------------------- 10


def test_line_dedup_keeps_the_first_of_each_component(spark):
    r = random.Random(7)
    line = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n)).strip()
    a, b = line(200), line(300)
    edited = a[:100] + "ZZ" + a[102:]
    rows = [(2, f"{a}\n\n{b}"), (1, f"{edited}\nunique one here\n{edited}"), (3, b), (4, None), (5, ""), (6, f"short\n{line(900)}"), (7, "short\nlast"), (7, "short\nlast"), (None, b)]
    df = spark.createDataFrame([(*x, 9) for x in rows], DOCS + ", line int")
    got = [(x["doc_id"], x["text"], x["n_lines"], x["n_dropped"]) for x in line_dedup.dedup_lines(df).collect()]
    assert (1, f"{edited}\nunique one here", 3, 1) in got
    assert (2, f"\n{b}", 3, 1) in got and (3, "", 1, 1) in got
    assert (4, None, 0, 0) in got and (5, "", 1, 0) in got and (None, b, 1, 0) in got
    assert got.count((7, "last", 2, 1)) == 2 and len(got) == len(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_of_clashing_columns_line_ends_and_repeated_ids(spark):
    rows = [(1, "same\r\n\r\nsame\r\nx", "a", 1, 2), (2, "y\r\n\r\nsame\r", "b", 1, 2), (3, "one\ntwo", "c", 1, 2), (3, "two\nthree", "d", 1, 2), (3, "two\nthree", "e", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, drops string, n_lines int, rid int")
    got = {x["drops"]: x for x in line_dedup.dedup_lines(df).collect()}
    assert got["a"]["text"] == "same\r\n\r\nx" and got["b"]["text"] == "y\r\n\r" and got["a"]["rid"] == 2
    assert [got[k]["n_lines"] for k in "abcde"] == [4, 3, 2, 2, 2]
    texts = sorted(got[k]["text"] for k in "cde")
    assert texts in (["one", "two\nthree", "two\nthree"], ["one\ntwo", "three", "three"])


def test_lines_whose_hashes_clash_stay_apart(spark, monkeypatch):
    full = line_dedup.line_id
    monkeypatch.setattr(line_dedup, "line_id", lambda line, salt=0: F.pmod(F.xxhash64(line), F.lit(3)) if not salt else full(line, salt))
    rows = [(i, f"line {i} {'abcdefghijklmnopqrst'[i]} alone\nshared by all of them") for i in range(12)]
    got = {x["doc_id"]: (x["text"], x["n_dropped"]) for x in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: (text, 0) if i == 0 else (text.split("\n")[0], 1) for i, text in rows}


def near(df):
    distinct = stage(df.distinct())
    return distinct, dict(rows_of(line_dedup.near_lines(distinct, stage(line_dedup.signed(distinct)), 0.8)))


def brute_lines(df):
    sets = {x["lid"]: {x["line"][k : k + 8] for k in range(max(1, len(x["line"]) - 7))} for x in df.collect()}
    keys = sorted(sets)
    links = [(a, b) for n, a in enumerate(keys) for b in keys[n + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return keys, links, union_find(keys, links)


def with_ids(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "line string").withColumn("lid", F.xxhash64("line"))


def test_line_similarity_is_decided_exactly(spark):
    r = random.Random(8)
    lines = []
    for n in [60] * 60 + [160] * 60 + [420] * 40 + [1000] * 30:
        base = "".join(r.choice("abcdefghijklmnop \u00e9\u6f22") for _ in range(n))
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3]) * n // 160):
            w[r.randrange(n)] = "Q"
        lines += [base, "".join(w)]
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    for n in [60] * 60 + [150] * 40:
        base = [word(r.randint(2, 9)) for _ in range(n)]
        other = list(base)
        for _ in range(n // 20):
            other[r.randrange(n)] = word(5)
        lines += [" ".join(base), " ".join(other)]
    distinct, got = near(with_ids(spark, lines))
    keys, links, want = brute_lines(distinct)
    missed = [k for k in keys if got.get(k, k) != want[k]]
    assert len(links) > 150 and len(missed) <= 0.01 * len(keys) and all(got[k] == want[k] for k in got if k not in missed)


def test_similar_lines_are_found_among_many_lines_of_one_template(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "TILE_ROWS", 40)
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head, lines = word(170), []
    for _ in range(300):
        own = word(30)
        lines += [head + own + word(9), head + own + word(9)]
    distinct, got = near(with_ids(spark, lines))
    keys, links, want = brute_lines(distinct)
    assert len(links) == 300 and len(got) == 600 and all(got[k] == want[k] for k in keys)


def test_long_lines_of_one_template_are_decided_only_near_the_threshold(spark, monkeypatch):
    decided, verified = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, *rest: decided.append(pairs.count()) or verified(pairs, *rest))
    r = random.Random(11)
    base, lines = [r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(500)], []
    for n in range(90):
        w = list(base)
        for _ in range(5):
            w[r.randrange(1, 499)] = r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        lines.append("".join(w))
    distinct, got = near(with_ids(spark, lines))
    keys, links, want = brute_lines(distinct)
    assert 0 < len(links) < 400 and all(got.get(k, k) == want[k] for k in keys)
    assert sum(decided) < len(links) + 400 < 90 * 89 / 8


def test_similar_lines_of_different_word_counts_are_found(spark):
    r = random.Random(10)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    long = " ".join(word(6) for _ in range(32))
    phrase = " ".join(word(6) for _ in range(4))
    lines = [long, " ".join([long, *(word(4) for _ in range(9))]), " ".join([phrase] * 8), " ".join([phrase] * 11)]
    _, got = near(with_ids(spark, lines))
    ids = [x["lid"] for x in with_ids(spark, lines).collect()]
    assert got == {ids[0]: min(ids[:2]), ids[1]: min(ids[:2]), ids[2]: min(ids[2:]), ids[3]: min(ids[2:])}


def test_distinct_lines_are_signed_where_they_are_and_few_keys_are_looked_up(spark):
    lines = with_ids(spark, ["a line of some words", "a line of some words", "another one"])
    signed = line_dedup.signed(lines.groupBy("lid", "line").agg(F.count("*").alias("n")))
    plan = signed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted((x["line"], x["n"], len(x["keys"])) for x in signed.collect()) == [("a line of some words", 2, 16), ("another one", 1, 16)]
    got = spark.range(2, 3000).select("id", line_dedup.least_shared(F.col("id"), 0.8).alias("s")).collect()
    assert all(x["s"] >= 0.8 * (x["id"] - x["s"]) and x["s"] - 1 < 0.8 * (x["id"] - x["s"] + 1) for x in got)


def test_lines_are_signed_by_numbers_only(spark):
    long = "a line of more than one row of work " * 4
    df = spark.createDataFrame([(3, f"{long}\nx"), (1, "x\nx\n \t\n"), (None, "x"), (2, None)], DOCS)
    lines, distinct = line_dedup.distinct_lines(df, "doc_id", "text")
    assert "line" not in distinct.columns
    texts = lines.select("lid", "line").distinct()
    got = distinct.join(texts, "lid").collect()
    assert sorted((x["line"], x["n"], x["first_doc"], x["clash"]) for x in got) == [(long, 1, 3, False), ("x", 3, 1, False)]
    assert {x["line"]: x["keys"] for x in got} == {x["line"]: x["keys"] for x in line_dedup.signed(texts).collect()}
