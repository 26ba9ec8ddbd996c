"""Phrase collocation mining: pairs of frequency-ranked word ids, counted in direct-address tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.llm.common import forget, lean, stage
from daybook.llm.ngram_join import bloom_of, in_bloom

#: So many of the most frequent words get ids by rank and go to every task, and so many of the most frequent pairs.
RANKED = 1 << 17
#: Longer words (in bytes) have no rank, so that what goes to every task is bounded in bytes too.
RANKED_BYTES = 64
#: A tile has so many ids on a side; one with a pair for every ``SPARSE`` cells at least is counted densely.
SIDE, SPARSE = 1024, 16
#: Pairs that a task gathers before it counts them.
GATHERED = 1 << 19
#: Counted rows that a task hands over at once.
SENT = 1 << 15
#: A slice of a text that is cut into words at once.
SLICE = 1 << 20
#: Codes from here on are hashes of words without a rank.
HASHED = 1 << 62
BREAK = b"\xff"  # stands for a mark between pieces; no UTF-8 text has this byte
PLAIN = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", BREAK * 10 + b" ")
LOWER = bytes(ord(chr(c).lower()) if 65 <= c <= 90 else c for c in range(256))
TABLE = bytes(PLAIN[c] for c in LOWER)


def code_of(lang: str, word: bytes) -> int:
    """The code of a word without a rank. ``Ranks`` refuses a corpus in which two words have the same one."""
    return HASHED | (xxhash.xxh64_intdigest(word, seed=xxhash.xxh64_intdigest(lang.encode(), seed=12)) >> 2)


def slices(data: bytes) -> Iterator[bytes]:
    """Cut a translated text between words."""
    at = 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            blank, mark = data.find(b" ", end), data.find(BREAK, end)
            found = [x for x in (blank, mark) if x >= 0]
            end = min(found) if found else len(data)
        yield data[at:end]
        at = end


def words_of(texts: list[str]) -> Iterator[pa.Array]:
    """All words of the texts in order as dictionary arrays; ``BREAK`` stands between pieces and texts."""
    for part in slices(BREAK.join(t.encode() for t in texts).translate(TABLE)):
        yield pa.array(part.replace(BREAK, b" \xff ").split(), pa.binary()).dictionary_encode()


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    """The batch's texts by language; null is ``und``, a null text is empty."""
    texts: dict[str, list[str]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        texts.setdefault("und" if lang is None else lang, []).append(text or "")
    return iter(texts.items())


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, code, n) of all words; tasks combine what one batch holds, Spark the rest."""

    def run(batches):
        for batch in batches:
            for lang, texts in by_lang(batch):
                for words in words_of(texts):
                    n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                    keep = [(w, lang, c) for w, c in zip(words.dictionary.to_pylist(), n.tolist(), strict=True) if w != BREAK]
                    yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in keep], pa.string()), pa.array([x[0].decode() for x in keep], pa.string()), pa.array([code_of(x[1], x[0]) for x in keep], pa.int64()), pa.array([x[2] for x in keep], pa.int64())], names=["lang", "word", "code", "n"])

    found = docs.mapInArrow(lean(run), "lang string, word string, code long, n long")
    return found.groupBy("lang", "word", "code").agg(F.sum("n").alias("n"))


def ranked(df: DataFrame, by: list[str], k: int) -> list:
    """At most k rows with the largest n, ties by the columns ``by``. Rows that equal a quantile of n are left out, so that not more than
    some k rows come to the driver, from all tasks together; who has no rank is only counted in another way."""
    count = df.count() if k else 0
    if count > k:
        df = df.where(F.col("n") > df.agg(F.percentile_approx("n", 1 - k / count, 100_000)).first()[0])
    return sorted(df.collect(), key=lambda r: (-r["n"], *(r[c] for c in by)))[:k] if count else []


class Ranks:
    """Ids of words by rank, and which words and pairs are frequent: all that a task needs, of bounded size.

    The ``RANKED`` most frequent words of all languages have their rank as id. Others have a hash that no other word of the corpus
    has. ``frequent`` is a bit array of fixed size that holds the codes of all frequent words beyond the ranked ones; what it holds
    by mistake only makes pairs that are dropped once they are counted.
    """

    def __init__(self, vocabulary: DataFrame, least: int):
        clash = vocabulary.groupBy("code").count().where("count > 1").limit(1).collect()
        if clash:
            raise ValueError(f"two words have the code {clash[0]['code']}; choose another seed")
        often = vocabulary.where(F.col("n") >= least)
        top = ranked(often.where(F.octet_length("word") <= RANKED_BYTES).select("lang", "word", "n"), ["lang", "word"], RANKED)
        self.ids: dict[str, dict[bytes, int]] = {}
        for i, r in enumerate(top):
            self.ids.setdefault(r["lang"], {})[r["word"].encode()] = i
        self.frequent = bloom_of(often.select("code")) if often.count() > len(top) else None

    def codes_of(self, lang: str, texts: list[str]) -> np.ndarray:
        """The words' codes in order, -1 between pieces and for words that are not frequent."""
        ids, out = self.ids.get(lang, {}), []
        for words in words_of(texts):
            known = np.array([ids.get(w, -1) for w in words.dictionary.to_pylist()], dtype=np.int64)
            if self.frequent is not None:
                rest = [(i, code_of(lang, w)) for i, w in enumerate(words.dictionary.to_pylist()) if known[i] < 0 and w != BREAK]
                codes = np.array([c for _, c in rest], dtype=np.int64)
                held = in_bloom(self.frequent, codes) if len(codes) else np.zeros(0, dtype=bool)
                known[np.array([i for i, _ in rest], dtype=np.int64)[held]] = codes[held]
            out.append(known[words.indices.to_numpy()])
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def count_tiles(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, how often) of all pairs of ids: pairs are put to tiles of SIDE x SIDE ids by rank; a full tile is counted at its
    addresses, all others as sorted coordinates."""
    if not len(a):
        return
    tile = (a // SIDE) * np.int64(1 << 31) + b // SIDE  # hashed codes are beyond all ranks and stay sparse
    hashed = (a >= HASHED) | (b >= HASHED)
    tile[hashed] = -1
    order = np.argsort(tile, kind="stable")
    a, b, tile = a[order], b[order], tile[order]
    cuts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    sizes = np.diff(np.r_[cuts, len(tile)])
    dense = (sizes * SPARSE >= SIDE * SIDE) & (tile[cuts] >= 0)
    for s, n in zip(cuts[dense], sizes[dense], strict=True):
        x, y = a[s : s + n], b[s : s + n]
        counts = np.bincount((x % SIDE) * SIDE + y % SIDE, minlength=SIDE * SIDE)
        at = np.flatnonzero(counts)
        yield x[0] // SIDE * SIDE + at // SIDE, y[0] // SIDE * SIDE + at % SIDE, counts[at]
    rest = ~np.repeat(dense, sizes)
    for some in (rest & (tile >= 0), rest & (tile < 0)):
        yield _coordinates(a[some], b[some])


def _coordinates(*cols: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows and how often each occurs, by sorting."""
    if not len(cols[0]):
        return (*cols, np.zeros(0, dtype=np.int64))
    if len(cols) == 2 and cols[0].max() < 1 << 31 and cols[1].max() < 1 << 31:
        keys, n = np.unique(cols[0] << 31 | cols[1], return_counts=True)
        return keys >> 31, keys & (1 << 31) - 1, n
    order = np.lexsort(cols[::-1])
    cols = tuple(c[order] for c in cols)
    first = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])
    return (*(c[first] for c in cols), np.diff(np.r_[first, len(order)]))


def _counted(docs: DataFrame, ranks: Ranks, split: Callable, tiled: Callable, names: list[str]) -> DataFrame:
    """(names, n): ``split`` makes columns of ids of a text's codes, of which tasks gather ``GATHERED`` rows; these ``tiled`` counts."""

    def run(batches):
        held, size = [], 0

        def flush():
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            for found in tiled(*cols):
                batch = pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names=[*names, "n"])
                yield from (batch.slice(at, SENT) for at in range(0, batch.num_rows, SENT))

        for batch in batches:
            for lang, texts in by_lang(batch):
                cols = split(ranks.codes_of(lang, texts))
                held.append(cols)
                size += len(cols[0])
                if size >= GATHERED:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    found = docs.mapInArrow(lean(run), ", ".join(f"{n} long" for n in [*names, "n"]))
    return found.groupBy(*names).agg(F.sum("n").alias("n"))


def adjacent(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of one piece."""
    there = (c[:-1] >= 0) & (c[1:] >= 0)
    return c[:-1][there], c[1:][there]


def mix_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for a pair of codes, to look it up in a bit array; pairs may share one."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
        x ^= x >> np.uint64(29)
        return (x * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _triples(top: np.ndarray, order: np.ndarray, frequent: np.ndarray):
    """Frequent pairs have ranks of their own, and (pair, next word) are pairs of ids again.

    top: keys of the most frequent pairs of ranked words, sorted; order: their ranks. A triple whose pairs are not both
    frequent by ``frequent`` is not one; a triple whose first pair has no rank is counted by its three codes.
    """

    def split(c):
        there = np.flatnonzero((c[:-2] >= 0) & (c[1:-1] >= 0) & (c[2:] >= 0)) if len(c) > 2 else np.zeros(0, dtype=np.int64)
        held = np.zeros(len(c), dtype=bool)
        two = np.flatnonzero((c[:-1] >= 0) & (c[1:] >= 0)) if len(c) > 1 else there
        held[two] = in_bloom(frequent, mix_pair(c[two], c[two + 1]))
        at = there[held[there] & held[there + 1]]
        return c[at], c[at + 1], c[at + 2]

    def tiled(a, b, c):
        small = (a < 1 << 31) & (b < 1 << 31)
        key = np.where(small, a << 31 | b & (1 << 31) - 1, -1)
        place = np.minimum(np.searchsorted(top, key), max(0, len(top) - 1))
        known = top[place] == key if len(top) else np.zeros(len(key), dtype=bool)
        for pair, word, n in count_tiles(order[place[known]], c[known]):
            first = np.empty(len(top), dtype=np.int64)
            first[order] = top
            yield first[pair] >> 31, first[pair] & (1 << 31) - 1, word, n
        yield _coordinates(a[~known], b[~known], c[~known])

    return split, tiled


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two and three words.

    Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words at blanks and tabs. a = f(phrase) >= ``least``;
    score is the least floor(10^6 a a / (l r)) over the cuts, of equal ones the first. A pair inside a triple
    with 100 f(triple) >= ``inside`` a is dropped. Best score first, then a, then the phrase by bytes. Null texts are empty, null languages
    ``und``; other columns are not read; an empty table gives no phrases; a text that repeats counts as often as it is there.

    Three passes over the texts: words, pairs of frequent words, triples of frequent pairs. Ids are ranks by frequency for the ``RANKED``
    most frequent words (and pairs), hashes without clashes for all others. Tasks count tiles of ids and emit each pair once for
    some half a million; Spark adds the tasks' counts, so no key's rows meet in one task. Counts are exact; products are decimals.
    """
    docs = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    vocabulary = stage(count_words(docs), "vocabulary")
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("total"))
    ranks = Ranks(vocabulary, least)

    def identified(batches):
        for b in batches:
            at = np.array([ranks.ids.get(lang, {}).get(w.encode(), -1) for lang, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], dtype=np.int64)
            id_ = np.where(at >= 0, at, b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(id_), b.column(3)], names=["lang", "word", "id", "f"])

    words = stage(vocabulary.where(F.col("n") >= least).mapInArrow(identified, "lang string, word string, id long, f long"), "words")
    pairs = stage(_counted(docs, ranks, adjacent, count_tiles, ["a", "b"]).where(F.col("n") >= least), "pairs")
    best = ranked(pairs.where((F.col("a") < RANKED) & (F.col("b") < RANKED)), ["a", "b"], RANKED)
    keys = np.array([r["a"] << 31 | r["b"] for r in best], dtype=np.int64)
    order = np.argsort(keys)

    def mixed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mix_pair(b.column(0).to_numpy(), b.column(1).to_numpy()))], names=["id"])

    held = bloom_of(pairs.select("a", "b").mapInArrow(mixed, "id long"))
    triples = stage(_counted(docs, ranks, *_triples(keys[order], order, held), ["a", "b", "c"]).where(F.col("n") >= least), "triples")

    # cuts: words of pairs, then words and pairs of triples
    f = lambda on, name: words.select(F.col("id").alias(on), F.col("f").alias(name))
    two = lambda x, y, name: pairs.select(F.col("a").alias(x), F.col("b").alias(y), F.col("n").alias(name))
    part = triples.select("a", "b", "n").unionByName(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "n"))
    longest = part.groupBy("a", "b").agg(F.max("n").alias("longer"))
    kept = pairs.join(longest, ["a", "b"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("n")))
    pair_cuts = kept.join(f("a", "l"), "a").join(f("b", "r"), "b").select("a", "b", F.lit(-1).cast("long").alias("c"), F.col("n").alias("f"), F.array(F.struct(score_of("n", "l", "r").alias("score"), F.lit(1).alias("k"), "l", "r")).alias("cuts"))
    three = triples.join(f("a", "l1"), "a").join(two("b", "c", "r1"), ["b", "c"]).join(two("a", "b", "l2"), ["a", "b"]).join(f("c", "r2"), "c")
    triple_cuts = three.select("a", "b", "c", F.col("n").alias("f"), F.array(*[F.struct(score_of("n", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]).alias("cuts"))
    scored = pair_cuts.unionByName(triple_cuts).withColumn("cut", F.array_min("cuts"))
    name = lambda on, out: words.select(F.col("id").alias(on), F.col("word").alias(out))
    spelt = scored.join(words.select(F.col("id").alias("a"), "lang", F.col("word").alias("w1")), "a").join(name("b", "w2"), "b").join(name("c", "w3"), "c", "left")
    spelt = spelt.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    by = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # a language's candidates are many: the first of each part, then of all parts
    some = spelt.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).where(F.col("rank") <= top)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    out = stage(out.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"), "phrases")
    forget(vocabulary, words, pairs, triples)
    return out


def score_of(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(10^6 a a / (l r)), exact while the numerator has 38 digits, that is for a up to 10^16."""
    wide = {c: f"CAST({c} AS DECIMAL(16, 0))" for c in (a, l, r)}
    return F.expr(f"({wide[a]} * {wide[a]} * CAST(1000000 AS DECIMAL(7, 0))) div ({wide[l]} * {wide[r]})")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language of ``documents``."""
    return phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


PHRASES_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM p
), g AS (
  SELECT lang, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0)
), f1 AS (
  SELECT lang, a, count(*) AS f FROM g GROUP BY ALL
), f2 AS (
  SELECT lang, a, b, count(*) AS f FROM g WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), f3 AS (
  SELECT lang, a, b, c, count(*) AS f FROM g WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), longer AS (
  SELECT lang, a, b, max(f) AS f FROM (SELECT lang, a, b, f FROM f3 UNION ALL SELECT lang, b, c, f FROM f3) GROUP BY ALL
), cuts AS (
  SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.a = f2.a JOIN f1 y ON y.lang = f2.lang AND y.a = f2.b
  LEFT JOIN longer o ON o.lang = f2.lang AND o.a = f2.a AND o.b = f2.b
  WHERE o.f IS NULL OR 100 * o.f < 50 * f2.f
  UNION ALL
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, 1, x.f, y.f
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.a = f3.a JOIN f2 y ON y.lang = f3.lang AND y.a = f3.b AND y.b = f3.c
  UNION ALL
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, 2, x.f, y.f
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.a = f3.a AND x.b = f3.b JOIN f1 y ON y.lang = f3.lang AND y.a = f3.c
), scored AS (
  SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best b JOIN total t ON t.lang = b.lang
QUALIFY rank <= 2000
"""
