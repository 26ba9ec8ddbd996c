"""Toxicity by a learned lexicon, Levenshtein automata over its trie, and context windows.

Terms are learned from labelled documents. A word that is no term is run through the
Levenshtein automaton of the word, intersected with the trie of all terms, which catches
misspelled ones; a window around each hit tells quotation from abuse; a logistic
model over the counts of exact and misspelled, abusive and quoted hits gives the score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.llm.common import lean, stage

#: Bound of what is learned: labelled documents read. Terms are as many as these documents prove.
TRAIN_DOCS = 20_000
#: A term stands in so many toxic documents, and so many standard deviations more than by chance.
TERM_DOCS, TERM_SIGMAS = 4, 5.0
WINDOW = 6
#: Words that a task remembers; beyond it the store starts anew.
KNOWN_WORDS = 250_000
STRIPPED = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‚‘’…¡¿"
QUOTES = frozenset("\"«»„“”‘’")
#: Words that report speech, in the languages of the corpus.
REPORTING = frozenset("said says wrote called calls quoted quote word term dit écrit appelle mot sagte schrieb nannte wort dijo escribió llamó palabra".split())
FEATURES = 4


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def raw_words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def most_errors(length: int) -> int:
    """Edits that a misspelled word of this length may be away from a term: short words mean others."""
    return 0 if length < 5 else 1


@dataclass
class LexiconTrie:
    """Terms as a trie; ``match`` intersects it with the Levenshtein automaton of a word."""

    terms: list[str]
    root: dict = field(default_factory=dict)

    def __post_init__(self):
        self.exact = {t: k for k, t in enumerate(self.terms)}
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        for t in self.terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
            if most_errors(len(t)):
                self.heads.setdefault(len(t), set()).add(t[: len(t) // 2])
                self.tails.setdefault(len(t), set()).add(t[len(t) // 2 :])

    def may_match(self, word: str) -> bool:
        """False only where no term is near: one edit leaves a term's first or second half whole."""
        for n in (len(word) - 1, len(word), len(word) + 1):
            if n in self.heads and (word[: n // 2] in self.heads[n] or word[n // 2 - n :] in self.tails[n]):
                return True
        return False

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term (the first in order, of equally near ones) and its distance."""
        if word in self.exact:
            return word, 0
        limit = most_errors(len(word) + 1)
        if not limit or not self.may_match(word):
            return None
        best: tuple[int, str] | None = None
        # a state of the automaton: for each prefix of the word, the edits that lead there
        todo = [(self.root, tuple(range(len(word) + 1)))]
        while todo:
            node, state = todo.pop()
            for c, child in node.items():
                if c == "":
                    d = state[-1]
                    if d <= most_errors(len(child)) and (best is None or (d, child) < best):
                        best = (d, child)
                    continue
                row = [state[0] + 1]
                for i, w in enumerate(word):
                    row.append(min(row[-1] + 1, state[i + 1] + 1, state[i] + (w != c)))
                if min(row) <= limit:
                    todo.append((child, tuple(row)))
        return (best[1], best[0]) if best else None


def is_quoted(words: list[str], at: int, window: int = WINDOW) -> bool:
    """Quotation marks open before and close behind the word within the window, or speech is reported there."""
    before, after = words[max(0, at - window) : at], words[at + 1 : at + 1 + window]
    own = words[at]
    opened = own[0] in QUOTES or any(w[0] in QUOTES for w in before)
    closed = own.rstrip(".,;:!?")[-1:] in QUOTES or any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in after)
    return (opened and closed) or any(w.strip(STRIPPED) in REPORTING for w in before)


class Scorer:
    """Counts of a text's hits, weighted by their terms: exact or misspelled, abusive or quoted."""

    def __init__(self, terms: list[tuple[str, float]]):
        self.trie, self.weight = LexiconTrie([t for t, _ in terms]), dict(terms)
        self.seen: set[str] = set()
        self.found: dict[str, tuple[str, int] | None] = {}
        self.hits: dict[str, tuple[float, int]] = {}

    def features(self, text: str | None) -> list[float]:
        words = raw_words(text)
        there = set(words)
        if len(self.seen) > KNOWN_WORDS:
            self.seen, self.hits, self.found = set(), {}, {}
        for w in there - self.seen:
            bare = w.strip(STRIPPED)
            if bare not in self.found:
                self.found[bare] = self.trie.match(bare)
            if found := self.found[bare]:
                self.hits[w] = (self.weight[found[0]], int(found[1] > 0))
        self.seen |= there
        sums = [0.0] * FEATURES
        if not self.hits.keys().isdisjoint(there):
            for i, w in enumerate(words):
                if hit := self.hits.get(w):
                    sums[hit[1] + 2 * is_quoted(words, i)] += hit[0]
        return [math.log1p(x) for x in sums]


def _certain(found: DataFrame, p: float) -> list:
    """Rows (word, clean, bad) whose share of bad ones is far above p, most certain first."""
    n = F.col("clean") + F.col("bad")
    sigmas = (F.col("bad") - n * p) / F.sqrt(n * p * (1 - p))
    chosen = found.where(F.col("bad") >= TERM_DOCS).withColumn("sigmas", sigmas).where(F.col("sigmas") >= TERM_SIGMAS)
    return chosen.orderBy(F.desc("sigmas"), "word").collect()


def learn_terms(train: DataFrame) -> list[tuple[str, float]]:
    """(term, weight) of words that stand in toxic documents far more often than by chance.

    train: (text, toxic). A word is first judged by its documents; of what is left, by its
    different contexts (the words before and behind), since copies of one toxic document
    repeat all its words. weight: smoothed log odds of contexts. All terms are kept: a term is
    proven by several toxic documents, so their number is bounded by that of ``train``.
    """

    def by_document(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for w in {w.strip(STRIPPED) for w in set(raw_words(text))}:
                    if len(w) > 2:
                        counts.setdefault(w, [0, 0])[toxic] += 1
            if len(counts) > KNOWN_WORDS:
                yield out(counts)
                counts = {}
        yield out(counts)

    def out(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["word", "clean", "bad"])

    words = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    base = train.agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count("*").alias("n"), F.sum(F.when(F.col("toxic") == 1, words)).alias("bad_words"), F.sum(words).alias("words")).first()
    if not base["bad"] or base["bad"] == base["n"]:
        return []
    p = base["bad"] / base["n"]
    found = train.select("text", "toxic").mapInArrow(lean(by_document), "word string, clean long, bad long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    candidates = frozenset(r["word"] for r in _certain(found, p))

    def by_context(batches):
        for batch in batches:
            seen = set()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = [w.strip(STRIPPED) for w in raw_words(text)]
                for i, w in enumerate(words):
                    if w in candidates:
                        seen.add((w, " ".join(words[max(0, i - 1) : i] + words[i + 1 : i + 2]), toxic))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in seen], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))], names=["word", "context", "toxic"])

    contexts = train.select("text", "toxic").mapInArrow(lean(by_context), "word string, context string, toxic int").distinct()
    counted = contexts.groupBy("word").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("bad"))
    p = base["bad_words"] / base["words"]  # long documents have more contexts
    odds = math.log(p / (1 - p))
    return [(r["word"], max(0.1, math.log((r["bad"] + 0.5) / (r["clean"] + 0.5)) - odds)) for r in _certain(counted, p)]


#: Where nothing speaks against it, a hit weighs this share of an exact, abusive one: exact and misspelled
#: ones, then both when quoted.
PRIOR = np.array([1.0, 0.9, 0.3, 0.2])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the constant) by Newton steps; hits never lower a score.

    The first fit is for exact, abusive hits; the second draws all weights towards their PRIOR shares of
    it, so kinds of hits that the labels never show still count, and those that clean documents have do not.
    """

    def newton(z, goal):
        goal, penalty = np.append(goal, 0.0), np.append(np.full(z.shape[1] - 1, ridge), 1e-3)

        def loss(v):
            m = z @ v
            return np.sum(np.logaddexp(0, m) - y * m) + 0.5 * np.sum(penalty * (v - goal) ** 2)

        share = min(max(y.mean(), 1e-6), 1 - 1e-6)
        v = np.append(np.zeros(z.shape[1] - 1), math.log(share / (1 - share)))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ v, -500, 500)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * (v - goal))
            size = 1.0
            while size > 1e-6 and loss(v - size * step) > loss(v):
                size /= 2
            v = v - size * step
        return v

    ones = np.ones((len(x), 1))
    exact = max(0.0, newton(np.hstack([x[:, :1], ones]), np.zeros(1))[0])
    free = np.ones(x.shape[1], dtype=bool)
    while True:
        v = newton(np.hstack([x[:, free], ones]), exact * PRIOR[free])
        w = np.zeros(x.shape[1] + 1)
        w[:-1][free], w[-1] = v[:-1], v[-1]
        if (w[:-1] >= 0).all():
            return w
        free &= w[:-1] >= 0


@dataclass
class ToxicityModel:
    terms: list[tuple[str, float]]
    weights: np.ndarray

    def score(self, docs: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
        """``docs`` with a score from 0 to 1; null and empty texts get that of a text without hits. A column ``out``
        that is there already is replaced."""
        docs = docs.drop(out)
        terms, weights, text_at = self.terms, self.weights, docs.columns.index(text_col)
        names = [*docs.columns, out]

        def run(batches):
            scorer = Scorer(terms)
            for batch in batches:
                x = np.array([scorer.features(t) for t in batch.column(text_at).to_pylist()]).reshape(-1, FEATURES)
                z = x @ weights[:-1] + weights[-1]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-z)), pa.float64())], names=names)

        schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
        return docs.mapInArrow(lean(run), schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = TRAIN_DOCS) -> ToxicityModel:
    """A model of ``labels`` (id, toxic), learned from at most ``bound`` labelled documents, held-out ones left out.

    Which ones is decided by a hash of the id. Ids with several labels count as toxic if one
    says so; null labels and ids are skipped. Without labels of both kinds nothing is
    toxic: all scores are the share of toxic ones, or 0.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("id")))
    chosen = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(bound)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    labelled = stage(rows.join(F.broadcast(chosen), "id").select("text", "toxic"), "labelled")
    terms = learn_terms(labelled)

    def run(batches):
        scorer = Scorer(terms)
        for batch in batches:
            x = np.array([scorer.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, FEATURES)
            rows, n = np.unique(np.column_stack([x, batch.column(1).to_numpy(zero_copy_only=False)]), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T] + [pa.array(n)], names=[f"f{k}" for k in range(FEATURES)] + ["y", "n"])

    kinds = ", ".join(f"f{k} double" for k in range(FEATURES)) + ", y double, n long"
    seen = labelled.mapInArrow(lean(run), kinds).toPandas()
    if seen.empty:
        return ToxicityModel([], np.array([0.0] * FEATURES + [-30.0]))
    data = np.repeat(seen.to_numpy(dtype=float)[:, :-1], seen["n"], axis=0)
    return ToxicityModel(terms, fit_logistic(data[:, :-1], data[:, -1]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``; those of at least 0.3 are predicted toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = model.score(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
