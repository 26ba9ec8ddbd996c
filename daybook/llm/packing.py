"""Best-fit packing of tokenised documents, after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so the instance is its histogram: at most
``capacity`` counts however many documents there are. The driver reduces and packs those
counts into patterns with multiplicities; Spark tokenises, counts, ranks the pieces of
each length and looks every rank up in the patterns' slots.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from daybook.llm.common import lean, stage

#: Encoded words, and encoded stems, that a worker keeps in a store; beyond it a new store begins and the full one stays beside it,
#: so that words which come again are taken over.
CACHED_WORDS = 250_000
BLANKS = re.compile("[ \t\n\r\x0b\x0c]+")
#: Only these split str.split() from the tokenizer's own white space.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
TAIL = ".,;:!?#$%&*()"


class CachedEncoder:
    """Ids of whole texts, as bytes of little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its
    words in turn, and each different word is encoded once. It also parts letters
    from marks, so a word of letters with marks behind is its stem and its tail. New stems
    are encoded together, as one text; an end-of-word token closes each of them.
    """

    def __init__(self, path: str, keep: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        # of the tokenizer's calls the one that tracks no offsets
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _alone(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _add_stems(self, new: list[str]) -> None:
        for s in range(0, len(new), 2000):
            some = new[s : s + 2000]
            ids = self._ids(" ".join(some))
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                data, at = ids.tobytes(), 0
                for stem, end in zip(some, (4 * ends).tolist(), strict=True):
                    self.stems[stem], at = data[at:end], end
            else:
                self.stems.update((stem, self._alone(stem)) for stem in some)

    def _add(self, new: set[str]) -> None:
        whole, stems, tails = [], [], []
        for w in new:
            stem = w.rstrip(TAIL)
            if stem.isalpha():
                whole.append(w)
                tails.append(w[len(stem) :])
                stems.append(stem.lower() if stem.isascii() else stem)
            else:
                self.words[w] = self._alone(w)
        known = self.stems
        self._add_stems([s for s in set(stems) if s not in known])
        known.update((t, self._alone(t)) for t in set(tails) if t and t not in known)
        for w, stem, tail in zip(whole, stems, tails, strict=True):
            self.words[w] = known[stem] + known[tail] if tail else known[stem]
        if len(known) > self.keep:
            self.stems = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.words) > self.keep:
            self.older, self.words = self.words, {}
        split = [[] if not t else BLANKS.split(t) if any(c in t for c in SEPARATORS) else t.split() for t in texts]
        known = self.words
        if new := {w for words in split for w in words if w not in known}:
            older = self.older
            known.update((w, older[w]) for w in new if w in older)
            if new := {w for w in new if w not in known}:
                self._add(new)
        return [b"".join(map(known.__getitem__, words)) for words in split]


@functools.cache
def encoder_of(path: str) -> CachedEncoder:
    """One encoder for each Python worker, so that its tasks share the words they know."""
    return CachedEncoder(path)


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids and the end id, cut at ``capacity``."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        encoder, end = encoder_of(tokenizer_path), np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    rows.append((doc_id, n, at // 4, len(cut) // 4, zlib.crc32(cut)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run, 1 << 20), "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Stock:
    """How many items of each size are left; sizes are kept sorted."""

    def __init__(self, counts: dict[int, int]):
        self.n = {w: c for w, c in counts.items() if c > 0}
        self.sizes = sorted(self.n)

    def take(self, w: int, m: int) -> None:
        self.n[w] -= m
        if not self.n[w]:
            del self.n[w]
            del self.sizes[bisect.bisect_left(self.sizes, w)]

    def left(self, w: int, taken: Counter) -> int:
        return self.n.get(w, 0) - taken[w]

    def largest(self, most: int, taken: Counter) -> int | None:
        for i in range(bisect.bisect_right(self.sizes, most) - 1, -1, -1):
            if self.left(self.sizes[i], taken) > 0:
                return self.sizes[i]
        return None

    def smallest(self, count: int, taken: Counter, over: int = 0) -> list[int]:
        out: list[int] = []
        for w in self.sizes[bisect.bisect_right(self.sizes, over) :]:
            out += [w] * min(self.left(w, taken), count - len(out))
            if len(out) == count:
                break
        return out


def dominating_set(stock: _Stock, j: int, capacity: int) -> tuple[int, ...] | None:
    """Of all sets that hold an item of size j, one that dominates the others, where that is proven.

    The reasons, with k the largest item that fits beside j: nothing fits; k fills the bin;
    no two items fit beside j; at most two do and no pair of them is larger than k; at most
    two do, and of the pairs no second item is larger than b, the largest beside j and k.
    """
    taken, room = Counter([j]), capacity - j
    k = stock.largest(room, taken)
    if k is None:
        return (j,)
    small = stock.smallest(3, taken)
    if k == room or len(small) < 2 or small[0] + small[1] > room:
        return (j, k)
    if len(small) == 3 and sum(small) <= room:
        return None
    best, seen = 0, Counter([j])
    for a in reversed(stock.sizes[: bisect.bisect_right(stock.sizes, room)]):
        if stock.left(a, seen) < 1 or 2 * a <= best:
            continue
        b = stock.largest(min(a, room - a), seen + Counter([a]))
        if b is not None:
            best = max(best, a + b)
    if k >= best:
        return (j, k)
    b = stock.largest(room - k, taken + Counter([k]))
    if b is None:
        return None
    above = stock.smallest(2, taken, over=b)
    return (j, k, b) if len(above) < 2 or sum(above) > room else None


def pack_counts(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Patterns (sizes in a bin) with their multiplicities, and how many bins the reduction fixed.

    All items of a size are treated together: a dominating set is fixed as often as the stock of
    its sizes lasts. Every reason for it says that what is left is too large to do better, so items
    that go only strengthen it, as long as the set's own sizes are there. Each turn so uses a size up
    but for two items at most: turns and patterns are bounded by the number of sizes, not of items.
    What remains is packed by best-fit decreasing on counts.
    """
    stock, patterns = _Stock(counts), []
    changed = True
    while changed:
        changed = False
        for j in list(reversed(stock.sizes)):
            while stock.n.get(j) and (found := dominating_set(stock, j, capacity)):
                need = Counter(found)
                times = min(stock.n[w] // q for w, q in need.items())
                for w, q in need.items():
                    stock.take(w, q * times)
                patterns.append((found, times))
                changed = True
    fixed = sum(m for _, m in patterns)
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, sizes: tuple[int, ...], m: int) -> None:
        if room not in open_bins:
            bisect.insort(rooms, room)
            open_bins[room] = []
        open_bins[room].append((sizes, m))

    for w in list(reversed(stock.sizes)):
        left = stock.n[w]
        while left:
            at = bisect.bisect_left(rooms, w)
            if at == len(rooms):
                each = capacity // w
                bins, rest = divmod(left, each)
                if bins:
                    put(capacity - each * w, (w,) * each, bins)
                if rest:
                    put(capacity - rest * w, (w,) * rest, 1)
                break
            room = rooms[at]
            sizes, m = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
            each = room // w
            bins = min(m, left // each)
            if bins:
                put(room - each * w, sizes + (w,) * each, bins)
            elif left:
                put(room - left * w, sizes + (w,) * left, 1)
            used = max(bins, 1)
            if m > used:
                put(room, sizes, m - used)
            left -= bins * each if bins else left
    return patterns + [x for group in open_bins.values() for x in group], fixed


def slots_of(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: rank r of slot (first, each, sequence, offset) sits in
    sequence + (r - first) // each, at offset + (r - first) % each * length. Sorted by length and first."""
    rows, used, sequence = [], Counter(), 0
    for sizes, m in patterns:
        offset = 0
        for w, each in sorted(Counter(sizes).items(), reverse=True):
            rows.append((w, used[w], each, sequence, offset))
            used[w] += each * m
            offset += each * w
        sequence += m
    table = np.array(sorted(rows) or np.empty((0, 5)), dtype=np.int64)
    return dict(zip(("length", "first", "each", "sequence", "offset"), table.T, strict=True))


def rank_within(df: DataFrame, key: str, order: list[str], salts: int) -> DataFrame:
    """Adds rank, 0, 1, ... within each key, with no window over a whole key.

    Rows are dealt into ``salts`` parts of each key, numbered there, and moved up by the
    sizes of the parts before: a table of (keys x salts) rows, bounded where keys are.
    """
    salted = df.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(key, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = salted.withColumn("rank", F.row_number().over(Window.partitionBy(key, "part").orderBy(*order)) - 1)
    return numbered.join(starts, [key, "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, rows_per_part: int = 20_000) -> DataFrame:
    """One row per piece with its place: sequence_id and offset; sequences are gapless from 0.

    A null or empty text is its end id alone; only texts longer than ``capacity`` are cut,
    at multiples of it. Equal documents and repeated rows are separate pieces. Only the
    histogram of lengths, at most ``capacity`` rows, comes to the driver, and only the
    slots, a few for each pattern of lengths, go to the tasks.
    """
    pieces = stage(tokenised_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    patterns, _ = pack_counts(counts, capacity)
    slots = slots_of(patterns)
    keys = slots["length"] * (1 << 48) + slots["first"] if counts else np.empty(0, np.int64)
    ranked = rank_within(pieces, "length", ["doc_id", "piece", "ids_crc32"], max(8, sum(counts.values()) // rows_per_part))

    def place(frames):
        for f in frames:
            length, rank = f["length"].to_numpy(), f["rank"].to_numpy()
            at = np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1
            along = rank - slots["first"][at]
            yield pd.DataFrame({**{c: f[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}, "sequence_id": slots["sequence"][at] + along // slots["each"][at], "offset": slots["offset"][at] + along % slots["each"][at] * length})

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*pieces.columns, "rank").mapInPandas(place, schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 4096 tokens of the public word-level BPE."""
    import public_tokenizers

    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
