"""SentencePiece encoding by batched Viterbi, and decoding.

Words of equal length advance together: at every end position, hashes of all substrings
that end there are looked up among the sorted piece keys, the longest first, and the best piece
and its backpointer are kept. Characters that no piece covers fall back to their bytes.

A merge-rank model has no log probabilities: what it prefers is the order of its merges. So
a step of the lattice is worth nothing where the merges of the two pieces that meet would have
crossed their border, and one otherwise. Then each prefix of a word has exactly one best path, and that is the
model's own segmentation.
"""

from __future__ import annotations

import functools
import itertools
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import lean

SPACE = "▁"
#: Words whose ids a worker keeps; beyond it the store starts anew.
KNOWN_WORDS = 500_000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Behind a character without a piece, or at a word's beginning, anything may follow.
OPEN = -1
#: Longer words are cut into windows that advance together; so many characters of each are also those of the next one.
WINDOW, OVERLAP = 1024, 256
#: Borders of two pieces whose answers a worker keeps, each at the place that its hash names.
KNOWN_BORDERS = 1 << 20


class PieceModel:
    """Pieces of a SentencePiece model of merge ranks; text is escaped as the model does it (dummy prefix, U+2581).

    Pieces are numbered in the order in which merging makes them: characters first, then by rank. A longer
    piece is known by its last merge, of ``left`` and ``right``. Pieces hold U+2581 only at their
    beginning, so no piece crosses from a word to the next, nor from letters to most marks: texts are cut
    there too, and a word is encoded once, whatever mark follows it.
    """

    def __init__(self, path: str, keep: int = KNOWN_WORDS):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.raw = [p.encode("utf-8") for p in self.pieces]
        for b, i in self.byte_id.items():
            self.raw[i] = bytes([b])
        skip = lambda i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)
        usable = [i for i, p in enumerate(self.pieces) if not skip(i) and SPACE not in p.lstrip(SPACE)]
        usable.sort(key=lambda i: (len(self.pieces[i]) > 1, -sp.get_score(i)))
        self._number(usable)
        self.units = self.units_of([self.pieces[i] for i in usable])
        self.bytes_of = pa.array(self.raw, pa.large_binary())
        self.keep, self.known = keep, {}
        self.border, self.answer = np.full(KNOWN_BORDERS, -1, dtype=np.int64), np.zeros(KNOWN_BORDERS, dtype=bool)

    def _number(self, usable: list[int]) -> None:
        number: dict[str, int] = {}
        texts, left, right, ids = [], [], [], []
        for i in usable:
            piece, n = self.pieces[i], len(texts)
            made = (n, n) if len(piece) == 1 else self._last_merge(piece, number, left, right, texts)
            if made is None:
                continue  # no merges lead to it
            number[piece] = n
            texts.append(piece)
            ids.append(i)
            left.append(made[0])
            right.append(made[1])
        self.number, self.texts = number, texts
        self.left, self.right, self.ids = np.array(left), np.array(right), np.array(ids, dtype=np.int64)
        self.lengths = np.array([len(p) for p in texts])
        self.hashes = np.array([self.key(p) for p in texts], dtype=np.uint64)
        self.longest = int(self.lengths.max())
        self.powers = np.array([pow(int(BASE), n, 2**64) for n in range(2 * self.longest + 1)], dtype=np.uint64)
        assert len(np.unique(self.hashes)) == len(texts)
        # the keys of each length, sorted: a probe meets only pieces of its own length
        self.by_length = {}
        for n in range(1, self.longest + 1):
            at = np.flatnonzero(self.lengths == n)
            at = at[np.argsort(self.hashes[at])]
            maybe = np.zeros(1 << 16, dtype=bool)
            maybe[(self.hashes[at] >> np.uint64(48)).astype(np.int64)] = True
            self.by_length[n] = (self.hashes[at], at, maybe)

    @staticmethod
    def units_of(pieces: list[str]) -> re.Pattern:
        """What a text is cut into: before each U+2581 and, where no piece has its two sides side by side, before a mark."""
        pairs = {(p[k - 1], p[k]) for p in pieces for k in range(1, len(p))}
        plain = string.ascii_letters + string.digits
        marks = [m for m in string.punctuation if not any((c, m) in pairs for c in plain)]
        if not marks:
            return re.compile(f"{SPACE}+[^{SPACE}]*")
        joined = re.escape("".join(sorted({SPACE} | {a for a, b in pairs if b in marks})))
        marks = re.escape("".join(marks))
        return re.compile(f"(?:{SPACE}+|[{marks}])(?:[^{SPACE}{marks}]+|(?<=[{joined}])[{marks}])*")

    @staticmethod
    def _last_merge(piece: str, number: dict[str, int], left: list[int], right: list[int], texts: list[str]) -> tuple[int, int] | None:
        """The two pieces whose merge makes this one: no earlier merge crosses where they meet."""
        for cut in range(1, len(piece)):
            a, b = number.get(piece[:cut]), number.get(piece[cut:])
            if a is None or b is None:
                continue
            x, y, limit = a, b, len(texts)
            while True:
                across = number.get(texts[x] + texts[y])
                if across is not None and across < limit:
                    break
                if x > y or left[y] == y:
                    if right[x] == x:
                        return a, b
                    limit, x = x, right[x]
                else:
                    limit, y = y + 1, left[y]
        return None

    @staticmethod
    def codes(words: list[str]) -> np.ndarray:
        """Code points of words of one length, a row each."""
        return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1)

    @staticmethod
    def running(codes: np.ndarray) -> np.ndarray:
        """Polynomial hashes of all prefixes, a column each."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
        for k in range(codes.shape[1]):
            out[:, k + 1] = out[:, k] * BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
        return out

    @classmethod
    def key(cls, piece: str) -> int:
        return int(cls.running(cls.codes([piece]))[0, -1])

    def look_up(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Numbers of the pieces of this length with these hashes, -1 where there is none."""
        keys, numbers, maybe = self.by_length[length]
        out = np.full(len(hashes), -1)
        some = np.flatnonzero(maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(keys, hashes[some]), len(keys) - 1)
            out[some] = np.where(keys[at] == hashes[some], numbers[at], -1)
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``undone``, which is asked once for each border while its answer is kept."""
        border = a * len(self.ids) + b
        at = ((border.astype(np.uint64) * BASE) >> np.uint64(44)).astype(np.int64) & (KNOWN_BORDERS - 1)
        new = np.flatnonzero(self.border[at] != border)
        if len(new):
            out = self.answer[at]
            _, first, back = np.unique(border[new], return_index=True, return_inverse=True)
            some = new[first]
            said = self.undone(a[some], b[some])
            out[new] = said[back]
            self.border[at[some]], self.answer[at[some]] = border[some], said
            return out
        return self.answer[at]

    def undone(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves a border between the pieces a and b.

        Their merges are undone, the latest first. Whatever then stands at the border must not have
        been merged across it: by a merge that comes before the one just undone.
        """
        out = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        x, y, limit = a.copy(), b.copy(), np.full(len(a), len(self.ids))
        while len(at):
            sizes = self.lengths[x] + self.lengths[y]
            both = self.hashes[x] * self.powers[self.lengths[y]] + self.hashes[y]
            across = np.full(len(at), -1)
            for n in np.unique(sizes):
                if n <= self.longest:
                    of = sizes == n
                    across[of] = self.look_up(both[of], int(n))
            crossed = (across >= 0) & (across < limit)
            out[at[crossed]] = False
            first = (x > y) | (self.left[y] == y)
            done = crossed | (first & (self.right[x] == x))
            limit = np.where(first, x, y + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
            at, x, y, limit = at[~done], x[~done], y[~done], limit[~done]
        return out

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length."""
        return self.paths(words, *self.lattice(words))

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For every end in words of one length: the last piece of the best path to it, and where that begins."""
        codes, length = self.codes(words), len(words[0])
        run = np.ascontiguousarray(self.running(codes).T)  # a row for each end
        last = np.full((length + 1, len(words)), OPEN, dtype=np.int64)
        back = np.zeros((length + 1, len(words)), np.int32)
        for end in range(1, length + 1):
            left = np.arange(len(words))  # words whose best step to this end is not known yet
            for n in range(min(end, self.longest), 0, -1):
                if len(left) == len(words):
                    piece = self.look_up(run[end] - run[end - n] * self.powers[n], n)
                else:
                    piece = self.look_up(run[end][left] - run[end - n][left] * self.powers[n], n)
                at = np.flatnonzero(piece >= 0)
                if not len(at):
                    continue
                before, own = last[end - n][left[at]], piece[at]
                worth = before < 0
                check = np.flatnonzero(~worth)
                if len(check):
                    worth[check] = self.apart(before[check], own[check])
                best = left[at[worth]]
                back[end][best], last[end][best] = end - n, own[worth]
                stays = np.ones(len(left), dtype=bool)
                stays[at[worth]] = False
                left = left[stays]
            back[end][left] = end - 1  # one character by its bytes
        return last, back

    def stands(self, a: int, b: int) -> bool:
        """``undone`` for one border."""
        x, y, limit = a, b, len(self.ids)
        while True:
            across = self.number.get(self.texts[x] + self.texts[y])
            if across is not None and across < limit:
                return False
            if x > y or self.left[y] == y:
                if self.right[x] == x:
                    return True
                limit, x = x, int(self.right[x])
            else:
                limit, y = y + 1, int(self.left[y])

    def long_word(self, word: str) -> bytes:
        """Ids of a word without any place to cut it: windows of it advance together and are joined where they agree.

        What follows an end depends on the best last pieces of as many ends before as the longest piece has characters. So where a window gives so
        many ends in a row the pieces that the windows before gave them, all that follows in it is right. Until it does (texts of one
        repeated pattern may never), single steps go on.
        """
        n, size = len(word), WINDOW + OVERLAP
        last = np.full(n + 1, OPEN, dtype=np.int64)
        starts = [*range(0, n - size, WINDOW), n - size]
        asked: dict[tuple[int, int], bool] = {}
        done = 0
        for at in range(0, len(starts), 1024):
            some = starts[at : at + 1024]
            found, _ = self.lattice([word[s : s + size] for s in some])
            for s, own in zip(some, found.T, strict=True):
                same = np.cumsum(np.r_[0, last[s + 1 : done + 1] == own[1 : done - s + 1]])
                agreed = np.flatnonzero(same[self.longest :] - same[: -self.longest] == self.longest) if len(same) > self.longest else []
                end = s + size
                if not done or len(agreed):
                    after = s + int(agreed[0]) + self.longest if done else 0
                    last[after + 1 : end + 1] = own[after - s + 1 :]
                else:
                    self._go_on(word, last, done, end, own[-(end - done) :], asked)
                done = end
        ids, end = [], n
        while end:
            piece = int(last[end])
            ids += [int(self.ids[piece])] if piece >= 0 else [self.byte_id[b] for b in reversed(word[end - 1].encode("utf-8"))]
            end -= int(self.lengths[piece]) if piece >= 0 else 1
        return np.array(ids[::-1], dtype="<u4").tobytes()

    def _go_on(self, word: str, last: np.ndarray, done: int, end: int, own: np.ndarray, asked: dict) -> None:
        """Single steps from ``done``; from where the window's pieces ``own`` are met for long enough, they are taken."""
        row = 0
        for e in range(done + 1, end + 1):
            for n in range(min(e, self.longest), 0, -1):
                piece = self.number.get(word[e - n : e])
                if piece is None:
                    continue
                border = (int(last[e - n]), piece)
                if border[0] >= 0 and border not in asked:
                    asked[border] = self.stands(*border)
                if border[0] < 0 or asked[border]:
                    last[e] = piece
                    break
            row = row + 1 if last[e] == own[e - done - 1] else 0
            if row == self.longest:
                last[e + 1 : end + 1] = own[e - done :]
                return

    def paths(self, words: list[str], last: np.ndarray, back: np.ndarray) -> list[bytes]:
        """Ids along the backpointers of all words at once, from the end."""
        rows, at, steps = np.arange(len(words)), np.full(len(words), len(last) - 1), []
        while at.any():
            steps.append(np.where(at > 0, last[at, rows], -2))
            at = np.where(at > 0, back[at, rows], 0)
        path = np.stack(steps[::-1], axis=1)
        there = path >= 0
        data, ends = self.ids[path[there]].astype("<u4").tobytes(), (4 * np.cumsum(there.sum(axis=1))).tolist()
        out = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for k in np.flatnonzero((path == OPEN).any(axis=1)).tolist():  # words with characters by their bytes
            ids, end = [], len(last) - 1
            while end:
                ids += [int(self.ids[last[end, k]])] if last[end, k] >= 0 else [self.byte_id[b] for b in reversed(words[k][end - 1].encode("utf-8"))]
                end = int(back[end, k])
            out[k] = np.array(ids[::-1], dtype="<u4").tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as bytes of little-endian unsigned 32-bit numbers; none for null and empty texts."""
        if len(self.known) > self.keep:
            self.known = {}
        split = [self.units.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        by_length: dict[int, list[str]] = {}
        for w in set(itertools.chain.from_iterable(split)).difference(self.known):
            by_length.setdefault(len(w), []).append(w)
        for length in [n for n in by_length if n > WINDOW + OVERLAP]:
            self.known.update((w, self.long_word(w)) for w in by_length.pop(length))
        for length, words in by_length.items():
            step = max(1, 200_000 // length)
            for s in range(0, len(words), step):
                some = words[s : s + step]
                self.known.update(zip(some, self.viterbi(some), strict=True))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: list[bytes | None]) -> list[str | None]:
        """The texts of ids, all at once; bytes that are no UTF-8 become replacement characters."""
        numbers = np.frombuffer(b"".join(x or b"" for x in ids), "<u4")
        joined = self.bytes_of.take(pa.array(numbers))
        offsets, data = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1), joined.buffers()[2]
        ends = offsets[np.cumsum([len(x or b"") // 4 for x in ids], dtype=np.int64)].tolist()
        data = data.to_pybytes() if data is not None else b""
        parts = zip(ids, [int(offsets[0]), *ends], ends, strict=False)
        return [None if x is None else data[a:b].decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ") for x, a, b in parts]


@functools.cache
def model_of(path: str) -> PieceModel:
    """One model for each Python worker, so that its tasks share the words they know."""
    return PieceModel(path)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_pieces): ids as bytes. Null and empty texts have none; a U+2581 in a text comes back as a blank."""

    def run(batches):
        model = model_of(model_path)
        for batch in batches:
            ids = model.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["id", "ids", "n_pieces"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "id long, ids binary, n_pieces long")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with a column text, decoded from its ids; null ids give a null text."""
    names = [*encoded.columns, "text"]
    at = encoded.columns.index("ids")

    def run(batches):
        model = model_of(model_path)
        for batch in batches:
            texts = model.decode(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return encoded.mapInArrow(lean(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", text string")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` encoded and decoded again: doc_id, n_pieces, ids_crc32, decoded_crc32 (of the decoded text)."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    decoded = decode_pieces(encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return decoded.select(F.col("id").alias("doc_id"), "n_pieces", F.crc32("ids").alias("ids_crc32"), F.crc32("text").alias("decoded_crc32"))
