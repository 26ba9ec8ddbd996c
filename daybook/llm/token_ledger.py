"""Token totals kept up by deltas: signed changes, additive roll-ups, idempotent batch commits.

A ledger is a folder in the shared store. A batch of changes (insert, revise, delete) is
joined with the current counts of its own keys, becomes rows of minus the old and plus the new count, and
these are rolled up by source, language and tokenizer version. A commit writes only what it changes: a
segment of new counts, dealt by key hash so that a small batch reads only the parts that hold its keys, and the roll-up. Segments and
roll-ups are merged after some commits. The commit record, renamed into place last, makes
them count: of two committers that take one number the second starts anew, a batch that is committed again
changes nothing, and one that broke off leaves nothing that is read.
"""

from __future__ import annotations

import functools
import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import forget, lean, shared_dir, stage
from daybook.llm.packing import encoder_of
from daybook.llm.pieces import SPACE

KEY = ["doc_id", "tokenizer_version"]
GROUP = ["source", "lang", "tokenizer_version"]
VALUE = "struct<tokens: long, source: string, lang: string>"
COUNTS = "doc_id long, tokenizer_version string, source string, lang string, tokens long"
SEGMENT = f"doc_id long, tokenizer_version string, seq long, new {VALUE}, old {VALUE}, bucket int"
TOTALS = "source string, lang string, tokenizer_version string, documents long, tokens long"
COMMITS = "seq long, batch_id string, segments array<string>, deltas array<string>"
#: Parts of the state by key hash; a batch of fewer keys reads fewer. Give a large ledger more.
BUCKETS = 64
#: Words of an escaped text, which begins with U+2581.
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")
#: So many segments, and roll-ups, are merged into one.
MERGE_AFTER = 16


class TokenLedger:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, merge_after: int = MERGE_AFTER):
        self.spark, self.path, self.buckets, self.merge_after = spark, path.rstrip("/"), buckets, merge_after
        self._commits: list = []
        self._load()

    def _load(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        found = self.spark.read.schema(COMMITS).json(f"{self.path}/commits").collect() if there else []
        self._commits = sorted(found, key=lambda r: r["seq"])

    def _record(self, batch_id: str | None, segments: list[str], deltas: list[str]) -> bool:
        """Add the next commit's record under its number; false if another committer has taken that."""
        jvm, gateway, seq = self.spark._jvm, self.spark.sparkContext._gateway, len(self._commits)
        path = jvm.org.apache.hadoop.fs.Path
        files = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        draft, final = path(f"{self.path}/drafts/{uuid.uuid4().hex}.json"), path(f"{self.path}/commits/{seq:09d}.json")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps({"seq": seq, "batch_id": batch_id, "segments": segments, "deltas": deltas}).encode() + b"\n"))
        out.close()
        files.mkdirs(final.getParent())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, gateway.new_array(rename, 0))  # fails where the file exists
        except Exception as e:
            if not files.exists(final):
                raise e
            files.delete(draft, False)
            return False
        self._load()
        return True

    def _live(self, what: str) -> list[str]:
        return self._commits[-1][what] if self._commits else []

    def _segments(self, names: list[str]) -> DataFrame:
        reader = self.spark.read.schema(SEGMENT).option("basePath", f"{self.path}/segments")
        return reader.parquet(*[f"{self.path}/segments/segment={n}" for n in names])

    def _state(self, buckets: list[int] | None = None) -> DataFrame:
        """(doc_id, tokenizer_version, new): the latest value of each key, null where deleted."""
        segments = self._live("segments")
        rows = self._segments(segments) if segments else self.spark.createDataFrame([], SEGMENT)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.groupBy(*KEY).agg(F.max_by("new", "seq").alias("new"), F.max("seq").alias("seq"))

    def counts(self) -> DataFrame:
        """The current count of each (document, tokenizer version)."""
        return self._state().where("new IS NOT NULL").select(*KEY, "new.source", "new.lang", "new.tokens")

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer version, over all committed deltas."""
        deltas = self._live("deltas")
        if not deltas:
            return self.spark.createDataFrame([], TOTALS)
        rows = self.spark.read.schema(TOTALS).parquet(*[f"{self.path}/{x}" for x in deltas])
        return rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 OR tokens <> 0")

    def _bucket(self):
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int").alias("bucket")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply (op, doc_id, tokenizer_version, source, lang, tokens); false if the batch was known already.

        op: insert and revise set a count, whether or not there was one; delete removes it, or does
        nothing. Of several changes of a document, deletes lose to counts and the largest
        (tokens, source, lang) wins. A null count is 0; changes with a null id, version or op are skipped;
        null sources and languages are groups of their own. More columns are ignored.
        """
        self._load()
        if self._known(batch_id):
            return False
        keep = F.when(F.col("op") != "delete", 1).otherwise(0)
        valid = changes.where("op IN ('insert', 'revise', 'delete') AND doc_id IS NOT NULL AND tokenizer_version IS NOT NULL")
        new = F.struct(keep.alias("keep"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"), "source", "lang")
        value = F.when(F.col("new.keep") == 1, F.struct("new.tokens", "new.source", "new.lang"))
        incoming = stage(valid.groupBy(*KEY).agg(F.max(new).alias("new")).select(*KEY, value.alias("new"), self._bucket()), "incoming")
        touched = [r["bucket"] for r in incoming.select("bucket").distinct().collect()]
        while not self._known(batch_id):
            name, seq = uuid.uuid4().hex, len(self._commits)
            old = self._state(touched if len(touched) < self.buckets else None).select(*KEY, F.col("new").alias("old"))
            joined = incoming.join(old, KEY, "left").select(*KEY, F.lit(seq).cast("long").alias("seq"), "new", "old", "bucket")
            segment, deltas = name, f"deltas-{name}"
            self._write_segment(joined.where("new IS NOT NULL OR old IS NOT NULL"), segment)
            self._rolled(segment).write.parquet(f"{self.path}/{deltas}")
            last = self._commits[-1] if self._commits else {"segments": [], "deltas": []}
            if self._record(batch_id, [*last["segments"], segment], [*last["deltas"], deltas]):
                forget(incoming)
                if len(self._commits[-1]["segments"]) >= self.merge_after:
                    self.merge()
                return True
            self._load()
        forget(incoming)
        return False

    def _known(self, batch_id: str) -> bool:
        return any(c["batch_id"] == batch_id for c in self._commits)

    def _write_segment(self, rows: DataFrame, name: str) -> None:
        # a segment has about as many files as parts or shuffle partitions, whichever is more
        spread = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        rows.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(spread))).sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(f"{self.path}/segments/segment={name}")

    def _rolled(self, segment: str) -> DataFrame:
        rows = self._segments([segment])
        side = lambda of, sign: F.when(F.col(of).isNotNull(), F.struct(F.col(f"{of}.source").alias("source"), F.col(f"{of}.lang").alias("lang"), F.lit(sign).cast("long").alias("documents"), (sign * F.col(f"{of}.tokens")).alias("tokens")))
        both = rows.select("tokenizer_version", F.explode(F.array(side("old", -1), side("new", 1))).alias("d")).where("d IS NOT NULL")
        return both.select("d.*", "tokenizer_version").groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).select(*[c.split()[0] for c in TOTALS.split(", ")])

    def merge(self) -> bool:
        """All segments and roll-ups become one each; false if another committer came first, whose state then holds."""
        if not self._commits:
            return False
        name = uuid.uuid4().hex
        self._write_segment(self._state().where("new IS NOT NULL").select(*KEY, "seq", "new", F.lit(None).cast(VALUE).alias("old"), self._bucket()), name)
        self.totals().write.parquet(f"{self.path}/deltas-{name}")
        return self._record(None, [name], [f"deltas-{name}"])


class PieceCounter:
    """Numbers of SentencePiece ids of whole texts; words are counted once, as no piece crosses from one to the next."""

    def __init__(self, path: str, keep: int = 300_000):
        import sentencepiece

        self.model, self.keep, self.known = sentencepiece.SentencePieceProcessor(model_file=path), keep, {}

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > self.keep:
            self.known = {}
        split = [WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = list({w for words in split for w in words if w not in self.known})
        # the model puts a blank before a text, so a word goes in without its own; a blank alone is one piece
        self.known.update((w, len(ids) or 1) for w, ids in zip(new, self.model.encode([w[1:] for w in new], num_threads=1), strict=True))
        return [sum(map(self.known.__getitem__, words)) for words in split]


@functools.cache
def piece_counter_of(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], beside: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, columns ``beside`` as text, tokenizer_version, tokens): the ids of every whole text under each tokenizer, {version: file}.

    A ``.json`` file is read by tokenizers, a ``.model`` by sentencepiece. Null and empty texts have 0 tokens.
    """

    def counted(path: str, texts: list[str | None]) -> list[int]:
        return piece_counter_of(path).count(texts) if path.endswith(".model") else [len(ids) // 4 for ids in encoder_of(path).encode(texts)]

    names = ["doc_id", *beside, "tokenizer_version", "tokens"]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for version, path in tokenizers.items():
                n = counted(path, texts)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in beside], F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run, 1 << 20), ", ".join(["doc_id long", *[f"`{c}` string" for c in beside], "tokenizer_version string, tokens long"]))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of ``documents`` under two tokenizers after four batches: estimates go in, exact counts revise them,
    toxic documents go out, and the revision comes once more and changes nothing.

    A repeated doc_id is one document: its largest count holds.
    """
    import public_tokenizers

    versions = {"word_bpe_49k": public_tokenizers.path("word_bpe_49k.json"), "piece_bpe_32k": public_tokenizers.path("piece_bpe_32k.model")}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    version = F.explode(F.array(*map(F.lit, versions))).alias("tokenizer_version")
    estimate = F.floor(F.length(F.coalesce("text", F.lit(""))) / 6).cast("long")
    loaded = docs.select(F.lit("insert").alias("op"), "doc_id", "source", "lang", estimate.alias("tokens"), version)
    # a text's own source and language travel with its counts, so no join on ids is needed
    exact = count_tokens(docs, versions, ("source", "lang")).withColumn("op", F.lit("revise"))
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id").distinct()
    gone = toxic.select(F.lit("delete").alias("op"), "doc_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("tokens"), version)
    ledger = TokenLedger(spark, f"{shared_dir(spark)}/ledger")
    ledger.commit("load", loaded)
    ledger.commit("recount", exact)
    ledger.commit("toxic", gone)
    ledger.commit("recount", exact)
    return ledger.totals()
