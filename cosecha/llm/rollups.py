"""Token counts as delta-maintained rollups.

A ledger keeps, for each committed batch, signed rows: what the batch adds to
and takes from the counts of (source, language, tokenizer version).  Deletes
and revised counts retract exactly what is counted for the document at that
time.  Totals are additive, so a commit adds the batch's summed deltas to the
totals before it and never recounts the corpus.

A batch is written to a folder of its own and counts from the moment its
commit file exists.  Commit files are numbered by version: each is written
whole under another name and renamed to the next free number, which fails if
another writer has taken it.  The batch is then applied again on the newer
totals, so no commit is ever computed on a base that has moved, and a crash
leaves either the whole commit or none.  A batch that is committed already
changes nothing.  The shared folder's file system must rename atomically, as
HDFS does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, importable, scratch, written
from .tokens import STEP_BYTES, default_path, texts_of, word_tokenizer

GROUP = ["source", "lang", "tokenizer_version"]
INSERT, DELETE, REVISE = "insert", "delete", "revise"
_STATE = "doc_id long, source string, lang string, tokenizer_version string, n_docs long, n_tokens long"

_encodings: dict = {}


def _counter(path: str):
    """Numbers of tokens of some texts, by the tokenizer file at ``path``."""
    if path.endswith(".json"):
        encode = word_tokenizer(path).encode
        return lambda texts: np.diff(encode(pa.array(texts, pa.string()))[1])
    if path not in _encodings:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                             special_tokens={})
    encoding = _encodings[path]
    return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]


def counted(docs: DataFrame, op: str, version: str, path: str) -> DataFrame:
    """Changes that insert or revise documents with their token counts under one tokenizer; null texts have none."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in by_bytes(batches, limit=STEP_BYTES):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(count(texts_of(batch)), pa.int64())],
                ["doc_id", "source", "lang", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long").select(
        F.lit(op).alias("op"), "doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), "n_tokens")


def deleted(ids: DataFrame) -> DataFrame:
    """Changes that delete the documents named by ``doc_id``."""
    none = F.lit(None)
    return ids.select(F.lit(DELETE).alias("op"), F.col("doc_id").cast("long").alias("doc_id"),
                      *[none.cast("string").alias(c) for c in GROUP], none.cast("long").alias("n_tokens"))


class Ledger:
    """Signed token counts in a shared folder, batch by batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        importable(spark)
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(
            spark.sparkContext._jsc.hadoopConfiguration())

    # -- commits: one small file for each version

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _read(self, path) -> dict:
        stream = self._fs.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commits(self) -> list[dict]:
        """The committed batches in their order."""
        root = self._at("commits")
        if not self._fs.exists(root):
            return []
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(root))
        return [self._read(self._at(f"commits/{n}")) for n in names if n.endswith(".json")]

    def _commit(self, version: int, record: dict) -> bool:
        """Publish a commit under its version number; False if another writer has taken the number."""
        draft, final = self._at(f"drafts/{uuid.uuid4().hex}.json"), self._at(f"commits/{version:012d}.json")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        self._fs.mkdirs(final.getParent())
        kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.NONE
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), options)
        except Exception:
            if self._fs.exists(final):
                return False
            raise
        return True

    # -- state

    def documents(self, ids: DataFrame | None = None, commits: list[dict] | None = None) -> DataFrame:
        """What is counted now for each document, or for those of ``ids`` (n_docs is 1 everywhere).

        Deltas of other documents go before anything is summed up.
        """
        paths = [c["deltas"] for c in (self.commits() if commits is None else commits)]
        if not paths:
            return self.spark.createDataFrame([], _STATE)
        rows = self.spark.read.schema(_STATE).parquet(*paths)
        if ids is not None:
            rows = rows.join(ids.select("doc_id"), "doc_id", "left_semi")
        return (rows.groupBy("doc_id", *GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .where("n_docs > 0"))

    def totals(self, commits: list[dict] | None = None) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens as of the last commit."""
        schema = _STATE.removeprefix("doc_id long, ")
        done = self.commits() if commits is None else commits
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(done[-1]["totals"])

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes (op, doc_id, source, lang, tokenizer_version, n_tokens); False if it was committed.

        * insert: counts the document; if it is counted already, its former
          counts are retracted, so an insert sent twice counts once.
        * revise: replaces the counts of a counted document, of any version;
          a document that isn't counted stays so.
        * delete: retracts all counts of the document, if there are any.

        Null sources and languages are groups of their own.  Changes without
        doc_id, with another op or, for insert and revise, without n_tokens
        are left out.  Of several changes to one document in a batch one
        counts: delete before revise before insert, then the larger count,
        then source, lang and version.
        Extra columns are ignored; an empty batch commits with no deltas.
        """
        latest = None
        while True:
            done = self.commits()
            if any(c["batch"] == batch for c in done):
                return False
            latest = self._latest(changes) if latest is None else latest
            record = self._deltas(batch, latest, done)
            if self._commit(len(done), {"batch": batch, "order": len(done), **record}):
                return True

    @staticmethod
    def _latest(changes: DataFrame) -> DataFrame:
        """The one change to each document that counts, written."""
        usable = F.col("doc_id").isNotNull() & (
            (F.col("op") == DELETE) | F.col("op").isin(INSERT, REVISE) & F.col("n_tokens").isNotNull())
        rank = F.when(F.col("op") == DELETE, 2).when(F.col("op") == REVISE, 1).otherwise(0)
        fields = [rank.alias("rank"), "n_tokens", *GROUP, "op"]
        latest = (changes.where(usable).groupBy("doc_id").agg(F.max(F.struct(*fields)).alias("c"))
                  .select("doc_id", "c.op", *[F.col(f"c.{g}").alias(g) for g in GROUP], "c.n_tokens"))
        return written(latest, "changes")

    def _deltas(self, batch: str, latest: DataFrame, done: list[dict]) -> dict:
        """Write a batch's signed rows and the totals after it, on top of the commits ``done``."""
        attempt = uuid.uuid4().hex[:12]
        if done:
            known = written(self.documents(latest, done), "known")
            back = known.select("doc_id", *GROUP, (-F.col("n_docs")).alias("n_docs"),
                                (-F.col("n_tokens")).alias("n_tokens"))
            counted_now = latest.where(F.col("op") == REVISE).join(known.select("doc_id").distinct(), "doc_id",
                                                                   "left_semi").select(*latest.columns)
            new = latest.where(F.col("op") == INSERT).unionByName(counted_now)
        else:
            back, new = self.spark.createDataFrame([], _STATE), latest.where(F.col("op") == INSERT)
        deltas = back.unionByName(new.select("doc_id", *GROUP, F.lit(1).cast("long").alias("n_docs"), "n_tokens"))
        delta_path = f"{self.path}/deltas/{batch}-{attempt}"
        deltas.write.parquet(delta_path)
        moved = self.spark.read.schema(_STATE).parquet(delta_path).groupBy(*GROUP).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        totals_path = f"{self.path}/totals/{batch}-{attempt}"
        (self.totals(done).unionByName(moved).groupBy(*GROUP)
         .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
         .where("n_docs <> 0 or n_tokens <> 0").write.parquet(totals_path))
        return {"deltas": delta_path, "totals": totals_path}


WORDS, BYTES = "word_bpe_49k", "byte_bpe_multi_50k"


def report(docs: DataFrame) -> DataFrame:
    """The registered query: a corpus loaded, its exact copies deleted, its other languages recounted.

    Batch ``load`` inserts every document counted by one tokenizer; ``copies``
    deletes all but the smallest doc_id of equal texts; ``languages`` revises
    all documents that aren't English with a tokenizer for many languages;
    ``load`` is then sent again and changes nothing.
    """
    spark = docs.sparkSession
    ledger = Ledger(spark, scratch(spark, "ledger"))
    load = counted(docs, INSERT, WORDS, default_path(f"{WORDS}.json"))
    ledger.apply("load", load)
    texts = docs.where("doc_id is not null").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    first = texts.groupBy("h").agg(F.min("doc_id").alias("first"))
    ledger.apply("copies", deleted(texts.join(first, "h").where("doc_id > first")))
    others = docs.where(~F.col("lang").eqNullSafe("en"))
    ledger.apply("languages", counted(others, REVISE, BYTES, default_path(f"{BYTES}.tiktoken")))
    ledger.apply("load", load)
    return ledger.totals()
