"""Token counts kept by signed deltas: totals by source, language and tokenizer version, committed batch by batch.

A store is a folder. ``batch=<id>`` holds one batch's additive rows and is committed by the marker that Spark's writer
leaves last; a folder without it (a driver that died) is ignored by readers and written again by the next delivery of
that batch. A batch that is committed already is skipped, so deliveries may repeat. ``base=<n>`` is a compaction: sums of the
batches it names.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from arealens.llm.staging import stage_table

GROUP = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens")
WORDS = "words"
# Fixed value: the split pattern that belongs to the byte-level vocabularies.
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def encoder(path: str):
    """Token counter of a rank file, or of white-space words for ``words``; kept in the worker."""
    if path == WORDS:
        return lambda text: len(text.encode("utf-8", "replace").split())
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        own = tiktoken.Encoding("own", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        _encoders[path] = lambda text: len(own.encode_ordinary(text))
    return _encoders[path]


def count_tokens(docs: DataFrame, tokenizers: Mapping[str, str], text: str = "text", prefix: str = "n_") -> DataFrame:
    """Every other column of ``docs`` plus one long ``<prefix><version>`` per tokenizer, in place of the text.

    ``tokenizers`` maps a version name to a rank file on the driver (shipped to the executors) or to ``words``. Whole
    texts are encoded; NULL and empty texts have 0 tokens. Columns that clash with the new names are replaced.
    """
    spark = docs.sparkSession
    names, files = list(tokenizers), {}
    for name, path in tokenizers.items():
        if path != WORDS:
            spark.sparkContext.addFile(path)
        files[name] = path if path == WORDS else os.path.basename(path)
    new = [f"{prefix}{n}" for n in names]
    kept = docs.drop(*new)
    schema = kept.drop(text).schema
    for n in new:
        schema = schema.add(n, "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [encoder(f if f == WORDS else SparkFiles.get(f)) for f in files.values()]
        for batch in batches:
            texts = pc.fill_null(batch.column(text), "")
            counts: list[list[int]] = [[] for _ in names]
            for value in texts:
                own = value.as_py()
                for out, counter in zip(counts, counters):
                    out.append(counter(own))
            rest = [(c, batch.column(c)) for c in batch.schema.names if c != text]
            columns = [c for _, c in rest] + [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays(columns, [n for n, _ in rest] + new)

    return kept.mapInArrow(count, schema)


def signed(counted: DataFrame, sign: int, versions: Mapping[str, str], times: str | None = None) -> DataFrame:
    """Change rows of counted documents: +1 for inserts, -1 for deletes; ``versions`` maps version to count column.

    A revised count is a delete of the old and an insert of the new count. ``times`` names a column that says how many equal
    documents a row stands for.
    """
    many = F.lit(sign).cast("long") * (F.col(times) if times else F.lit(1))
    pairs = F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(f"`{c}`").alias("n")) for v, c in versions.items()])
    return counted.select("source", "lang", many.alias("n_docs"), F.explode(pairs).alias("_p")).select(
        "source", "lang", "_p.tokenizer", "n_docs", (F.col("_p.n") * F.col("n_docs")).alias("n_tokens")
    )


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])


class Rollup:
    """Totals by source, language and tokenizer version in one folder of the shared storage."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _store(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _committed(self, kind: str) -> list[str]:
        """Ids of finished folders ``<kind>=<id>``, read from the listing alone."""
        at, store = self._store(self.folder)
        if not store.exists(at):
            return []
        names = [s.getPath().getName() for s in store.listStatus(at)]
        own = [n.split("=", 1)[1] for n in names if n.startswith(f"{kind}=")]
        return sorted(i for i in own if store.exists(self._store(f"{self.folder}/{kind}={i}/_SUCCESS")[0]))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of change rows once; False if it was committed before. Only sums by group are written."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"batch id {batch!r} needs letters, digits, dot, dash or underscore")
        if batch in self.batches():
            return False
        summed(changes).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        return True

    def batches(self) -> list[str]:
        """Every committed batch, those in the newest compaction included."""
        return sorted({*self._committed("batch"), *self._base()[1]})

    def _base(self) -> tuple[str | None, list[str]]:
        bases = self._committed("base")
        if not bases:
            return None, []
        last = max(bases, key=int)
        ids = self.spark.read.schema("batch string").parquet(f"{self.folder}/base={last}/ids")
        return last, [r.batch for r in ids.collect()]

    def totals(self) -> DataFrame:
        """Current sums; groups whose documents are all gone keep a row of zeros. An empty store has no rows."""
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
        last, inside = self._base()
        paths = [f"{self.folder}/base={last}/sums"] * (last is not None)
        paths += [f"{self.folder}/batch={b}" for b in self._committed("batch") if b not in inside]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return summed(self.spark.read.schema(schema).parquet(*paths))

    def compact(self) -> None:
        """Writes the sums of all committed batches as a new base; it counts from its last marker on."""
        last, _ = self._base()
        at = f"{self.folder}/base={0 if last is None else int(last) + 1}"
        ids = self.batches()
        self.totals().write.mode("overwrite").parquet(f"{at}/sums")
        self.spark.createDataFrame([(b,) for b in ids], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{at}/ids")
        path, store = self._store(f"{at}/_SUCCESS")
        store.create(path, True).close()


def tidy(text):
    """White space at the ends dropped and runs of blanks and tabs made one blank."""
    return F.regexp_replace(F.trim(text), "[ \\t]+", " ")


def maintain(docs: DataFrame, folder: str, tokenizers: Mapping[str, str]) -> Rollup:
    """A rollup of ``docs`` (doc_id, text, source, lang) brought up in three batches, each delivered twice.

    ``load`` inserts every document; ``revise`` replaces the counts of texts that tidying changes; ``withdraw`` deletes
    all but one of the documents with one whole text (the smallest doc_id stays, of repeated rows one). Documents without
    text are never withdrawn.
    """
    raw = docs.select("doc_id", "source", "lang", "text")
    neat = tidy(F.col("text"))
    both = raw.select(
        "doc_id", "source", "lang", F.sha2("text", 256).alias("_sha"),
        F.explode(F.when(F.col("text").eqNullSafe(neat), F.array(F.struct(F.lit(2).alias("state"), F.col("text").alias("text"))))
                  .otherwise(F.array(F.struct(F.lit(0).alias("state"), F.col("text").alias("text")), F.struct(F.lit(1).alias("state"), neat.alias("text"))))).alias("_v"),
    ).select("doc_id", "source", "lang", "_sha", "_v.state", "_v.text")
    counted = stage_table(count_tokens(both, tokenizers), "token-counts")
    versions = {v: f"n_{v}" for v in tokenizers}
    store = Rollup(docs.sparkSession, folder)
    now = counted.filter("state > 0")
    # equal texts have equal counts: copies shrink to one row per source and language before they meet
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "source", "lang")).alias("least")
    counts = [F.first(c).alias(c) for c in versions.values()]
    copies = now.filter("_sha is not null").groupBy("_sha", "source", "lang").agg(F.count(F.lit(1)).alias("n"), least, *counts)
    first = copies.groupBy("_sha").agg(F.sum("n").alias("all"), F.min("least").alias("first")).filter("all > 1")
    gone = copies.join(first, "_sha").withColumn("gone", F.col("n") - F.col("least").eqNullSafe(F.col("first")).cast("long"))
    old, new = counted.filter("state = 0"), counted.filter("state = 1")
    deliveries = {
        "load": signed(counted.filter("state != 1"), 1, versions),
        "revise": signed(old, -1, versions).unionByName(signed(new, 1, versions)),
        "withdraw": signed(gone.filter("gone > 0"), -1, versions, "gone"),
    }
    for batch in ("load", "revise", "revise", "withdraw", "load", "withdraw"):
        store.commit(batch, deliveries[batch])
    return store
