"""Ranked lexical search of a stated set of items over all documents, scoring every different bag of words once.

A score depends on two things of a document alone: how often it holds each term of the items, and its length, which enters as the
small integer m. Documents are therefore reduced to the items' vocabulary, and those with the same counts and the same m form a class. A
class is found by a hash and verified on the counts themselves, scored once for all items, and only then expanded
into its members by ascending key. As members of a class tie in every ranking, no more than ``top`` of them, those with the smallest keys, can ever be
listed; a window that is limited before its shuffle picks them, so a class of any size reaches no task as a whole.

Items are taken in blocks of bounded vocabulary; each block is one pass over the documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from arealens.llm import textbatch as tb
from arealens.llm.staging import stage_table

TOP = 20
BLOCK_BYTES = 16 << 20
NO_KEY = (1 << 63) - 1
SALTS = 64
CELLS = 1 << 22

# Terms are runs of these bytes (digits, letters, all that is not ASCII); the scores' saturation and length norm.
TERM = np.ones(256, bool)
TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
TERM_PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER_AZ = {c: c + 32 for c in range(0x41, 0x5B)}


def term_counts(text: str | None) -> Counter:
    """Terms of one text in lower case (A-Z only) with their counts."""
    return Counter(TERM_PATTERN.findall((text or "").translate(LOWER_AZ)))


class Items:
    """Items of one block: their vocabulary as sorted hashes, and for every term the items that hold it and how often."""

    def __init__(self, rows: list[tuple[object, str | None]]):
        self.keys = [k for k, _ in rows]
        counts = [term_counts(t) for _, t in rows]
        words = sorted({w for c in counts for w in c})
        data, offsets = tb.utf8(pa.array(words, pa.string()))
        hashes = tb.word_hashes(data, offsets[:-1], offsets[1:]) if words else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        place = {words[w]: i for i, w in enumerate(order.tolist())}
        held = sorted((place[w], i, n) for i, c in enumerate(counts) for w, n in c.items())
        self.item = np.array([i for _, i, _ in held], np.int64)
        self.times = np.array([n for *_, n in held], np.int64)
        self.start = np.searchsorted(np.array([t for t, *_ in held], np.int64), np.arange(len(words) + 1))


def item_blocks(items: DataFrame, key: str, text: str, limit: int) -> Iterator[Items]:
    """Different (key, text) rows of the items, dealt by hash into blocks of about ``limit`` bytes of text."""
    rows = items.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // limit
    for block in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)) == block)
        yield Items([(r["key"], r["text"]) for r in part.collect()])


def bags(docs: DataFrame, vocabulary: np.ndarray, key: str, text: str) -> DataFrame:
    """(doc, n, terms, tf) of every document with a term: all its terms with repeats, and the counts of those in the vocabulary."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.utf8(batch.column(1))
            for lo, hi in tb.blocks(offsets):
                own = tb.LOWER[data[offsets[lo] : offsets[hi]]]
                starts, ends, rows = tb.word_spans(own, offsets[lo : hi + 1] - offsets[lo], TERM[own])
                n = np.bincount(rows, minlength=hi - lo)
                hashes = tb.word_hashes(own, starts, ends)
                at = np.searchsorted(vocabulary, hashes)
                known = np.flatnonzero(vocabulary[np.minimum(at, len(vocabulary) - 1)] == hashes) if len(vocabulary) else np.zeros(0, np.int64)
                cells, tf = np.unique(rows[known] * max(1, len(vocabulary)) + at[known], return_counts=True)
                some = np.flatnonzero(n)
                cut = np.searchsorted(cells, np.append(some, hi - lo) * max(1, len(vocabulary))).astype(np.int32)
                terms = pa.array((cells % max(1, len(vocabulary))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).take(pa.array(some)), pa.array(n[some]),
                        pa.ListArray.from_arrays(pa.array(cut), terms), pa.ListArray.from_arrays(pa.array(cut), pa.array(tf.astype(np.int64))),
                    ],
                    ["doc", "n", "terms", "tf"],
                )

    keyed = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_KEY)).alias("doc"), F.col(f"`{text}`"))
    return keyed.mapInArrow(scan, "doc long, n long, terms array<int>, tf array<long>")


def classes(found: DataFrame, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(m, terms, tf, members): every different bag with its m once, and its ``top`` smallest keys in order."""
    length = F.lit(75) + F.expr(f"(25L * n * {n_docs}L) div {n_terms}L")
    rows = found.filter(F.size("terms") > 0).select("doc", length.alias("m"), "terms", "tf")
    rows = rows.withColumn("hash", F.xxhash64("m", "terms", "tf"))
    same = ["hash", "m", "terms", "tf"]
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("doc"))
    first = rows.withColumn("nth", nth).filter(F.col("nth") <= top)
    members = F.transform(F.sort_array(F.collect_list(F.struct("nth", "doc"))), lambda x: x["doc"])
    return first.groupBy(*same).agg(members.alias("members")).drop("hash")


def weights(found: DataFrame, n_docs: int, terms: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of every term of the vocabulary."""
    df = np.zeros(terms, np.int64)
    for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
        df[r["term"]] = r["df"]
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def scores(m: np.ndarray, cut: np.ndarray, terms: np.ndarray, tf: np.ndarray, items: Items, weight: np.ndarray) -> np.ndarray:
    """Scores, one row per class and one column per item; the bag of class i is terms[cut[i]:cut[i + 1]] with counts tf."""
    n, width = len(m), len(items.keys)
    of = np.repeat(np.arange(n), np.diff(cut))
    gain = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * m[of]))
    out = np.zeros(n * width, np.int64)
    reach = items.start[terms + 1] - items.start[terms]
    edges = np.concatenate([[0], np.cumsum(reach)])
    lo = 0
    while lo < len(terms):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + CELLS, "right")) - 1)
        entry = np.repeat(np.arange(lo, hi), reach[lo:hi])
        post = np.arange(edges[hi] - edges[lo]) - (edges[entry] - edges[lo]) + items.start[terms[entry]]
        np.add.at(out, of[entry] * width + items.item[post], gain[entry] * items.times[post])
        lo = hi
    return out.reshape(n, width)


class Best:
    """The ``top`` best documents of every item among those seen so far."""

    def __init__(self, items: int, top: int):
        self.items, self.top = items, top
        self.item = self.score = self.doc = np.zeros(0, np.int64)

    def add(self, scored: np.ndarray, members: list[np.ndarray]) -> None:
        """Scores of some classes and their members. A class can only count where fewer than ``top`` classes of this call score higher."""
        bar = np.ones(self.items, np.int64)
        if len(scored) > self.top:
            bar = np.maximum(bar, np.partition(scored, -self.top, axis=0)[-self.top])
        full = np.flatnonzero(np.bincount(self.item, minlength=self.items) == self.top)
        # kept rows stand by item and falling score: the last of an item is its worst
        bar[full] = np.maximum(bar[full], self.score[np.searchsorted(self.item, full, "right") - 1])
        rows, item = np.nonzero(scored >= bar)
        size = np.array([len(members[r]) for r in rows.tolist()], np.int64)
        self.item = np.concatenate([self.item, np.repeat(item, size)])
        self.score = np.concatenate([self.score, np.repeat(scored[rows, item], size)])
        self.doc = np.concatenate([self.doc, *[members[r] for r in rows.tolist()]])
        self.prune()

    def prune(self) -> None:
        order = np.lexsort((self.doc, -self.score, self.item))
        item = self.item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.top]
        self.item, self.score, self.doc = self.item[order], self.score[order], self.doc[order]


def best_of_block(found: DataFrame, items: Items, weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, score, doc): in every task the best documents of each item."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, step = Best(len(items.keys), top), max(1, CELLS // max(1, len(items.keys)))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                m = part.column(0).to_numpy()
                size = pc.list_value_length(part.column(1)).to_numpy()
                terms, tf, docs = (part.column(c).flatten().to_numpy() for c in (1, 2, 3))
                ends = np.cumsum(pc.list_value_length(part.column(3)).to_numpy())
                scored = scores(m, np.concatenate([[0], np.cumsum(size)]), terms.astype(np.int64), tf, items, weight)
                best.add(scored, np.split(docs, ends[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(best.item, pa.int32()), pa.array(best.score), pa.array(best.doc)], ["item", "score", "doc"])

    return classes(found, n_docs, n_terms, top).mapInArrow(scan, "item int, score long, doc long")


def ranked(best: DataFrame, top: int) -> DataFrame:
    """(item, rank, doc, score): first in slices of every item, so that no task meets all that the tasks before send for one item."""
    order = [F.desc("score"), F.asc("doc")]
    slice_ = Window.partitionBy("item", F.pmod(F.xxhash64("doc"), F.lit(SALTS))).orderBy(*order)
    short = best.withColumn("rank", F.row_number().over(slice_)).filter(F.col("rank") <= top)
    return short.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item_key, rank, key, score): the ``top`` best documents of every item with a score above 0, equal scores by ascending key.

    Terms are runs of digits, letters and non-ASCII characters, lower-cased in A-Z. With N documents that have terms, L terms in them, n terms in
    one, tf and df of a term: w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 75 + 25 n N div L, and a document scores the sum over the item's
    terms, repeats included, of w (10^9 tf div (1000 tf + 12 m)).

    NULL and empty texts have no terms: such documents count nowhere, such items rank nothing. Repeated rows and rows with equal keys are
    documents of their own; a NULL key comes last among equal scores. Repeated items are ranked once; items with one key
    and different texts are ranked one by one, a NULL key is a key. An empty table gives an empty result. Keys of documents are integers. Words are found in the vocabulary
    by 64-bit hashes; classes compare their counts themselves.
    """
    kind, out = items.schema[item_key].dataType.simpleString(), None
    for block in item_blocks(items, item_key, item_text, block_bytes):
        if not len(block.hashes):
            continue
        found = stage_table(bags(docs, block.hashes, key, text), "bags")
        n_docs, n_terms = found.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            continue
        best = best_of_block(found, block, weights(found, n_docs, len(block.hashes)), n_docs, n_terms, top)
        rows = ranked(best, top)
        # the driver holds the keys of one block of items
        named = docs.sparkSession.createDataFrame(list(enumerate(block.keys)), f"item int, item_key {kind}")
        rows = rows.join(F.broadcast(named), "item")
        doc = F.when(F.col("doc") != NO_KEY, F.col("doc"))
        rows = rows.select(F.col("item_key").alias(item_key), "rank", doc.alias(key), "score")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"`{item_key}` {kind}, rank int, `{key}` long, score long")
    return out
