"""Removal of repeated word windows.

Every window of ``width`` consecutive words gets a Rabin-Karp hash. Spark counts them in three steps:

1. Each task hashes its documents in batches. Of a window that occurs often in a batch, one entry travels (with the smallest
   document number of the batch); the batch itself settles the others. A hot passage so sends one entry per batch.
2. Entries meet by ranges of the hash, packed 7 bytes each, and every entry learns whether a smaller document has the window.
3. The answers, one bit per entry, go back by batch, are joined to the documents, and repeated windows merge into
   maximal runs of removed words.

A stored hash keeps 56 bits beside its range, so two different windows share one with a chance of about 2**-61 per pair.
A document has to fit into a task's memory; batches bound everything else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from arealens.llm import textbatch as tb
from arealens.llm.staging import deal, partitions

WIDTH = 13
BATCH_BYTES = 12 << 20
NO_KEY = -(1 << 63)
PACKED = "bucket int, batch long, local boolean, docs binary, counts binary, payload binary"


def window_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every window of ``width`` words, in order; words are runs without ASCII white space."""
    starts, ends, rows = tb.word_spans(data, offsets, ~tb.SPACE[data])
    n = len(starts) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values = tb.mix(tb.fixed_hash(tb.rolling_prefix(tb.word_hashes(data, starts, ends)), width))
    whole = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return values[whole], rows[whole]


def place_of(batch: int, buckets: int) -> int:
    """Bucket that carries what belongs to a whole batch; neighbouring batches lie apart for any number of buckets."""
    return (batch * 0x9E3779B97F4A7C15 % (1 << 64) >> 32) % buckets


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pack7(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def unpack7(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def group_least(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For every element the smallest key among the elements of equal value."""
    if not len(values):
        return keys
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    least = np.minimum.reduceat(keys[order], starts)
    out = np.empty(len(keys), keys.dtype)
    out[order] = np.repeat(least, np.diff(np.append(starts, len(values))))
    return out


def first_of_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Indexes of the first occurrence of each value in each row, in order; ``rows`` rise."""
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (r[1:] != r[:-1])]) if len(order) else np.zeros(0, bool)
    return np.sort(order[new])


def packed_batch(ids: np.ndarray, sums: np.ndarray, values: np.ndarray, rows: np.ndarray, batch: int, buckets: int) -> Iterator[tuple]:
    """Rows of PACKED for the windows of one batch: one of what the batch settles itself, one per bucket of entries."""
    keys = ids[rows]
    removed = keys > group_least(values, keys)
    if removed.any():
        own = np.unique(rows[removed])
        cut = tb.row_starts(rows, len(ids))
        masks = [np.packbits(removed[cut[r] : cut[r + 1]]).tobytes() for r in own.tolist()]
        counts = np.array([len(m) for m in masks], "<u4")
        yield place_of(batch, buckets), batch, True, np.stack([ids[own], sums[own]]).astype("<i8").tobytes(), counts.tobytes(), b"".join(masks)
    open_ = np.flatnonzero(~removed)
    sent = open_[first_of_row(values[open_], rows[open_])]
    where = bucket_of(values[sent], buckets)
    order = np.argsort(where, kind="stable")
    sent, where = sent[order], where[order]
    edges = np.searchsorted(where, np.arange(buckets + 1))
    for b in np.unique(where).tolist():
        part = sent[edges[b] : edges[b + 1]]
        own, counts = np.unique(rows[part], return_counts=True)
        docs = np.stack([ids[own], sums[own]]).astype("<i8").tobytes()
        yield b, batch, False, docs, counts.astype("<u4").tobytes(), pack7(values[part])


def pack_windows(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """PACKED rows of a table (_id, _sum, _text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, sums, values, rows, held, n = [], [], [], [], 0, 0

        def flush():
            nonlocal ids, sums, values, rows, held, n, number
            if n:
                # the number is the same when a lost task runs again
                packed = packed_batch(
                    np.concatenate(ids), np.concatenate(sums), np.concatenate(values), np.concatenate(rows),
                    (part << 24) + number, buckets,
                )
                for row in packed:
                    yield one_row(row)
                ids, sums, values, rows, held, n = [], [], [], [], 0, 0
                number += 1

        for batch in batches:
            data, offsets = tb.utf8(batch.column("_text"))
            own = batch.column("_id").to_numpy(zero_copy_only=False)
            own_sum = batch.column("_sum").to_numpy(zero_copy_only=False)
            for lo, hi in tb.blocks(offsets):
                v, r = window_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                values.append(v)
                rows.append(r + n)
                ids.append(own[lo:hi])
                sums.append(own_sum[lo:hi])
                n += hi - lo
                held += int(offsets[hi] - offsets[lo])
                if held >= BATCH_BYTES:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(scan, PACKED)


NAMES = [c.split()[0] for c in PACKED.split(", ")]
TYPES = [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]


def one_row(values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, TYPES)], NAMES)


def settle_bucket(rows: list[dict]) -> Iterator[tuple]:
    """Per batch with any repeated entry: (batch, docs, bits per document) of the entries that a smaller document has."""
    values = np.concatenate([unpack7(r["payload"]) for r in rows])
    heads = [np.frombuffer(r["docs"], "<i8").reshape(2, -1) for r in rows]
    counts = [np.frombuffer(r["counts"], "<u4").astype(np.int64) for r in rows]
    keys = np.concatenate([np.repeat(h[0], c) for h, c in zip(heads, counts)])
    removed = keys > group_least(values, keys)
    at = 0
    for row, head, count in zip(rows, heads, counts):
        own = removed[at : at + int(count.sum())]
        at += len(own)
        if not own.any():
            continue
        ends = np.cumsum(count)
        some = np.flatnonzero(np.add.reduceat(own, ends - count))
        bits = [np.packbits(own[ends[i] - count[i] : ends[i]]).tobytes() for i in some.tolist()]
        sizes = np.array([len(b) for b in bits], "<u4")
        yield row["batch"], head[:, some].astype("<i8").tobytes(), sizes.tobytes(), b"".join(bits)


def settle(packed: DataFrame) -> DataFrame:
    """(bucket, batch, local, docs, counts, payload) of what is removed; rows arrive sorted by bucket."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []

        def done():
            for batch, docs, counts, bits in settle_bucket(rows) if rows else ():
                yield one_row((bucket, batch, False, docs, counts, bits))

        for arrow in batches:
            for row in arrow.to_pylist():
                if row["local"]:
                    yield one_row(row[c] for c in NAMES)
                    continue
                if row["bucket"] != bucket:
                    yield from done()
                    bucket, rows = row["bucket"], []
                rows.append(row)
        yield from done()

    return packed.mapInArrow(scan, PACKED)


MARKS = "_id long, _sum long, local binary, buckets array<int>, bits array<binary>"


def by_document(settled: DataFrame) -> DataFrame:
    """One row of MARKS per document that loses words; rows arrive sorted by batch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, found = None, {}

        def done():
            keys = list(found)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                        pa.array([found[k][0] for k in keys], pa.binary()),
                        pa.array([found[k][1] for k in keys], pa.list_(pa.int32())),
                        pa.array([found[k][2] for k in keys], pa.list_(pa.binary())),
                    ],
                    ["_id", "_sum", "local", "buckets", "bits"],
                )

        for arrow in batches:
            for row in arrow.to_pylist():
                if row["batch"] != batch:
                    yield from done()
                    batch, found = row["batch"], {}
                head = np.frombuffer(row["docs"], "<i8").reshape(2, -1)
                at = 0
                for i, s, size in zip(*head.tolist(), np.frombuffer(row["counts"], "<u4").tolist()):
                    mark = found.setdefault((i, s), [None, [], []])
                    bits = row["payload"][at : at + size]
                    at += size
                    if row["local"]:
                        mark[0] = bits
                    else:
                        mark[1].append(row["bucket"])
                        mark[2].append(bits)
        yield from done()

    return settled.mapInArrow(scan, MARKS)


def removed_windows(values: np.ndarray, local: bytes | None, buckets: list[int] | None, bits: list[bytes] | None, n_buckets: int) -> np.ndarray:
    """Which windows of one document are repeats, from its hashes and its marks."""
    n = len(values)
    out = np.unpackbits(np.frombuffer(local, np.uint8), count=n).astype(bool) if local else np.zeros(n, bool)
    if buckets:
        open_ = np.flatnonzero(~out)
        sent = open_[first_of_row(values[open_], np.zeros(len(open_), np.int64))]
        where = bucket_of(values[sent], n_buckets)
        gone = [sent[:0]]
        for b, own in zip(buckets, bits):
            part = sent[where == b]
            gone.append(part[np.unpackbits(np.frombuffer(own, np.uint8), count=len(part)).astype(bool)])
        out |= np.isin(values, values[np.concatenate(gone)])
    return out


def covered(flags: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie under a flagged stretch of ``width``."""
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + width, n), -1)
    return np.cumsum(edge[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


OUT = "n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"


def remove_repeats(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, ``spans`` (maximal runs of removed words) and ``kept_text`` of every document.

    A word goes if a window over it also starts in a document with a smaller key; windows are judged on the input. Kept
    words are joined by one blank. NULL or empty text has no words; texts shorter than a window lose nothing; rows with
    equal keys never remove from each other; a NULL key is smaller than any other. Other columns are left out.
    """
    buckets = partitions(docs)
    rows = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_KEY)).alias("_id"),
        F.col(f"`{key}`").isNull().alias("_none"),
        F.xxhash64(F.col(f"`{text}`")).alias("_sum"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"),
    )
    packed = pack_windows(rows.select("_id", "_sum", "_text"), width, buckets)
    settled = settle(deal(packed, buckets, "bucket").sortWithinPartitions("bucket", "batch"))
    marks = by_document(settled.repartition(buckets, "batch").sortWithinPartitions("batch", "bucket"))
    marked = rows.join(marks.dropDuplicates(["_id", "_sum"]), ["_id", "_sum"], "left")
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.utf8(batch.column("_text"))
            for lo, hi in tb.blocks(offsets):
                part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                values, at = window_hashes(part, own, width)
                edge = tb.row_starts(at, hi - lo)
                marks = [batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("local", "buckets", "bits")]
                raw, out = part.tobytes(), []
                for i in range(hi - lo):
                    words = raw[own[i] : own[i + 1]].split()
                    n, spans = len(words), []
                    if marks[0][i] or marks[1][i]:
                        gone = removed_windows(values[edge[i] : edge[i + 1]], marks[0][i], marks[1][i], marks[2][i], buckets)
                        mask = covered(gone, width, n)
                        spans = [{"start": a, "end": b} for a, b in zip(*[x.tolist() for x in runs(mask)])]
                        words = [w for w, m in zip(words, mask.tolist()) if not m]
                    out.append((n, n - len(words), spans, b" ".join(words).decode()))
                ids = batch.column("_id").slice(lo, hi - lo).to_pylist()
                none = batch.column("_none").slice(lo, hi - lo).to_pylist()
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), span, pa.large_string()))]
                columns[3] = columns[3].cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if x else i for i, x in zip(ids, none)], pa.int64()), *columns],
                    [key, "n_words", "n_removed", "spans", "kept_text"],
                )

    return marked.mapInArrow(cut, f"`{key}` long, {OUT}").withColumn(key, F.col(f"`{key}`").cast(kind))
