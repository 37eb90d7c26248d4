"""Removal of long repeated byte strings with Burrows-Wheeler transforms of bounded size.

Every ``length``-byte string (window) names an anchor: the smallest hashed ``seed``-byte piece inside it. The choice depends on the window
alone, so equal windows name equal anchors at the same place, and all windows that name one anchor occurrence lie in one stretch
of text, its context.

1. Tasks hash anchors and contexts. Spark finds out which contexts occur again as a whole (all their windows repeat, no bytes
   need to travel) and which anchors have different contexts. Each batch sends every distinct hash once.
2. The different contexts of an anchor meet in one task. There their suffixes are sorted, transformed, and right-bounded intervals
   grow by backward extension, breadth first: level l finds every place where the common prefix of neighbours has length l.
   Extension stops at ``length``; the boundaries that stay undefined are those with a common prefix of at least that length.
3. An anchor with more than ``crowd`` different contexts goes to no task: its windows are counted by hash instead. Here too each
   batch sends every distinct hash once and gets one byte back for it; no window is a row of its own.
4. Repeated windows merge into maximal removed runs.

A second, shorter length can be looked for in the same pass: windows then name anchors by their first ``short`` bytes, contexts reach
``length`` bytes beyond their last start (or to the end of the text), and the extension notes the boundaries still open at both lengths.

Anchors and contexts compare by 64-bit hashes; windows of step 2 compare byte by byte. A document has to fit into a task's memory
and below 256 MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from arealens.llm import textbatch as tb
from arealens.llm.staging import deal, partitions, stage_table
from arealens.llm.substring import NO_KEY, bucket_of, place_of, runs
from arealens.llm.syncmers import sliding_min

LENGTH, SEED, CROWD = 400, 64, 2000
#: A passage that counts has more than 50 words, 51 of about 5.5 bytes with their blank. In the test tables 98 % of such shared passages
#: have this many bytes, 71 % have 400.
PASSAGE = 280
#: Pieces for two lengths at once: longer ones stand in fewer texts by chance, shorter ones name fewer anchors.
TWO_LENGTHS_SEED = 96
BATCH_BYTES = 12 << 20
#: Windows of one batch when those of crowded anchors are counted; 12 bytes each.
BATCH_WINDOWS = 1 << 20
POOL_BYTES = 1 << 18
PLACE = np.uint64((1 << 28) - 1)
SEPARATOR = 0xFF  # no byte of UTF-8


class Anchors:
    """Anchor occurrences of some rows, in order: row, anchor hash, context hash, window starts ``first`` .. ``last`` and ``end`` (in the block).

    Windows have the smallest of ``lengths``; ``end`` is where the largest window of the last start ends, or else the text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...], seed: int):
        self.data, self.offsets, self.lengths = data, offsets, lengths
        length, none = min(lengths), np.zeros(0, np.int64)
        self.row, self.first, self.last, self.end, self.at = none, none, none, none, none
        self.key = self.context = none.astype(np.uint64)
        if len(data) < length:
            return
        self.prefix = tb.rolling_prefix(tb.BYTE_CODE[data])
        hashes = tb.mix(tb.fixed_hash(self.prefix, seed))
        # smallest hash, of equal ones the leftmost
        ranked = hashes & ~PLACE | np.arange(len(hashes), dtype=np.uint64)
        least = (sliding_min(ranked, length - seed + 1) & PLACE).astype(np.int64)
        starts, ends = offsets[:-1], offsets[1:]
        valid = np.zeros(len(least) + 1, np.int64)
        some = ends - starts >= length
        np.add.at(valid, starts[some], 1)
        np.add.at(valid, ends[some] - length + 1, -1)
        at = np.flatnonzero(np.cumsum(valid)[: len(least)])
        if not len(at):
            return
        chosen = least[at]
        new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)])
        edge = np.flatnonzero(new)
        self.first = at[edge]
        self.last = at[np.append(edge[1:], len(at)) - 1]
        self.at = chosen[edge]
        self.row = np.searchsorted(offsets, self.first, "right") - 1
        self.end = np.minimum(self.last + max(lengths), offsets[self.row + 1])
        # the least hashes are all small numbers: mixed again, they spread over all buckets
        self.key = tb.mix(hashes[self.at] + tb.BASE)
        whole = tb.stretch_hash(self.prefix, self.first, self.end)
        shape = ((self.at - self.first) << 40 | (self.last - self.first) << 20 | (self.end - self.first)).astype(np.uint64)
        self.context = tb.mix(whole ^ tb.mix(shape))

    def starts(self, i: int, length: int) -> int:
        """How many windows of ``length`` bytes start in the context of occurrence ``i``, from its first start on."""
        return max(0, min(int(self.last[i] - self.first[i]) + 1, int(self.offsets[self.row[i] + 1] - self.first[i]) - length + 1))

    def windows(self, i: int, length: int) -> np.ndarray:
        """Hashes of the windows of occurrence ``i``."""
        at = np.arange(self.first[i], self.first[i] + self.starts(i, length))
        return tb.mix(tb.stretch_hash(self.prefix, at, at + length) + np.uint64(length))


PACKED = "kind string, bucket int, batch long, a binary, b binary, c binary"
NAMES = ["kind", "bucket", "batch", "a", "b", "c"]
TYPES = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def one_row(values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, TYPES)], NAMES)


def distinct_runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order of (bucket-preserving) size, each element's index among them, and how often each occurs."""
    return np.unique(values, return_inverse=True, return_counts=True)


def packed_batch(ids, sums, counts, keys, contexts, batch: int, buckets: int) -> Iterator[tuple]:
    """``key`` rows (anchor, how many contexts, one of them), ``context`` rows (context, how often) and the ``map`` back."""
    key, key_of, _ = distinct_runs(keys)
    context, context_of, often = distinct_runs(contexts)
    pair = np.unique(np.stack([key_of, context_of]), axis=1)
    kinds = np.bincount(pair[0], minlength=len(key))
    one = context[pair[1][np.searchsorted(pair[0], np.arange(len(key)))]]
    key_edge = np.searchsorted(bucket_of(key, buckets), np.arange(buckets + 1))
    context_edge = np.searchsorted(bucket_of(context, buckets), np.arange(buckets + 1))
    for b in range(buckets):
        lo, hi = key_edge[b], key_edge[b + 1]
        if lo < hi:
            yield "key", b, batch, key[lo:hi].tobytes(), one[lo:hi].tobytes(), kinds[lo:hi].astype("<u4").tobytes()
        lo, hi = context_edge[b], context_edge[b + 1]
        if lo < hi:
            yield "context", b, batch, context[lo:hi].tobytes(), (often[lo:hi] > 1).tobytes(), None
    head = np.concatenate([ids, sums, counts]).astype("<i8").tobytes()
    edges = np.concatenate([key_edge, context_edge]).astype("<i8").tobytes()
    yield "map", place_of(batch, buckets), batch, head, edges, np.stack([key_of, context_of]).astype("<u4").tobytes()


def pack_anchors(docs: DataFrame, lengths: tuple[int, ...], seed: int, buckets: int) -> DataFrame:
    """PACKED rows of a table (_id, _sum, _text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, found = TaskContext.get().partitionId(), 0, 0, []

        def flush():
            nonlocal held, found, number
            if found:
                columns = [np.concatenate(x) for x in zip(*found)]
                if len(columns[3]):
                    for row in packed_batch(*columns, (part << 24) + number, buckets):
                        yield one_row(row)
                number, held, found = number + 1, 0, []

        for batch in batches:
            data, offsets = tb.utf8(batch.column("_text"))
            ids, sums = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_sum"))
            for lo, hi in tb.blocks(offsets):
                own = Anchors(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lengths, seed)
                counts = np.bincount(own.row, minlength=hi - lo)
                some = np.flatnonzero(counts)
                found.append((ids[lo:hi][some], sums[lo:hi][some], counts[some], own.key, own.context))
                held += int(offsets[hi] - offsets[lo])
                if held >= BATCH_BYTES:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(scan, PACKED)


def first_and_total(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per element: is it the first of its value, the sum of the weights of its value, and the index of its value."""
    _, first, inverse = np.unique(values, return_index=True, return_inverse=True)
    is_first = np.zeros(len(values), bool)
    is_first[first] = True
    return is_first, np.bincount(inverse, weights)[inverse], inverse


def settle_keys(rows: list[dict], crowd: int) -> list[np.ndarray]:
    """0: one context everywhere; 1: several; 2: more than ``crowd``."""
    values, ones = (np.concatenate([np.frombuffer(r[c], "<u8") for r in rows]) for c in "ab")
    kinds = np.concatenate([np.frombuffer(r["c"], "<u4") for r in rows]).astype(np.int64)
    is_first, total, inverse = first_and_total(values, kinds)
    lead = np.zeros(inverse.max() + 1, np.uint64)
    lead[inverse[is_first]] = ones[is_first]
    differs = np.bincount(inverse, (kinds > 1) | (ones != lead[inverse]))[inverse] > 0
    state = np.where(differs, np.where(total > crowd, 2, 1), 0).astype(np.uint8)
    return np.split(state, np.cumsum([len(r["a"]) // 8 for r in rows])[:-1])


def settle_contexts(rows: list[dict]) -> list[np.ndarray]:
    """0: the context (or window) occurs once; 4: repeated; 12: repeated, and this batch speaks for all of its kind."""
    values = np.concatenate([np.frombuffer(r["a"], "<u8") for r in rows])
    often = np.concatenate([np.frombuffer(r["b"], bool) for r in rows])
    is_first, total, _ = first_and_total(values, 1.0 + often)
    state = np.where(total > 1, np.where(is_first, 12, 4), 0).astype(np.uint8)
    return np.split(state, np.cumsum([len(r["a"]) // 8 for r in rows])[:-1])


def settle(packed: DataFrame, crowd: int) -> DataFrame:
    """PACKED rows with states in ``a`` for batches that have any, and the maps as they came."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def done():
            if rows:
                kind, bucket = at
                states = settle_keys(rows, crowd) if kind == "key" else settle_contexts(rows)
                for row, state in zip(rows, states):
                    if state.any():
                        yield one_row((kind, bucket, row["batch"], state.tobytes(), None, None))

        for arrow in batches:
            for row in arrow.to_pylist():
                if row["kind"] == "map":
                    yield one_row(row[c] for c in NAMES)
                    continue
                if (row["kind"], row["bucket"]) != at:
                    yield from done()
                    at, rows = (row["kind"], row["bucket"]), []
                rows.append(row)
        yield from done()

    return packed.mapInArrow(scan, PACKED)


def by_document(settled: DataFrame) -> DataFrame:
    """(_id, _sum, states): one byte per anchor occurrence of every document that has a state."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, rows = None, []

        def done():
            whole = [r for r in rows if r["kind"] == "map"]
            if not whole:
                return
            ids, sums, counts = np.frombuffer(whole[0]["a"], "<i8").reshape(3, -1)
            edges = np.frombuffer(whole[0]["b"], "<i8").reshape(2, -1)
            of = np.frombuffer(whole[0]["c"], "<u4").reshape(2, -1)
            states = [np.zeros(e[-1], np.uint8) for e in edges]
            for r in rows:
                if r["kind"] != "map":
                    k = 0 if r["kind"] == "key" else 1
                    lo = edges[k][r["bucket"]]
                    states[k][lo : lo + len(r["a"])] = np.frombuffer(r["a"], np.uint8)
            key_state, context_state = states[0][of[0]], states[1][of[1]]
            # one occurrence of the batch speaks for a context
            speaks = np.zeros(len(context_state), bool)
            speaks[np.unique(of[1], return_index=True)[1]] = True
            context_state = np.where((context_state == 12) & ~speaks, 4, context_state)
            state = key_state | context_state
            ends = np.cumsum(counts)
            some = [i for i, (a, b) in enumerate(zip(ends - counts, ends)) if state[a:b].any()]
            if some:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[some]), pa.array(sums[some]),
                        pa.array([state[ends[i] - counts[i] : ends[i]].tobytes() for i in some], pa.binary()),
                        pa.array([batch] * len(some), pa.int64()), pa.array(some, pa.int64()),
                    ],
                    ["_id", "_sum", "states", "batch", "nth"],
                )

        for arrow in batches:
            for row in arrow.to_pylist():
                if row["batch"] != batch:
                    yield from done()
                    batch, rows = row["batch"], []
                rows.append(row)
        yield from done()

    found = settled.mapInArrow(scan, "_id long, _sum long, states binary, batch long, nth long")
    # of repeated rows the first is the one that speaks for contexts
    return found.groupBy("_id", "_sum").agg(F.min_by("states", F.struct("batch", "nth")).alias("states"))


WORK = "kind string, key long, _id long, _sum long, start long, size long, level int, bytes binary"
WORK_NAMES = ["kind", "key", "_id", "_sum", "start", "size", "level", "bytes"]


def contexts(marked: DataFrame, lengths: tuple[int, ...], seed: int) -> DataFrame:
    """WORK rows of documents with states: ``all`` (every window of size starts repeats), ``bytes`` (a context to compare) and ``windows``
    (the hashes of the windows of size starts).

    ``level`` is the index of the window's length in ``lengths``; a context to compare serves all of them.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), *[pa.int64()] * 5, pa.int32(), pa.binary()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], WORK_NAMES)

        for batch in batches:
            data, offsets = tb.utf8(batch.column("_text"))
            ids, sums, states = (batch.column(c).to_pylist() for c in ("_id", "_sum", "states"))
            for lo, hi in tb.blocks(offsets):
                own = Anchors(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lengths, seed)
                state = np.frombuffer(b"".join(states[lo:hi]), np.uint8)
                keys, rows, held = own.key.view(np.int64), [], 0
                for i in np.flatnonzero(state).tolist():
                    row, first = int(own.row[i]), int(own.first[i])
                    who = ids[lo + row], sums[lo + row], first - int(own.offsets[row])
                    if state[i] & 4:
                        rows += [("all", int(keys[i]), *who, size, k, None) for k, n in enumerate(lengths) if (size := own.starts(i, n))]
                    if not state[i] & 4 or state[i] & 8:
                        if state[i] & 3 == 1:
                            rows.append(("bytes", int(keys[i]), *who, int(own.last[i]) - first + 1, 0, own.data[first : own.end[i]].tobytes()))
                        elif state[i] & 3 == 2:
                            hashes = [(k, own.windows(i, n)) for k, n in enumerate(lengths)]
                            rows += [("windows", int(keys[i]), *who, len(h), k, h.astype("<u8").tobytes()) for k, h in hashes if len(h)]
                    if len(rows) > 20_000:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return marked.mapInArrow(scan, WORK)


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts in the order of their first ``depth`` bytes or more, by prefix tripling from 8 bytes on.

    Three ranks make one 63-bit key; texts too long for that take two and double.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    order = np.argsort(key)
    ordered = key[order]
    start = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    alone = start & np.append(start[1:], True)
    open_, reach = order[~alone], 8
    times = 3 if (n + 1) ** 3 < 1 << 63 else 2
    while reach < depth and len(open_):
        follow = rank[np.minimum(open_ + reach, n)] + 1
        if times == 3:
            follow = follow * (n + 1) + rank[np.minimum(open_ + 2 * reach, n)] + 1
        own = rank[open_]
        turn = np.argsort(own * (n + 1) ** (times - 1) + follow)
        open_, own, follow = open_[turn], own[turn], follow[turn]
        old = np.concatenate([[True], own[1:] != own[:-1]])
        new = old | np.concatenate([[True], follow[1:] != follow[:-1]])
        at = np.arange(len(open_))
        rank[open_] = own + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
        open_ = open_[~(new & np.append(new[1:], True))]
        reach *= times
    return np.argsort(rank[:n])


def long_common(text: np.ndarray, order: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length and every place of ``order``: do this suffix and the one before share that many bytes free of the separator?

    Intervals of suffixes with a common first string grow by one byte on the left, all intervals of a level at once. The end of an
    interval of strings of l + 1 bytes is where a common prefix of l bytes ends, unless a lower level was there first; only
    intervals that set a new end grow on. Neighbours after the same byte stay neighbours, so runs of the transform move as one.
    """
    n = len(text)
    bwt = text[order - 1]
    by_byte = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_byte] = np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
    last, run = np.append(first[1:], n), np.repeat(np.arange(len(first)), np.diff(first, append=n))
    total = np.bincount(bwt, minlength=256)
    right = np.cumsum(total)
    some = total > 0
    open_ = np.ones(n + 1, bool)
    open_[0] = open_[n] = False
    low, high = (right - total)[some], right[some]
    fresh = open_[high]
    open_[high] = False
    low, high = low[fresh], high[fresh]
    seen = {1: open_.copy()}
    for level in range(1, max(lengths)):
        if not len(low):
            break
        # each interval in pieces of one byte: those move as they are
        begin = run[low]
        size = run[high - 1] - begin + 1
        ends = np.cumsum(size)
        which = np.repeat(np.arange(len(size)), size)
        piece = np.arange(ends[-1]) + (begin - (ends - size))[which]
        rows = np.maximum(first[piece], low[which])
        long = np.minimum(last[piece], high[which]) - rows
        byte = bwt[rows]
        kept = byte != SEPARATOR
        low, long, which = lf[rows[kept]], long[kept], which[kept] << 8 | byte[kept]
        if len(low):
            # in the order of the longer strings; equal bytes of one interval lie side by side
            turn = np.argsort(low)
            low, long, which = low[turn], long[turn], which[turn]
            new = np.concatenate([[True], which[1:] != which[:-1]])
            end = np.append(new[1:], True)
            low, high = low[new], low[end] + long[end]
            fresh = open_[high]
            low, high = low[fresh], high[fresh]
            open_[high] = False
        if level + 1 in lengths:
            seen[level + 1] = open_.copy()
    return [seen.get(n, open_) for n in lengths]


def repeated_starts(pieces: list[bytes], lengths: tuple[int, ...], sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the runs (piece, first start, how many) of starts of strings of that length that occur at two places of the pieces.

    Pieces are UTF-8. Only the first ``sizes[i]`` starts of piece i count: what begins behind them belongs to another piece.
    """
    mark = bytes([SEPARATOR])
    text = np.frombuffer(mark.join(pieces) + mark, np.uint8)
    order = sorted_suffixes(text, max(lengths))
    long = np.array([len(p) for p in pieces])
    begin = np.concatenate([[0], np.cumsum(long + 1)[:-1]])
    out = []
    for length, same in zip(lengths, long_common(text, order, lengths)):
        edge = np.zeros(len(text) + 1, np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + np.clip(np.minimum(sizes, long - length + 1), 0, None), -1)
        counted = np.cumsum(edge)[order] > 0
        group = np.cumsum(~same[:-1])
        hit = np.zeros(len(text), bool)
        hit[order] = counted & (np.bincount(group, counted)[group] > 1)
        first, end = runs(hit)
        piece = np.searchsorted(begin, first, "right") - 1
        out.append((piece, first - begin[piece], end - first))
    return out


STRETCHES = "_id long, _sum long, start long, size long, level int"


def compare_contexts(work: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """STRETCHES of repeated window starts; ``bytes`` rows arrive sorted by key, and whole keys fill a pool of about POOL_BYTES."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, held, last = [], 0, None

        def done():
            found = repeated_starts([r[4] for r in pool], lengths, [r[3] for r in pool]) if pool else []
            ids, sums, starts = np.array([r[:3] for r in pool], np.int64).reshape(-1, 3).T
            for level, (piece, first, n) in enumerate(found):
                if len(piece):
                    columns = [ids[piece], sums[piece], starts[piece] + first, n]
                    level = pa.array(np.full(len(piece), level, np.int32))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), level], ["_id", "_sum", "start", "size", "level"])

        for batch in batches:
            for key, *row in zip(*[batch.column(c).to_pylist() for c in ("key", "_id", "_sum", "start", "size", "bytes")]):
                if key != last and held >= POOL_BYTES:
                    yield from done()
                    pool, held = [], 0
                last = key
                pool.append(row)
                held += len(row[4])
        yield from done()

    return work.mapInArrow(scan, STRETCHES)


def pack_windows(work: DataFrame, buckets: int) -> DataFrame:
    """PACKED rows of ``windows`` rows: ``window`` (hashes, how often) and the ``map`` back."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, found = TaskContext.get().partitionId(), 0, 0, []

        def done():
            batch, heads = (part << 24) + number, np.array([r[:-1] for r in found], "<i8").T
            hashes, of, often = distinct_runs(np.concatenate([np.frombuffer(r[-1], "<u8") for r in found]))
            edge = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
            for b in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
                lo, hi = edge[b], edge[b + 1]
                yield one_row(("window", b, batch, hashes[lo:hi].tobytes(), (often[lo:hi] > 1).tobytes(), None))
            yield one_row(("map", place_of(batch, buckets), batch, heads.tobytes(), edge.astype("<i8").tobytes(), of.astype("<u4").tobytes()))

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("_id", "_sum", "start", "size", "level", "bytes")]):
                found.append(row)
                held += row[3]
                if held >= BATCH_WINDOWS:
                    yield from done()
                    number, held, found = number + 1, 0, []
        if found:
            yield from done()

    return work.mapInArrow(scan, PACKED)


def repeated_stretches(settled: DataFrame) -> DataFrame:
    """STRETCHES of the repeated ones among the windows of ``pack_windows``; rows arrive sorted by batch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, rows = None, []

        def done():
            whole = [r for r in rows if r["kind"] == "map"]
            if not whole or len(rows) == 1:
                return
            ids, sums, starts, sizes, levels = np.frombuffer(whole[0]["a"], "<i8").reshape(5, -1)
            edge = np.frombuffer(whole[0]["b"], "<i8")
            state = np.zeros(edge[-1], np.uint8)
            for r in rows:
                if r["kind"] != "map":
                    lo = edge[r["bucket"]]
                    state[lo : lo + len(r["a"])] = np.frombuffer(r["a"], np.uint8)
            again = state[np.frombuffer(whole[0]["c"], "<u4")] > 0
            # an unrepeated place behind every row ends its runs
            ends = np.cumsum(sizes)
            first, end = runs(np.insert(again, ends, False))
            begin = ends - sizes + np.arange(len(sizes))
            i = np.searchsorted(begin, first, "right") - 1
            columns = [ids[i], sums[i], starts[i] + first - begin[i], end - first, levels[i].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["_id", "_sum", "start", "size", "level"])

        for arrow in batches:
            for row in arrow.to_pylist():
                if row["batch"] != batch:
                    yield from done()
                    batch, rows = row["batch"], []
                rows.append(row)
        yield from done()

    return settled.mapInArrow(scan, STRETCHES)


def repeated_windows(rows: DataFrame, lengths: tuple[int, ...], seed: int, crowd: int, factor: int = 1) -> DataFrame:
    """STRETCHES of starts of repeated windows of a table (_id, _sum, _text), for each length; stretches of one document may touch."""
    buckets = partitions(rows, factor)
    packed = pack_anchors(rows, lengths, seed, buckets)
    settled = settle(deal(packed, buckets, "bucket").sortWithinPartitions("kind", "bucket", "batch"), crowd)
    states = by_document(settled.repartition(buckets, "batch").sortWithinPartitions("batch"))
    marked = rows.join(states, ["_id", "_sum"])
    work = stage_table(contexts(marked, lengths, seed), "contexts")
    stretch = ["_id", "_sum", "start", "size", "level"]
    whole = work.filter("kind = 'all'").select(stretch)
    pooled = work.filter("kind = 'bytes'").repartition(buckets, "key").sortWithinPartitions("key")
    crowded = pack_windows(work.filter("kind = 'windows'"), buckets)
    counted = settle(deal(crowded, buckets, "bucket").sortWithinPartitions("kind", "bucket", "batch"), crowd)
    hashed = repeated_stretches(counted.repartition(buckets, "batch").sortWithinPartitions("batch"))
    return whole.unionByName(compare_contexts(pooled, lengths)).unionByName(hashed)


OUT = "n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, seed: int = SEED, crowd: int = CROWD, key: str = "doc_id", text: str = "text",
    whole_characters: bool = False, keep: tuple[str, ...] = (), short: int | None = None,
) -> DataFrame:
    """key, n_bytes, n_removed, ``spans`` (maximal removed runs of bytes), ``kept`` (remaining UTF-8) and the columns in ``keep``.

    A byte goes if a ``length``-byte string over it also starts anywhere else, in the same document or another. Strings are
    judged on the input and overlaps count; matches never cross documents. With ``whole_characters`` a run shrinks to whole
    characters. NULL and empty texts have no bytes; texts shorter than ``length`` lose nothing; repeated rows are documents of
    their own and so remove each other's strings, as equal texts do. A NULL key is a key like any other.

    With ``short`` (less than ``length``) the column ``short_spans`` tells which bytes lie under repeated strings of that many bytes;
    they are reported, not removed.
    """
    lengths = (length,) if short is None else (length, short)
    kept = [F.col(f"`{c}`") for c in keep]
    rows = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_KEY)).alias("_id"),
        F.xxhash64(F.col(f"`{text}`")).alias("_sum"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"),
        *kept,
    )
    found = repeated_windows(rows.select("_id", "_sum", "_text"), lengths, seed, crowd)
    at = [F.collect_set(F.when(F.col("level") == k, F.struct("start", "size"))).alias(f"_at{k}") for k in range(len(lengths))]
    found = found.groupBy("_id", "_sum").agg(*at)
    joined = rows.join(found, ["_id", "_sum"], "left")
    kind = docs.schema[key].dataType.simpleString()
    extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def spans_of(data: np.ndarray, offsets: np.ndarray, at: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, starts and ends (in the block) of the maximal runs of bytes under windows that begin in the stretches ``at`` of each row."""
        size = pc.fill_null(pc.list_value_length(at), 0).to_numpy()
        flat = at.flatten()
        first = flat.field("start").to_numpy() + np.repeat(offsets[:-1], size)
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + flat.field("size").to_numpy() + window - 1, -1)
        under = np.cumsum(edge)[:-1] > 0
        opens = np.zeros(len(data) + 1, bool)
        opens[offsets[:-1]] = True
        # a run ends with its row
        a = np.flatnonzero(under & (opens[:-1] | ~np.concatenate([[False], under[:-1]])))
        b = np.flatnonzero(under & (opens[1:] | ~np.concatenate([under[1:], [False]]))) + 1
        rows = np.searchsorted(offsets, a, "right") - 1
        if whole_characters:
            lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            a, b = lead[np.searchsorted(lead, a)], lead[np.searchsorted(lead, b, "right") - 1]
            rows, a, b = rows[a < b], a[a < b], b[a < b]
        return rows, a, b

    def as_spans(rows: np.ndarray, a: np.ndarray, b: np.ndarray, offsets: np.ndarray) -> pa.Array:
        values = pa.StructArray.from_arrays([pa.array(a - offsets[rows]), pa.array(b - offsets[rows])], ["start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(offsets))).astype(np.int32)), values)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, edges = tb.utf8(batch.column("_text"))
            for lo, hi in tb.blocks(edges):
                part, data, offsets = batch.slice(lo, hi - lo), whole[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo]
                found = [spans_of(data, offsets, part.column(f"_at{k}"), n) for k, n in enumerate(lengths)]
                rows, a, b = found[0]
                gone = np.zeros(len(data) + 1, np.int32)
                np.add.at(gone, a, 1)
                np.add.at(gone, b, -1)
                stays = np.cumsum(gone)[:-1] == 0
                left = np.concatenate([[0], np.cumsum(stays)])[offsets]
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[stays])])
                size = np.diff(offsets)
                ids = pa.array([None if i == NO_KEY else i for i in part.column("_id").to_pylist()], pa.int64())
                columns = [pa.array(size), pa.array(size - np.diff(left)), as_spans(rows, a, b, offsets), kept.cast(pa.binary())]
                columns += [as_spans(*f, offsets) for f in found[1:]]
                yield pa.RecordBatch.from_arrays([ids, *columns, *[part.column(c) for c in keep]], [key, *names, *keep])

    names = ["n_bytes", "n_removed", "spans", "kept", "short_spans"][: 3 + len(lengths)]
    more = ", short_spans array<struct<start:long,end:long>>" if short else ""
    return joined.mapInArrow(cut, f"`{key}` long, {OUT}{more}{extra}").withColumn(key, F.col(f"`{key}`").cast(kind))
