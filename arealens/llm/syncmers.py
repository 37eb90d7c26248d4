"""Document fingerprints from closed syncmers.

A stretch of ``k`` bytes is an anchor if the smallest hash among its inner stretches of ``s`` bytes lies at its first
or last place. Whether it is one depends on its own bytes alone, so equal passages give equal anchors wherever they
stand, and gaps between anchors stay short. The fingerprint lists every anchor of the whole text with its distance
from the anchor before; two fingerprints are alike as far as their anchors match in the same order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arealens.llm import textbatch as tb
from arealens.llm.staging import deal, partitions

K, S = 48, 8


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:])[:n] if rest else out[:n]


def anchors(data: np.ndarray, offsets: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, byte position in the row and 32-bit hash of every closed syncmer; rows are never mixed."""
    if len(data) < k:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint32)
    prefix = tb.rolling_prefix(tb.BYTE_CODE[data])
    inner = tb.mix(tb.fixed_hash(prefix, s))
    least = sliding_min(inner, k - s + 1)
    n = len(data) - k + 1
    at = np.flatnonzero((inner[:n] == least) | (inner[k - s : k - s + n] == least))
    row = np.searchsorted(offsets, at, "right") - 1
    whole = at + k <= offsets[row + 1]
    at, row = at[whole], row[whole]
    value = tb.mix(tb.stretch_hash(prefix, at, at + k)) >> np.uint64(32)
    return row, at - offsets[row], value.astype(np.uint32)


def fingerprints(data: np.ndarray, offsets: np.ndarray, k: int = K, s: int = S) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) of each row. A text shorter than ``k`` bytes, or without an anchor, is one anchor by itself."""
    row, at, value = anchors(data, offsets, k, s)
    cut = tb.row_starts(row, len(offsets) - 1)
    out = []
    for i in range(len(offsets) - 1):
        a, b = cut[i], cut[i + 1]
        if a < b:
            out.append((value[a:b], at[a:b]))
        elif offsets[i] == offsets[i + 1]:
            out.append((np.zeros(0, np.uint32), np.zeros(0, np.int64)))
        else:
            own = data[offsets[i] : offsets[i + 1]]
            whole = tb.mix(tb.stretch_hash(tb.rolling_prefix(tb.BYTE_CODE[own]), np.array([0]), np.array([len(own)])))
            out.append(((whole >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.int64)))
    return out


def written(mark: tuple[np.ndarray, np.ndarray]) -> str:
    """``hash:gap`` in hex for every anchor, joined by blanks; empty for an empty text."""
    values, at = mark
    return " ".join([f"{v:08x}:{g:x}" for v, g in zip(values.tolist(), np.diff(at, prepend=0).tolist())])


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [p.split(":") for p in fingerprint.split()]
    values = np.array([int(v, 16) for v, _ in parts], np.uint32)
    return values, np.cumsum(np.array([int(g, 16) for _, g in parts], np.int64))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Anchors of both that match in the same order, over all different anchors (0 to 1); two empty ones are alike.

    The first place of each hash counts; the longest rising chain of matched places is what stands in the same order.
    """
    if len(a[0]) == len(b[0]) and np.array_equal(a[0], b[0]):
        return 1.0
    left, first_a = np.unique(a[0], return_index=True)
    right, first_b = np.unique(b[0], return_index=True)
    _, in_a, in_b = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    if not len(in_a):
        return 0.0
    pa_, pb_ = first_a[in_a], first_b[in_b]
    tails: list[int] = []
    for p in pb_[np.argsort(pa_)].tolist():
        i = bisect_left(tails, p)
        tails[i : i + 1] = [p]
    return len(tails) / (len(left) + len(right) - len(tails))


def fingerprint_table(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """Every column of ``docs`` but the text, with ``n_bytes``, ``n_anchors`` and ``fingerprint``. NULL text is empty."""
    kept = docs.drop("n_bytes", "n_anchors", "fingerprint")
    schema = kept.drop(text).schema.add("n_bytes", "long").add("n_anchors", "long").add("fingerprint", "string")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.utf8(batch.column(text))
            rest = batch.select([c for c in batch.schema.names if c != text])
            for lo, hi in tb.blocks(offsets):
                part = data[offsets[lo] : offsets[hi]]
                marks = fingerprints(part, offsets[lo : hi + 1] - offsets[lo], k, s)
                own = rest.slice(lo, hi - lo)
                added = [pa.array(np.diff(offsets[lo : hi + 1])), pa.array([len(m[0]) for m in marks], pa.int64()), pa.array([written(m) for m in marks])]
                yield pa.RecordBatch.from_arrays([*own.columns, *added], schema.names)

    return kept.mapInArrow(scan, schema)


def beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents dealt over partitions by ranges of the key, with the first of each range also behind the range before.

    Columns ``_part``, ``_key``, ``_text``, ``_guest``; each partition is sorted by them. Whoever reads a partition in order sees, for
    every own row, the next row of the whole table: the text crosses the network once and no task sees all rows. The
    smallest key is also the guest of the last range. NULL keys come before all others; rows with equal keys follow the
    order of their texts.
    """
    n = partitions(docs)
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    found = docs.agg(
        F.min(f"`{key}`").alias("least"),
        F.percentile_approx(F.col(f"`{key}`"), [i / n for i in range(1, n)] or [0.5], 10_000).alias("cuts"),
    ).first()
    none = docs.filter(F.col(f"`{key}`").isNull()).limit(1).count() > 0
    cuts = sorted({c for c in (found.cuts or []) if c != found.least or none})
    # one number per partition, never more
    where = F.lit(0)
    if cuts:
        bounds = F.array(*[F.lit(c) for c in cuts])
        where = F.when(F.col("_key").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("_key"))))
    first = F.col("_key").isNull() if none else F.col("_key").eqNullSafe(F.lit(found.least))
    part = where.cast("int")
    place = lambda p, guest: F.struct(p.cast("int").alias("_part"), F.lit(guest).alias("_guest"))
    guest = F.when(first, place(F.lit(len(cuts)), True))
    if cuts:
        guest = guest.when(F.col("_key").isin(cuts), place(part - 1, True))
    both = rows.withColumn("_at", F.explode(F.array_compact(F.array(place(part, False), guest))))
    dealt = deal(both.select("_key", "_text", "_at._part", "_at._guest"), n, "_part")
    return dealt.sortWithinPartitions("_part", "_guest", F.col("_key").asc_nulls_first(), "_text")


def edited(text: str, after: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many, or all, of the text after it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


EDIT_SCHEMA = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double,"
    " near_next double, n_anchors long"
)


def edit_resilience(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of every text, of its edited text (half taken from the next document) and their likeness.

    One row per row of ``docs``: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_anchors. NULL text is empty; a table of one row is its own next; repeated rows follow each other in text order. No
    rows give no rows. Other columns are left out.
    """
    kind = docs.schema[key].dataType.simpleString()

    def pairs(batches):
        """(key, text, next text) of every own row, in blocks of bounded size."""
        block, size, held = [], 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_part", "_guest", "_key", "_text")]
            for part, guest, own, body in zip(*columns):
                if held is not None and held[0] == part:
                    block.append((held[1], held[2], body))
                    size += len(body)
                held = None if guest else (part, own, body)
                if size > tb.BLOCK_BYTES:
                    yield block
                    block, size = [], 0
        if block:
            yield block

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, *[c.split()[0] for c in EDIT_SCHEMA.split(", ")]]
        for block in pairs(batches):
            chain = [own for _, own, _ in block]
            changed = [edited(own, after) for _, own, after in block]
            marks = fingerprints(*tb.utf8(pa.array(chain, pa.large_string())), k, s)
            marks_edited = fingerprints(*tb.utf8(pa.array(changed, pa.large_string())), k, s)
            last = fingerprints(*tb.utf8(pa.array([block[-1][2]], pa.large_string())), k, s)
            follows = [
                marks[i + 1] if i + 1 < len(block) and block[i][2] == chain[i + 1] else None for i in range(len(block))
            ]
            follows[-1] = last[0]
            for i, f in enumerate(follows):
                if f is None:
                    follows[i] = fingerprints(*tb.utf8(pa.array([block[i][2]], pa.large_string())), k, s)[0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b[0] for b in block]),
                    pa.array([len(t) for t in chain], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array([written(m) for m in marks]),
                    pa.array([written(m) for m in marks_edited]),
                    pa.array([likeness(a, b) for a, b in zip(marks, marks_edited)], pa.float64()),
                    pa.array([likeness(a, b) for a, b in zip(marks, follows)], pa.float64()),
                    pa.array([len(m[0]) for m in marks], pa.int64()),
                ],
                names,
            )

    return beside_next(docs, key, text).mapInArrow(scan, f"`{key}` {kind}, {EDIT_SCHEMA}")
