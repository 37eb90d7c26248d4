"""The features of GeoJSON documents of any size, one text each, read block by block.

Spark's text reader cuts a file into blocks. What a block does to the nesting depends on where the text before it stands, in a string
or not, so a first pass notes it for both cases: a few numbers per block. Added up in order they say where each block begins.
A second pass cuts the features out; one that goes on in later blocks is put together again by the block it began in.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

CHUNK = 4 << 20
QUOTE, OPEN, CLOSE = 1, 2, 3
KIND = np.zeros(256, np.uint8)
KIND[ord('"')], KIND[[ord("{"), ord("[")]], KIND[[ord("}"), ord("]")]] = QUOTE, OPEN, CLOSE
LIST = re.compile(rb'(?<!\\)"features"\s*:\s*\[')


def brackets(data: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the brackets outside strings, 1 for opening and -1 for closing ones, and whether a string is open at the end."""
    text = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(KIND[text])
    if b"\\" in data:
        # what an odd run of backslashes stands before is escaped
        plain = np.maximum.accumulate(np.where(text == ord("\\"), -1, np.arange(len(text))))
        at = at[(at == 0) | ((at - 1 - plain[at - 1]) % 2 == 0)]
    kind = KIND[text[at]]
    quotes = np.cumsum(kind == QUOTE) + inside
    kept = (kind != QUOTE) & (quotes % 2 == 0)
    return at[kept], np.where(kind[kept] == OPEN, 1, -1), bool((quotes[-1] if len(quotes) else inside) % 2)


def lists(data: bytes, at: np.ndarray) -> np.ndarray:
    """Which of the brackets open an array named ``features``."""
    return np.isin(at, [m.end() - 1 for m in LIST.finditer(data)])


def chunks(batches: Iterator[pa.RecordBatch], mark: str) -> Iterator[tuple[tuple[str, int], bytes]]:
    """(file, block) and text, in the order of the text; ``mark`` stood behind every piece."""
    for batch in batches:
        where = zip(batch.column("file").to_pylist(), batch.column("block").to_pylist())
        for block, pieces in itertools.groupby(zip(where, batch.column("value").to_pylist()), lambda r: r[0]):
            held, size = [], 0
            for _, piece in pieces:
                held.append(piece)
                size += len(piece)
                if size >= CHUNK:
                    yield block, (mark.join(held) + mark).encode()
                    held, size = [], 0
            if held:
                yield block, (mark.join(held) + mark).encode()


EFFECT = "file string, block long, inside boolean, ends_inside boolean, rise long, lowest long, levels array<long>, listed array<boolean>"
ARROW_EFFECT = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("inside", pa.bool_()), ("ends_inside", pa.bool_()), ("rise", pa.int64()), ("lowest", pa.int64())]
    + [("levels", pa.list_(pa.int64())), ("listed", pa.list_(pa.bool_()))]
)


def effects(pieces: DataFrame, mark: str) -> DataFrame:
    """Two rows per block, for a start outside and inside a string: state at the end, net and lowest depth, and for every level whether the
    last bracket that led to it opened a list of features; depths count from the start of the block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), texts in itertools.groupby(chunks(batches, mark), lambda r: r[0]):
            state = {start: [start, 0, 0, {}] for start in (False, True)}
            for _, data in texts:
                for own in state.values():
                    at, step, own[0] = brackets(data, own[0])
                    level = own[1] + np.cumsum(step)
                    if len(at):
                        up = step > 0
                        named = lists(data, at[up])
                        last, which = np.unique(level[up][::-1], return_index=True)
                        own[3] |= dict(zip(last.tolist(), named[::-1][which].tolist()))
                        own[1], own[2] = int(level[-1]), min(own[2], int(level.min()))
            rows = [(file, block, start, end, rise, low, list(seen), list(seen.values())) for start, (end, rise, low, seen) in state.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(ARROW_EFFECT.names, r)) for r in rows], ARROW_EFFECT)

    return pieces.mapInArrow(scan, EFFECT)


def block_starts(found: list, whole: bool) -> dict[tuple[str, int], tuple[int, bool, int, bool, int]]:
    """Number, in a string, depth, in the list of features, and block where the open feature began (or -1) of every block's start.

    With ``whole`` all files are one document, else each is one. Unclosed documents are left out: they are no JSON.
    """
    effect = {(r.file, r.block, r.inside): r for r in found}
    order = sorted({(len(r.file), r.file, r.block) for r in found})
    out, number = {}, 0
    for _, document in itertools.groupby(order, lambda k: None if whole else k[1]):
        inside, depth, listed, owner, own = False, 0, False, -1, {}
        for _, file, block in document:
            own[file, block] = number, inside, depth, listed, owner
            e = effect[file, block, inside]
            passes = owner >= 0 and depth + e.lowest > 2
            listed = dict(zip(e.levels, e.listed)).get(2 - depth, listed)
            inside, depth = e.ends_inside, depth + e.rise
            owner = owner if passes else number if listed and depth > 2 else -1
            number += 1
        # behind the last piece of a file stands a mark that may not be in it
        if not inside and depth <= 0:
            out |= own
    return out


def cut_features(pieces: DataFrame, starts: dict, mark: str) -> DataFrame:
    """(owner, number, value): whole features (owner -1), and parts of those that began in block ``owner`` and went on behind it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            owners, numbers, values = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(numbers, pa.int64()), pa.array(values, pa.string())], ["owner", "number", "value"])

        for block, texts in itertools.groupby(chunks(batches, mark), lambda r: r[0]):
            if block not in starts:
                continue
            number, inside, depth, listed, owner = starts[block]
            # text of the open feature, and the block it began in
            held, open_, began = [], owner >= 0, owner
            for _, data in texts:
                at, step, inside = brackets(data, inside)
                level = depth + np.cumsum(step)
                depth = int(level[-1]) if len(level) else depth
                enters = at[(step > 0) & (level == 2)]
                kinds = np.concatenate([[listed], lists(data, enters)])
                listed = bool(kinds[-1])
                text = np.frombuffer(data, np.uint8)
                edge = ((step > 0) & (level == 3) & (text[at] == ord("{"))) | ((step < 0) & (level == 2) & (text[at] == ord("}")))
                edge &= kinds[np.searchsorted(enters, at, "right")]
                rows, from_ = [], 0
                for place, opens in zip(at[edge].tolist(), (step[edge] > 0).tolist()):
                    if opens:
                        held, open_, began, from_ = [], True, number, place
                    elif open_:
                        value = b"".join([*held, data[from_ : place + 1]]).decode()
                        rows.append((-1 if began == number else began, number, value))
                        held, open_ = [], False
                if open_:
                    held.append(data[from_:])
                if rows:
                    yield out(rows)
            if open_:
                yield out([(began, number, b"".join(held).decode())])

    return pieces.mapInArrow(scan, "owner long, number long, value string")


def feature_texts(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """``value``: the text of every object in the top-level ``features`` array of the UTF-8 documents below ``path``, as it stands there.

    Each file is one document; with ``whole`` all files are one, in the order of their names and broken between lines. A single
    feature has to fit into a task's memory. Per block, two rows of a few numbers reach the driver.
    """
    # no line end stands in a JSON string, so one more at the end of a file changes nothing; a document of one file may be one line
    mark = "\n" if whole else "}"
    pieces = spark.read.option("lineSep", mark).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    starts = block_starts(effects(pieces, mark).collect(), whole)
    found = cut_features(pieces, starts, mark)
    ordered = F.array_sort(F.collect_list(F.struct("number", "value")))
    broken = found.filter("owner >= 0").groupBy("owner").agg(F.array_join(F.transform(ordered, lambda r: r["value"]), "").alias("value"))
    return found.filter("owner < 0").select("value").unionByName(broken.select("value"))
