"""Near-duplicates by SuperMinHash.

A document is the set of its distinct shingles of ``size`` words. Each shingle seeds a random permutation of the registers
and one fraction per rank: at rank j it offers j + fraction to the register that its permutation names. Offers of a rank are all
smaller than those of the next, so a document is finished at the first rank after which every register is filled
(long documents stop after two or three ranks), and the ranks of a shingle never meet in one register, which makes the
signature's variance smaller than that of independent minima.

Documents of equal sets are one node. Nodes that agree in a band of registers are joined to the band's least node; the
components of these candidate links are dealt out, each with the texts of its nodes, and all links inside are decided on full
sets. Comparing one node (a pivot) with the rest of a component settles all its links, and 1 - similarity is a metric: two
nodes whose distances to a pivot differ by more than the threshold cannot be linked. So copies, however many, cost few pivots,
and no pairs are formed. A component beyond ``TASK_SHINGLES`` is cut into blocks, and rounds of pivots go to every block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arealens.llm import textbatch as tb
from arealens.llm.graph import connected_components
from arealens.llm.staging import partitions, shielded, stage_table

SIZE, THRESHOLD = 5, 75  # words, percent
BANDS, ROWS = 48, 6
TASK_SHINGLES = 4_000_000
PIVOTS = 32
NO_KEY = -(1 << 63)
REAL_KEY = -(1 << 62)  # rows without a key get numbers below it
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row and their rows, sorted by row and hash. A-Z are lower-cased.

    A row with fewer than ``size`` words has its whole sequence as one shingle; a row without words has none.
    """
    data = tb.LOWER[data]
    starts, ends, rows = tb.word_spans(data, offsets, ~tb.SPACE[data])
    prefix = tb.rolling_prefix(tb.word_hashes(data, starts, ends))
    n = len(starts) - size + 1
    whole = np.flatnonzero(rows[:n] == rows[size - 1 :]) if n > 0 else np.zeros(0, np.int64)
    values, at = tb.mix(tb.fixed_hash(prefix, size)[whole]), rows[whole]
    edge = tb.row_starts(rows, len(offsets) - 1)
    counts = np.diff(edge)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = tb.mix(tb.stretch_hash(prefix, edge[short], edge[short + 1]) + counts[short].astype(np.uint64))
        values, at = np.concatenate([values, own]), np.concatenate([at, short])
    order = np.lexsort((values, at))
    values, at = values[order], at[order]
    if len(values):
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (at[1:] != at[:-1])])
        values, at = values[new], at[new]
    return values, at


def superminhash(values: np.ndarray, rows: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """(n_rows, m) signatures: rank in the top bits, 22 bits of fraction below. Rows without shingles keep the top value."""
    out = np.full(n_rows * m, np.uint32(0xFFFFFFFF))
    base, order = rows * m, None
    for j in range(m):
        x = tb.mix(values + np.uint64(int(STEP) * (j + 1) % (1 << 64)))
        pick = (j + ((x >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32))).astype(np.int64)
        offer = (np.uint32(j) << np.uint32(22)) | (x & np.uint64(0x3FFFFF)).astype(np.uint32)
        if order is None:
            register = pick
        else:
            at = np.arange(len(values))
            register = order[at, pick].astype(np.int64)
            order[at, pick] = order[:, j]
        np.minimum.at(out, base + register, offer)
        open_ = (out.reshape(n_rows, m) == np.uint32(0xFFFFFFFF)).any(axis=1)[base // m]
        if not open_.any():
            break
        # only documents with empty registers go on, and only they need a permutation
        if order is None:
            values, base, pick = values[open_], base[open_], pick[open_]
            order = np.broadcast_to(np.arange(m, dtype=np.uint16), (len(values), m)).copy()
            order[np.arange(len(values)), pick] = 0
        elif not open_.all():
            values, base, order = values[open_], base[open_], order[open_]
    return out.reshape(n_rows, m)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) signed 64-bit hashes of each band's registers."""
    out = np.zeros((len(signatures), bands), np.uint64)
    for r in range(rows):
        out = tb.mix(out * tb.BASE + signatures[:, r : bands * rows : rows].astype(np.uint64) + STEP)
    return out.view(np.int64)


SIGNED = "_id long, _sum long, n_shingles long, set_key binary, bands array<long>"


def signatures(docs: DataFrame, size: int = SIZE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """SIGNED rows of a table (_id, _sum, _text): set size, 128-bit key of the set, and one hash per band."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.utf8(batch.column("_text"))
            for lo, hi in tb.blocks(offsets, tb.BLOCK_BYTES // 2):
                values, at = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                edge = tb.row_starts(at, hi - lo)
                hashes = band_hashes(superminhash(values, at, hi - lo, bands * rows), bands, rows)
                keys = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(lo, hi - lo), batch.column("_sum").slice(lo, hi - lo), pa.array(np.diff(edge)),
                        pa.array(keys, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * bands, pa.int32()), pa.array(hashes.reshape(-1))),
                    ],
                    ["_id", "_sum", "n_shingles", "set_key", "bands"],
                )

    return docs.mapInArrow(scan, SIGNED)


def candidate_links(nodes: DataFrame) -> DataFrame:
    """(a, b): every node with the least node of each band bucket it shares; a bucket of s nodes gives s - 1 links.

    Buckets are counted before the shuffle, lonely ones leave, and what remains joins on the bucket; adaptive execution
    splits a crowded one.
    """
    placed = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    crowded = placed.groupBy("band", "value").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    return placed.join(crowded.drop("most"), ["band", "value"]).filter("node > least").select(
        F.col("node").alias("a"), F.col("least").alias("b")
    ).distinct()


def alike(common: np.ndarray, size: int, sizes: np.ndarray, threshold: int) -> np.ndarray:
    """Exact test of 100 * intersection >= threshold * union."""
    return 100 * common >= threshold * (size + sizes - common)


class Pool:
    """Shingle sets of several nodes, compared with one set at a time."""

    def __init__(self, values: np.ndarray, rows: np.ndarray, n: int):
        self.values, self.n = values, n
        self.edge = tb.row_starts(rows, n)
        self.sizes = np.diff(self.edge)

    def row(self, i: int) -> np.ndarray:
        return self.values[self.edge[i] : self.edge[i + 1]]

    def common(self, own: np.ndarray) -> np.ndarray:
        """Intersection sizes of ``own`` (sorted) with every row."""
        at = np.searchsorted(own, self.values)
        hit = own[np.minimum(at, len(own) - 1)] == self.values
        total = np.concatenate([[0], np.cumsum(hit)])
        return total[self.edge[1:]] - total[self.edge[:-1]]


def find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def link_pool(pool: Pool, threshold: int = THRESHOLD) -> np.ndarray:
    """Root of every row under the exact links; rows are compared pivot by pivot until no open pair can be linked."""
    n, reach = pool.n, 1 - threshold / 100 + 1e-9
    parent, root = np.arange(n), np.arange(n)
    done, far = np.zeros(n, bool), []
    while True:
        largest = np.bincount(root, minlength=n).argmax()
        open_ = np.flatnonzero(~done & (root != largest)) if far else np.arange(1)
        chosen = None
        for i in open_.tolist():
            # whoever may be linked with i: not yet compared, in another component, at like distances from all pivots
            other = ~done & (root != root[i])
            for d in far[-PIVOTS:]:
                other &= np.abs(d - d[i]) <= reach
            if other.any() or not far:
                chosen = i
                break
            done[i] = True
        if chosen is None:
            return root
        common = pool.common(pool.row(chosen))
        union = pool.sizes[chosen] + pool.sizes - common
        far.append(1 - common / union)
        done[chosen] = True
        for i in np.flatnonzero(alike(common, pool.sizes[chosen], pool.sizes, threshold)).tolist():
            a, b = find(parent, chosen), find(parent, i)
            parent[max(a, b)] = min(a, b)
        root = np.array([find(parent, i) for i in range(n)])


def link_components(members: DataFrame, size: int, threshold: int) -> DataFrame:
    """(a, b) links within whole components; ``members`` (component, node, _text) arrive sorted by component."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, nodes, texts = None, [], []

        def done():
            if nodes:
                values, rows = shingles(*tb.utf8(pa.array(texts, pa.large_string())), size)
                root = link_pool(Pool(values, rows, len(nodes)), threshold)
                own = np.array(nodes)
                moved = np.flatnonzero(root != np.arange(len(nodes)))
                if len(moved):
                    yield pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[root[moved]])], ["a", "b"])

        for batch in batches:
            for c, node, text in zip(*[batch.column(x).to_pylist() for x in ("component", "node", "_text")]):
                if c != component:
                    yield from done()
                    component, nodes, texts = c, [], []
                nodes.append(node)
                texts.append(text)
        yield from done()

    return members.mapInArrow(scan, "a long, b long")


def link_large(members: DataFrame, size: int, threshold: int, block_shingles: int) -> DataFrame:
    """(a, b) links within components too large for a task; ``members`` (component, node, n_shingles, _text) are staged.

    Each round takes some open nodes of every component as pivots, sends them to all blocks of their component, and adds
    the links found. A node is settled once it was a pivot, or while it lies in the component's largest part: then every
    node outside that part is settled by its own turn. Rounds end when nothing is open.
    """
    spark = members.sparkSession
    sums = members.groupBy("component").agg(F.ceil(F.sum("n_shingles") / block_shingles).alias("_blocks"))
    members = members.join(sums, "component").withColumn("block", F.pmod(F.xxhash64("node"), "_blocks"))
    members = stage_table(members.select("component", "block", "node", "_blocks", "_text"), "large-components")
    links = stage_table(spark.createDataFrame([], "a long, b long"), "links")
    was = stage_table(spark.createDataFrame([], "component long, node long"), "pivots")

    def compare(block: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if block.empty or pivots.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        pool = Pool(*shingles(*tb.utf8(pa.array(block["_text"], pa.large_string())), size), len(block))
        own = Pool(*shingles(*tb.utf8(pa.array(pivots["_text"], pa.large_string())), size), len(pivots))
        names, found = block["node"].to_numpy(), []
        for i, pivot in enumerate(pivots["node"].tolist()):
            hit = names[alike(pool.common(own.row(i)), own.sizes[i], pool.sizes, threshold)]
            found.append(pd.DataFrame({"a": hit, "b": pivot}))
        return pd.concat(found).astype("int64")

    while True:
        parts = connected_components(links)
        placed = members.select("component", "node").join(parts.withColumnRenamed("component", "part"), "node", "left")
        placed = placed.withColumn("part", F.coalesce("part", "node"))
        sizes = placed.groupBy("component", "part").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.groupBy("component").agg(F.max_by("part", F.struct("n", "part")).alias("largest"))
        open_ = placed.join(was, ["component", "node"], "left_anti").join(largest, "component")
        started = was.select("component").distinct().withColumn("started", F.lit(True))
        open_ = open_.join(started, "component", "left").filter("part != largest or started is null")
        # the first PIVOTS of each component in hash order, kept small before the shuffle
        turn = F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("node").alias("h"), "node"))), 1, PIVOTS)
        salted = open_.withColumn("_salt", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(64))).groupBy("component", "_salt").agg(turn.alias("t"))
        chosen = salted.groupBy("component").agg(F.slice(F.array_sort(F.flatten(F.collect_list("t"))), 1, PIVOTS).alias("t"))
        chosen = stage_table(chosen.select("component", F.explode("t.node").alias("node")), "pivots")
        if chosen.isEmpty():
            return links
        pivots = members.drop("block").join(chosen, ["component", "node"])
        # names of their own, as the table meets itself
        pivots = pivots.select(
            F.col("component").alias("component"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("block"),
            F.col("node").alias("node"), F.col("_text").alias("_text"),
        )
        near = (
            members.groupBy("component", "block")
            .cogroup(pivots.groupBy("component", "block"))
            .applyInPandas(compare, "a long, b long")
        )
        links = stage_table(links.unionByName(near.filter("a != b")), "links")
        was = stage_table(was.unionByName(chosen), "pivots")


def numbered(docs: DataFrame, key: str, text: str) -> list:
    """(_id, _sum): the key, or for a NULL key a number below all keys that depends on the text, and the text's hash."""
    body = F.xxhash64(F.col(f"`{text}`"))
    none = F.lit(NO_KEY) + F.shiftrightunsigned(body, 2)
    return [F.coalesce(F.col(f"`{key}`").cast("long"), none).alias("_id"), body.alias("_sum")]


def classes(
    docs: DataFrame, size: int = SIZE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
    task_shingles: int = TASK_SHINGLES, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(_id, _sum, n_shingles, _set, _component) of every row; equal sets have one ``_set``, empty ones each their own. See ``near_duplicates``."""
    plain = docs.select(*numbered(docs, key, text), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    signed = stage_table(signatures(plain, size, bands, rows), "signatures")
    sets = signed.filter("set_key is not null")
    # of equal sets the least document stands for all
    nodes = stage_table(
        sets.groupBy("set_key").agg(
            F.min("_id").alias("node"), F.min_by("_sum", F.struct("_id", "_sum")).alias("_sum"),
            F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
        ),
        "nodes",
    )
    groups = stage_table(connected_components(candidate_links(nodes)), "candidates")
    members = nodes.select("node", "_sum", "n_shingles").join(groups, "node")
    weight = members.groupBy("component").agg(F.sum("n_shingles").alias("weight"))
    members = members.join(weight, "component")
    members = plain.withColumnRenamed("_id", "node").join(members, ["node", "_sum"]).dropDuplicates(["node", "_sum"])
    members = stage_table(members.select("component", "node", "n_shingles", "weight", "_text"), "members")
    fits = F.col("weight") <= task_shingles
    n = partitions(docs)
    whole = members.filter(fits).repartition(n, "component").sortWithinPartitions("component", "node")
    links = link_components(whole, size, threshold)
    large = members.filter(~fits)
    if not large.isEmpty():
        links = links.unionByName(link_large(large.drop("weight"), size, threshold, max(1, task_shingles // 4)))
    linked = connected_components(links).withColumnRenamed("component", "_component")
    reached = nodes.select("set_key", "node").join(linked, "node", "left")
    reached = reached.select("set_key", F.coalesce("_component", "node").alias("_component"))
    out = signed.select("_id", "_sum", "n_shingles", "set_key").join(reached, "set_key", "left")
    own = F.coalesce(F.hex("set_key"), F.concat(F.lit("empty"), F.col("_sum").cast("string")))
    return out.select("_id", "_sum", "n_shingles", own.alias("_set"), F.coalesce("_component", "_id").alias("_component"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, n_shingles, component_id (least key reachable by links) and kept (key = component_id), one row per row.

    Two documents are linked at 100 * intersection >= threshold * union of their shingle sets. With 48 bands of 6 rows a
    link of exactly 0.75 shares no band once in about 12,000 cases, one of 0.8 once in 10**6; a component is lost only if
    all paths are. NULL, empty and blank texts have no shingles and no links. Equal sets are always linked. Rows with
    equal keys are one document; rows without a key are documents of their own, smaller than any other, and report NULL.
    Keys are whole numbers above -2**62. Other columns are left out; ``options`` are those of ``classes``.
    """
    kind = docs.schema[key].dataType
    named = lambda c: F.when(F.col(c) >= REAL_KEY, F.col(c)).cast(kind)
    found = classes(docs, key=key, text=text, **options)
    return found.select(
        named("_id").alias(key), "n_shingles", named("_component").alias("component_id"), (F.col("_id") == F.col("_component")).alias("kept")
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, all columns: of every component the document with the least key, and of repeated rows one.

    Rows with one key and different shingle sets are different texts: all of them stay that lead a component.
    """

    def stage(rows: DataFrame, name) -> DataFrame:
        first = classes(rows, key=name(key), text=name(text), **options).filter("_id = _component")
        first = first.groupBy("_id", "_set").agg(F.min("_sum").alias("_sum"))
        return rows.select("*", *numbered(rows, name(key), name(text))).join(first, ["_id", "_sum"], "left_semi").dropDuplicates(["_id", "_sum"])

    return shielded(stage)(docs)
