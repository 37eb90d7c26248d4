"""Quality classifier by co-training.

Two classifiers see different sides of a document. The content view reads its words: presence of the words and word beginnings
that tell the labelled classes apart. The metadata view reads everything else: language, source, length and layout (shares of
capitals, symbols, digits and repeats). Each round, each view names the documents of whose label it is most confident, among all of
the table but the labelled sample, and the other learns from them. Views are then calibrated on labelled documents that neither learned from,
and a combination of the calibrated views scores every document of the table.

Only the labelled sample is bounded: ``labelled_rows`` documents chosen by a hash of the key. Its features and those of the exchanged
documents (``confident`` per round, view and class) go to the driver, where the small models are fitted. Every round judges all
documents in place: tasks send the numbers of their surest texts, and the features of the chosen ones alone are fetched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from arealens.llm import textbatch as tb

LABELLED_ROWS = 8_000
ROUNDS, CONFIDENT, SURE = 3, 400, 0.97
SLOTS = 1 << 20
LEXICON = 6_000
BEGINNING = 5
HASHED = 64

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
PLAIN_MARK = np.zeros(256, bool)
PLAIN_MARK[[ord(c) for c in ".,;:'\"()-?"]] = True
SYMBOL = ~(LETTER | DIGIT | PLAIN_MARK | tb.SPACE)
LINE = np.zeros(256, bool)
LINE[0x0A] = True


def content_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every word and every word beginning, lower-cased in A-Z; a slot may come more than once."""
    low = tb.LOWER[data]
    starts, ends, rows = tb.word_spans(low, offsets, LETTER[low])
    prefix = tb.rolling_prefix(tb.BYTE_CODE[low])
    whole = tb.mix(tb.stretch_hash(prefix, starts, ends))
    long = ends - starts > BEGINNING
    part = tb.mix(tb.stretch_hash(prefix, starts[long], starts[long] + BEGINNING) + np.uint64(1))
    slots = np.concatenate([whole, part]) & np.uint64(SLOTS - 1)
    return np.concatenate([rows, rows[long]]), slots.astype(np.int64)


def metadata(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(rows, features): layout shares and their roots, log length, and hashed language and source (``codes``, two columns)."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    some = np.maximum(size, 1)

    def share(table):
        total = np.concatenate([[0], np.cumsum(table[data])])
        return (total[offsets[1:]] - total[offsets[:-1]]) / some

    starts, ends, rows = tb.word_spans(data, offsets, ~tb.SPACE[data])
    words = np.bincount(rows, minlength=n)
    at_least = np.maximum(words, 1)
    hashes = tb.word_hashes(data, starts, ends)
    again = np.zeros(len(rows), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    mean = np.bincount(rows, ends - starts, minlength=n) / at_least
    shares = [share(t) for t in (UPPER, DIGIT, SYMBOL, PLAIN_MARK, LINE, tb.SPACE)] + [np.bincount(rows, again, minlength=n) / at_least]
    shares += [np.sqrt(s) for s in shares]
    dense = np.stack([*shares, np.log1p(size), np.log1p(words), mean / 10, size == 0], axis=1)
    hashed = np.zeros((n, 2 * HASHED))
    for i in range(2):
        hashed[np.arange(n), i * HASHED + codes[:, i]] = 1
    return np.concatenate([dense, hashed], axis=1).astype(np.float32)


def fit_logistic(matvec, rmatvec, n_features: int, y: np.ndarray, weight: np.ndarray, l2: float, steps: int = 150):
    """Weights and intercept of an L2-regularised logistic regression, by Adam on the full sample."""
    w, b = np.zeros(n_features), 0.0
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    total = weight.sum()
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(matvec(w) + b, -30, 30)))
        r = weight * (p - y) / total
        g, gb = rmatvec(r) + l2 * w, r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.2 * (1 - t / (steps + 1))
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b = b - rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


PAIRS = 1 << 20


class Sample:
    """Features of the bounded sample on the driver: slots of row i are ``slots[edge[i]:edge[i + 1]]``, distinct per row."""

    def __init__(self, slots: list[np.ndarray], meta: np.ndarray):
        self.n, self.meta = len(meta), meta
        self.edge = np.concatenate([[0], np.cumsum([len(s) for s in slots])]).astype(np.int64)
        self.slots = np.concatenate(slots).astype(np.int32) if slots else np.zeros(0, np.int32)

    def extended(self, other: Sample) -> Sample:
        """These rows and those of ``other`` behind them."""
        out = Sample([], np.concatenate([self.meta, other.meta]))
        out.edge = np.concatenate([self.edge, self.edge[-1] + other.edge[1:]])
        out.slots = np.concatenate([self.slots, other.slots])
        return out

    def parts(self, index: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position in ``index``, slot) pairs of some rows, about PAIRS at a time."""
        counts = np.diff(self.edge)[index]
        ends = np.cumsum(counts)
        lo = 0
        while lo < len(index):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - counts[lo] + PAIRS, "right")))
            own = index[lo:hi]
            slots = np.concatenate([self.slots[self.edge[i] : self.edge[i + 1]] for i in own.tolist()])
            yield np.repeat(np.arange(lo, hi, dtype=np.int32), counts[lo:hi]), slots
            lo = hi


class ContentView:
    """Logistic regression over the presence of lexicon slots."""

    def __init__(self, sample: Sample, index: np.ndarray, y: np.ndarray):
        good, seen = np.zeros(SLOTS), np.zeros(SLOTS)
        for rows, slots in sample.parts(index):
            good += np.bincount(slots, y[rows], SLOTS)
            seen += np.bincount(slots, minlength=SLOTS)
        base = y.mean()
        # distance of a slot's class share from the base rate, in standard errors
        z = np.abs(good - seen * base) / np.sqrt(np.maximum(seen, 1) * max(base * (1 - base), 1e-9))
        lexicon = np.sort(np.argsort(-np.where(seen >= 3, z, 0), kind="stable")[:LEXICON])
        place = np.full(SLOTS, -1, np.int32)
        place[lexicon] = np.arange(len(lexicon))
        kept = [(rows[known], place[slots[known]]) for rows, slots in sample.parts(index) for known in (place[slots] >= 0,)]
        r, c = (np.concatenate(x) for x in zip(*kept))
        n = len(index)
        w, b = fit_logistic(
            lambda w: np.bincount(r, w[c], n), lambda e: np.bincount(c, e[r], len(lexicon)), len(lexicon), y, np.ones(n), 1e-5
        )
        self.weights, self.bias = np.zeros(SLOTS, np.float32), float(b)
        self.weights[lexicon] = w

    def margin(self, rows: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
        """Margins of n rows from slots that are distinct per row."""
        return np.bincount(rows, self.weights[slots], n) + self.bias

    def margins(self, sample: Sample) -> np.ndarray:
        every = np.arange(sample.n)
        return sum(self.margin(rows, slots, sample.n) - self.bias for rows, slots in sample.parts(every)) + self.bias


class MetadataView:
    """Logistic regression over standardised metadata."""

    def __init__(self, meta: np.ndarray, y: np.ndarray):
        x = meta.astype(np.float64)
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        x = (x - self.mean) / self.scale
        self.weights, self.bias = fit_logistic(lambda w: x @ w, lambda e: x.T @ e, x.shape[1], y, np.ones(len(y)), 1e-4)

    def margin(self, meta: np.ndarray) -> np.ndarray:
        return ((meta - self.mean) / self.scale) @ self.weights + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into log-odds (Platt, with his smoothed targets)."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(float(np.std(margin)), 1e-9)
    x = margin / scale
    w, b = fit_logistic(lambda w: x * w[0], lambda e: np.array([e @ x]), 1, target, np.ones(len(y)), 1e-6, 300)
    return max(float(w[0]), 0.0) / scale, float(b)


@dataclass
class CoTrained:
    """Fitted views, their calibration, and the combination of both log-odds."""

    content: ContentView
    meta: MetadataView
    scales: tuple[tuple[float, float], tuple[float, float]]
    blend: np.ndarray

    def odds(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.clip(a * m + b, -9, 9) for (a, b), m in zip(self.scales, (content, meta)))


def parts(odds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What the combination weighs: doubt and trust of each view on their own, so that one strong doubt can decide."""
    return np.stack([f(o) for o in odds for f in (lambda o: np.minimum(o, 0), lambda o: np.maximum(o, 0))], axis=1)


TURNS = (("content", "meta"), ("meta", "content"))
#: Chosen documents: their numbers, pseudo-labels and features.
Given = tuple[np.ndarray, np.ndarray, Sample]


def most_sure(odds: np.ndarray, ids: np.ndarray, confident: int, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the up to ``confident`` lowest and highest log-odds beyond the bar, surest first; one for equal ids, ties by id."""
    bar = np.log(sure / (1 - sure))
    out = []
    for sign in (-1, 1):
        beyond = np.flatnonzero(sign * odds >= bar)
        order = beyond[np.lexsort((ids[beyond], -sign * odds[beyond]))]
        out.append(order[np.sort(np.unique(ids[order], return_index=True)[1])[:confident]])
    return tuple(out)


def sample_pool(sample: Sample, index: np.ndarray, confident: int, sure: float):
    """Exchange among rows of a sample on the driver."""

    def exchange(views: dict, scales: dict, taken: dict) -> dict[str, Given]:
        given = {}
        for giver, learner in TURNS:
            a, b = scales[giver]
            free = np.setdiff1d(index, taken[learner])
            low, high = most_sure(a * margins_of(views[giver], sample)[free] + b, free, confident, sure)
            chosen = free[np.concatenate([low, high])]
            slots = [sample.slots[sample.edge[i] : sample.edge[i + 1]] for i in chosen.tolist()]
            given[learner] = chosen, np.repeat([0.0, 1.0], [len(low), len(high)]), Sample(slots, sample.meta[chosen])
        return given

    return exchange


def margins_of(view, sample: Sample) -> np.ndarray:
    return view.margins(sample) if isinstance(view, ContentView) else view.margin(sample.meta)


def co_train(sample: Sample, y: np.ndarray, rounds: int = ROUNDS, confident: int = CONFIDENT, sure: float = SURE, exchange=None) -> CoTrained | None:
    """Fits both views; ``y`` is 1, 0 or -1 (unlabelled) per row. None if a class has fewer than two labelled rows.

    ``exchange`` names each learner the documents of which the other view is surest (default: among the sample's unlabelled rows).
    """
    known = np.flatnonzero(y >= 0)
    if min((y[known] == 1).sum(), (y[known] == 0).sum()) < 2:
        return None
    held = known[3::4]
    learn = np.setdiff1d(known, held)
    if len(np.unique(y[held])) < 2 or len(np.unique(y[learn])) < 2:
        held = learn = known
    exchange = exchange or sample_pool(sample, np.flatnonzero(y < 0), confident, sure)
    grown = sample
    own = {k: (learn, y[learn].astype(float)) for k in ("content", "meta")}
    taken = {k: np.zeros(0, np.int64) for k in own}

    def fit(which):
        index, target = own[which]
        return ContentView(grown, index, target) if which == "content" else MetadataView(grown.meta[index], target)

    views = {k: fit(k) for k in own}
    for _ in range(rounds):
        scales = {k: calibrate(margins_of(v, sample)[held], y[held]) for k, v in views.items()}
        given = exchange(views, scales, taken)
        if not sum(len(ids) for ids, _, _ in given.values()):
            break
        for learner, (ids, labels, rows) in given.items():
            index, target = own[learner]
            own[learner] = np.concatenate([index, np.arange(grown.n, grown.n + rows.n)]), np.concatenate([target, labels])
            taken[learner] = np.concatenate([taken[learner], ids])
            grown = grown.extended(rows) if rows.n else grown
        views = {k: fit(k) for k in own}
    model = CoTrained(views["content"], views["meta"], ((1.0, 0.0), (1.0, 0.0)), np.zeros(5))
    raw = margins_of(model.content, sample), margins_of(model.meta, sample)
    model.scales = tuple(calibrate(m[held], y[held]) for m in raw)
    x = parts(model.odds(raw[0][held], raw[1][held]))
    w, b = fit_logistic(lambda w: x @ w, lambda e: x.T @ e, 4, y[held].astype(float), np.ones(len(held)), 1e-3, 300)
    model.blend = np.append(np.maximum(w, 0), b)
    return model


def labels_of(labels: DataFrame, key: str, quality: str, toxic: str) -> DataFrame:
    """(_key, _y): 1 if every label of the key says good and none says toxic, else 0; keys without a quality label are left out."""
    good = (F.col(f"`{quality}`") == 1) & (F.coalesce(F.col(f"`{toxic}`"), F.lit(0)) == 0)
    rows = labels.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{quality}`").isNotNull())
    return rows.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.min(good.cast("int")).alias("_y"))


def code(name: str):
    return F.pmod(F.xxhash64(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))), F.lit(HASHED)).cast("int")


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets, codes) of bounded parts of a table with _text, _a and _b."""
    for batch in batches:
        data, offsets = tb.utf8(batch.column("_text"))
        codes = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("_a", "_b")], axis=1)
        for lo, hi in tb.blocks(offsets):
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], codes[lo:hi]


def features(rows: DataFrame) -> tuple[pa.Table, Sample]:
    """Features of a bounded table (_sum, _y, _text, _a, _b) on the driver, in order of _sum and _y."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets, codes in blocks_of(batches):
            at, slots = content_slots(data, offsets)
            pair = np.unique(at * SLOTS + slots)
            edge = np.searchsorted(pair // SLOTS, np.arange(part.num_rows + 1))
            slots = (pair % SLOTS).astype("<i4")
            meta = metadata(data, offsets, codes).astype("<f4")
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_sum"), part.column("_y"), pa.array([slots[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary()),
                    pa.array([m.tobytes() for m in meta], pa.binary()),
                ],
                ["_sum", "_y", "slots", "meta"],
            )

    taken = rows.mapInArrow(scan, "_sum long, _y int, slots binary, meta binary").toArrow().sort_by([("_sum", "ascending"), ("_y", "ascending")])
    slots = [np.frombuffer(s, "<i4") for s in taken.column("slots").to_pylist()]
    meta = [np.frombuffer(m, "<f4") for m in taken.column("meta").to_pylist()]
    return taken.select(["_sum", "_y"]), Sample(slots, np.stack(meta) if meta else np.zeros((0, 1), np.float32))


def table_pool(rows: DataFrame, known: np.ndarray, confident: int, sure: float):
    """Exchange among all texts of a table (_sum, _text, _a, _b) but those numbered in ``known``.

    Every task keeps its ``confident`` surest texts per view and class; of theirs the surest of all are found by a window that is
    limited before its shuffle. Equal texts count once.
    """

    def exchange(views: dict, scales: dict, taken: dict) -> dict[str, Given]:
        sent = rows.sparkSession.sparkContext.broadcast((views, scales, {k: np.concatenate([known, v]) for k, v in taken.items()}))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            views, scales, closed = sent.value
            used = views["content"].weights != 0
            best = {turn: (np.zeros(0), np.zeros(0, np.int64)) for turn in range(2 * len(TURNS))}
            for part, data, offsets, codes in blocks_of(batches):
                at, slots = content_slots(data, offsets)
                kept = used[slots]
                pair = np.unique(at[kept] * SLOTS + slots[kept])
                margin = {
                    "content": views["content"].margin(pair // SLOTS, pair % SLOTS, part.num_rows),
                    "meta": views["meta"].margin(metadata(data, offsets, codes)),
                }
                ids = part.column("_sum").to_numpy()
                for i, (giver, learner) in enumerate(TURNS):
                    free = ~np.isin(ids, closed[learner])
                    a, b = scales[giver]
                    odds, own = a * margin[giver][free] + b, ids[free]
                    for label, chosen in enumerate(most_sure(odds, own, confident, sure)):
                        old = best[2 * i + label]
                        odds_, ids_ = np.concatenate([old[0], odds[chosen]]), np.concatenate([old[1], own[chosen]])
                        again = most_sure(odds_, ids_, confident, sure)[label]
                        best[2 * i + label] = odds_[again], ids_[again]
            for turn, (odds, own) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), turn, np.int32)), pa.array(own), pa.array(np.abs(odds))], ["turn", "_sum", "odds"])

        found = rows.mapInArrow(scan, "turn int, _sum long, odds double").groupBy("turn", "_sum").agg(F.max("odds").alias("odds"))
        nth = F.row_number().over(Window.partitionBy("turn").orderBy(F.desc("odds"), "_sum"))
        chosen: dict[int, list[int]] = {}
        for r in found.withColumn("nth", nth).filter(F.col("nth") <= confident).select("turn", "_sum").collect():
            chosen.setdefault(r["turn"], []).append(r["_sum"])
        sent.unpersist()
        ids = sorted({x for own in chosen.values() for x in own})
        if not ids:
            return {learner: (np.zeros(0, np.int64), np.zeros(0), Sample([], np.zeros((0, 1), np.float32))) for _, learner in TURNS}
        one = rows.filter(F.col("_sum").isin(ids)).dropDuplicates(["_sum"])
        table, every = features(one.withColumn("_y", F.lit(-1)))
        place = {x: i for i, x in enumerate(table.column("_sum").to_pylist())}
        given = {}
        for i, (_, learner) in enumerate(TURNS):
            own = [(x, float(label)) for label in (0, 1) for x in sorted(chosen.get(2 * i + label, [])) if x in place]
            slots = [every.slots[every.edge[place[x]] : every.edge[place[x] + 1]] for x, _ in own]
            given[learner] = np.array([x for x, _ in own], np.int64), np.array([y for _, y in own]), Sample(slots, every.meta[[place[x] for x, _ in own]])
        return given

    return exchange


def train(
    docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS, confident: int = CONFIDENT, sure: float = SURE,
    key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", quality: str = "quality", toxic: str = "toxic",
) -> CoTrained | None:
    """Co-trained model from a bounded sample of labelled documents and all others, or None if the labels do not hold two classes.

    Documents that are not in the labelled sample are unlabelled, whatever their labels; copies of its texts are left out.
    """
    # the sample is the first keys in hash order: a bounded table
    some = labels_of(labels, key, quality, toxic).orderBy(F.xxhash64("_key"), "_key").limit(labelled_rows)
    body = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.xxhash64(body).alias("_sum"), body.alias("_text"), code(lang).alias("_a"), code(source).alias("_b"))
    table, sample = features(rows.join(F.broadcast(some), "_key").dropDuplicates(["_key"]).drop("_key"))
    if not sample.n:
        return None
    exchange = table_pool(rows.drop("_key"), table.column("_sum").to_numpy(), confident, sure)
    return co_train(sample, table.column("_y").to_numpy(), rounds, confident, sure, exchange)


def score(docs: DataFrame, model: CoTrained | None, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Every column of ``docs`` plus p_content, p_meta, score and keep (score of one half or more).

    Without a model every document scores one half and stays. NULL texts are empty; NULL language and source are values of
    their own. Columns that clash with the new names are replaced.
    """
    new = ["p_content", "p_meta", "score", "keep"]
    docs = docs.drop(*new)
    if model is None:
        half = F.lit(0.5)
        return docs.select("*", half.alias("p_content"), half.alias("p_meta"), half.alias("score"), F.lit(True).alias("keep"))
    # two weights for each of a fixed number of slots
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema, columns = docs.schema, docs.columns
    for n, t in zip(new, ("double", "double", "double", "boolean")):
        schema = schema.add(n, t)

    names = schema.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        used = own.content.weights != 0
        for batch in batches:
            data, offsets = tb.utf8(batch.column(text))
            codes = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("_a", "_b")], axis=1)
            for lo, hi in tb.blocks(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                rows, slots = content_slots(part, at)
                known = used[slots]
                pair = np.unique(rows[known] * SLOTS + slots[known])
                content = own.content.margin(pair // SLOTS, pair % SLOTS, hi - lo)
                odds = own.odds(content, own.meta.margin(metadata(part, at, codes[lo:hi])))
                final = sigmoid(parts(odds) @ own.blend[:4] + own.blend[4])
                rest = [batch.column(c).slice(lo, hi - lo) for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(sigmoid(odds[0])), pa.array(sigmoid(odds[1])), pa.array(final), pa.array(final >= 0.5)], names
                )

    return docs.select("*", code(lang).alias("_a"), code(source).alias("_b")).mapInArrow(scan, schema)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Trains on ``docs`` and ``labels`` and scores every document; see ``train`` and ``score``."""
    return score(docs, train(docs, labels, **options))
