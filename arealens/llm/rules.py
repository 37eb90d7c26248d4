"""Quality rules as a short-circuit cascade.

Every rule judges a few measures of a text (counts of words, symbols, repeated lines ...). Measures differ in cost by orders of
magnitude and rules in how many documents they reject, so a pilot first runs all of them over a sample: it sums the
time each measure takes and counts which rules reject together. From that the driver orders the rules: next comes the rule with the most
new rejections per cost, where measures already taken are free and rejections of earlier rules no longer count. In the main pass a document
leaves the cascade at its first rejection, and what only later rules need is never measured for it.

The order decides the cost alone: a document is kept if no rule rejects it, whatever the order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arealens.llm import textbatch as tb

SAMPLE_ROWS = 4000


class Texts:
    """Texts of some rows as bytes, with what their measures share: words, their hashes, and counts of bytes by row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._words = self._hashes = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of every run without ASCII white space."""
        if self._words is None:
            self._words = tb.word_spans(self.data, self.offsets, ~tb.SPACE[self.data])
        return self._words

    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            starts, ends, _ = self.words()
            self._hashes = tb.word_hashes(self.data, starts, ends)
        return self._hashes

    def by_row(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row are flagged."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def take(self, rows: np.ndarray) -> Texts:
        """The texts of ``rows`` (rising) alone; words that are known are carried over."""
        if len(rows) == self.n:
            return self
        size = np.diff(self.offsets)
        chosen = np.zeros(self.n, bool)
        chosen[rows] = True
        out = Texts(self.data[np.repeat(chosen, size)], np.concatenate([[0], np.cumsum(size[rows])]))
        if self._words is not None:
            starts, ends, row = self._words
            kept = chosen[row]
            number = np.cumsum(chosen) - 1
            shift = np.zeros(self.n, np.int64)
            shift[rows] = self.offsets[rows] - out.offsets[:-1]
            row = row[kept]
            out._words = starts[kept] - shift[row], ends[kept] - shift[row], number[row]
            out._hashes = self._hashes[kept] if self._hashes is not None else None
        return out


def _flags(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


SYMBOL = _flags(b"#*$%&|<>")
UPPER, LOWER, DIGIT = (_flags(bytes(range(ord(a), ord(b) + 1))) for a, b in ("AZ", "az", "09"))


def repeats(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: does its row hold it twice or more, and has the row held it before? Rows rise."""
    order = np.lexsort((values, rows))
    r, v = rows[order], values[order]
    same = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
    twice, before = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    twice[order[1:]] = before[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, before


def n_words(t: Texts) -> np.ndarray:
    return np.bincount(t.words()[2], minlength=t.n)


def word_chars(t: Texts) -> np.ndarray:
    return t.by_row(~tb.SPACE[t.data] & (t.data & 0xC0 != 0x80))


def longest_word(t: Texts) -> np.ndarray:
    """Code points of the longest word."""
    total = np.concatenate([[0], np.cumsum(t.data & 0xC0 != 0x80)])
    starts, ends, rows = t.words()
    out = np.zeros(t.n, np.int64)
    np.maximum.at(out, rows, total[ends] - total[starts])
    return out


def lines(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every line that holds a word."""
    starts, ends, rows = tb.word_spans(t.data, t.offsets, t.data != 0x0A)
    total = np.concatenate([[0], np.cumsum(~tb.SPACE[t.data])])
    some = total[ends] > total[starts]
    return starts[some], ends[some], rows[some]


def n_lines(t: Texts) -> np.ndarray:
    return np.bincount(lines(t)[2], minlength=t.n)


def n_dup_lines(t: Texts) -> np.ndarray:
    starts, ends, rows = lines(t)
    return np.bincount(rows[repeats(rows, tb.word_hashes(t.data, starts, ends))[1]], minlength=t.n)


def n_repeat_words(t: Texts, width: int = 3) -> np.ndarray:
    """Words in windows of ``width`` words that the text holds twice or more."""
    rows, values = t.words()[2], tb.fixed_hash(tb.rolling_prefix(t.hashes()), width)
    whole = np.flatnonzero(rows[: len(values)] == rows[width - 1 :]) if len(values) else np.zeros(0, np.int64)
    twice, _ = repeats(rows[whole], tb.mix(values[whole]))
    edge = np.zeros(len(rows) + 1, np.int64)
    np.add.at(edge, whole[twice], 1)
    np.add.at(edge, whole[twice] + width, -1)
    return np.bincount(rows[np.cumsum(edge)[:-1] > 0], minlength=t.n)


MEASURES: dict[str, Callable[[Texts], np.ndarray]] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": lambda t: t.by_row(SYMBOL[t.data]),
    "n_lines": n_lines,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
    "n_upper": lambda t: t.by_row(UPPER[t.data]),
    "n_lower": lambda t: t.by_row(LOWER[t.data]),
    "n_digits": lambda t: t.by_row(DIGIT[t.data]),
    "n_shouts": lambda t: t.by_row(t.data == ord("!")),
    "longest_word": longest_word,
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps a dict of the named measures (one number per row) to one flag per row."""

    name: str
    measures: tuple[str, ...]
    rejects: Callable[[dict[str, np.ndarray]], np.ndarray]


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < 50),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_symbols", "n_words"), lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("short_words", ("word_chars", "n_words"), lambda m: m["word_chars"] < 3 * m["n_words"]),
    Rule("long_words", ("word_chars", "n_words"), lambda m: m["word_chars"] > 12 * m["n_words"]),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("capitals", ("n_upper", "n_lower"), lambda m: m["n_upper"] > m["n_lower"]),
    Rule("digits", ("n_digits", "word_chars"), lambda m: 2 * m["n_digits"] > m["word_chars"]),
    Rule("shouting", ("n_shouts", "n_words"), lambda m: 2 * m["n_shouts"] > m["n_words"]),
    Rule("endless_word", ("longest_word",), lambda m: m["longest_word"] > 1000),
)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """(rows of key and text, the texts) in bounded blocks."""
    for batch in batches:
        data, offsets = tb.utf8(batch.column(1))
        for lo, hi in tb.blocks(offsets):
            yield batch.slice(lo, hi - lo), Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


@dataclass(frozen=True)
class Estimate:
    """What a sample says: nanoseconds each measure took, and how many rows were rejected by each set of rules (a bit mask)."""

    cost: dict[str, int]
    masks: dict[int, int]


def pilot(docs: DataFrame, rules: Sequence[Rule], text: str = "text", rows: int = SAMPLE_ROWS, seed: int = 13) -> Estimate:
    """Costs and rejections on a random sample of about ``rows`` rows; only sums reach the driver, at most one per set of rules met."""
    present = docs.count()
    sample = docs.select(F.lit(0), F.col(f"`{text}`")).sample(min(1.0, rows / max(1, present)), seed)
    needed = tuple(dict.fromkeys(m for r in rules for m in r.measures))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches):
            spent, seen = [], {}
            for name in needed:
                fresh = texts.take(np.arange(texts.n))
                began = time.perf_counter_ns()
                seen[name] = MEASURES[name](fresh)
                spent.append(time.perf_counter_ns() - began)
            mask = np.zeros(texts.n, np.int64)
            for i, rule in enumerate(rules):
                mask |= rule.rejects(seen).astype(np.int64) << i
            found, often = np.unique(mask, return_counts=True)
            which = [*range(len(needed)), *found.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([True] * len(needed) + [False] * len(found)), pa.array(which, pa.int64()), pa.array([*spent, *often.tolist()], pa.int64())],
                ["is_cost", "which", "amount"],
            )

    sums = sample.mapInArrow(scan, "is_cost boolean, which long, amount long").groupBy("is_cost", "which").agg(F.sum("amount").alias("amount")).collect()
    cost = {needed[r["which"]]: r["amount"] for r in sums if r["is_cost"]}
    return Estimate({m: max(1, cost.get(m, 1)) for m in needed}, {r["which"]: r["amount"] for r in sums if not r["is_cost"]})


def ordered(rules: Sequence[Rule], seen: Estimate, free: Sequence[str] = ()) -> list[Rule]:
    """Rules by new rejections per new cost, the best first; of equal ones the cheaper, then the earlier in ``rules``."""
    open_, taken, left, out = list(range(len(rules))), set(free), dict(seen.masks), []

    def merit(i: int) -> tuple[float, float, int]:
        cost = 1 + sum(seen.cost[m] for m in rules[i].measures if m not in taken)
        return sum(n for mask, n in left.items() if mask >> i & 1) / cost, -cost, -i

    while open_:
        best = max(open_, key=merit)
        open_.remove(best)
        out.append(rules[best])
        taken.update(rules[best].measures)
        left = {mask: n for mask, n in left.items() if not mask >> best & 1}
    return out


def judge(texts: Texts, order: Sequence[Rule], always: Sequence[str] = ()) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Measures in ``always`` of every row, the index in ``order`` of the first rule that rejects it (-1: none), and how many rules judged it."""
    known = {m: MEASURES[m](texts) for m in always}
    first, judged = np.full(texts.n, -1), np.zeros(texts.n, np.int64)
    rows, part, held = np.arange(texts.n), texts, dict(known)
    for i, rule in enumerate(order):
        if not len(rows):
            break
        for m in rule.measures:
            if m not in held:
                held[m] = MEASURES[m](part)
        judged[rows] += 1
        out = rule.rejects(held)
        if out.any():
            first[rows[out]] = i
            stay = np.flatnonzero(~out)
            rows, part = rows[stay], part.take(stay)
            held = {m: v[stay] for m, v in held.items()}
    return known, first, judged


def cascade(
    docs: DataFrame, rules: Sequence[Rule] = RULES, always: Sequence[str] = (), sample_rows: int = SAMPLE_ROWS,
    key: str = "doc_id", text: str = "text", order: Sequence[Rule] | None = None,
) -> DataFrame:
    """One row per document: key, the measures in ``always`` (long), ``kept``, ``rejected_by`` (NULL if kept) and ``n_judged``.

    A document is kept if no rule rejects it. ``rejected_by`` is the first rule in the order found on the sample and ``n_judged`` the
    number of rules that looked at it, so both may change from run to run; nothing else does. Measures in ``always`` are taken of
    every document, all others only as long as it is in the cascade. Words are runs without ASCII white space; NULL counts as empty,
    and empty texts have 0 of everything. Repeated rows and rows with equal or NULL keys are judged one by one; other columns are left out.
    """
    order = ordered(rules, pilot(docs, rules, text, sample_rows), always) if order is None else list(order)
    names = pa.array([*[r.name for r in order], None], pa.string())
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            known, first, judged = judge(texts, order, always)
            own = [pa.array(known[m], pa.int64()) for m in always]
            by = names.take(pa.array(np.where(first < 0, len(order), first)))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *own, pa.array(first < 0), by, pa.array(judged, pa.int64())], [key, *always, "kept", "rejected_by", "n_judged"]
            )

    measured = "".join(f", {m} long" for m in always)
    return docs.select(docs[f"`{key}`"], docs[f"`{text}`"]).mapInArrow(scan, f"`{key}` {kind}{measured}, kept boolean, rejected_by string, n_judged long")
