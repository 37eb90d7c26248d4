"""License notices in text: exact phrases, and short notices with spelling errors.

Each notice that may hold ``e`` errors is cut into ``e + 1`` pieces: whatever ``e`` errors do, one piece stays exact
(pigeonhole). Exact search for the pieces gives candidate places; the regex library's bounded-error matching then looks at a
window around each and reports span and errors.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from arealens.llm import textbatch as tb

# Phrases that must stand word by word, and the label of each.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Notice:
    """Words of a short notice joined by blanks, its label, and the errors it may hold."""

    words: str
    label: str
    errors: int


NOTICES = (
    Notice("gnu general public license", "gpl", 3),
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("gnu affero general public license", "agpl", 3),
    Notice("apache license version 2 0", "apache", 3),
    Notice("licensed under the apache license", "apache", 3),
    Notice("creative commons attribution", "cc-by", 3),
    Notice("creative commons zero", "cc0", 2),
    Notice("mozilla public license", "mpl", 2),
    Notice("released under the mit license", "mit", 3),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("bsd 3 clause license", "bsd", 2),
    Notice("eclipse public license", "epl", 2),
    Notice("spdx license identifier", "spdx", 2),
    Notice("all rights reserved", "all-rights-reserved", 2),
)

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
PLAIN = bytes(int(tb.LOWER[b]) if WORD[b] else 0x20 for b in range(256))


def pieces(words: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 stretches of near equal length that together are the whole notice, with their starts."""
    cuts = [round(i * len(words) / (errors + 1)) for i in range(errors + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


@cache
def compiled(notices: tuple[Notice, ...]):
    """Per notice: its pieces as bytes and the bounded-error pattern, which must begin and end at words."""
    return [
        (n, [(a, p.encode()) for a, p in pieces(n.words, n.errors)],
         regex.compile(rf"(?<![^ ])(?:{regex.escape(n.words, literal_spaces=True)}){{e<={n.errors}}}(?![^ ])", regex.BESTMATCH))
        for n in notices
    ]


def best_matches(pattern, text: str, windows: list[tuple[int, int]]) -> list:
    """Matches that do not overlap, in order: the best of all, then again the best of what its neighbours leave free.

    Every match lies in one of ``windows``, so each is searched by itself; one is searched again only where a better match has taken a part
    of it. The work grows with the number of windows, not with its square.
    """
    taken, heap, found, turn = [], [], [], itertools.count()

    def search(a: int, b: int) -> None:
        m = pattern.search(text, a, b) if a < b else None
        if m is not None and m.end() > m.start():
            heapq.heappush(heap, (sum(m.fuzzy_counts), m.start(), m.end(), a, b, next(turn), m))

    for a, b in windows:
        search(a, b)
    while heap:
        *_, start, end, a, b, _, m = heapq.heappop(heap)
        i = bisect.bisect(taken, (start, end))
        # taken stretches that this match would overlap
        near = [x for x in taken[max(0, i - 1) : i + 2] if x[0] < end and start < x[1]]
        if not near:
            bisect.insort(taken, (start, end))
            found.append(m)
            near = [(start, end)]
        for x, y in zip([a, *[e for _, e in near]], [*[s for s, _ in near], b]):
            search(x, y)
    return sorted(found, key=lambda m: m.start())


def near_notices(text: bytes, notices: tuple[Notice, ...]) -> list[tuple[str, int, int, int, int]]:
    """(label, first word, words, errors, length of the notice) of every notice found in blank-joined lower-case words."""
    found, part, blanks = [], None, None
    for notice, seeds, pattern in compiled(notices):
        reach = len(notice.words.encode()) + 2 * notice.errors + 1
        windows = set()
        for start, seed in seeds:
            at = text.find(seed)
            while at >= 0:
                # whole words on either side
                a, b = max(0, at - start - notice.errors - 1), at - start + reach
                end = text.find(b" ", b)
                windows.add((text.rfind(b" ", 0, a) + 1, end if end >= 0 else len(text)))
                at = text.find(seed, at + 1)
        if not windows:
            continue
        if part is None:
            part = text.decode()
            blanks = np.flatnonzero(np.frombuffer(part.encode("utf-32-le"), np.uint32) == 0x20)
        # places in characters, counted once from edge to edge
        edges = sorted({x for w in windows for x in w})
        sizes = edges if text.isascii() else np.cumsum([len(text[x:y].decode()) for x, y in zip([0, *edges], edges)]).tolist()
        place = dict(zip(edges, sizes))
        for m in best_matches(pattern, part, sorted((place[a], place[b]) for a, b in windows)):
            if m[0].strip():
                lead = len(m[0]) - len(m[0].lstrip(" "))
                first = int(np.searchsorted(blanks, m.start() + lead))
                found.append((notice.label, first, len(m[0].split()), sum(m.fuzzy_counts), len(notice.words)))
    return found


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " spans array<struct<label:string,first_word:long,n_words:long,errors:long>>"
)


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] | None = None, notices: tuple[Notice, ...] = NOTICES,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: key, n_words, places of exact phrases, labels, score and the spans of near notices.

    Words are runs of digits, letters and non-ASCII characters, lower-cased in A-Z. ``score`` is 1 with an exact phrase, else
    the best 1 - errors / length of a near notice, else 0. ``labels`` are those of exact phrases and near notices. NULL and
    empty texts have no words, empty labels and score 0. Whole texts are scanned; nothing is shuffled.
    """
    phrases = PHRASES if phrases is None else phrases
    kind = docs.schema[key].dataType.simpleString()
    targets = []
    for phrase, label in phrases.items():
        data, offsets = tb.utf8(pa.array([phrase]))
        starts, ends, _ = tb.word_spans(data, offsets, WORD[data])
        targets.append((label, tb.word_hashes(data, starts, ends)))

    def one_block(data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        data = tb.LOWER[data]
        starts, ends, rows = tb.word_spans(data, offsets, WORD[data])
        hashes = tb.word_hashes(data, starts, ends)
        cut = tb.row_starts(rows, len(offsets) - 1)
        places: dict[int, list[tuple[int, str]]] = {}
        for label, target in targets:
            n = len(hashes) - len(target) + 1
            hit = np.ones(max(0, n), bool)
            for j, h in enumerate(target):
                hit &= hashes[j : j + n] == h
            at = np.flatnonzero(hit)
            for i, row in zip(at[rows[at] == rows[at + len(target) - 1]].tolist(), rows[at].tolist()) if len(at) else ():
                places.setdefault(row, []).append((i - int(cut[row]), label))
        plain = data.tobytes().translate(PLAIN)
        out = []
        for row in range(len(offsets) - 1):
            base = places.get(row, [])
            body = b" ".join(plain[offsets[row] : offsets[row + 1]].split())
            near = near_notices(body, notices)
            own = sorted({label for _, label in base})
            score = 1.0 if base else max([1 - e / n for _, _, _, e, n in near], default=0.0)
            first = [i for i, _ in base]
            out.append((
                int(cut[row + 1] - cut[row]), len(base), min(first, default=None), max(first, default=None), ",".join(own),
                ",".join(sorted({*own, *[f[0] for f in near]})), score,
                [dict(zip(("label", "first_word", "n_words", "errors"), f)) for f in near],
            ))
        return out

    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("errors", pa.int64())])
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.utf8(batch.column(1))
            for lo, hi in tb.blocks(offsets):
                rows = one_block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], [key, *names])

    return docs.select(docs[f"`{key}`"], docs[f"`{text}`"]).mapInArrow(scan, f"`{key}` {kind}, {SCHEMA}")
