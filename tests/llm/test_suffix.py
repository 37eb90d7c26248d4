import random
from collections import Counter

import numpy as np
import pytest

from arealens.llm import suffix
from tests.llm import helpers as H


def brute(rows, length):
    bodies = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for r, b in zip(rows, bodies):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((r[0], len(b), int(gone.sum()), len(edge) // 2, kept))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def few_letters(seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcd ") for _ in range(500))
    rows = []
    for i in range(40):
        a = rng.randrange(400)
        own = "".join(rng.choice("ab") for _ in range(rng.randrange(60)))
        rows.append((i, own + base[a : a + rng.randrange(200)] + "é" * rng.randrange(3) + own[::-1], "en", "hot", 1))
    return rows


@pytest.mark.parametrize("seed, length, piece, crowd", [(1, 40, 8, 2000), (2, 40, 8, 1), (3, 25, 5, 3), (4, 100, 30, 2000)])
def test_same_as_brute_force(spark, seed, length, piece, crowd):
    rows = H.awkward(seed) + [(700 + r[0], *r[1:]) for r in few_letters(seed)]
    got = suffix.remove_repeats(H.with_clashes(H.table(spark, rows, 4)), length, piece, crowd).collect()
    have = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got]
    assert ordered(have) == ordered(brute(rows, length))


def test_production_length_with_a_hot_passage(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(450))
    rows = [(i, f"{rng.random()} " * 10 + passage + f" {rng.random()}" * 10, "en", "hot", 1) for i in range(60)]
    for crowd in (2000, 10):
        got = suffix.remove_repeats(H.table(spark, rows, 3), crowd=crowd).collect()
        assert ordered((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == ordered(brute(rows, 400))


def test_whole_characters_and_kept_columns(spark):
    rows = [(i, f"{i}" + "é" * 60 + "x" * i, "en", "hot", 1) for i in range(3)]
    got = suffix.remove_repeats(H.table(spark, rows), 21, 5, whole_characters=True, keep=("lang", "n_chars")).collect()
    for r in got:
        r.kept.decode()
        assert (r.lang, r.n_chars) == ("en", 1) and r.n_bytes - r.n_removed == len(r.kept)
    exact = {r[0]: r[2] for r in brute(rows, 21)}
    assert all(exact[r.doc_id] - 6 <= r.n_removed <= exact[r.doc_id] for r in got)


def test_repeated_starts_against_counting():
    rng = random.Random(3)
    for _ in range(80):
        length = rng.choice([1, 2, 9, 30])
        base = bytes(rng.choice(b"abc\0") for _ in range(150))
        pieces = [base[(a := rng.randrange(120)) : a + rng.randrange(60)] + bytes(rng.choice(b"ab") for _ in range(rng.randrange(20))) for _ in range(rng.randint(1, 8))]
        pieces = [p for p in pieces if len(p) >= length] or [b"a" * length]
        seen = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
        want = [[i for i in range(len(p) - length + 1) if seen[p[i : i + length]] > 1] for p in pieces]
        got, same = (starts(f, len(pieces)) for f in suffix.repeated_starts(pieces, (length, length), [len(p) for p in pieces]))
        assert got == same == want


def starts(found, n):
    """Starts by piece of runs (piece, first, how many)."""
    out = [[] for _ in range(n)]
    for piece, first, size in zip(*[x.tolist() for x in found]):
        out[piece] += range(first, first + size)
    return out


def test_starts_behind_a_piece_do_not_count():
    # the last 4 bytes of the first piece are the first of the second, and stand in the text once
    first, second = suffix.repeated_starts([b"abcdefgh", b"efghijkl", b"xxcdefyy"], (6, 4), [4, 8, 8])
    assert starts(first, 3) == [[], [], []] and starts(second, 3) == [[2], [], [2]]


@pytest.mark.parametrize("seed, length, short, piece, crowd", [(1, 40, 25, 8, 2000), (2, 60, 20, 6, 1), (3, 45, 44, 5, 3)])
def test_two_lengths_in_one_pass(spark, seed, length, short, piece, crowd):
    rows = H.awkward(seed) + [(700 + r[0], *r[1:]) for r in few_letters(seed)]
    got = suffix.remove_repeats(H.with_clashes(H.table(spark, rows, 4)), length, piece, crowd, short=short).collect()
    have = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got]
    assert ordered(have) == ordered(brute(rows, length))
    marked = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.short_spans), len(r.short_spans)) for r in got]
    assert ordered(marked) == ordered(x[:4] for x in brute(rows, short))


def test_empty_table(spark):
    assert suffix.remove_repeats(H.table(spark, [])).count() == 0


def test_crowded_anchors_make_no_row_per_window(spark):
    rng = random.Random(5)
    near = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(2)]
    rows = []
    for i in range(60):
        own = list(near[i % 2])
        own[rng.randrange(300)] = "#"
        rows.append((i, "".join(own), "en", "hot", 1))
    docs = H.table(spark, rows, 4).selectExpr("doc_id AS _id", "xxhash64(text) AS _sum", "text AS _text")
    found = suffix.repeated_windows(docs, (60, 40), 12, 1)
    many = sum(len(b) - n + 1 for _, b, *_ in rows for n in (60, 40))
    assert found.count() < many / 10
    for level, length in enumerate((60, 40)):
        seen = Counter(t[i : i + length] for _, t, *_ in rows for i in range(len(t) - length + 1))
        want = {(r[0], i) for r in rows for i in range(len(r[1]) - length + 1) if seen[r[1][i : i + length]] > 1}
        have = {(r._id, r.start + j) for r in found.filter(f"level = {level}").collect() for j in range(r.size)}
        assert have == want


def test_windows_of_crowded_anchors_in_many_batches(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BATCH_WINDOWS", 50)
    rows = H.awkward(6) + [(700 + r[0], *r[1:]) for r in few_letters(6)]
    got = suffix.remove_repeats(H.table(spark, rows, 4), 40, 8, 1).collect()
    assert ordered((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == ordered(brute(rows, 40))
