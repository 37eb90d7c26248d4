import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from arealens.llm import rules, textbatch as tb
from tests.llm import helpers as H

SPACE = "\x20\x09-\x0d"


def brute(text):
    text = text or ""
    words = re.findall(f"[^{SPACE}]+", text)
    triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + j for i in range(len(words) - 2) for j in range(3) if triples[tuple(words[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if re.search(f"[^{SPACE}]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(again),
        "n_upper": len(re.findall("[A-Z]", text)),
        "n_lower": len(re.findall("[a-z]", text)),
        "n_digits": len(re.findall("[0-9]", text)),
        "n_shouts": text.count("!"),
        "longest_word": max(map(len, words), default=0),
    }


def verdict(m):
    return not (
        m["n_words"] < 50 or 2 * m["n_repeat_words"] > m["n_words"] or 10 * m["n_symbols"] > m["n_words"]
        or m["word_chars"] < 3 * m["n_words"] or m["word_chars"] > 12 * m["n_words"] or 2 * m["n_dup_lines"] > m["n_lines"]
        or m["n_upper"] > m["n_lower"] or 2 * m["n_digits"] > m["word_chars"] or 2 * m["n_shouts"] > m["n_words"] or m["longest_word"] > 1000
    )


def junk(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    clean = lambda n: " ".join(word() for _ in range(n))
    texts = [clean(80) for _ in range(12)]
    texts += [" ".join(w + "!!" for w in clean(70).upper().split()), " ".join(w + "### " for w in clean(60).split())]
    texts += ["\n".join(["one line of words that comes back", clean(6)] * 20), "\n".join([clean(9)] * 3 + [clean(9) for _ in range(6)])]
    texts += ["12345 67890 " * 40 + clean(20), "é" * 1200 + " " + clean(90), "a b c " * 30, clean(2) + "\n\n \t\n" + clean(60) + "\r\n", "ñ " * 55]
    return [(2000 + i, t, "en", "hot", 1) for i, t in enumerate(texts)]


def every():
    return H.awkward(4) + junk(4)


def test_same_as_brute_force(spark):
    rows = every()
    names = tuple(rules.MEASURES)
    got = rules.cascade(H.with_clashes(H.table(spark, rows, 4)), always=names).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    have = sorted([(r.doc_id, *[r[n] for n in names], r.kept) for r in got], key=key)
    want = sorted([(r[0], *[brute(r[1])[n] for n in names], verdict(brute(r[1]))) for r in rows], key=key)
    assert have == want
    assert 5 < sum(r.kept for r in got) < len(rows) - 5
    assert all((r.rejected_by is None) == r.kept and 1 <= r.n_judged <= len(rules.RULES) for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_the_order_changes_no_verdict(spark, seed):
    order = list(rules.RULES)
    random.Random(seed).shuffle(order)
    got = rules.cascade(H.table(spark, every()), order=order).collect()
    named = {r.name: r for r in rules.RULES}
    for r in got:
        if r.rejected_by is not None:
            assert order[r.n_judged - 1] is named[r.rejected_by]
    assert Counter((r.doc_id, r.kept) for r in got) == Counter((r[0], verdict(brute(r[1]))) for r in every())


def test_parts_of_a_batch_measure_alike():
    texts = [r[1] for r in every()]
    whole = rules.Texts(*tb.utf8(pa.array(texts, pa.string())))
    whole.hashes()
    rows = np.array(sorted(random.Random(1).sample(range(len(texts)), 20)))
    part = whole.take(rows)
    for name, measure in rules.MEASURES.items():
        assert measure(part).tolist() == measure(whole)[rows].tolist() == [brute(texts[i])[name] for i in rows.tolist()]


def test_rules_that_reject_most_per_cost_come_first():
    a, b, c, d = (rules.Rule(n, (m,), None) for n, m in (("a", "dear"), ("b", "cheap"), ("c", "cheap"), ("d", "own")))
    # a rejects 90 at cost 1,000, b 10 at cost 10; d costs 20 and rejects 15, 10 of which b has rejected before
    seen = rules.Estimate({"dear": 1000, "cheap": 10, "own": 20}, {0b0001: 90, 0b1010: 10, 0b1000: 5, 0b0100: 1, 0: 50})
    assert [r.name for r in rules.ordered([a, b, c, d], seen)] == ["b", "c", "d", "a"]
    assert rules.ordered([a, b, c, d], seen, free=("dear",))[0].name == "a"


def test_what_is_rejected_is_measured_no_further(monkeypatch):
    seen = []
    monkeypatch.setitem(rules.MEASURES, "counted", lambda t: seen.append(t.n) or np.zeros(t.n, np.int64))
    order = [rules.BASE_RULES[0], rules.Rule("late", ("counted",), lambda m: m["counted"] > 0)]
    texts = rules.Texts(*tb.utf8(pa.array(["word " * 60, "short", None, "word " * 70])))
    _, first, judged = rules.judge(texts, order)
    assert seen == [2] and first.tolist() == [-1, 0, 0, -1] and judged.tolist() == [2, 1, 1, 2]


def test_pilot_counts_every_sampled_row(spark):
    rows = every()
    seen = rules.pilot(H.table(spark, rows), rules.RULES, rows=10**6)
    assert sum(seen.masks.values()) == len(rows) and all(v > 0 for v in seen.cost.values())
    assert seen.masks.get(0, 0) == sum(verdict(brute(r[1])) for r in rows)


def test_empty_table(spark):
    assert rules.cascade(H.table(spark, []), always=("n_words",)).count() == 0
