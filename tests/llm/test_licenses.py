import re

from arealens.llm import licenses
from tests.llm import helpers as H

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "Released under the MIT License.", "mit license MIT\nLICENSE apache-license, CC BY 4.0; cc by-sa", "gnu general public license",
    "GNU Genral Public Licence v3", "Licensed under the Apache Lisense, Version 2.0", "", None, " .,- ", "emit licenses", "mit, (license)",
    "Permission is hereby granted, free of charge, to any persn obtaining a copy", "é cc by é", "cc", "by cc by cc by",
    "Creative Comons Attribution 4.0", "words " * 5000 + "apache license " + "words " * 5000,
    "cc by", "All rights rserved", "nothing to see",
]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base(text):
    words = WORD.findall(lower(text))
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return words, places


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", "mine") for i, t in enumerate(texts)], "doc_id long, text string, labels string, score string").repartition(3)


def test_exact_phrases_match_a_plain_search(spark):
    got = {r.doc_id: r for r in licenses.scan_licenses(rows(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        words, places = base(text)
        r, at = got[i], [p for p, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None)), text
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.score == 1) >= bool(at)


def test_misspelt_notices_are_found_with_span_and_errors(spark):
    got = {r.doc_id: r for r in licenses.scan_licenses(rows(spark, TEXTS)).collect()}
    spans = lambda i: {(s.label, s.first_word, s.n_words, s.errors) for s in got[i].spans}
    assert got[3].labels == "gpl" and ("gpl", 0, 4, 2) in spans(3) and got[3].base_labels == ""
    assert got[4].labels == "apache" and ("apache", 0, 5, 1) in spans(4)
    assert got[10].labels == "mit" and ("mit", 0, 13, 1) in spans(10)
    assert got[14].labels == "cc-by" and 0.9 < got[14].score < 1
    assert got[17].labels == "all-rights-reserved"
    assert got[18].labels == "" and got[18].score == 0 and got[18].spans == []
    assert ("mit", 0, 5, 0) in spans(0)


def test_every_edit_within_the_bound_is_found():
    import random

    rng, notice = random.Random(5), licenses.Notice("mozilla public license", "mpl", 2)
    for _ in range(200):
        body = list(notice.words)
        for _ in range(2):
            i = rng.randrange(1, len(body) - 1)
            kind = rng.choice("sid")
            if kind == "d":
                del body[i]
            elif kind == "s":
                body[i] = rng.choice("abxyz")
            else:
                body.insert(i, rng.choice("abxyz"))
        text = " ".join("front words " .split() + "".join(body).split() + ["end"])
        found = licenses.near_notices(text.encode(), (notice,))
        assert found and min(f[3] for f in found) <= 2, text


def test_nulls_and_repeats(spark):
    got = licenses.scan_licenses(H.with_clashes(H.table(spark, H.awkward()))).collect()
    assert len(got) == len(H.awkward())
    assert licenses.scan_licenses(H.table(spark, [])).count() == 0


def test_two_near_notices_in_one_window_are_both_found():
    import random

    text = "gnu genral publc license or gnu general public license"
    gpl = licenses.NOTICES[0]
    assert licenses.near_notices(text.encode(), (gpl,)) == [("gpl", 0, 4, 2, 26), ("gpl", 5, 4, 0, 26)]
    rng, words = random.Random(8), gpl.words
    for _ in range(60):
        parts, errors = [], []
        for _ in range(rng.randint(2, 4)):
            body, n = list(words), rng.randint(0, 3)
            # brute force: the places of the changed letters are known, so are spans and errors
            for at in rng.sample([i for i, c in enumerate(words) if c != " "], n):
                body[at] = "\u00e9"
            parts.append("".join(body))
            errors.append(n)
        got = licenses.near_notices(" or ".join(parts).encode(), (gpl,))
        assert [(f[1], f[2], f[3]) for f in got] == [(5 * i, 4, n) for i, n in enumerate(errors)], parts


def test_windows_give_what_a_search_of_the_whole_text_gives():
    import random

    rng = random.Random(3)
    for _ in range(40):
        notice = rng.choice(licenses.NOTICES)
        parts = []
        for _ in range(rng.randint(1, 8)):
            body = list(notice.words)
            for _ in range(rng.randint(0, notice.errors + 1)):
                body[rng.randrange(len(body))] = rng.choice("ab\u00e9 ")
            parts.append(" ".join("".join(body).split()))
            parts.append(" ".join(rng.choice(["or", "and", "x", "license", "the"]) for _ in range(rng.randint(0, 3))))
        text = " ".join(" ".join(parts).split())
        pattern = licenses.compiled((notice,))[0][2]
        whole, open_ = [], [(0, len(text))]
        while open_:
            a, b = open_.pop()
            m = pattern.search(text, a, b) if a < b else None
            if m is not None and m.end() > m.start():
                whole.append(sum(m.fuzzy_counts))
                open_ += [(a, m.start()), (m.end(), b)]
        got = licenses.near_notices(text.encode(), (notice,))
        assert len(got) == len(whole) and sorted(f[3] for f in got) == sorted(whole), text


def test_a_long_list_of_notices_takes_linear_time():
    import time

    spent = []
    for n in (500, 4000):
        text = b"all rigths reserved " * n
        began = time.process_time()
        assert len(licenses.near_notices(text.strip(), licenses.NOTICES)) == n
        spent.append(time.process_time() - began)
    assert spent[1] < 30 * spent[0]
