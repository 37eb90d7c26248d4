"""Small tables with the awkward cases every operator has to take."""

import random

WORDS = "ab cd ef gh ij kl mn op qr st uv wx yz".split()


def awkward(seed=1, n=40, words=60):
    """(doc_id, text, lang, source, n_chars) rows: copies, near copies, NULLs, empty, blank and long texts, repeated rows."""
    rng = random.Random(seed)
    make = lambda k: " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 60)}" for _ in range(k))
    rows = []
    for i in range(n):
        text = make(rng.randint(1, words))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "b", None]), len(text)))
    base = make(120)
    for i in range(n, n + 6):
        own = base.split()
        own[rng.randrange(120)] = f"changed{i}"
        rows.append((i, " ".join(own) + ("" if i % 2 else " \n"), "en", "hot", 1))
    passage = make(50)
    rows += [(n + 10 + i, make(5) + " " + passage + " " + make(5), "en", "b", 0) for i in range(4)]
    rows += [(n + 20, base, "en", "hot", 3), (n + 20, base, "en", "hot", 3)]
    rows += [(n + 21, "", "en", "hot", 0), (n + 22, None, None, None, None), (n + 23, " \t\n ", "en", "hot", 4)]
    rows += [(None, base + " tail", "en", "hot", 5), (None, None, "en", "hot", None)]
    rows += [(n + 30, "é " * 900 + make(30), "fr", "hot", 9), (n + 31, ("x" * 50 + " ") * 60, "en", "hot", 9)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "_id _sum _text _part _key score keep spans n_words node component kept bucket batch _in0 mix_rate item".split()


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("mine") for c in CLASHES})


def components(sets, linked):
    """Least reachable index of each set under the relation ``linked``."""
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]
