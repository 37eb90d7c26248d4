"""Benchmark decontamination by templates, with DataFrame functions only.

Text becomes a template: names, numbers and units turn into typed placeholders, other words are lower-cased. Windows of
``width`` template tokens are hashed and joined with those of the benchmark, so a question whose numbers or names were changed
still meets its original. Matches that lie on one diagonal (same offset between document and item) are counted, and the values in
their slots are compared: equal values are a verbatim copy, values replaced one for one throughout are a re-parameterised question, and
anything else is no leak.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arealens.llm.staging import stage_table

WIDTH = 8
LITERALS = 5
LEAST = 13
BROADCAST_WINDOWS = 500_000
BROADCAST_DOCUMENTS = 500_000

# Words that count as a unit right after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g gram grams kg t ton tons oz ounce ounces"
    " lb lbs pound pounds ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days"
    " week weeks month months year years cent cents dollar dollars euro euros percent degrees mph kph hz khz mhz w kw v"
).split()
# Placeholders in front of which a slot's value stands until it is cut away.
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
# A run of capitalised words inside a sentence.
NAME_RUN = r"([\p{L}\p{N},;:)] )(\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*)"
NUMBER_RUN = r"([+-]?\p{Nd}+(?:[.,]\p{Nd}+)*)"
UNIT_RUN = rf"({NUMBER} ?)({'|'.join(UNITS)})\b"
SLOT_VALUE = r"\x01[^\x01]*\x01|\x02[^\x02]*\x02|\x03[^\x03]*\x03"
MAY_HAVE_SLOTS = r"\p{Nd}|[\p{L}\p{N},;:)] \p{Lu}"
WHITE = r"[\s\p{Z}]"
# White space other than one blank in front of a name or a unit.
HIDDEN_SLOT = rf"[\p{{L}}\p{{N}},;:)](?! \p{{Lu}}){WHITE}+\p{{Lu}}|\p{{Nd}}(?! \p{{L}}){WHITE}+\p{{L}}"
RAW_TOKEN = SLOT_VALUE + r"|\p{L}+"
TOKEN = r"[\x01\x02\x03]|\p{L}+"


def unstacked(run: str) -> str:
    """The pattern of a run for Java, which takes a piece of stack per repetition of a group unless the group is possessive.

    Thousands of names or numbers in a row overflow the stack, which ends the executor. Nothing stands behind the group, so what
    matches stays the same.
    """
    return run.removesuffix(")*)") + ")*+)"


def marked(text: Column) -> Column:
    """Text with every slot value between two marks of its type. NULL counts as empty; marks already present are dropped."""
    out = F.translate(F.coalesce(text, F.lit("")), NAME + NUMBER + UNIT, "")
    out = F.regexp_replace(out, unstacked(NAME_RUN), rf"$1{NAME}$2{NAME}")
    out = F.regexp_replace(out, unstacked(NUMBER_RUN), rf"{NUMBER}$1{NUMBER}")
    return F.regexp_replace(out, UNIT_RUN, rf"$1{UNIT}$2{UNIT}")


def template(mark: Column) -> Column:
    """Tokens of the template: one mark per slot, lower-case words between."""
    out = mark
    for m in (NAME, NUMBER, UNIT):
        out = F.regexp_replace(out, f"{m}[^{m}]*{m}", f"{m} ")
    return F.regexp_extract_all(F.lower(out), F.lit(TOKEN), F.lit(0))


def spaced(text: Column) -> Column:
    """The text and, where white space other than one blank hides a name or a unit, the text with single blanks."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(HIDDEN_SLOT), F.array(text, F.regexp_replace(text, WHITE + "+", " "))).otherwise(F.array(text))


def windows(tokens: Column, width: int) -> Column:
    """Hash of every ``width`` neighbouring tokens, in order; none if there are fewer."""
    n = F.size(tokens) - F.lit(width - 1)
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(tokens, i, width)))
    return F.when(n > 0, hashes).otherwise(F.array().cast("array<bigint>"))


def exact_windows(tokens: Column, values: Column, width: int, literals: int) -> Column:
    """As ``windows``, but those with fewer than ``literals`` plain words are hashed with the values of their slots."""
    n = F.size(tokens) - F.lit(width - 1)
    poor = lambda i: F.size(F.filter(F.slice(tokens, i, width), lambda t: t > F.lit("\x04"))) < literals
    one = lambda i: F.when(poor(i), F.xxhash64(F.lit("exact"), F.slice(values, i, width))).otherwise(F.xxhash64(F.slice(tokens, i, width)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), one)).otherwise(F.array().cast("array<bigint>"))


def crowded(width: int, literals: int) -> str:
    """Pattern of marked texts that may have a window with fewer than ``literals`` plain words."""
    gap = rf"[^\p{{L}}{NAME}-{UNIT}]*+(?:\p{{L}}++[^\p{{L}}{NAME}-{UNIT}]*+){{0,{max(literals - 1, 0)}}}+"
    return rf"(?:{SLOT_VALUE})(?:{gap}(?:{SLOT_VALUE})){{{max(width - literals, 0)}}}"


def valued_tokens(mark: Column) -> Column:
    """Tokens of the template with the value of every slot; names compare without case."""
    return F.regexp_extract_all(F.lower(mark), F.lit(RAW_TOKEN), F.lit(0))


def slots(values: Column) -> Column:
    """(token position, value) of every slot."""
    placed = F.transform(values, lambda t, i: F.struct(i.alias("at"), t.alias("value")))
    return F.filter(placed, lambda p: F.substring(p["value"], 1, 1) < F.lit("\x04"))


BEST = ["consistent", "n_tokens", "item_tokens", "n_slots", "n_changed"]


def better(of: str) -> Column:
    """Order of the diagonals on which one item stands in one document."""
    return F.struct(f"{of}consistent", f"{of}n_tokens", -F.col(f"{of}n_changed"), f"{of}n_slots")


def item_forms(benchmark: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(family, tokens, values, fresh, item): every template with all the slot values its items have; of equal items the least key.

    An item has templates of its text, of the text with single blanks, and of the lower-case text, where names are plain words.
    The last has in ``fresh`` the places of the windows that the others have not, else ``fresh`` is NULL.
    """
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = F.array_distinct(F.concat(spaced(own), F.array(F.lower(own))))
    items = benchmark.select(F.col(f"`{key}`").alias("item"), F.xxhash64(own).alias("own"), F.size(spaced(own)).alias("typed"), F.posexplode(texts).alias("form", "text"))
    items = items.filter("item is not null").select("item", "own", (F.col("form") >= F.col("typed")).alias("low"), marked(F.col("text")).alias("mark"))
    items = items.select("item", "own", "low", template(F.col("mark")).alias("tokens"), valued_tokens(F.col("mark")).alias("values"))
    items = items.withColumn("hashes", windows(F.col("tokens"), width)).filter(F.size("tokens") >= width)
    typed = items.filter("not low")
    other = typed.groupBy("item", "own").agg(F.flatten(F.collect_set("hashes")).alias("others"))
    low = items.filter("low").join(other, ["item", "own"], "left")
    placed = F.transform("hashes", lambda h, i: F.when(~F.array_contains(F.coalesce("others", F.array().cast("array<bigint>")), h), i))
    low = low.withColumn("fresh", F.array_compact(placed)).filter(F.size("fresh") > 0)
    columns = ["tokens", "values", "fresh", "item"]
    items = typed.withColumn("fresh", F.lit(None).cast("array<int>")).select(columns).unionByName(low.select(columns))
    return items.groupBy(F.xxhash64("tokens").alias("family"), "tokens", "values", "fresh").agg(F.min("item").alias("item"))


def item_windows(items: DataFrame, width: int, literals: int) -> DataFrame:
    """(family, item_tokens, pos, hash, poor): windows, once for all items of one template; those poor in words once for all equal values."""
    hashes = F.posexplode(exact_windows(F.col("tokens"), F.col("values"), width, literals)).alias("pos", "hash")
    placed = items.select("family", F.size("tokens").alias("item_tokens"), "tokens", hashes)
    words = F.size(F.filter(F.slice("tokens", F.col("pos") + 1, width), lambda t: t > F.lit("\x04")))
    return placed.withColumn("poor", words < literals).drop("tokens").distinct()


def leaks(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, literals: int = LITERALS, least: int = LEAST,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(_id, _sum, item, best): one row per document text and benchmark item it leaks; see ``contaminated``."""
    items = stage_table(item_forms(benchmark, width, item_key, item_text), "benchmark-items")
    found = stage_table(item_windows(items, width, literals), "benchmark-windows").withColumnRenamed("pos", "item_pos")
    found = F.broadcast(found) if found.count() <= BROADCAST_WINDOWS else found
    own = docs.select(F.col(f"`{key}`").alias("_id"), F.xxhash64(F.col(f"`{text}`")).alias("_sum"), F.col(f"`{text}`").alias("_own"))
    forms_of = lambda rows: rows.select("_id", "_sum", F.posexplode(spaced(F.col("_own"))).alias("_form", "_text"))
    known = forms_of(own)
    # tokens are a column of their own, so that they are made once and not again for every window
    mark = F.col("_mark")
    tokens = known.select("_id", "_sum", "_form", marked(F.col("_text")).alias("_mark"))
    dense = F.when(mark.rlike(crowded(width, literals)), valued_tokens(mark))
    tokens = tokens.select("_id", "_sum", "_form", template(mark).alias("_tokens"), dense.alias("_values"))
    tokens_, values = F.col("_tokens"), F.col("_values")
    hashes = F.when(values.isNull(), windows(tokens_, width)).otherwise(exact_windows(tokens_, values, width, literals))
    hashed = tokens.select("_id", "_sum", "_form", F.posexplode(hashes).alias("pos", "hash"))
    met = hashed.join(found, "hash").withColumn("shift", F.col("pos") - F.col("item_pos"))
    spot = ["_id", "_sum", "_form", "family", "shift"]
    places = [F.collect_set(F.when(of, F.col("item_pos"))).alias(n) for n, of in (("rich", ~F.col("poor")), ("exact", F.col("poor")))]
    diagonal = met.groupBy(*spot).agg(F.max("item_tokens").alias("item_tokens"), *places)
    covered = lambda places: F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + F.lit(width - 1))))))
    bar = F.least(F.lit(least), F.col("item_tokens"))
    diagonal = stage_table(diagonal.filter(covered(F.concat("rich", "exact")) >= bar), "diagonals")
    # only documents with a diagonal are marked again, and only those with slots bring their values, not their texts
    met = stage_table(diagonal.select(F.col("_id").alias("_met"), F.col("_sum").alias("_with")).distinct(), "documents-met")
    met = F.broadcast(met) if met.count() <= BROADCAST_DOCUMENTS else met
    again = forms_of(own.join(met, own["_id"].eqNullSafe(met["_met"]) & (own["_sum"] == met["_with"]), "left_semi"))
    valued = again.filter(F.col("_text").rlike(MAY_HAVE_SLOTS)).select("_id", "_sum", "_form", slots(valued_tokens(marked(F.col("_text")))).alias("doc_slots"))
    valued = valued.dropDuplicates(["_id", "_sum", "_form"])
    same = diagonal["_id"].eqNullSafe(valued["_id"]) & (diagonal["_sum"] == valued["_sum"]) & (diagonal["_form"] == valued["_form"])
    there = F.map_from_entries(F.coalesce("doc_slots", F.array().cast("array<struct<at:int,value:string>>")))
    both = diagonal.join(valued, same, "left").select(*[diagonal[c] for c in spot], "item_tokens", "rich", "exact", there.alias("there"))
    # every item of the template is judged by its own slot values
    forms = items.select("family", "item", "fresh", slots(F.col("values")).alias("item_slots"))
    both = both.join(F.broadcast(forms) if forms.count() <= BROADCAST_WINDOWS // 10 else forms, "family")
    under = lambda places, at: F.exists(places, lambda p: (p <= at) & (at < p + F.lit(width)))
    pair = lambda s: F.struct(s["at"].alias("at"), s["value"].alias("own"), F.element_at("there", s["at"] + F.col("shift")).alias("other"))
    both = both.withColumn("pairs", F.transform("item_slots", pair)).drop("there", "item_slots")
    differs = lambda q: ~q["own"].eqNullSafe(q["other"])
    # a window poor in words counts for the items whose values stand there
    changed = lambda p: F.exists("pairs", lambda q: (p <= q["at"]) & (q["at"] < p + F.lit(width)) & differs(q))
    both = both.withColumn("places", F.concat("rich", F.filter("exact", lambda p: ~changed(p))))
    both = both.filter(F.col("fresh").isNull() | F.arrays_overlap("fresh", "places"))
    both = both.withColumn("n_tokens", covered("places")).filter(F.col("n_tokens") >= bar)
    both = both.withColumn("pairs", F.filter("pairs", lambda q: under("places", q["at"])))
    both = both.withColumn("kinds", F.array_distinct(F.transform("pairs", lambda q: F.struct(q["own"], q["other"]))))
    consistent = F.size("kinds") == F.size(F.array_distinct(F.transform("kinds", lambda p: p["own"])))
    # plain words under windows whose slots are all equal: a copy with few changes, whatever the other slots say
    both = both.withColumn("copied", F.filter("places", lambda p: ~changed(p)))
    words = covered("copied") - F.size(F.filter("pairs", lambda q: under("copied", q["at"])))
    judged = both.withColumn("consistent", consistent).filter(F.col("consistent") | (words >= bar))
    judged = judged.withColumn("n_slots", F.size("pairs")).withColumn("n_changed", F.size(F.filter("pairs", differs)))
    # of one template the item that stands there with the fewest changes, and the least key of several
    row = F.struct("item", *BEST)
    nearest = judged.groupBy(*spot).agg(F.min_by(row, F.struct(~F.col("consistent"), -F.col("n_tokens"), "n_changed", "item")).alias("b")).select("_id", "_sum", "b.*")
    return nearest.groupBy("_id", "_sum", "item").agg(F.max_by(F.struct(*BEST), better("")).alias("best"))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item_key: str = "item_id", **options) -> DataFrame:
    """One row per document and benchmark item it leaks: key, item_id, kind, tokens matched, the item's tokens, slots, changed slots.

    A leak is ``least`` template tokens of the item (all, if it has fewer) under matching windows of one diagonal whose slots are
    consistent: every value of the item stands for one value of the document throughout. ``kind`` is ``verbatim`` if all slots are
    equal, else ``reparameterised``. A diagonal with inconsistent slots is a leak of kind ``altered`` if the windows whose slots are
    all equal hold as many plain words. Items that share a template are judged one by one; of those on one diagonal the one with the
    fewest changed slots is reported, of several the least key. Windows with fewer than ``literals`` plain words count only where
    all their slot values are equal, so texts made of other numbers and names match nothing.

    Names and units are also looked up behind line breaks and wider white space, and items also with their names in lower case.
    Text in capitals is one name. A name that opens a sentence is a plain word.

    Items of fewer than ``width`` tokens, NULL and empty texts and NULL items match nothing; an empty benchmark leaks nowhere.
    Repeated rows of one document report once; rows with equal keys and different texts are judged one by one and reported
    under their key. Other columns are left out. Benchmark windows are broadcast up to ``BROADCAST_WINDOWS`` (counted), else they
    join by a shuffle on the hash that adaptive execution may split. The keys of documents with a diagonal are broadcast up to
    ``BROADCAST_DOCUMENTS`` (counted), so that texts are not shuffled to mark those documents again.
    """
    found = leaks(docs, benchmark, key=key, item_key=item_key, **options)
    found = found.groupBy("_id", "item").agg(F.max_by("best", better("best.")).alias("b"))
    return found.select(
        F.col("_id").alias(key),
        F.col("item").alias(item_key),
        F.when(~F.col("b.consistent"), "altered").when(F.col("b.n_changed") == 0, "verbatim").otherwise("reparameterised").alias("kind"),
        *[F.col(f"b.{c}").cast("long").alias(c) for c in ("n_tokens", "item_tokens", "n_slots", "n_changed")],
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that leak an item; every other row and column stays as it is."""
    found = leaks(docs, benchmark, key=key, text=text, **options).select("_id", F.col("_sum").alias("_leak")).distinct()
    same = docs[f"`{key}`"].eqNullSafe(found["_id"]) & (F.xxhash64(docs[f"`{text}`"]) == found["_leak"])
    return docs.join(found, same, "left_anti")
