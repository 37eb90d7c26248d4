import pytest

from arealens.llm import decontam
from tests.llm import helpers as H

ITEMS = [
    (1, "A train leaves at noon and travels 120 km in 3 hours toward the old harbour with Alice Brown, while another follows 120 km behind."),
    (2, "What is the capital of the small island country that lies north of the great southern ocean and west of nothing?"),
    (3, "Too short to judge."),
    (4, None),
    (5, "A train leaves at noon and travels 99 km in 7 hours toward the old harbour with Bob Green, while another follows 99 km behind."),
    (None, "an item that has no key but does have more than enough plain words to fill some windows of it"),
    (7, "only nine little plain words stand here in order"),
]
FRONT, BACK = "Some words of the page that come before. ", " And other words that come after it."
DOCS = [
    (10, FRONT + ITEMS[0][1] + BACK),
    (11, FRONT + ITEMS[0][1].replace("120", "450").replace("3 hours", "9 hours").replace("Alice Brown", "Carol White") + BACK),
    (12, FRONT + ITEMS[0][1].replace("120", "450", 1).replace("3 hours", "9 hours") + BACK),  # 120 stands for 450 and for 120
    (13, FRONT + ITEMS[1][1].upper() + BACK),
    (14, FRONT + " ".join(ITEMS[1][1].split()[:14]) + BACK),
    (15, FRONT + " ".join(ITEMS[1][1].split()[:12]) + BACK),
    (16, "Too short to judge. " * 3),
    (17, None), (18, ""), (None, ITEMS[1][1]), (None, "clean text without a key that is long enough to have its own windows"),
    (19, "an item that has no key but does have more than enough plain words to fill some windows of it"),
    (20, FRONT + ITEMS[6][1] + BACK), (20, FRONT + ITEMS[6][1] + BACK), (21, "only nine little plain words stand here"),
    (22, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25"),
    (23, (ITEMS[1][1] + " ") * 40),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in DOCS], H.SCHEMA).repartition(3)
    return H.with_clashes(docs).drop("item"), spark.createDataFrame(ITEMS, "item_id long, text string")


def test_leaks_and_their_kinds(tables):
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(*tables).collect()}
    assert set(got) == {(10, 1), (11, 1), (14, 2), (None, 2), (20, 7), (23, 2)}
    assert got[10, 1].kind == "verbatim" and got[10, 1].n_changed == 0 and got[10, 1].n_slots == 7
    assert got[11, 1].kind == "reparameterised" and got[11, 1].n_changed == 4
    assert got[14, 2].kind == "verbatim" and got[14, 2].n_tokens == 14
    assert got[20, 7].n_tokens == got[20, 7].item_tokens == 9


def test_dropping_leaves_clean_rows_alone(tables):
    docs, benchmark = tables
    left = sorted((r.doc_id is not None, r.doc_id or 0) for r in decontam.drop_contaminated(docs, benchmark).collect())
    gone = {10, 11, 14, 20, 23}
    assert left == sorted([(True, i) for i, _ in DOCS if i is not None and i not in gone] + [(False, 0)])


def test_empty_tables(spark, tables):
    docs, benchmark = tables
    none = benchmark.filter("false")
    assert decontam.contaminated(docs, none).count() == 0
    assert decontam.drop_contaminated(docs, none).count() == len(DOCS)
    assert decontam.contaminated(docs.filter("false"), benchmark).count() == 0


def test_no_python_in_the_plan(tables):
    plan = decontam.contaminated(*tables)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def kinds(spark, items, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id): r.kind for r in found.collect()}


def test_every_item_of_a_template_is_judged_by_its_own_values(spark):
    text = "a basket holds {} apples and the other one on the table holds {} pears so how many pieces of fruit are there"
    items = [(1, text.format(2, 2)), (2, text.format(3, 5)), (3, text.format(4, 7))]
    got = kinds(spark, items, [FRONT + text.format(3, 5) + BACK, FRONT + text.format(4, 7) + BACK, FRONT + ITEMS[4][1] + BACK])
    assert got == {(0, 2): "verbatim", (1, 3): "verbatim"}
    assert kinds(spark, [i for i in ITEMS if i[0] in (1, 5)], [FRONT + ITEMS[4][1] + BACK]) == {(0, 5): "verbatim"}


def test_copies_in_lower_case_and_with_other_line_breaks(spark):
    text = "One morning the baker Anna Lee sold 12 loaves to her friend Bob Cole, then gave 3 hours to Carla and the rest to Dan, who met Eve at noon."
    wrapped = text.replace(" Anna", "\nAnna").replace(" Cole", "\n  Cole").replace(" Carla", "\r\nCarla").replace("3 hours", "3\nhours")
    assert kinds(spark, [(1, text)], [FRONT + text.lower() + BACK, FRONT + wrapped + BACK]) == {(0, 1): "verbatim", (1, 1): "verbatim"}
    assert kinds(spark, [(1, wrapped)], [FRONT + text + BACK, text.replace("Carla", "Gina")]) == {(0, 1): "verbatim", (1, 1): "reparameterised"}


def test_copies_rich_in_numbers_and_names(spark):
    sums = "Compute 12 + 7 * 3 - 4 / 2 and give 5 digits of 9 times 8 plus 6 minus 1."
    german = "Im Garten hinter dem Haus stehen Birnen, Pflaumen, Kirschen, Quitten, Nelken, Rosen, Tulpen, Astern, Dahlien, Lilien, Farne, Moose, Gras."
    row = "2019 12 31 4.5 6.7 8.9 10 11 12 13 14 15 16 17"
    other = "".join(str((int(c) + 3) % 10) if c.isdigit() else c for c in sums)
    texts = [FRONT + t + BACK for t in (sums, german, row, other, row.replace("6.7", "7.6").replace("12 13", "1 2"))]
    assert kinds(spark, [(1, sums), (2, german), (3, row)], texts) == {(i, i + 1): "verbatim" for i in range(3)}


def test_long_copy_with_one_repeated_number_changed(spark):
    text = ITEMS[0][1] + " nobody on the platform knew whether the two of them would ever meet again before the long winter came down"
    texts = [FRONT + text.replace("120", "121", 1) + BACK, FRONT + text + BACK, FRONT + text.replace("120", "121") + BACK]
    assert kinds(spark, [(1, text)], texts) == {(0, 1): "altered", (1, 1): "verbatim", (2, 1): "reparameterised"}


def test_long_runs_of_names_and_numbers(spark):
    n, text = 20_000, ITEMS[0][1]
    numbers = ",".join(str(i) for i in range(n))
    runs = ["It was " + "Von " * n, "IT WAS " * n, "Rows " + numbers, "1." * n + "5", " ".join(map(str, range(n))), "a B " * n, "3 Km 4 km " * n]
    items = [(1, text), (2, "seven plain words lead up to the row " + numbers + " and seven plain words come at the end of it")]
    texts = [t for run in runs for t in (run, run.strip() + " - " + FRONT + text + BACK)] + [items[1][1]]
    assert kinds(spark, items, texts) == {(i, 1): "verbatim" for i in range(1, 14, 2)} | {(14, 2): "verbatim"}
    marks = spark.createDataFrame([(runs[0],), (runs[2],)], "text string").select(decontam.marked(decontam.F.col("text")).alias("mark"))
    assert [r.mark for r in marks.collect()] == ["It was \x01" + runs[0][7:-1] + "\x01 ", "Rows \x02" + numbers + "\x02"]


def test_documents_met_beyond_the_broadcast_bound(tables, monkeypatch):
    want = sorted(map(str, decontam.contaminated(*tables).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_DOCUMENTS", 0)
    assert sorted(map(str, decontam.contaminated(*tables).collect())) == want
