"""The registered queries of the training-data operators, and the SQL twins of those that SQL can express.

Each is a thin layer over its operator: whole tables in, whole results out, digests derived where a contract asks for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from arealens.llm import bags, decontam, laesa, licenses, minhash, mixing, quality, rules, substring, suffix, syncmers, tokens, warc
from arealens.session import scratch_path

TOKENIZER_FOLDER = "/opt/tokenizers"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_five = ", ".join(
    f"('0x' || substr(hex, {1 + 5 * i}, 5))::BIGINT AS v{i}" for i in range(8)
)
_letters = " || ".join(
    f"substr('{BASE32}', 1 + (v{i} >> {shift} & 31)::INTEGER, 1)" for i in range(8) for shift in (15, 10, 5, 0)
)
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p),
v AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS last, {_five} FROM h)
SELECT page_id, payload_bytes, {_letters} AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM v
"""


@query("op3_warc_salvage", WARC_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written to archives and read back by the salvage reader."""
    found = warc.round_trip(table(spark, folder, "pages"))
    page = lambda c: F.regexp_extract(c, "urn:x-page:(-?[0-9]+)", 1).try_cast("bigint")
    return found.filter("kind = 'record'").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


@query("op6_token_rollup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after a load, a revision and a withdrawal, with deliveries that repeat."""
    tokenizers = {"byte_bpe_50k": f"{TOKENIZER_FOLDER}/byte_bpe_50k.tiktoken", "words": tokens.WORDS}
    store = tokens.maintain(table(spark, folder, "documents"), scratch_path(spark, "token-rollup"), tokenizers)
    return store.totals()


@query("op8_license_scan")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Exact phrases and near notices of every document."""
    return licenses.scan_licenses(table(spark, folder, "documents"))


MIX_SEED = "mix-1"
MIX_SQL = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
t AS (SELECT sum(n_docs)::DOUBLE AS total, count(*)::DOUBLE AS sources FROM n),
r AS (SELECT source, (1.0::DOUBLE / sources) * total / n_docs AS rate FROM n, t),
steps AS (
  SELECT source, rate, 0 AS k, -rate AS log_term, exp(-rate) AS cdf FROM r
  UNION ALL
  SELECT source, rate, k + 1, log_term + ln(rate) - ln((k + 1)::DOUBLE), cdf + exp(log_term + ln(rate) - ln((k + 1)::DOUBLE))
  FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 20)
),
u AS (
  SELECT *, (('0x' || substr(md5(concat_ws('|', '{MIX_SEED}', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 12))::BIGINT
             + 0.5::DOUBLE) / pow(16, 12) AS u
  FROM documents
),
c AS (
  SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, s.rate AS mix_rate, count(*) FILTER (s.cdf <= u.u) AS copies
  FROM u JOIN steps s ON u.source IS NOT DISTINCT FROM s.source GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, round(mix_rate, 9) AS mix_rate, copies::INTEGER AS mix_copies, copy::INTEGER AS mix_copy,
       md5(concat_ws('|', '{MIX_SEED}', coalesce(doc_id::VARCHAR, ''), copy::VARCHAR)) AS mix_order
FROM c, unnest(range(1, copies + 1)) AS x(copy)
"""


@query("op9_poisson_mix", MIX_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Every source at equal weight, as many rows as there are documents in the mean."""
    return mixing.poisson_mix(table(spark, folder, "documents"), seed=MIX_SEED).withColumn("mix_rate", F.round("mix_rate", 9))


@query("op10_syncmer_fingerprint")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return syncmers.edit_resilience(table(spark, folder, "documents"))


WINDOW_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, len(words) AS n, unnest(range(1, len(words) - 11)) AS i FROM w),
h AS (SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS s FROM p),
m AS (SELECT s, min(doc_id) AS first FROM h GROUP BY s),
r AS (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM h JOIN m USING (s) WHERE doc_id > first),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM r GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(words, lambda x, k: NOT coalesce(list_contains(gone, k), false)), ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""


@query("op2_substring_dedup", WINDOW_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 13 words that start in an earlier document, removed."""
    cut = substring.remove_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
),
p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS near FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.near),
k AS (SELECT doc_id, min(near) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN k ON k.doc_id = w.doc_id
"""


@query("op7_superminhash", NEAR_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return minhash.near_duplicates(table(spark, folder, "documents"))


def _template_sql(source: str, key: str, out: str) -> str:
    """raw (values in marks) and tokens (marks alone) of a table, as ``decontam.marked`` and ``decontam.template`` make them."""
    mark = {m: f"chr({ord(m)})" for m in (decontam.NAME, decontam.NUMBER, decontam.UNIT)}
    text = "coalesce(text, '')"
    for m in mark.values():
        text = f"replace({text}, {m}, '')"
    name, number, unit = mark.values()
    text = f"regexp_replace({text}, '{decontam.NAME_RUN}', '\\1' || {name} || '\\2' || {name}, 'g')"
    text = f"regexp_replace({text}, '{decontam.NUMBER_RUN}', {number} || '\\1' || {number}, 'g')"
    units = decontam.UNIT_RUN.replace(decontam.NUMBER, "\\x02")
    text = f"regexp_replace({text}, '{units}', '\\1' || {unit} || '\\2' || {unit}, 'g')"
    plain = "mark"
    for i, m in enumerate(mark.values(), 1):
        plain = f"regexp_replace({plain}, '\\x0{i}[^\\x0{i}]*\\x0{i}', {m} || ' ', 'g')"
    return f"""
{out}m AS (SELECT {key} AS id, text, {text} AS mark FROM {source}),
{out} AS MATERIALIZED (SELECT id, md5(coalesce(text, '')) AS h, regexp_extract_all(mark, '{decontam.RAW_TOKEN}') AS raw,
  regexp_extract_all(lower({plain}), '{decontam.TOKEN}') AS tokens FROM {out}m)"""


_W = decontam.WIDTH
LEAK_SQL = f"""
WITH {_template_sql('(SELECT DISTINCT doc_id, text FROM documents)', 'doc_id', 'd')},
{_template_sql('benchmark', 'item_id', 'b')},
i AS MATERIALIZED (SELECT tokens, min(id) AS item, arg_min(raw, id) AS raw FROM b WHERE id IS NOT NULL AND len(tokens) >= {_W} GROUP BY tokens),
ip AS (SELECT item, tokens, unnest(range(0, len(tokens) - {_W - 1})) AS ip FROM i),
iw AS (SELECT item, ip, array_to_string(tokens[ip + 1 : ip + {_W}], ' ') AS w FROM ip
       WHERE len(list_filter(tokens[ip + 1 : ip + {_W}], lambda t: t > chr(4))) >= {decontam.LITERALS}),
dp AS (SELECT id, h, tokens, unnest(range(0, len(tokens) - {_W - 1})) AS p FROM d WHERE len(tokens) >= {_W}),
dw AS (SELECT id, h, p, array_to_string(tokens[p + 1 : p + {_W}], ' ') AS w FROM dp),
m AS MATERIALIZED (SELECT DISTINCT id, h, item, p - ip AS shift, ip FROM dw JOIN iw USING (w)),
c AS MATERIALIZED (SELECT DISTINCT id, h, item, shift, unnest(range(ip, ip + {_W})) AS at FROM m),
g AS (SELECT id, h, item, shift, count(*) AS n_tokens FROM c GROUP BY ALL),
f AS MATERIALIZED (SELECT g.*, len(i.tokens) AS item_tokens FROM g JOIN i USING (item) WHERE n_tokens >= least({decontam.LEAST}, len(i.tokens))),
s AS (SELECT f.id, f.h, f.item, f.shift, lower(i.raw[c.at + 1]) AS own, lower(d.raw[c.at + 1 + f.shift]) AS other
      FROM f JOIN c USING (id, h, item, shift) JOIN i USING (item) JOIN d USING (id, h) WHERE i.raw[c.at + 1] < chr(4)),
k AS (SELECT id, h, item, shift, count(*) AS n_slots, count(*) FILTER (own <> other) AS n_changed,
             count(DISTINCT own || other) = count(DISTINCT own) AS consistent FROM s GROUP BY ALL),
j AS (SELECT f.*, coalesce(n_slots, 0) AS n_slots, coalesce(n_changed, 0) AS n_changed FROM f LEFT JOIN k USING (id, h, item, shift)
      WHERE coalesce(consistent, true)),
r AS (SELECT *, row_number() OVER (PARTITION BY id, item ORDER BY n_tokens DESC, n_changed, n_slots DESC) AS nth FROM j)
SELECT id AS doc_id, item AS item_id, CASE WHEN n_changed = 0 THEN 'verbatim' ELSE 'reparameterised' END AS kind,
       n_tokens::BIGINT AS n_tokens, item_tokens::BIGINT AS item_tokens, n_slots::BIGINT AS n_slots, n_changed::BIGINT AS n_changed FROM r WHERE nth = 1
"""


@query("op5_template_decontam", LEAK_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or with other numbers and names."""
    return decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _byte_runs(length: int, out: str) -> str:
    """doc_id, a, b: maximal runs of bytes (in hex, from 1) under strings of ``length`` bytes that stand at two places."""
    return f"""
{out}h AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, {2 * length})) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - {length - 1})) AS i FROM d)),
{out}f AS (SELECT doc_id, i FROM {out}h SEMI JOIN (SELECT s FROM {out}h GROUP BY s HAVING count(*) > 1) USING (s)),
{out}g AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {length} THEN 0 ELSE 1 END AS new FROM {out}f),
{out}n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM {out}g),
{out} AS (SELECT doc_id, run, min(i) AS a, max(i) + {length} AS b FROM {out}n GROUP BY ALL)"""


BYTES_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),{_byte_runs(suffix.LENGTH, "r")},{_byte_runs(suffix.PASSAGE, "q")},
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM r),
t AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS e,
         string_agg(substr(x, (2 * z + 1)::BIGINT, (2 * (a - z))::BIGINT), '' ORDER BY a) AS body
  FROM k JOIN d USING (doc_id) GROUP BY doc_id
),
p AS (SELECT doc_id, sum(b - a)::BIGINT AS n_passage_bytes FROM q GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(body || substr(x, (2 * e + 1)::BIGINT), x))) AS kept_sha256, coalesce(n_passage_bytes, 0) AS n_passage_bytes
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN p USING (doc_id)
"""


@query("op4_suffix_dedup", BYTES_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Strings of 400 bytes that occur again, removed; beside it the bytes under shorter repeated passages."""
    cut = suffix.remove_repeats(table(spark, folder, "documents"), seed=suffix.TWO_LENGTHS_SEED, short=suffix.PASSAGE)
    passages = F.aggregate("short_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), passages.alias("n_passage_bytes")
    )


@query("op1_cotrained_quality")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Score and decision for every document."""
    docs = table(spark, folder, "documents")
    scored = quality.classify(docs, table(spark, folder, "labels"))
    return scored.select("doc_id", "p_content", "p_meta", "score", "keep")


RANK_SQL = r"""
WITH low AS (SELECT doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS MATERIALIZED (SELECT row_number() OVER () AS nr, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM low),
b AS MATERIALIZED (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
),
n AS (SELECT count(*) FILTER (len(terms) > 0) AS N, sum(len(terms))::BIGINT AS L FROM d),
m AS (SELECT nr, id, 100 - 25 + (25 * len(terms) * N) // L AS m FROM d, n WHERE len(terms) > 0),
f AS MATERIALIZED (SELECT nr, term, count(*) AS tf FROM (SELECT nr, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, n WHERE term IN (SELECT term FROM b) GROUP BY term, N),
i AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL),
s AS (SELECT item_id, nr, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM i JOIN w USING (term) JOIN f USING (term) JOIN m USING (nr) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id)::INTEGER AS rank, id AS doc_id, score FROM s JOIN m USING (nr) WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""


@query("op11_bag_search", RANK_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return bags.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _cluster_sql() -> str:
    """Rounds of assignment and update, one after another; vectors and centroids in long form."""
    parts = [f"""
k AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = {laesa.WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {laesa.WIDTH}),
e AS MATERIALIZED (SELECT row_number() OVER () AS nr, vec_id, v FROM k),
x AS MATERIALIZED (SELECT nr, unnest(range({laesa.WIDTH})) AS pos, unnest(v) AS x FROM e),
c0 AS MATERIALIZED (SELECT cluster, unnest(range({laesa.WIDTH})) AS pos, unnest(v) AS c FROM (
       SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, v FROM e QUALIFY cluster < {laesa.CLUSTERS}))"""]
    for i in range(laesa.ROUNDS + 1):
        parts.append(f"""
d{i} AS (SELECT nr, cluster, sum((x - c) * (x - c))::BIGINT AS distance FROM x JOIN c{i} USING (pos) GROUP BY nr, cluster),
a{i} AS MATERIALIZED (SELECT nr, cluster, distance FROM d{i} QUALIFY row_number() OVER (PARTITION BY nr ORDER BY distance, cluster) = 1)""")
        if i < laesa.ROUNDS:
            parts.append(f"""
n{i} AS (SELECT cluster, pos, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM a{i} JOIN x USING (nr) GROUP BY cluster, pos),
c{i + 1} AS MATERIALIZED (SELECT cluster, pos, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{i} LEFT JOIN n{i} USING (cluster, pos))""")
    last = laesa.ROUNDS
    return f"""
WITH {",".join(parts)},
h AS (SELECT cluster, sha256(string_agg(c::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c{last} GROUP BY cluster)
SELECT vec_id, a.cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{last} a JOIN e USING (nr) JOIN h ON h.cluster = a.cluster
"""


CLUSTER_SQL = _cluster_sql()


@query("op12_pivot_clusters", CLUSTER_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of all embeddings after five rounds."""
    found = laesa.pivot_clusters(table(spark, folder, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT row_number() OVER () AS nr, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
       list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT nr, len(words) AS n, words, unnest(range(1, len(words) - 1)) AS i FROM w),
h AS MATERIALIZED (SELECT nr, i, array_to_string(words[i : i + 2], ' ') AS s FROM p),
g AS (SELECT nr, i FROM h JOIN (SELECT nr, s FROM h GROUP BY ALL HAVING count(*) > 1) USING (nr, s)),
r AS (SELECT nr, count(DISTINCT pos) AS n_repeat_words FROM (SELECT nr, unnest(range(i, i + 3)) AS pos FROM g) GROUP BY nr),
m AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS lower,
        length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(t, '[^!]', '', 'g')) AS shouts,
        coalesce(list_max(list_transform(words, lambda x: length(x))), 0) AS longest
      FROM w LEFT JOIN r USING (nr)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR 2 * n_dup_lines > n_lines
       OR upper > lower OR 2 * digits > word_chars OR 2 * shouts > n_words OR longest > 1000) AS kept
FROM b
"""


@query("op13_rule_cascade", RULES_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of every document, and whether the cascade keeps it."""
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = rules.cascade(table(spark, folder, "documents"), always=base)
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    return judged.select("doc_id", *base, failed.alias("base_failed"), "kept")
