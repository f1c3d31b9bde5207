"""All queries of the library proper, and their SQL twins.

The notes that they work on are generated from the keys of orders (see functions.generate), so
both engines see the same texts.  Span queries return one row for each span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batch_udfs as U
from ..functions import generate as G
from ..functions import patterns as P
from ..functions import spans as S
from ..operators import deidentify as D
from ..operators import generate
from ..sources import readers

SPARK, DUCK = G.Dialect("spark"), G.Dialect("duck")
QUERIES: dict = {}
ORACLES: dict = {}


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Dealt out by key to a stated number of partitions: adaptive execution would coalesce them by
    bytes, but span work is long for few bytes and wants every core."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def _keys_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey")


def _orders(spark: SparkSession, sf_dir: str) -> str:
    _keys_of(spark, sf_dir).createOrReplaceTempView("veilspark_orders")
    return "veilspark_orders"


def notes(spark: SparkSession, sf_dir: str, distinct: bool = False) -> DataFrame:
    """id, scenario, text of the notes.  Keys alone are dealt out; each note is written where its key went.

    distinct: one note for each id, should a key stand on several orders.
    """
    keys = _keys_of(spark, sf_dir).filter("o_orderkey is not null").select(F.col("o_orderkey").cast("bigint").alias("k"))
    drawn = (keys.distinct() if distinct else keys).withColumn("draw", F.expr(SPARK.u("scenario")) % 105)
    return drawn.select(F.col("k").alias("id"), F.expr(G.scenario_sql("draw")).alias("scenario"), U.note_text(F.col("k")).alias("text"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(G.fields_sql(SPARK, _orders(spark, sf_dir)))


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ------------------------------------------------------------------ SQL building blocks (DuckDB)

NOTES = f"notes AS MATERIALIZED ({G.notes_sql(DUCK)})"
FIELDS = f"fields AS ({G.fields_sql(DUCK)})"


def _name_filter(rules: str) -> str:
    if rules == "any":
        return "true"
    if rules == "legacy":
        return " AND ".join(f"NOT contains(span_text, {_lit(w)})" for w in P.LEGACY_SKIP)
    words = r"string_split_regex(span_text, '\s+')"
    phrases = " AND ".join(f"NOT contains(lower(span_text), {_lit(p.lower())})" for p in P.FIXED_PHRASES)
    starts = ", ".join(_lit(w) for w in P.FIXED_STARTS)
    return f"({phrases}) AND len({words}) BETWEEN 2 AND 3 AND length({words}[1]) BETWEEN 2 AND 15 AND length({words}[-1]) BETWEEN 2 AND 20 AND {words}[1] NOT IN ({starts})"


def spans_cte(name: str, parts: list[tuple[str, str]], rules: dict[int, str] | None = None, src: str = "notes", key: str = "id") -> str:
    """name(id, seq, type, span_start, span_end, span_text): candidates; seq orders their emission."""
    out = []
    for k, (kind, p) in enumerate(parts):
        q = _lit(p)
        one = f"""SELECT {key}, {k} * 100000 + i AS seq, {_lit(kind)} AS type, CAST(pos - length(m) AS BIGINT) AS span_start, CAST(pos AS BIGINT) AS span_end, m AS span_text FROM (
          SELECT {key}, i, m, sum(length(g) + length(m)) OVER (PARTITION BY {key} ORDER BY i) AS pos FROM (
            SELECT {key}, unnest(mm) AS m, unnest(gg[1:len(mm)]) AS g, generate_subscripts(mm, 1) AS i FROM (
              SELECT {key}, regexp_extract_all(text, {q}) AS mm, string_split_regex(text, {q}) AS gg FROM {src})))"""
        if rules and k in rules:
            one = f"SELECT * FROM ({one}) WHERE {_name_filter(rules[k])}"
        out.append(one)
    return f"{name} AS MATERIALIZED ({' UNION ALL '.join(out)})"


RAW = spans_cte("raw", [("PERSON", P.NAME), *P.DETECTION], {0: "fixed"})
_KEEP = "STRUCT(seq BIGINT, type VARCHAR, s BIGINT, e BIGINT, t VARCHAR)[]"
RESOLVED = f"""packed AS (SELECT id, list({{'seq': CAST(seq AS BIGINT), 'type': type, 's': span_start, 'e': span_end, 't': span_text}} ORDER BY span_start, span_start - span_end, seq) AS a FROM raw GROUP BY id),
kept AS (SELECT id, list_reduce(a, lambda acc, x: CASE WHEN len(acc) = 0 OR x.s >= acc[-1].e THEN list_append(acc, x) ELSE acc END, CAST([] AS {_KEEP})) AS a FROM packed),
pred AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY u.s) AS rank, u.type AS type, u.s AS span_start, u.e AS span_end, u.t AS span_text FROM (SELECT id, unnest(a) AS u FROM kept))"""


def truth_cte(rules: str, name: str = "truth") -> str:
    parts = [*P.TRUTH[rules], ("PERSON", P.NAME)]
    return (
        spans_cte(f"{name}_raw", parts, {len(parts) - 1: rules})
        + f""", {name} AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY span_start, seq) AS rank, type, span_start, span_end, span_text
          FROM (SELECT id, type, span_start, span_end, span_text, min(seq) AS seq FROM {name}_raw GROUP BY ALL))"""
    )


_TOKEN = {
    "replace": "'[' || type || ']'",
    "mask": "CASE WHEN length(span_text) <= 2 THEN repeat('*', length(span_text)) ELSE left(span_text, 1) || repeat('*', length(span_text) - 2) || right(span_text, 1) END",
    "hash": "substr(sha256(span_text), 1, 8)",
}
_TOKEN["hybrid"] = f"CASE WHEN type IN ('PERSON', 'PHONE', 'ADDRESS') THEN {_TOKEN['replace']} WHEN type = 'DATE' THEN {_TOKEN['mask']} WHEN type = 'MEDICAID_ID' THEN {_TOKEN['hash']} ELSE span_text END"


def sanitized_cte(method: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (
      SELECT n.id, n.text, coalesce(p.head, '') || substr(n.text, coalesce(p.last, 0) + 1) AS sanitized_text FROM notes n LEFT JOIN (
        SELECT id, string_agg(substr(text, prev + 1, span_start - prev) || tok, '' ORDER BY span_start) AS head, max(span_end) AS last FROM (
          SELECT q.id, m.text, span_start, span_end, coalesce(lag(span_end) OVER (PARTITION BY q.id ORDER BY span_start), 0) AS prev, {_TOKEN[method]} AS tok
          FROM pred q JOIN notes m ON q.id = m.id) GROUP BY id) p ON n.id = p.id)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def register(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


# ------------------------------------------------------------------ generator

_FIELDS = {
    "name_variations": ["id", "name"],
    "date_variations": ["id", "dob", "d1", "d2", "d3"],
    "session_times": ["id", "session", "begin_at", "finish_at", "minutes"],
    "client_profile": ["id", "first", "last", "dob", "medicaid", "phone", "parent1", "parent2", "home"],
    "staff_profile": ["id", "staff_name", "staff_title", "staff_cred", "provider"],
    "session_places": ["id", "location", "program", "other_program"],
}
for _name, _cols in _FIELDS.items():
    _pick = ["CAST(k AS BIGINT) AS id" if c == "id" else "CAST(minutes AS BIGINT) AS minutes" if c == "minutes" else c for c in _cols]
    register(_name, _with(FIELDS) + f"SELECT {', '.join(_pick)} FROM fields")(lambda spark, sf_dir, pick=_pick: fields(spark, sf_dir).selectExpr(*pick))


@register("notes_generate", _with(NOTES) + "SELECT id, scenario, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM notes")
def notes_generate(spark, sf_dir):
    return notes(spark, sf_dir).select("id", "scenario", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


_KEYS = "(SELECT range AS o_orderkey FROM range(1, {n} + 1)) q"


@register("notes_batch", f"SELECT id, scenario, printf('note_%04d_%s.txt', id, scenario) AS filename, md5(text) AS text_md5 FROM ({G.notes_sql(DUCK, _KEYS.format(n=1000))})")
def notes_batch(spark, sf_dir):
    return generate.generate_notes(spark, 1000).select("id", "scenario", "filename", F.md5("text").alias("text_md5"))


@register("medicaid_batch", f"SELECT medicaid_id FROM (SELECT medicaid AS medicaid_id, min(k) AS k FROM ({G.fields_sql(DUCK, _KEYS.format(n=200 + 200 // 8 + 16))}) GROUP BY medicaid ORDER BY min(k) LIMIT 200)")
def medicaid_batch(spark, sf_dir):
    return generate.generate_medicaid_ids(spark, 200)


@register(
    "sample_clients",
    _with(FIELDS) + f"SELECT k AS id, first || ' ' || last AS name, born, CAST(datediff('day', born, DATE '2025-11-30') // 365 AS BIGINT) AS age, address, medicaid FROM fields ORDER BY {DUCK.u('sample')}, k LIMIT 5",
)
def sample_clients(spark, sf_dir):
    """Five clients by draw (the limit is the feature: a sample)."""
    age = F.floor(F.datediff(F.lit("2025-11-30").cast("date"), "born") / 365).cast("long")
    five = fields(spark, sf_dir).withColumn("draw", F.expr(SPARK.u("sample"))).orderBy("draw", "k").limit(5)
    return five.select(F.col("k").alias("id"), F.concat("first", F.lit(" "), "last").alias("name"), "born", age.alias("age"), "address", "medicaid")


_SCEN = ", ".join(f"({_lit(n)}, {w})" for n, w in G.SCENARIOS)


@register(
    "scenario_distribution",
    _with(FIELDS, f"s(scenario, w) AS (VALUES {_SCEN})")
    + "SELECT s.scenario, count(k) AS n, round(count(k) * 100.0 / (SELECT count(*) FROM fields), 2) AS pct FROM s LEFT JOIN fields f ON s.scenario = f.scenario GROUP BY s.scenario",
)
def scenario_distribution(spark, sf_dir):
    all_ = spark.createDataFrame([(n,) for n, _ in G.SCENARIOS], "scenario string")
    n = fields(spark, sf_dir).groupBy("scenario").agg(F.count(F.lit(1)).alias("c"))
    total = n.agg(F.sum("c").alias("total"))
    out = all_.join(n, "scenario", "left").crossJoin(F.broadcast(total)).withColumn("n", F.coalesce("c", F.lit(0)).cast("long"))
    return out.select("scenario", "n", F.round(F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("total").cast("double")), F.lit(0.0)), 2).alias("pct"))


@register("medicaid_generate", _with(FIELDS) + "SELECT DISTINCT medicaid AS medicaid_id FROM fields")
def medicaid_generate(spark, sf_dir):
    return fields(spark, sf_dir).select(F.col("medicaid").alias("medicaid_id")).distinct()


_BENT = "CASE k % 5 WHEN 0 THEN medicaid WHEN 1 THEN lower(medicaid) WHEN 2 THEN substr(medicaid, 1, 7) WHEN 3 THEN substr(medicaid, 1, 1) || '1' || substr(medicaid, 3) ELSE medicaid || '0' END"


@register("medicaid_validate", _with(FIELDS) + f"SELECT k AS id, v AS value, length(v) = 8 AND regexp_matches(v, '^([A-Z][^a-z]|[^A-Za-z][A-Z])[0-9]{{6}}$') AS valid FROM (SELECT k, {_BENT} AS v FROM fields)")
def medicaid_validate(spark, sf_dir):
    return fields(spark, sf_dir).selectExpr("k AS id", f"{_BENT} AS value").withColumn("valid", D.valid_medicaid(F.col("value")))


@register("identifier_combinations", f"SELECT CAST({len(G.FIRST)} * {len(G.LAST)} * {len(G.PARENTS)} AS BIGINT) AS combinations")
def identifier_combinations(spark, sf_dir):
    sizes = [spark.createDataFrame([(x,) for x in xs], "x string").distinct().agg(F.count(F.lit(1)).alias(f"n{i}")) for i, xs in enumerate((G.FIRST, G.LAST, G.PARENTS))]
    one = sizes[0].crossJoin(sizes[1]).crossJoin(sizes[2])  # three single rows
    return one.select((F.col("n0") * F.col("n1") * F.col("n2")).alias("combinations"))


# ------------------------------------------------------------------ detection and annotation

_SPAN_COLS = "type, span_start, span_end, span_text"


def _typed(kind: str):
    parts = [p for p in P.DETECTION if p[0] == kind]
    oracle = _with(NOTES, spans_cte("raw", parts)) + f"SELECT id, {_SPAN_COLS} FROM raw"

    def run(spark, sf_dir):
        df = notes(spark, sf_dir).withColumn("entities", U.kind_spans(F.col("text"), kind))
        return D.explode_spans(df, "id").drop("rank")

    return oracle, run


for _name, _kind in {"detect_date": "DATE", "detect_medicaid": "MEDICAID_ID", "detect_phone": "PHONE", "detect_address": "ADDRESS", "detect_credential": "CREDENTIAL"}.items():
    _oracle, _run = _typed(_kind)
    register(_name, _oracle)(_run)

for _rules in ("fixed", "legacy"):
    register(f"detect_person_{_rules}", _with(NOTES, spans_cte("raw", [("PERSON", P.NAME)], {0: _rules})) + f"SELECT id, {_SPAN_COLS} FROM raw")(
        lambda spark, sf_dir, rules=_rules: D.explode_spans(notes(spark, sf_dir).withColumn("entities", U.name_spans(F.col("text"), rules)), "id").drop("rank")
    )
    register(f"truth_{_rules}", _with(NOTES, truth_cte(_rules)) + f"SELECT id, rank, {_SPAN_COLS} FROM truth")(
        lambda spark, sf_dir, rules=_rules: D.explode_spans(D.annotate(notes(spark, sf_dir), rules), "id")
    )


_GAZ = r"\b(?:" + "|".join(sorted(set(G.FIRST) | set(G.LAST), key=lambda n: (-len(n), n))) + r")\b"


@register("detect_person_gazetteer", _with(NOTES, spans_cte("raw", [("PERSON", _GAZ)])) + f"SELECT id, {_SPAN_COLS} FROM raw")
def detect_person_gazetteer(spark, sf_dir):
    df = notes(spark, sf_dir)
    return D.explode_spans(df.withColumn("entities", U.listed_spans(F.col("text"), [*G.FIRST, *G.LAST])), "id").drop("rank")


_FLAT = r"regexp_replace(text, '[\x{C0}-\x{24F}\x{370}-\x{1FFF}\x{3040}-\x{9FFF}]', '_', 'g')"


@register(
    "person_candidates_documents",
    _with(f"flat AS (SELECT doc_id, {_FLAT} AS text FROM documents WHERE text IS NOT NULL)", spans_cte("raw", [("PERSON", P.NAME)], src="flat", key="doc_id"))
    + "SELECT r.doc_id, span_start, span_end, substr(d.text, span_start + 1, span_end - span_start) AS span_text FROM raw r JOIN documents d ON r.doc_id = d.doc_id",
)
def person_candidates_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return D.explode_spans(docs.withColumn("entities", S.find_spans(F.col("text"), P.NAME, "PERSON")), "doc_id").select("doc_id", "span_start", "span_end", "span_text")


@register("detect_all_raw", _with(NOTES, RAW) + f"SELECT id, row_number() OVER (PARTITION BY id ORDER BY seq) AS rank, {_SPAN_COLS} FROM raw")
def detect_all_raw(spark, sf_dir):
    return D.explode_spans(D.detect_raw(notes(spark, sf_dir)), "id")


@register("detect_resolved", _with(NOTES, RAW, RESOLVED) + f"SELECT id, rank, {_SPAN_COLS} FROM pred")
def detect_resolved(spark, sf_dir):
    return D.explode_spans(D.detect(notes(spark, sf_dir)), "id")


# ------------------------------------------------------------------ sanitizing

for _m in S.METHODS:
    register(f"sanitize_{_m}", _with(NOTES, RAW, RESOLVED, sanitized_cte(_m, "san")) + "SELECT id, sanitized_text FROM san")(
        lambda spark, sf_dir, m=_m: D.sanitize_detected(notes(spark, sf_dir), m).select("id", "sanitized_text")
    )

_ALL = ",\n".join(sanitized_cte(m, f"san_{m}") for m in S.METHODS) + ",\nsan AS (" + " UNION ALL ".join(f"SELECT {_lit(m)} AS method, * FROM san_{m}" for m in S.METHODS) + ")"
_RATE = """rates AS (SELECT s.method, s.id, CASE WHEN count(p.id) = 0 THEN 1.0 ELSE CAST(count(CASE WHEN NOT contains(s.sanitized_text, p.span_text) THEN 1 END) AS DOUBLE) / count(p.id) END AS rate, count(p.id) AS n
  FROM san s LEFT JOIN pred p ON s.id = p.id GROUP BY s.method, s.id)"""


@register("removal_by_doc", _with(NOTES, RAW, RESOLVED, _ALL, _RATE) + "SELECT method, id, round(rate, 4) AS removal_rate, n AS num_entities FROM rates")
def removal_by_doc(spark, sf_dir):
    return D.rate_detected(notes(spark, sf_dir)).select("method", "id", F.round("removal_rate", 4).alias("removal_rate"), F.col("num_entities").cast("long").alias("num_entities"))


@register("removal_summary", _with(NOTES, RAW, RESOLVED, _ALL, _RATE) + "SELECT method, round(avg(rate), 4) AS avg_removal_rate, count(*) AS total_documents FROM rates GROUP BY method")
def removal_summary(spark, sf_dir):
    return D.removal_summary(D.rate_detected(notes(spark, sf_dir)))


@register(
    "hash_linkage",
    _with(NOTES, RAW, RESOLVED) + "SELECT substr(sha256(span_text), 1, 8) AS token, count(DISTINCT id) AS docs FROM pred GROUP BY 1",
)
def hash_linkage(spark, sf_dir):
    """A document counts once for each of its tokens: they are told apart within it, and no id is shuffled."""
    tokens = notes(spark, sf_dir, distinct=True).select(U.hash_tokens(F.col("text")).alias("t")).select(F.explode_outer("t").alias("n")).filter("n is not null")
    return tokens.groupBy("n").agg(F.count(F.lit(1)).alias("docs")).select(F.lower(F.lpad(F.hex("n"), 8, "0")).alias("token"), "docs")


_WORDS = "SELECT method, id, unnest(regexp_extract_all(lower({c}), '[a-z0-9]+')) AS w, {x} AS x, {y} AS y FROM san"


_SIMILAR = (
    f"w AS ({_WORDS.format(c='text', x=1, y=0)} UNION ALL {_WORDS.format(c='sanitized_text', x=0, y=1)})",
    "n AS (SELECT method, id, w, sum(x) AS x, sum(y) AS y FROM w GROUP BY ALL)",
    "sim AS (SELECT method, id, round(CAST(sum(x * y) AS DOUBLE) / (sqrt(CAST(sum(x * x) AS DOUBLE)) * sqrt(CAST(sum(y * y) AS DOUBLE))), 6) AS similarity FROM n GROUP BY method, id)",
)


@register("similarity_tf", _with(NOTES, RAW, RESOLVED, _ALL, *_SIMILAR) + "SELECT method, id, similarity FROM sim")
def similarity_tf(spark, sf_dir):
    return D.rate_detected(notes(spark, sf_dir, distinct=True), similarity=True).filter("similarity is not null").select("method", "id", "similarity")


@register(
    "method_summary",
    _with(NOTES, RAW, RESOLVED, _ALL, _RATE, *_SIMILAR)
    + """SELECT a.method, avg_removal_rate, avg_similarity, total_documents FROM (SELECT method, round(avg(rate), 4) AS avg_removal_rate, count(*) AS total_documents FROM rates GROUP BY method) a
      JOIN (SELECT method, round(avg(similarity), 4) AS avg_similarity FROM sim GROUP BY method) b ON a.method = b.method""",
)
def method_summary(spark, sf_dir):
    """Both averages of each method; the similarity is that of word counts."""
    return D.method_means(D.rate_detected(notes(spark, sf_dir, distinct=True), similarity=True))


# ------------------------------------------------------------------ evaluation

_STRICT = """counts AS (SELECT p.id, p.np, coalesce(t.nt, 0) AS nt, coalesce(m.tp, 0) AS tp FROM (SELECT n.id, count(q.id) AS np FROM notes n LEFT JOIN pred q ON n.id = q.id GROUP BY n.id) p
  LEFT JOIN (SELECT id, count(*) AS nt FROM truth GROUP BY id) t ON p.id = t.id
  LEFT JOIN (SELECT a.id, count(*) AS tp FROM pred a JOIN truth b ON a.id = b.id AND a.type = b.type AND a.span_start = b.span_start AND a.span_end = b.span_end GROUP BY a.id) m ON p.id = m.id)"""
_LISTS = """pl AS (SELECT id, list({'r': rank, 't': type, 's': span_start, 'e': span_end} ORDER BY rank) AS a FROM pred GROUP BY id), tl AS (SELECT id, list({'r': rank, 't': type, 's': span_start, 'e': span_end} ORDER BY rank) AS b FROM truth GROUP BY id)"""
_RELAXED = (
    _LISTS
    + """, counts AS (SELECT id, np, nt, coalesce(len(list_reduce(a, lambda used, x: list_concat(used, list_filter(b, lambda y: y.t = x.t AND y.s < x.e AND x.s < y.e AND NOT list_contains(list_transform(used, lambda z: z.r), y.r))[1:1]), CAST([] AS STRUCT(r BIGINT, t VARCHAR, s BIGINT, e BIGINT)[]))), 0) AS tp
  FROM (SELECT n.id, a, coalesce(b, []) AS b, coalesce(len(a), 0) AS np, coalesce(len(b), 0) AS nt FROM notes n LEFT JOIN pl ON n.id = pl.id LEFT JOIN tl ON n.id = tl.id))"""
)
_BY_DOC = "SELECT id, CAST(tp AS BIGINT) AS tp, CAST(np - tp AS BIGINT) AS fp, CAST(nt - tp AS BIGINT) AS fn FROM counts"


def _metric(mode: str) -> str:
    return f"""s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(np - tp) AS BIGINT) AS fp, CAST(sum(nt - tp) AS BIGINT) AS fn FROM counts),
    m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS r FROM s),
    z AS (SELECT {_lit(mode)} AS mode, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 4) AS f1 FROM m)"""


def _counts(spark, sf_dir, mode: str, rules: str = "fixed"):
    return D.evaluate_detected(notes(spark, sf_dir), rules, mode)


for _mode, _sql in (("strict", _STRICT), ("relaxed", _RELAXED)):
    _base = (NOTES, RAW, RESOLVED, truth_cte("fixed"), _sql)
    _old = (NOTES, RAW, RESOLVED, truth_cte("legacy"), _sql)
    register(f"eval_by_doc_{_mode}", _with(*_base) + _BY_DOC)(lambda spark, sf_dir, m=_mode: _counts(spark, sf_dir, m))
    register(f"eval_{_mode}", _with(*_base, _metric(_mode)) + "SELECT * FROM z")(lambda spark, sf_dir, m=_mode: D.metrics(_counts(spark, sf_dir, m), m))
    register(f"eval_legacy_{_mode}", _with(*_old, _metric(_mode)) + "SELECT * FROM z")(lambda spark, sf_dir, m=_mode: D.metrics(_counts(spark, sf_dir, m, "legacy"), m))

#: Recall before, by its name: few notes and scenarios, and the rules before these.
BASELINES = {"first": 0.683, "legacy": 0.6974}
BASELINE_RECALL = BASELINES["first"]

for _name, _rules in (("eval_vs_baselines", "fixed"), ("eval_legacy_vs_baselines", "legacy")):
    register(
        _name,
        _with(NOTES, RAW, RESOLVED, truth_cte(_rules), _RELAXED, _metric("relaxed"), "b(name, baseline) AS (VALUES " + ", ".join(f"({_lit(n)}, CAST({v} AS DOUBLE))" for n, v in BASELINES.items()) + ")")
        + "SELECT name, mode, recall, baseline, round((recall - baseline) / baseline * 100, 2) AS improvement_pct FROM z, b",
    )(lambda spark, sf_dir, rules=_rules: D.against_baselines(D.metrics(_counts(spark, sf_dir, "relaxed", rules), "relaxed"), BASELINES))

# Stored predictions and annotations that do not cover each other: some documents have only one of the two.
_PARTIAL = "p AS (SELECT id, count(*) AS np FROM pred WHERE id % 5 <> 0 GROUP BY id), t AS (SELECT * FROM truth WHERE id % 7 <> 0), q AS (SELECT * FROM pred WHERE id % 5 <> 0)"


@register(
    "eval_stored_strict",
    _with(NOTES, RAW, RESOLVED, truth_cte("fixed"), _PARTIAL)
    + """SELECT n.id, coalesce(m.tp, 0) AS tp, coalesce(p.np, 0) - coalesce(m.tp, 0) AS fp, coalesce(c.nt, 0) - coalesce(m.tp, 0) AS fn FROM (SELECT id FROM notes WHERE id % 5 <> 0) n LEFT JOIN p ON n.id = p.id
      LEFT JOIN (SELECT id, count(*) AS nt FROM t GROUP BY id) c ON n.id = c.id
      LEFT JOIN (SELECT q.id, count(*) AS tp FROM q JOIN t ON q.id = t.id AND q.type = t.type AND q.span_start = t.span_start AND q.span_end = t.span_end GROUP BY q.id) m ON n.id = m.id""",
)
def eval_stored_strict(spark, sf_dir):
    """Predictions joined with annotations by id; documents come from the predictions."""
    df = notes(spark, sf_dir)
    return D.evaluate_documents(D.detect(df.filter("id % 5 <> 0")), D.annotate(df.filter("id % 7 <> 0"), "fixed"), "strict")


@register(
    "attach_stored",
    _with(NOTES, RAW, RESOLVED) + "SELECT n.id, CAST(count(p.id) AS BIGINT) AS num_entities, min(p.span_start) AS first_start FROM notes n LEFT JOIN (SELECT * FROM pred WHERE id % 3 <> 0) p ON n.id = p.id GROUP BY n.id",
)
def attach_stored(spark, sf_dir):
    """Notes with their stored spans; those without any keep an empty list."""
    df = notes(spark, sf_dir)
    stored = D.detect(df.filter("id % 3 <> 0")).select("id", F.transform("entities", lambda x: F.struct(x["text"].alias("text"), x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end"))).alias("entities"))
    return readers.attach(df, stored).select("id", F.size("entities").cast("long").alias("num_entities"), F.array_min(F.transform("entities", lambda x: x["start"])).cast("long").alias("first_start"))


_SUMMARY = "SELECT (SELECT count(*) FROM notes) AS documents, (SELECT count(*) FROM {0}) AS spans, round(CAST((SELECT count(*) FROM {0}) AS DOUBLE) / (SELECT count(*) FROM notes), 4) AS mean_spans"


@register("detection_summary", _with(NOTES, RAW, RESOLVED) + _SUMMARY.format("pred"))
def detection_summary(spark, sf_dir):
    return D.summarise_texts(notes(spark, sf_dir))


@register("annotation_summary", _with(NOTES, truth_cte("fixed")) + _SUMMARY.format("truth"))
def annotation_summary(spark, sf_dir):
    return D.summarise_texts(notes(spark, sf_dir), "fixed")


@register(
    "eval_vs_baseline",
    _with(NOTES, RAW, RESOLVED, truth_cte("fixed"), _RELAXED, _metric("relaxed"))
    + f"SELECT mode, recall, CAST({BASELINE_RECALL} AS DOUBLE) AS baseline, round((recall - CAST({BASELINE_RECALL} AS DOUBLE)) / CAST({BASELINE_RECALL} AS DOUBLE) * 100, 2) AS improvement_pct FROM z",
)
def eval_vs_baseline(spark, sf_dir):
    return D.against_baseline(D.metrics(_counts(spark, sf_dir, "relaxed"), "relaxed"), BASELINE_RECALL)


@register("entity_distribution", _with(NOTES, RAW, RESOLVED) + "SELECT type, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM pred), 2) AS pct FROM pred GROUP BY type")
def entity_distribution(spark, sf_dir):
    return D.detected_distribution(notes(spark, sf_dir))


@register(
    "entity_count_compare",
    _with(NOTES, RAW, RESOLVED, truth_cte("fixed"))
    + "SELECT coalesce(a.type, b.type) AS type, coalesce(tn, 0) AS truth_n, coalesce(pn, 0) AS pred_n, coalesce(pn, 0) - coalesce(tn, 0) AS difference FROM (SELECT type, count(*) AS tn FROM truth GROUP BY type) a FULL JOIN (SELECT type, count(*) AS pn FROM pred GROUP BY type) b ON a.type = b.type",
)
def entity_count_compare(spark, sf_dir):
    totals = D.kind_totals(notes(spark, sf_dir), "fixed")
    return totals.withColumn("difference", F.col("pred_n") - F.col("truth_n"))


@register(
    "sample_compare",
    _with(NOTES, RAW, RESOLVED, truth_cte("fixed"))
    + "SELECT 'truth' AS side, rank, type, span_text FROM truth WHERE id = (SELECT min(id) FROM notes) AND rank <= 10 UNION ALL SELECT 'pred', rank, type, span_text FROM pred WHERE id = (SELECT min(id) FROM notes) AND rank <= 10",
)
def sample_compare(spark, sf_dir):
    both = notes(spark, sf_dir)
    first = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.min("o_orderkey")).first()[0]
    return D.compare_sample(D.annotate(both, "fixed"), D.detect(both), -1 if first is None else first)


@register(
    "sample_counts",
    _with(NOTES, RAW, RESOLVED, truth_cte("fixed"))
    + "SELECT 'truth' AS side, count(*) AS n FROM truth WHERE id = (SELECT min(id) FROM notes) UNION ALL SELECT 'pred', count(*) FROM pred WHERE id = (SELECT min(id) FROM notes)",
)
def sample_counts(spark, sf_dir):
    both = notes(spark, sf_dir)
    first = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.min("o_orderkey")).first()[0]
    return D.compare_sample_counts(D.annotate(both, "fixed"), D.detect(both), -1 if first is None else first)
