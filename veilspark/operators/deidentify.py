"""Detection, annotation, sanitizing and evaluation as DataFrame operators.

Each works row by row, so it runs the same in batch and in streams; only summaries shuffle, and those
after partial aggregation.  The built-in rules run on Arrow batches (functions.batches); other
registries, backends and stored spans go by expressions (functions.spans), with the same results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import batch_udfs as U
from ..functions import patterns as P
from ..functions import spans as S


def person_spans(text: Column, backend: str = "rules", names: list[str] | None = None) -> Column:
    """The PERSON backends that are plain expressions; learned ones join their spans (see detect)."""
    if backend == "rules":
        return S.name_spans(text, "fixed")
    if backend == "gazetteer":
        return S.gazetteer_spans(text, names or [])
    if backend == "none":
        return F.array().cast(f"array<{S.SPAN}>")
    raise ValueError(f"unknown backend {backend!r}")


def _built_in(backend: str = "rules", registry=None, person: str | None = None, names=None) -> bool:
    return backend == "rules" and registry is None and person is None


def detect_raw(df: DataFrame, text: str = "text", backend: str = "rules", registry=None, names=None, person: str | None = None) -> DataFrame:
    """Adds entities: all candidate spans in order of emission, names first.

    person: a column of precomputed PERSON spans (same struct), used in place of a backend.
    """
    if _built_in(backend, registry, person):
        return df.withColumn("entities", U.raw_spans(F.col(text)))
    first = F.col(person) if person else person_spans(F.col(text), backend, names)
    return df.withColumn("entities", S.in_order(first, *S.pattern_spans(F.col(text), registry or P.DETECTION)))


def detect(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """Adds entities: candidates with overlaps resolved."""
    if _built_in(**options):
        return df.withColumn("entities", U.detected(F.col(text)))
    return detect_raw(df, text, **options).withColumn("entities", S.resolve_overlaps(F.col("entities")))


def annotate(df: DataFrame, rules: str = "fixed", text: str = "text", out: str = "entities") -> DataFrame:
    """Adds the rule-made reference spans of a generation."""
    return df.withColumn(out, U.annotated(F.col(text), rules))


def explode_spans(df: DataFrame, *keys: str, spans: str = "entities") -> DataFrame:
    """A row for each span: keys, rank (from 1), type, span_start, span_end, span_text.

    The outer form with a filter behind it: of the inner one the optimizer derives a filter on the
    array's size and pushes it to the source, and the whole span search would run twice.
    """
    rows = df.select(*keys, F.posexplode_outer(spans).alias("p", "e")).filter(F.col("e").isNotNull())
    return rows.select(
        *keys, (F.col("p") + 1).cast("long").alias("rank"), F.col("e.type").alias("type"), F.col("e.start").cast("long").alias("span_start"), F.col("e.end").cast("long").alias("span_end"), F.col("e.text").alias("span_text")
    )


def sanitize(df: DataFrame, method: str, text: str = "text", spans: str = "entities") -> DataFrame:
    return df.withColumn("sanitized_text", S.sanitize(F.col(text), F.col(spans), method))


def sanitize_all(df: DataFrame, methods=S.METHODS) -> DataFrame:
    """A row for each document and method, with its removal rate; spans are found once."""
    each = F.array(*[F.struct(F.lit(m).alias("method"), S.sanitize(F.col("text"), F.col("entities"), m).alias("sanitized_text")) for m in methods])
    out = df.withColumn("m", F.explode(each)).select(*df.columns, "m.method", "m.sanitized_text")
    return out.withColumn("num_entities", F.size("entities")).withColumn("removal_rate", S.removal_rate(F.col("entities"), F.col("sanitized_text")))


def sanitize_detected(df: DataFrame, method: str, text: str = "text") -> DataFrame:
    """sanitize after detect, in one pass: adds sanitized_text and keeps no spans."""
    return df.withColumn("sanitized_text", U.sanitized(F.col(text), method))


def rate_detected(df: DataFrame, similarity: bool = False, key: str = "id", methods=S.METHODS) -> DataFrame:
    """key, method, num_entities, removal_rate of sanitize_all after detect, in one pass and without the texts.

    similarity: adds that of term_similarity, for each row (null if there are no words on both sides).
    """
    made = U.similarities(F.col("text"), tuple(methods)) if similarity else U.removals(F.col("text"), tuple(methods))
    # outer, as in explode_spans; each array has all methods
    rows = df.select(key, made.alias("made")).select(key, F.posexplode_outer("made").alias("p", "m")).withColumn("method", F.element_at(F.array(*map(F.lit, methods)), F.col("p") + 1))
    found, gone = F.col("m.found"), F.col("m.gone")
    out = [F.col(key), F.col("method"), found.cast("int").alias("num_entities"), F.when(found == 0, F.lit(1.0)).otherwise(gone.cast("double") / found.cast("double")).alias("removal_rate")]
    if similarity:
        out.append(F.when((F.col("m.xx") > 0) | (F.col("m.yy") > 0), _cosine(F.col("m.xy"), F.col("m.xx"), F.col("m.yy"))).alias("similarity"))
    return rows.select(*out)


def removal_summary(df: DataFrame) -> DataFrame:
    """Macro means of unrounded rates, rounded to 4."""
    return df.groupBy("method").agg(F.round(F.avg("removal_rate"), 4).alias("avg_removal_rate"), F.count(F.lit(1)).alias("total_documents"))


def evaluate_documents(pred: DataFrame, truth: DataFrame, mode: str, key: str = "id") -> DataFrame:
    """key, tp, fp, fn.  Documents come from the predictions; one without truth has none to find."""
    if mode == "strict":
        # of spans that must be equal their names will do, which are shorter than the spans; equal ones of a list are numbered
        side = lambda df, name: df.select(key, U.span_names(F.col("entities")).alias(name))
        both = side(pred, "p").join(side(truth, "t").hint("merge"), key, "left").withColumn("t", F.coalesce("t", F.array().cast("array<string>")))
        both = both.select(key, F.size(F.array_intersect("p", "t")).cast("long").alias("tp"), F.size("p").alias("np"), F.size("t").alias("nt"))
        return both.select(key, "tp", (F.col("np") - F.col("tp")).cast("long").alias("fp"), (F.col("nt") - F.col("tp")).cast("long").alias("fn"))
    none = F.array().cast(f"array<{S.SPAN}>")
    both = pred.select(key, F.col("entities").alias("pred")).join(truth.select(key, F.col("entities").alias("truth")).hint("merge"), key, "left")
    return count_matches(both.withColumn("truth", F.coalesce("truth", none)), mode, key)


def evaluate_detected(df: DataFrame, rules: str, mode: str, key: str = "id", text: str = "text") -> DataFrame:
    """key, tp, fp, fn of detect against annotate, in one pass over the texts: no span leaves its worker."""
    counted = df.select(key, U.match_counts(F.col(text), mode, rules).alias("m"))
    return counted.select(key, "m.tp", (F.col("m.np") - F.col("m.tp")).alias("fp"), (F.col("m.nt") - F.col("m.tp")).alias("fn"))


def count_matches(both: DataFrame, mode: str, key: str = "id") -> DataFrame:
    tp = S.matched(F.col("pred"), F.col("truth"), mode)
    out = both.select(key, tp.cast("long").alias("tp"), F.size("pred").alias("np"), F.size("truth").alias("nt"))
    return out.select(key, "tp", (F.col("np") - F.col("tp")).cast("long").alias("fp"), (F.col("nt") - F.col("tp")).cast("long").alias("fn"))


def metrics(counts: DataFrame, mode: str) -> DataFrame:
    """Micro precision, recall and F1 over all documents, rounded to 4; 0 where undefined."""
    s = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    s = s.withColumn("p", ratio(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))).withColumn("r", ratio(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")))
    f1 = ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return s.select(F.lit(mode).alias("mode"), "tp", "fp", "fn", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"))


def against_baseline(measured: DataFrame, baseline: float) -> DataFrame:
    """Improvement in percent over a baseline recall, from the rounded recall."""
    return measured.select("mode", "recall", F.lit(baseline).alias("baseline"), F.round((F.col("recall") - baseline) / baseline * 100, 2).alias("improvement_pct"))


def against_baselines(measured: DataFrame, baselines: dict[str, float]) -> DataFrame:
    """As against_baseline, a row for each named baseline."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("baseline")) for n, v in baselines.items()]))
    rows = measured.select("mode", "recall", each.alias("b")).select("b.name", "mode", "recall", "b.baseline")
    return rows.withColumn("improvement_pct", F.round((F.col("recall") - F.col("baseline")) / F.col("baseline") * 100, 2))


def summarise(df: DataFrame, spans: str = "entities") -> DataFrame:
    """One row: documents, spans, mean_spans (0 for an empty table)."""
    s = df.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.size(spans)), F.lit(0)).cast("long").alias("spans"))
    return _summary(s)


def summarise_texts(df: DataFrame, rules: str | None = None, text: str = "text") -> DataFrame:
    """As summarise, of detect (or, with rules, of annotate); only a number leaves each text's worker."""
    counts = df.select(U.span_count(F.col(text), rules).alias("n"))
    return _summary(counts.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("spans")))


def _summary(s: DataFrame) -> DataFrame:
    return s.withColumn("mean_spans", F.round(F.coalesce(F.try_divide(F.col("spans").cast("double"), F.col("documents").cast("double")), F.lit(0.0)), 4))


def kind_totals(df: DataFrame, rules: str, text: str = "text") -> DataFrame:
    """type, truth_n, pred_n of annotate and detect over all texts; kinds without any span are left out."""
    counts = df.select(U.kind_counts(F.col(text), rules).alias("c"))
    places = range(len(U.KINDS))
    sums = counts.agg(*[F.sum(F.col(f"c.{side}")[k]).alias(f"{side}{k}") for side in ("truth", "pred") for k in places])
    each = F.explode(F.array(*[F.struct(F.lit(U.KINDS[k]).alias("type"), F.col(f"truth{k}").alias("truth_n"), F.col(f"pred{k}").alias("pred_n")) for k in places]))
    return sums.select(each.alias("s")).select("s.*").filter("truth_n > 0 or pred_n > 0")


def method_summary(df: DataFrame, similarity: DataFrame) -> DataFrame:
    """method, avg_removal_rate, avg_similarity, total_documents: macro means of unrounded values, rounded to 4.

    df: as sanitize_all gives it; similarity: method and similarity for each document.
    """
    mean = similarity.groupBy("method").agg(F.round(F.avg("similarity"), 4).alias("avg_similarity"))
    return removal_summary(df).join(mean, "method", "left").select("method", "avg_removal_rate", "avg_similarity", "total_documents")


def method_means(rated: DataFrame) -> DataFrame:
    """As method_summary, of rate_detected with similarity: one pass, one group for each method."""
    return rated.groupBy("method").agg(
        F.round(F.avg("removal_rate"), 4).alias("avg_removal_rate"), F.round(F.avg("similarity"), 4).alias("avg_similarity"), F.count(F.lit(1)).alias("total_documents")
    )


def compare_sample_counts(truth: DataFrame, pred: DataFrame, key_value: int) -> DataFrame:
    """side, n: the number of spans of one document on both sides."""
    side = lambda df, name: df.filter(F.col("id") == key_value).select(F.lit(name).alias("side"), F.size("entities").cast("long").alias("n"))
    return side(truth, "truth").unionByName(side(pred, "pred"))


def entity_distribution(spans: DataFrame) -> DataFrame:
    """type, n, pct of exploded spans; empty input gives no rows."""
    return _shares(spans.groupBy("type").agg(F.count(F.lit(1)).alias("n")))


def _shares(n: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row for each type: one pass over the spans
    return n.select("type", "n", F.round(F.col("n") * 100.0 / total, 2).alias("pct"))


def detected_distribution(df: DataFrame, text: str = "text") -> DataFrame:
    """As entity_distribution, of detect; no span leaves its worker."""
    return _shares(kind_totals(df, "", text).select("type", F.col("pred_n").alias("n")))


def compare_counts(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """type, truth_n, pred_n, difference; a type absent on a side counts 0 there."""
    a = truth.groupBy("type").agg(F.count(F.lit(1)).alias("truth_n"))
    b = pred.groupBy("type").agg(F.count(F.lit(1)).alias("pred_n"))
    z = a.join(b, "type", "full").select("type", F.coalesce("truth_n", F.lit(0)).alias("truth_n"), F.coalesce("pred_n", F.lit(0)).alias("pred_n"))
    return z.withColumn("difference", F.col("pred_n") - F.col("truth_n"))


def compare_sample(truth: DataFrame, pred: DataFrame, key_value: int, n: int = 10) -> DataFrame:
    """The first n spans of one document on both sides (the limit is the feature: a preview)."""
    side = lambda df, name: explode_spans(df.filter(F.col("id") == key_value), "id").filter(F.col("rank") <= n).select(F.lit(name).alias("side"), "rank", "type", "span_text")
    return side(truth, "truth").unionByName(side(pred, "pred"))


def term_similarity(df: DataFrame, key: str = "id") -> DataFrame:
    """Cosine of word counts between text and sanitized_text, by key and method."""
    words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    a = df.select(key, "method", words(F.col("text")).alias("w"), F.lit(1).alias("x"), F.lit(0).alias("y"))
    b = df.select(key, "method", words(F.col("sanitized_text")).alias("w"), F.lit(0).alias("x"), F.lit(1).alias("y"))
    n = a.unionByName(b).groupBy(key, "method", "w").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    s = n.groupBy(key, "method").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return s.select(key, "method", _cosine(F.col("xy"), F.col("xx"), F.col("yy")).alias("similarity"))


def _cosine(xy: Column, xx: Column, yy: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(xy.cast("double"), F.sqrt(xx.cast("double")) * F.sqrt(yy.cast("double"))), F.lit(0.0)), 6)


def valid_medicaid(value: Column) -> Column:
    """Eight characters, a cased and no lower-case one among the first two, then six digits."""
    return F.coalesce((F.length(value) == 8) & value.rlike(r"^([A-Z][^a-z]|[^A-Za-z][A-Z])[0-9]{6}$"), F.lit(False))
