"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame operations alone.

Each document draws an exponential key -ln(u)/w: u comes from a digest of its doc_id and the
seed, w is the document's quality weight (the share of its characters that are
neither digits nor symbols, see quality_weight), so better documents tend to come first.  Documents are sorted within their
source by that key and their sizes are summed until the source's budget is met.  A source whose
target is at least its size first takes every document whole (a complete epoch); only what is
left of the target goes to the weighted selection.  The document in which the budget ends gives
just the words that are missing, so a source's taken words equal its target rounded down.

Prefix sums never gather a source in one task: keys are cut into buckets, the sizes of buckets
are summed first, and only the bucket in which the budget ends is looked into, twice over; the
last window sees about a 16-millionth of a source.  Nor do sources meet in one task: their ranks
come from a distributed sort and the sizes of its parts, and the level at which targets are filled
from a few sums, each a round over the table of sources.  Documents meet their source's plan by
common.join_groups, so large sources are not gathered by the join either.

Defined cases: null or empty text has size 0 and is taken 0 times; a null source is a source of
its own, last in order; a source of size 0 has target 0; a null doc_id draws by the text instead;
repeated rows count each (equal keys are broken by doc_id, then size); an empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, join_groups, materialise, read

BUCKETS = 4096
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2


def word_count(text: str = "text"):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def quality_weight(text: str = "text"):
    """0.1 to 1: a documented, label-free weight - the share of characters left when digits and symbols go."""
    whole = F.coalesce(F.col(text), F.lit(""))
    kept = F.length(F.translate(whole, "|#$%&*!{}<>[]=_~^\\0123456789", ""))
    return F.greatest(F.lit(0.1), kept.cast("double") / F.greatest(F.length(whole), F.lit(1)).cast("double"))


def ranked(sizes: DataFrame) -> DataFrame:
    """sizes with rank, 1 for the first source by code point (null last), by a distributed sort.

    Only the number of rows of each of the sort's parts comes to the driver.
    """
    placed = sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id())
    placed = materialise(placed, "mix-sources")
    part = F.shiftright("place", 33).cast("int")
    counts = dict(placed.groupBy(part.alias("part")).count().collect())
    before, starts = 0, []
    for k in sorted(counts):
        starts += [F.lit(k), F.lit(before)]
        before += counts[k]
    start = F.element_at(F.create_map(*starts), part) if starts else F.lit(0)
    return placed.withColumn("rank", start + F.col("place").bitwiseAND((1 << 33) - 1) + 1).drop("place")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sizes with rank and target; sizes: source, source_size, a row for each source.

    Filling by weight with a ceiling of cap times the size: all sources share by weight; those above
    their ceiling get the ceiling, and the others share what is left anew, until none is above.
    """
    cycle = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    w = ranked(sizes).withColumn("weight", cycle)
    size, level, full, known = F.col("source_size").cast("double"), 0.0, F.lit(False), -1
    while True:
        sums = w.agg(F.sum(size), F.sum(F.when(full, size)), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        everything, filled, weight_left, n_full = (x or 0 for x in sums)
        if n_full == known or not weight_left:
            break
        known, level = n_full, (everything * share - filled * cap) / weight_left
        full = F.lit(level) * F.col("weight") > size * cap
    return w.withColumn("target", F.when(full, size * cap).otherwise(F.lit(level) * F.col("weight"))).drop("weight")


def mix_sources(docs: DataFrame, seed: int = 42, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """A row for each row of docs: doc_id, size, source_size, target, taken."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), name).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    rows = docs.select("doc_id", "source", word_count().alias("size"), u.alias("u"), quality_weight().alias("w"))
    # a place in (0, 1) that sorts as the exponential key -ln(u)/w does
    rows = rows.withColumn("key", -F.log(F.col("u")) / F.col("w")).withColumn("place", 1 - F.exp(-F.col("key")))
    rows = materialise(rows.select("doc_id", "source", "size", "key", "place"), "mix-sizes")
    # level 1: the bucket in which the budget ends; level 2: its sub-bucket
    a = F.least((F.col("place") * BUCKETS).cast("int"), F.lit(BUCKETS - 1))
    b = F.least(((F.col("place") * BUCKETS - F.col("a")) * BUCKETS).cast("int"), F.lit(BUCKETS - 1))
    named = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    rows = rows.withColumn("a", a).withColumn("b", b).withColumn("s", named).drop("source", "place")
    first = materialise(rows.groupBy("s", "a").agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("rows")), "mix-buckets")

    sizes = first.groupBy("s").agg(F.sum("sum").alias("source_size"), F.sum("rows").alias("rows"))
    goal = targets(sizes.withColumn("source", F.when(~F.col("s.none"), F.col("s.name"))), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size").cast("double"))).otherwise(F.lit(0)).cast("long")
    goal = goal.select("s", "rows", "source_size", "target", epochs.alias("epochs"))
    goal = goal.withColumn("budget", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))

    def ends(sums: DataFrame, left: DataFrame, bucket: str, out: str, room: str, rest: str) -> DataFrame:
        """left with the bucket in which room ends (null: in none), and the room left before it."""
        before = Window.partitionBy("s").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        cut = sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
        cut = cut.join(left.select("s", room), "s").filter((F.col("before") < F.col(room)) & (F.col("before") + F.col("sum") >= F.col(room)))
        met = left.join(cut.select("s", F.col(bucket).alias(out), "before"), "s", "left")
        return met.withColumn(rest, F.col(room) - F.coalesce("before", F.lit(0))).drop("before")

    total = goal.agg(F.sum("rows")).first()[0] or 0
    plan = materialise(ends(first, goal, "a", "cut_a", "budget", "room_a"), "mix-cuts")
    inside = join_groups(rows, plan.filter("cut_a is not null").select("s", "cut_a", "rows"), ["s"], "rows", total).filter("a = cut_a")
    second = inside.groupBy("s", "b").agg(F.sum("size").alias("sum"))
    plan = materialise(ends(second, plan, "b", "cut_b", "room_a", "room_b"), "mix-plan")
    joined = join_groups(rows, plan, ["s"], "rows", total)
    at_end = F.coalesce((F.col("a") == F.col("cut_a")) & (F.col("b") == F.col("cut_b")), F.lit(False))
    full = (F.col("a") < F.col("cut_a")) | ((F.col("a") == F.col("cut_a")) & (F.col("b") < F.col("cut_b")))
    last = Window.partitionBy("s").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = joined.filter(at_end).withColumn("seen", F.coalesce(F.sum("size").over(last), F.lit(0)))
    cut = cut.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("room_b") - F.col("seen"))))
    rest = joined.filter(~at_end).withColumn("part", F.when(F.col("budget") <= 0, F.lit(0)).when(F.coalesce(full, F.lit(False)), F.col("size")).otherwise(F.lit(0)))
    cols = ["doc_id", "size", "source_size", "target", "epochs", "part"]
    return cut.select(*cols).unionByName(rest.select(*cols)).select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u,
         greatest(0.1, CAST(length(regexp_replace(coalesce(text, ''), '[|#$%&*!{}<>\[\]=_~^\\0-9]', '', 'g')) AS DOUBLE)
                       / CAST(greatest(length(coalesce(text, '')), 1) AS DOUBLE)) AS w
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM d GROUP BY source),
v AS (SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
f AS (SELECT *, coalesce(sum(CAST(source_size AS DOUBLE)) OVER b, 0) * 2 AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left,
             sum(CAST(source_size AS DOUBLE)) OVER () AS all_size
      FROM v WINDOW b AS (ORDER BY CAST(source_size AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (all_size * 1.5 - filled) / weight_left AS level FROM f),
h AS (SELECT *, first_value(CASE WHEN level * weight <= CAST(source_size AS DOUBLE) * 2 THEN level END IGNORE NULLS)
        OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lev FROM l),
t AS (SELECT source, source_size, CASE WHEN lev IS NULL THEN CAST(source_size AS DOUBLE) * 2 ELSE lev * weight END AS target FROM h),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / CAST(source_size AS DOUBLE)) AS BIGINT) ELSE 0 END AS epochs FROM t),
k AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.epochs, CAST(floor(g.target) AS BIGINT) - g.epochs * g.source_size AS budget,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / w, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seen
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - seen)) AS BIGINT) AS taken FROM k
"""
