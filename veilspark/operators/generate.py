"""Synthetic notes and identifiers from the number of rows wanted and a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import generate as G


def _keys(spark: SparkSession, n: int) -> str:
    spark.range(1, n + 1).select(F.col("id").alias("o_orderkey")).createOrReplaceTempView("veilspark_keys")
    return "veilspark_keys"


def generate_notes(spark: SparkSession, n: int, seed: int = 42, scenario: str | None = None) -> DataFrame:
    """id, scenario, filename, text of n notes; a note depends on its number and the seed alone.

    scenario: only that template, for all n; an unknown one gives no text.
    """
    d = G.Dialect("spark", seed)
    if scenario is None:
        df = spark.sql(G.notes_sql(d, _keys(spark, n)))
    else:
        body = G.text_sql(d, G.body_sql(d, scenario)) if scenario in G.TEMPLATES else "cast(null as string)"
        df = spark.sql(f"select k as id, '{scenario if scenario in G.TEMPLATES else 'unknown'}' as scenario, {body} as text from ({G.fields_sql(d, _keys(spark, n))}) gg")
    return df.select("id", "scenario", F.format_string("note_%04d_%s.txt", "id", "scenario").alias("filename"), "text")


def generate_medicaid_ids(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """medicaid_id: n distinct identifiers, sorted; rounds draw more until enough are distinct."""
    if n > 26 * 26 * 10**6:
        raise ValueError("there are not that many identifiers")
    d, drawn = G.Dialect("spark", seed), n + n // 8 + 16
    letter = lambda f: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(1 + {d.u(f)} % 26 as int), 1)"
    value = f"{letter('m1')} || {letter('m2')} || lpad(cast({d.u('m3')} % 1000000 as string), 6, '0')"
    while True:
        ids = spark.sql(f"select {value} as medicaid_id, min(k) as k from (select o_orderkey as k from {_keys(spark, drawn)}) group by 1")
        if ids.count() >= n:
            return ids.orderBy("k").limit(n).select("medicaid_id").orderBy("medicaid_id")  # n is the feature
        drawn *= 2
