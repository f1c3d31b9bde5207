"""Learned backends, loaded once for each Python worker; their libraries are optional."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf

from ..functions.spans import SPAN


class BackendMissing(ImportError):
    """The library that a backend needs is not installed."""


def available(library: str) -> bool:
    return importlib.util.find_spec(library) is not None


def _need(library: str) -> None:
    if not available(library):
        raise BackendMissing(library)


def with_model_persons(df: DataFrame, model: str = "en_core_web_sm", text: str = "text", out: str = "persons") -> DataFrame:
    """Adds the PERSON spans of a named-entity model; pass the column to detect as person=."""
    _need("spacy")

    @pandas_udf(f"array<{SPAN}>")
    def persons(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import spacy

        nlp = spacy.load(model)
        for batch in batches:
            docs = nlp.pipe(batch.fillna("").tolist())
            yield pd.Series([[(e.start_char, e.end_char, "PERSON", e.text, k) for k, e in enumerate(d.ents) if e.label_ == "PERSON"] for d in docs])

    return df.withColumn(out, persons(text))


def embedding_similarity(df: DataFrame, model: str = "all-MiniLM-L6-v2", text: str = "text", sanitized: str = "sanitized_text", out: str = "similarity_score") -> DataFrame:
    """Adds the cosine of sentence embeddings; equal texts of a batch are embedded once."""
    _need("sentence_transformers")

    @pandas_udf("double")
    def cosine(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from sentence_transformers import SentenceTransformer

        encoder = SentenceTransformer(model)
        for a, b in batches:
            names = pd.unique(pd.concat([a, b]).fillna(""))
            vectors = dict(zip(names, encoder.encode(list(names), normalize_embeddings=True), strict=True))
            yield pd.Series([float(vectors[x] @ vectors[y]) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)])

    return df.withColumn(out, cosine(text, sanitized))
