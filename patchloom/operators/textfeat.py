"""TF-IDF features of code, fitted on one table and applied to another."""

from __future__ import annotations

from pyspark.sql import DataFrame

from patchloom.operators import datasets as D

MAX_FEATURES = 2000


def fit(df: DataFrame, id_column: str, text: str, size: int = MAX_FEATURES, min_df: int = 1) -> tuple[DataFrame, int]:
    """The size most frequent terms with their document counts, and the number of documents."""
    return D.vocabulary(D.ngrams(df, id_column, text), id_column, size, min_df), df.count()


def transform(df: DataFrame, fitted: tuple[DataFrame, int], id_column: str, text: str) -> DataFrame:
    """(id, term, weight) of df under a fitted vocabulary."""
    return D.tfidf(D.ngrams(df, id_column, text), fitted[0], fitted[1], id_column)


def fit_transform(df: DataFrame, id_column: str, text: str, size: int = MAX_FEATURES) -> DataFrame:
    return transform(df, fit(df, id_column, text, size), id_column, text)
