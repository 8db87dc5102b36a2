"""Counting of word lists. Forms are a table (form, label); a form listed twice counts twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def count_lexicon(docs: DataFrame, forms: DataFrame, key: str, text: str, pattern: str = X.LATIN_WORD) -> DataFrame:
    """(key, label, n) of labels that occur. Tokens are counted per document before they meet the forms."""
    tokens = docs.select(key, F.explode(X.tokens(F.col(text), pattern)).alias("form")).groupBy(key, "form").agg(F.count("*").alias("c"))
    many = forms.groupBy("form", "label").agg(F.count("*").alias("times"))
    return tokens.join(many, "form").groupBy(key, "label").agg(F.sum(F.col("c") * F.col("times")).alias("n"))


def trigger_counts(text, triggers: dict[str, list[str]]):
    """A struct of substring counts per label, in a lower-case text column."""
    return F.struct(*[sum((X.occurrences(text, x) for x in parts), F.lit(0).cast("long")).alias(label) for label, parts in triggers.items()])
