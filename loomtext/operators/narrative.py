"""Narrative features: text metrics, event lift per segment, tension curves, name candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as V
from ..functions import text as X
from ..functions.numeric import min_max
from .lexicon import trigger_counts

# Capitalised words that are no names.
NAME_STOP = ["The", "And", "But", "He", "She", "They", "It", "Then", "When", "There", "Now", "So", "As", "At", "In", "On", "For", "Once", "One", "Der", "Die", "Das", "Und", "Er", "Sie", "Es", "Da", "Als", "Nun", "Aber", "Ein", "Eine", "Ich", "Du", "Wir", "Was", "Wie", "Dann", "Doch", "Sein", "Ihr", "God"]
MID_SENTENCE_NAME = "(?<![.!?“\"’'\\n])(?<![.!?][”\"’'])\\s([A-Z][a-z]{2,})\\b"
LIFT = 1.5


def metrics(text: Column) -> Column:
    """words, words per line, words per sentence, capitalised words in a thousand."""
    w = F.size(X.words(text)).cast("double")
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))).cast("double")
    one = lambda x: F.greatest(F.lit(1.0), x)
    return F.struct(w.alias("words"), (w / one(F.size(X.lines(text)).cast("double"))).alias("per_para"), (w / one(count("[.!?]+"))).alias("sentence"), (count("[A-Z][a-z]+") * 1000 / one(w)).alias("names"))


def event_sequence(docs: DataFrame, triggers: dict[str, list[str]], key: str, text: str, parts: int = 12) -> DataFrame:
    """(key, segment, label, hits, lift): per segment the label whose triggers are densest against the whole corpus, if by ``LIFT`` or more.

    Of equal lifts the label named first wins. One pass gives the corpus rates; they are one row.
    """
    labels = list(triggers)
    whole = docs.select(trigger_counts(F.lower(text), triggers).alias("c"), F.size(X.words(F.col(text))).alias("n"))
    rates = whole.agg(*[F.greatest(F.lit(1e-9), F.sum(f"c.{k}") / F.greatest(F.lit(1), F.sum("n"))).alias(f"rate_{i}") for i, k in enumerate(labels)])
    # The words are a column of their own, so that the segments' slices don't split the text again.
    seg = docs.select(key, X.words(F.col(text)).alias("w")).where(F.size("w") > 0).select(key, F.posexplode(V.segments(F.col("w"), parts)).alias("segment", "ws"))
    seg = seg.select(key, "segment", F.greatest(F.size("ws"), F.lit(1)).alias("n"), trigger_counts(F.lower(F.array_join("ws", " ")), triggers).alias("c"))
    seg = seg.crossJoin(F.broadcast(rates))  # one row
    lifts = F.array(*[F.struct((F.col(f"c.{k}") / F.col("n") / F.col(f"rate_{i}")).alias("lift"), F.lit(-i).alias("o"), F.lit(k).alias("label"), F.col(f"c.{k}").alias("hits")) for i, k in enumerate(labels)])
    best = F.array_max(lifts)
    out = seg.select(key, "segment", best.alias("b"))
    return out.select(key, "segment", F.when(F.col("b.lift") >= LIFT, F.col("b.label")).alias("label"), F.when(F.col("b.lift") > 0, F.col("b.hits")).otherwise(0).alias("hits"), F.col("b.lift").alias("lift"))


def tension_curve(docs: DataFrame, high: list[str], low: list[str], key: str, text: str, parts: int = 12) -> DataFrame:
    """(key, segment, raw, tension): tense minus calm words in a hundred, and the same between 0 and 1 within a text."""
    # The words are a column of their own, so that the segments' slices don't split the text again.
    seg = docs.select(key, X.words(F.col(text)).alias("w")).where(F.size("w") > 0).select(key, F.posexplode(V.segments(F.col("w"), parts)).alias("segment", "ws"))
    bare = F.transform("ws", lambda x: X.strip_ends(F.lower(x)))
    count = lambda of: F.size(F.filter(bare, lambda x: x.isin(*of)))
    raw = (count(high) - count(low)) / F.greatest(F.lit(1), F.size("ws")) * 100
    over = Window.partitionBy(key)
    seg = seg.select(key, "segment", raw.alias("raw"))
    return seg.withColumn("tension", min_max(F.col("raw"), F.min("raw").over(over), F.max("raw").over(over)))


def candidate_names(docs: DataFrame, key: str, text: str, lang: str, common: int = 20, least: int = 3, top: int = 8) -> DataFrame:
    """(key, name, n, confidence, share): capitalised words in mid-sentence of English texts that the corpus doesn't often write small."""
    small = docs.select(F.explode(F.regexp_extract_all(text, F.lit(X.NAME_WORD), F.lit(0))).alias("w")).where(F.col("w").rlike("^[a-zß-ÿ]")).groupBy("w").agg(F.count("*").alias("c")).where(F.col("c") >= common)
    found = docs.where(F.col(lang) == "en").select(key, F.explode(F.regexp_extract_all(text, F.lit(MID_SENTENCE_NAME), F.lit(1))).alias("name")).where(~F.col("name").isin(*NAME_STOP))
    n = found.groupBy(key, "name").agg(F.count("*").alias("n")).withColumn("w", F.lower("name")).join(small, "w", "left_anti")
    n = n.withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    n = n.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "name"))).where((F.col("rank") <= top) & (F.col("n") >= least))
    return n.select(key, "name", "n", F.bround(F.least(F.lit(1.0), F.col("n") / 12), 2).alias("confidence"), F.bround(F.col("n") / F.col("total"), 3).alias("share"))
