"""URL filter: rules first, then host word segmentation and naive Bayes.

Hosts run words together. A unigram Viterbi splits each host label into the most probable
words, with word frequencies counted over the corpus (page texts and the seed words), and a
multinomial naive Bayes over the words of host and path gives the verdict where no rule fits.

The classes are learned from the corpus itself: urls whose segmented host has a seed word are
the examples to block, all others those to allow. Counts cover all rows; every word counts once
more in each class, and so does one word not seen.

Nothing that grows with the corpus is broadcast: candidate substrings of the distinct labels
are joined with the word counts, and url words with the table of word weights.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and is
judged by the prior alone; empty parts likewise; characters outside the alphabet split words;
repeated rows and keys are judged alike; an empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, shuffle_width, tune

#: (host, path prefix, verdict); the longest that fits a url wins.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Words that mark hosts to block, as examples for the classifier.
SEEDS = ["adult", "ads", "bet", "bets", "casino", "cheap", "click", "farm", "free", "gambling", "jackpot", "loan", "loans", "pills", "poker", "porn", "sex", "spam", "track", "viagra", "win", "xxx"]
#: Longest word that a label is split into; count that a seed word starts from; share of an unknown character.
LONGEST, SEED_COUNT, UNKNOWN = 24, 1000, 1e-9


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host_ and path_."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(coalesce(cast(`{url}` as string), ''), instr(coalesce(cast(`{url}` as string), ''), '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("host_", lower).withColumn("path_", path)


def by_rules(parts: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds rule_ and ruled_; the rules are constants, tried from the longest to the shortest."""
    rule, verdict = None, None
    for host, path, what in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host_") == host) | F.col("host_").endswith(f".{host}")) & F.col("path_").startswith(path)
        rule = F.when(fits, F.lit(host + path)) if rule is None else rule.when(fits, F.lit(host + path))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    none = F.lit(None).cast("string")
    return parts.withColumn("rule_", rule if rule is not None else none).withColumn("ruled_", verdict if verdict is not None else none)


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n): frequencies of the lower-case words of the page texts, tags aside."""
    text = F.regexp_replace(F.coalesce(F.col(html).cast("string"), F.lit("")), r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(text), r"[^a-z0-9]+")).alias("word"))
    return words.where(F.length("word").between(1, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))


def best_split(label: str, cost: dict[str, float], unknown: float) -> list[str]:
    """The cheapest way to write ``label`` as words; characters of no word stand alone at ``unknown`` each."""
    n = len(label)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(max(0, j - LONGEST), j):
            c = cost.get(label[i:j])
            if c is None and j - i == 1:
                c = unknown
            if c is not None and best[i] + c < best[j]:
                best[j], back[j] = best[i] + c, i
    out, j = [], n
    while j:
        out.append(label[back[j] : j])
        j = back[j]
    return out[::-1]


def segmented(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) for distinct labels: their substrings are joined with the counts, then split by Viterbi."""
    subs = labels.select("label", F.explode(F.expr(f"flatten(transform(sequence(1, length(label)), i -> transform(sequence(1, least({LONGEST}, length(label) - i + 1)), n -> substring(label, i, n))))")).alias("word"))
    total = counts.agg(F.sum("n").cast("double").alias("total"))
    known = subs.distinct().join(counts, "word").groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))
    held = labels.join(known, "label", "left").crossJoin(F.broadcast(total))  # one row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for label, words, counts_, total in zip(batch["label"], batch["words"], batch["counts"], batch["total"], strict=True):
                total = total or 1.0
                cost = {w: -math.log(c / total) for w, c in zip(words if words is not None else (), counts_ if counts_ is not None else (), strict=True)}
                out.append(best_split(label, cost, -math.log(UNKNOWN)))
            yield pd.DataFrame({"label": batch["label"], "words": out})

    # A label is few bytes but many steps, so the labels are dealt evenly whatever their size.
    held = held.repartition(shuffle_width(labels.sparkSession), "label")
    return held.select("label", F.map_keys("known").alias("words"), F.map_values("known").alias("counts"), "total").mapInPandas(run, "label string, words array<string>")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules: list[tuple[str, str, str]] = RULES, seeds: list[str] = SEEDS) -> DataFrame:
    """Per row: key, host, path, rule, verdict, words (of host and path), score (log odds of block)."""
    spark = pages.sparkSession
    tune(spark)
    parts = by_rules(with_parts(pages, url), rules)
    parts = parts.select(F.col(key).alias("key_"), F.monotonically_increasing_id().alias("row_"), "host_", "path_", "rule_", "ruled_")
    parts = materialize(parts, "urls")
    split = lambda c: F.filter(F.split(F.lower(F.col(c)), r"[^a-z0-9]+"), lambda x: x != "")
    seed_rows = spark.createDataFrame([(w, SEED_COUNT) for w in seeds], "word string, n long")
    counts = word_counts(pages, html).union(seed_rows).groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "words")
    labels = parts.select(F.explode(split("host_")).alias("label")).distinct()
    pieces = materialize(segmented(labels, counts), "labels")
    hosts = parts.select("host_").distinct().select("host_", F.explode(split("host_")).alias("label")).join(pieces, "label")
    hosts = hosts.select("host_", F.explode("words").alias("word")).groupBy("host_").agg(F.collect_list("word").alias("words"))
    hosts = hosts.withColumn("seeded", F.arrays_overlap("words", F.array(*[F.lit(w) for w in seeds])))
    hosts = materialize(hosts, "hosts")
    rows = parts.join(hosts, "host_", "left").withColumn("bad", F.coalesce("seeded", F.lit(False)))
    rows = rows.withColumn("words", F.concat(F.coalesce("words", F.array().cast("array<string>")), split("path_")))
    rows = materialize(rows.drop("seeded"), "judged")
    words = rows.select("row_", "bad", F.explode("words").alias("word"))
    by_word = words.groupBy("word").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g"))
    by_word = materialize(by_word, "word-classes")
    mass = by_word.agg(F.sum("b"), F.sum("g"), F.count("*")).first()
    docs = rows.agg(F.count_if("bad"), F.count("*")).first()
    b, g, v = (float(x or 0) for x in mass)
    prior = math.log((docs[0] + 1) / (docs[1] - docs[0] + 1))
    weight = F.log((F.col("b") + 1) / F.lit(b + v + 1)) - F.log((F.col("g") + 1) / F.lit(g + v + 1))
    weights = by_word.select("word", weight.alias("w"))
    # Sums per row are taken per partition of words first; the join's other side has one row per word.
    scores = words.groupBy("row_", "word").agg(F.count("*").alias("n")).join(weights, "word").groupBy("row_").agg(F.sum(F.col("n") * F.col("w")).alias("s"))
    out = rows.join(scores, "row_", "left").withColumn("score", F.coalesce("s", F.lit(0.0)) + F.lit(prior))
    verdict = F.coalesce("ruled_", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return out.select(F.col("key_").alias(key), F.col("host_").alias("host"), F.col("path_").alias("path"), F.col("rule_").alias("rule"), verdict.alias("verdict"), "words", "score")
