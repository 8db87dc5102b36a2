"""Splitting of books that are put together from the documents, so that the parts to be found are known."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import books as B
from ..operators import relational as R
from .base import Tables, query

_LONG = " and of the King of the Hills Beyond the Sea"
# A book has the documents of one source among so many ids, so books grow in number and not in size.
_IDS, _SHELVES = 1500, 18
_TALES = lambda book: f"""t AS (SELECT {book} AS source, doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body, row_number() OVER (PARTITION BY {book} ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL),
x AS (SELECT source, doc_id, body, k, 'Tale of the ' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || CASE WHEN k % 3 = 0 THEN '{_LONG}' ELSE '' END AS title FROM t),
s AS (SELECT source, doc_id, title, body, k FROM x WHERE len(string_split(body, ' ')) >= 120)"""  # noqa: E731
_BOOK = f"(source || '/' || (doc_id // {_IDS}))"
_SHELF = f"(source || '/' || (doc_id // {_IDS}) || '/' || (doc_id % {_SHELVES}))"


def _tales(t: Tables, shelves: bool = False, unnamed: str | None = None):
    """(source, doc_id, body, k, title): a book's name, its documents by place; with ``shelves``, books of 84 documents at most; documents without a source in the book ``unnamed``, if given."""
    parts = [F.col("source"), F.expr(f"doc_id div {_IDS}").cast("string"), *([(F.col("doc_id") % _SHELVES).cast("string")] if shelves else [])]
    name = F.concat_ws("/", *parts)
    if unnamed is not None:
        name = F.when(F.col("source").isNull(), unnamed).otherwise(name)
    d = t.documents.where("text IS NOT NULL").select(name.alias("source"), "doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("body"))
    d = d.withColumn("k", F.row_number().over(R.Window.partitionBy("source").orderBy("doc_id")))
    return d.withColumn("title", F.concat(F.lit("Tale of the "), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.when(F.col("k") % 3 == 0, _LONG).otherwise("")))


def _in_order(parts) -> F.Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", parts.alias("p")))), lambda s: s["p"]), "")


def _contents(k, title):
    """An entry of a table of contents; every third title runs over two lines."""
    leader = F.concat(F.lit(" . . . . "), k.cast("string"), F.lit("\n"))
    return F.when(k % 3 == 0, F.concat(F.replace(title, F.lit(" of the King"), F.lit("\nof the King")), leader)).otherwise(F.concat(title, leader))


@query(f"WITH {_TALES(_BOOK)} SELECT source, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS pos, title, md5(body) AS body FROM s")
def wn15_st18_split_by_contents(t: Tables):
    """Books of one source's documents under a table of contents: long titles wrap in it and are capitals in the text, and a book may have one document (ST-12, 13, 15, 18)."""
    text = F.concat(F.lit("\n\n\n"), F.upper("title"), F.lit("\n\n"), F.col("body"), F.lit("\n"))
    books = _tales(t, unnamed="").groupBy("source").agg(F.concat(F.lit("A book\n\nCONTENTS\n\nPreface . . . i\n"), _in_order(_contents(F.col("k"), F.col("title"))), F.lit("\n\n\n\n\nPREFACE\n\nNone.\n"), _in_order(text)).alias("text"))
    got = B.by_contents(books, "source", "text", least_entries=1)
    return got.select(F.nullif("book", F.lit("")).alias("source"), F.col("pos").cast("long").alias("pos"), "title", F.md5("body").alias("body"))


# Contents count from five lines on, the preface and second lines among them.
_LISTED = "n AS (SELECT source, count(*) + 1 + count(*) FILTER (k % 3 = 0) AS entries FROM x GROUP BY source)"


@query(f"WITH {_TALES(_BOOK)}, {_LISTED} SELECT source, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS pos, title, md5('Told again.' || chr(10) || chr(10) || upper(title) || chr(10) || chr(10) || body) AS body FROM x JOIN n USING (source) WHERE entries >= 5 AND 2 + len(string_split(title, ' ')) + len(string_split(body, ' ')) >= 120")
def wn15_ordered_split(t: Tables):
    """Books in the order of their contents whose titles stand in the text once more, with more text behind them than behind the heading (WN-15)."""
    text = F.concat(F.lit("\n\n\n"), F.upper("title"), F.lit("\n\nTold again.\n\n"), F.upper("title"), F.lit("\n\n"), F.col("body"), F.lit("\n"))
    books = _tales(t).groupBy("source").agg(F.concat(F.lit("A book\n\nCONTENTS\n\nPreface . . . i\n"), _in_order(_contents(F.col("k"), F.col("title"))), F.lit("\n\n\n\n\nPREFACE\n\nNone.\n"), _in_order(text)).alias("text"))
    got = B.by_contents(books, "source", "text", ordered=True)
    return got.select(F.col("book").alias("source"), F.col("pos").cast("long").alias("pos"), "title", F.md5("body").alias("body"))


@query(f"WITH {_TALES(_SHELF)} SELECT source, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS pos, CASE WHEN k % 3 = 0 THEN title ELSE 'Tale ' || k END AS title, md5(body) AS body FROM s WHERE k <> 4")
def st19_split_numbered(t: Tables):
    """Books with arabic numbers over their sections, titles in the line or in a block below an illustration's mark (ST-17, 19)."""
    head = F.concat(F.lit("\n\n\n"), F.col("k").cast("string"), F.lit("."))
    named = F.when(F.col("k") % 3 == 0, F.concat(F.lit("\n\n[Illustration: a hill]\n\n"), F.col("title"))).otherwise(F.concat(F.lit(" Tale "), F.col("k").cast("string")))
    books = _tales(t, shelves=True).groupBy("source").agg(F.concat(F.lit("A book"), _in_order(F.concat(head, named, F.lit("\n\n"), F.col("body"))), F.lit("\n\nTHE END OF ALL\n\nmore words")).alias("text"))
    got, _ = B.by_numbers(books, "source", "text", r"^(\d{1,3})\.(?:\s+(\S.*))?$", roman=False, exclude=[4], stop_at="^THE END OF ALL$")
    pos = F.row_number().over(R.Window.partitionBy("book").orderBy("start")) - 1
    return got.select(F.col("book").alias("source"), pos.cast("long").alias("pos"), "title", F.md5("body").alias("body"))


_ROMAN = "(['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX'])[k // 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[k % 10 + 1]"


@query(f"WITH {_TALES(_SHELF)} SELECT source, k - 1 AS pos, {_ROMAN} || '. ' || title || CASE WHEN count(*) OVER (PARTITION BY source) = 1 THEN ' Notes and References.' ELSE '' END AS entry FROM x")
def st14_flowing_contents(t: Tables):
    """Contents that run on over lines: numerals with points cut them into titles, and what follows the last one goes; a lone title stays as it is."""
    tens, ones = F.floor(F.col("k") / 10).cast("int"), (F.col("k") % 10).cast("int")
    names = lambda xs: F.array(*map(F.lit, xs))
    roman = F.concat(F.get(names(["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX"]), tens), F.get(names(["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]), ones))
    entry = F.concat(roman, F.lit(". "), F.col("title"), F.when(F.col("k") % 2 == 0, "\n").otherwise(" "))
    books = _tales(t, shelves=True).groupBy("source").agg(F.concat(F.lit("CONTENTS\n\n"), _in_order(entry), F.lit("Notes and References.\n\n\n\n\nEnd")).alias("text"))
    flow = B.flowing(B.contents(B.lines_of(books, "source", "text"), least=1))
    pos = F.row_number().over(R.Window.partitionBy("book", "head").orderBy("i")) - 1
    return flow.select(F.col("book").alias("source"), pos.cast("long").alias("pos"), "entry")


@query("""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), m AS (SELECT doc_id, i, length(trim(line)) AS c, CASE WHEN length(trim(line)) BETWEEN 1 AND 30 THEN i END AS h FROM l),
a AS (SELECT doc_id, i, c, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS hd FROM m), r AS (SELECT doc_id, hd, sum(c) OVER (PARTITION BY doc_id, hd ORDER BY i) AS s FROM a WHERE i > hd), f AS (SELECT doc_id, hd, coalesce(min(s) FILTER (s > 4000), max(s)) AS follows FROM r GROUP BY ALL)
SELECT m.doc_id, CAST(m.i AS BIGINT) AS start, CAST(coalesce(follows, 0) AS BIGINT) AS follows FROM m LEFT JOIN f ON f.doc_id = m.doc_id AND f.hd = m.i WHERE m.h IS NOT NULL""")
def wn16_following_length(t: Tables):
    """Short lines as headings, and how much text follows each."""
    lines = B.lines_of(t.documents, "doc_id", "text")
    places = lines.where(F.length(F.trim("line")).between(1, 30)).select("book", F.col("i").alias("start"))
    return B.following(lines, places).select(F.col("book").alias("doc_id"), F.col("start").cast("long").alias("start"), "follows")
