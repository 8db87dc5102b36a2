"""Books split into sections, as plans over their lines: contents, headings, matches, sections.

Lines carry their place; blank-delimited blocks, tables of contents and sections are runs of
lines, found by windows over a book's lines. Nothing here works through a book in Python, and the
lines of one book are the most that a task has to hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .written import written

# Lines that open and close a table of contents, words in it that are no entries, titles that are no tales, and limits of a heading.
TOC_HEAD = r"(?i)^\s*(?:CONTENTS|TABLE OF CONTENTS|INHALT|INHALTSVERZEICHNIS|CONTENTS OF VOLUME.*)[.:]?\s*$"
TOC_STOP = r"(?i)^\s*(?:LIST OF ILLUSTRATIONS|ILLUSTRATIONS|LIST OF PLATES)[.:]?\s*$"
NOISE = ["PAGE", "SEITE", "PAGINA", "PAG", "CONTENTS", "INHALT"]
SKIP = ["PREFACE", "INTRODUCTION", "FOREWORD", "ACKNOWLEDGMENT", "ACKNOWLEDGMENTS", "DEDICATION", "NOTES", "NOTE", "APPENDIX", "BIBLIOGRAPHY", "GLOSSARY", "INDEX", "CONTENTS", "ILLUSTRATIONS", "LIST OF STORIES", "VORWORT", "ANMERKUNGEN"]
LEAD_NUMBER = r"^\s*(?:[IVXLCDM]+|\d+)\s*[.—–:)-]?\s+"
FOOTNOTE_TAIL = r"\s*\[\d+\]\s*$"
FLOW = r"\s+(?=[IVXLC]{1,8}\.\s+[A-ZÄÖÜ])"
FLOW_TAIL = r"(?i)\s+(?:" + "|".join(sorted([*SKIP, "NOTES AND REFERENCES"], key=lambda x: (-len(x), x))) + r")\.?\s*$"
ILLUSTRATION = r"(?s)^\[Illustration\b.*\]$"
HEADING_LINES, HEADING_CHARS, LINE_CHARS, SENTENCE_CHARS, PREFIX_CHARS = 3, 120, 80, 60, 12
TOC_BLANKS, TOC_ENTRIES, LEAST_WORDS, ENOUGH = 4, 5, 120, 4000
QUOTES = "\"“”«»'"


def plain(c: Column) -> Column:
    """Upper case, everything but letters and digits as single spaces."""
    return X.key_of(c, None)


def heading_key(c: Column) -> Column:
    return plain(F.regexp_replace(F.trim(c), LEAD_NUMBER, ""))


def lines_of(books: DataFrame, key: str, text: str, compatible: bool = False) -> DataFrame:
    """(book, i, line, blank, gap): lines by place; ``gap`` is how many blank lines stand right before one.

    ``compatible`` makes full-width and other compatible characters plain ones, so that titles meet headings in either form.
    """
    rows = books.select(F.col(key).alias("book"), F.posexplode(F.split(X.normalise(F.coalesce(text, F.lit("")), "NFKC") if compatible else F.coalesce(text, F.lit("")), "\n")).alias("i", "line"))
    rows = rows.withColumn("blank", F.trim("line") == "")
    over = Window.partitionBy("book").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("gap", F.col("i") - 1 - F.coalesce(F.max(F.when(~F.col("blank"), F.col("i"))).over(over), F.lit(-1)))


def blocks(lines: DataFrame) -> DataFrame:
    """(book, start, end, parts): runs of lines that aren't blank, trimmed."""
    over = Window.partitionBy("book").orderBy("i")
    full = lines.where("NOT blank").withColumn("run", F.sum(F.when(F.col("gap") > 0, 1).otherwise(0)).over(over))
    got = full.groupBy("book", "run").agg(F.min("i").alias("start"), F.max("i").alias("end"), F.array_sort(F.collect_list(F.struct("i", F.trim("line").alias("line")))).alias("p"))
    return got.select("book", "start", "end", F.col("p.line").alias("parts"))


def contents(lines: DataFrame, least: int = TOC_ENTRIES, blanks: int = TOC_BLANKS) -> DataFrame:
    """(book, head, n, i, entry): entries of each table of contents, which ends before ``blanks`` blank lines or another list."""
    over = Window.partitionBy("book").orderBy("i")
    rows = lines.where("NOT blank").withColumn("is_head", F.col("line").rlike(TOC_HEAD)).withColumn("head", F.max(F.when(F.col("is_head"), F.col("i"))).over(over)).where("head IS NOT NULL AND NOT is_head")
    within = Window.partitionBy("book", "head").orderBy("i")
    rows = rows.withColumn("entry", X.clean_entry(F.col("line"))).withColumn("good", (F.length(heading_key(F.col("entry"))) >= 3) & ~plain(F.col("entry")).isin(*NOISE))
    before = F.coalesce(F.count_if("good").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("stop", F.col("line").rlike(TOC_STOP) | ((F.col("gap") >= blanks) & (before > 0)))
    rows = rows.withColumn("over", F.max("stop").over(within)).where("NOT over AND good")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("book", "head"))).where(F.col("n") >= least)
    return rows.select("book", "head", "n", "i", "entry")


def flowing(entries: DataFrame) -> DataFrame:
    """Contents that run on from line to line, cut before each roman numeral with a point and a capital.

    Words that name back matter go from the end of the last title. Contents without such a numeral stay as they are.
    """
    rows = F.array_sort(F.collect_list(F.struct("i", "entry")))
    whole = entries.groupBy("book", "head", "n").agg(rows.alias("rows")).withColumn("parts", F.filter(F.transform(F.split(F.array_join(F.transform("rows", lambda s: s["entry"]), " "), FLOW), lambda x: F.trim(x)), lambda x: x != ""))
    last = F.size("parts") - 1
    parts = F.transform("parts", lambda x, i: F.when(i == last, F.trim(F.regexp_replace(x, FLOW_TAIL, ""))).otherwise(x))
    cut = F.when(F.size("parts") > 1, F.transform(parts, lambda x, i: F.struct(i.cast("int").alias("i"), x.alias("entry")))).otherwise(F.col("rows"))
    return whole.select("book", "head", "n", F.explode(cut).alias("e")).select("book", "head", "n", "e.i", "e.entry").where("entry <> ''")


def headings(blocks_: DataFrame, entries: DataFrame) -> DataFrame:
    """(book, start, end, key): short blocks outside the tables of contents that look like headings, by each of their keys.

    Keys are those of the whole block and of its first line, each also without a footnote's number.
    """
    spans = entries.groupBy("book", "head").agg(F.max("i").alias("last"))
    inside = blocks_.join(spans, "book").where("start BETWEEN head AND last").select("book", "start").distinct()
    b = blocks_.join(inside, ["book", "start"], "left_anti").where(F.size("parts") <= HEADING_LINES)
    joined = F.array_join("parts", " ")
    b = b.where((F.length(joined) <= HEADING_CHARS) & ~F.exists("parts", lambda x: F.length(x) > LINE_CHARS) & ~joined.rlike(r"^[\[~_*]"))
    b = b.withColumn("t", F.btrim(joined, F.lit(QUOTES))).where("t <> ''")
    prose = F.col("t").rlike("[.!?]$") & (F.length("t") > SENTENCE_CHARS) & (F.upper("t") != F.col("t"))
    b = b.where(~F.col("t").rlike("[,;:»”]$") & ~prose)
    names = F.array(F.col("t"), F.btrim(F.get("parts", F.lit(0)), F.lit(QUOTES)))
    keys = F.array_distinct(F.concat(F.transform(names, heading_key), F.transform(names, lambda x: heading_key(F.regexp_replace(x, FOOTNOTE_TAIL, "")))))
    return b.select("book", "start", "end", F.explode(keys).alias("key")).where("key <> ''")


def unwrapped(entries: DataFrame, heads: DataFrame) -> DataFrame:
    """Entries with those joined to the next that are headings only together with it; of a run of such entries every other one."""
    known = heads.select("book", "key").distinct().withColumn("known", F.lit(True))
    over = Window.partitionBy("book", "head").orderBy("i")
    e = entries.withColumn("both", F.concat_ws(" ", "entry", F.lead("entry").over(over))).withColumn("key", heading_key(F.col("entry"))).withColumn("both_key", F.when(F.lead("entry").over(over).isNotNull(), heading_key(F.col("both"))))
    e = e.join(known, ["book", "key"], "left").join(known.withColumnRenamed("key", "both_key").withColumnRenamed("known", "both_known"), ["book", "both_key"], "left")
    e = e.withColumn("wraps", F.col("known").isNull() & F.col("both_known").isNotNull())
    e = e.withColumn("place", F.row_number().over(over)).withColumn("last_other", F.coalesce(F.max(F.when(~F.col("wraps"), F.col("place"))).over(over), F.lit(0)))
    e = e.withColumn("joins", F.col("wraps") & ((F.col("place") - F.col("last_other")) % 2 == 1))
    e = e.withColumn("taken", F.coalesce(F.lag("joins").over(over), F.lit(False))).where("NOT taken")
    return e.select("book", "head", "n", "i", F.when(F.col("joins"), F.col("both")).otherwise(F.col("entry")).alias("entry"))


def matched(entries: DataFrame, heads: DataFrame) -> DataFrame:
    """(book, i, entry, start, end): headings of each entry's key; where there are none, those of the only key of which one begins the other."""
    e = entries.withColumn("key", heading_key(F.col("entry")))
    exact = e.join(heads, ["book", "key"])
    rest = e.join(exact.select("book", "i").distinct(), ["book", "i"], "left_anti").where(F.length("key") >= PREFIX_CHARS).withColumn("p", F.substring("key", 1, PREFIX_CHARS))
    # Where one of two keys of that length begins the other, they share their first letters, and those can be hashed.
    h = heads.where(F.length("key") >= PREFIX_CHARS).select("book", F.substring("key", 1, PREFIX_CHARS).alias("p"), F.col("key").alias("other"), "start", "end")
    near = rest.join(h, ["book", "p"]).where("startswith(key, other) OR startswith(other, key)")
    only = near.groupBy("book", "i").agg(F.count_distinct("other").alias("kinds")).where("kinds = 1").select("book", "i")
    names = ["book", "i", "entry", "start", "end"]
    return exact.select(*names).union(near.join(only, ["book", "i"]).select(*names))


def _sections(lines: DataFrame, starts: DataFrame, least_words: int, tail: DataFrame | None = None) -> DataFrame:
    """(book, pos, title, start, body): the lines from each (book, start, end, title) to the next or to the book's ``tail``."""
    marks = starts.select("book", F.col("start").alias("i"), F.struct("start", "end", "title").alias("s")).dropDuplicates(["book", "i"])
    over = Window.partitionBy("book").orderBy("i")
    rows = lines.join(marks, ["book", "i"], "left").withColumn("s", F.last("s", ignorenulls=True).over(over)).where("s IS NOT NULL AND i > s.end")
    if tail is not None:
        rows = rows.join(tail, "book", "left").where("tail IS NULL OR i < tail")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    out = rows.groupBy("book", "s").agg(F.btrim(F.regexp_replace(body, "\n{3,}", "\n\n"), F.lit(" \n\t")).alias("body"))
    out = out.where(F.size(F.filter(F.split("body", r"\s+"), lambda w: w != "")) >= least_words)
    return out.select("book", (F.row_number().over(Window.partitionBy("book").orderBy("s.start")) - 1).alias("pos"), F.trim("s.title").alias("title"), F.col("s.start").alias("start"), "body")


def following(lines: DataFrame, places: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """(book, start, follows): the letters between a heading and the next one; counting ends with the line that brings more than ``enough``."""
    marks = places.select("book", F.col("start").alias("i"), F.col("start").alias("at"))
    rows = lines.select("book", "i", F.length(F.trim("line")).alias("c")).join(marks, ["book", "i"], "left")
    rows = rows.withColumn("at", F.last("at", ignorenulls=True).over(Window.partitionBy("book").orderBy("i"))).where("i > at")
    upto = rows.withColumn("upto", F.sum("c").over(Window.partitionBy("book", "at").orderBy("i")))
    size = upto.groupBy("book", F.col("at").alias("start")).agg(F.coalesce(F.min(F.when(F.col("upto") > enough, F.col("upto"))), F.max("upto")).alias("follows"))
    return places.join(size, ["book", "start"], "left").select("book", "start", F.coalesce("follows", F.lit(0)).cast("long").alias("follows"))


def in_order(found: DataFrame) -> DataFrame:
    """(book, i, start): of each entry's candidates (book, i, start) the first behind the place that the entry before it took; the first of all if none is.

    A fold over a book's entries, which are no more than the lines of its contents.
    """
    each = found.groupBy("book", "i").agg(F.array_sort(F.collect_set("start")).alias("at")).groupBy("book").agg(F.array_sort(F.collect_list(F.struct("i", "at"))).alias("es"))
    none = F.expr("named_struct('cursor', -1, 'taken', cast(array() as array<struct<i: int, start: int>>))")

    def take(held, e):
        pick = F.coalesce(F.get(F.filter(e["at"], lambda k: k > held["cursor"]), F.lit(0)), F.get(e["at"], F.lit(0)))
        return F.struct(pick.alias("cursor"), F.array_append(held["taken"], F.struct(e["i"].alias("i"), pick.alias("start"))).alias("taken"))

    got = each.select("book", F.aggregate(F.transform("es", lambda e: F.struct(e["i"].cast("int").alias("i"), F.transform(e["at"], lambda k: k.cast("int")).alias("at"))), none, take)["taken"].alias("t"))
    return got.select("book", F.explode("t").alias("t")).select("book", "t.i", "t.start")


def by_contents(books: DataFrame, key: str, text: str, least_words: int = LEAST_WORDS, flow: bool = False, skip: list[str] | None = None, alias: dict[str, str] | None = None, stop_at: str | None = None, ordered: bool = False, compatible: bool = False, least_entries: int = TOC_ENTRIES) -> DataFrame:
    """(book, pos, title, start, body): sections under the headings that a book's longest table of contents names.

    An entry with several headings takes the one with most text before the next heading; in an ``ordered`` book,
    the first one behind the heading of the entry before it. ``alias`` gives entries
    the headings they mean; ``stop_at`` is a line that ends the last section; lists of fewer than ``least_entries`` are no contents.
    """
    lines = lines_of(books, key, text, compatible)
    # Entries and headings are a small part of the text and are used many times over.
    entries = written(contents(lines, least_entries), "entries")
    best = entries.groupBy("book").agg(F.max(F.struct("n", -F.col("head"))).alias("b")).select("book", (-F.col("b.col2")).alias("head"))
    heads = written(headings(blocks(lines), entries), "headings")
    listed = entries.join(best, ["book", "head"])
    listed = unwrapped(flowing(listed) if flow else listed, heads).where(~heading_key(F.col("entry")).isin(*SKIP, *[x.upper() for x in skip or []]))
    listed = listed.withColumn("title", F.col("entry"))
    for said, meant in (alias or {}).items():
        listed = listed.withColumn("entry", F.when(heading_key(F.col("entry")) == heading_key(F.lit(said)), F.lit(meant)).otherwise(F.col("entry")))
    found = matched(listed.select("book", "i", "entry"), heads).join(listed.select("book", "i", "title"), ["book", "i"])
    if ordered:
        found = written(found, "candidates")
        starts = found.join(in_order(found.select("book", "i", "start")), ["book", "i", "start"]).groupBy("book", "i", "start", "title").agg(F.max("end").alias("end"))
    else:
        sized = found.join(following(lines.where("NOT blank"), heads.select("book", "start").distinct()), ["book", "start"], "left")
        picked = sized.groupBy("book", "i", "title").agg(F.max(F.struct(F.coalesce("follows", F.lit(0)).alias("follows"), (-F.col("start")).alias("o"), "end")).alias("p"))
        starts = picked.select("book", (-F.col("p.o")).alias("start"), F.col("p.end").alias("end"), "title")
    starts = written(starts.select("book", "start", "end", "title"), "starts")
    tail = None
    if stop_at:
        first = starts.groupBy("book").agg(F.min("start").alias("first"))
        tail = lines.join(first, "book").where((F.col("i") > F.col("first")) & F.trim("line").rlike(stop_at)).groupBy("book").agg(F.min("i").alias("tail"))
    return _sections(lines, starts, least_words, tail)


def by_numbers(books: DataFrame, key: str, text: str, heading: str, roman: bool = True, least_words: int = LEAST_WORDS, take_from: int = 1, exclude: list[int] | None = None, stop_at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sections, problems): sections under numbered lines, and (book, problem) where the numbers aren't 1, 2, 3 and so on.

    ``heading`` has the number as group 1 and may have a title as group 2; without one the title is the
    next block that is no illustration mark. A heading stands after a blank line.
    """
    lines = lines_of(books, key, text)
    tail = None
    rows = lines
    if stop_at:
        tail = lines.where(F.trim("line").rlike(stop_at)).groupBy("book").agg(F.min("i").alias("tail"))
        rows = lines.join(tail, "book", "left").where("tail IS NULL OR i < tail")
    found = rows.where(F.trim("line").rlike(heading) & ((F.col("i") == 0) | (F.col("gap") > 0)))
    raw = F.regexp_extract(F.trim("line"), heading, 1)
    found = found.select("book", F.col("i").alias("start"), F.coalesce(X.roman_to_int(raw) if roman else raw.try_cast("int"), F.lit(0)).alias("number"), F.trim(F.regexp_extract(F.trim("line"), heading, 2)).alias("told"))
    order = Window.partitionBy("book").orderBy("start")
    found = found.withColumn("place", F.row_number().over(order))
    problems = found.where("number <> place").groupBy("book").agg(F.array_sort(F.collect_list("number")).alias("numbers")).select("book", F.concat(F.lit("not consecutive at "), F.array_join(F.slice("numbers", 1, 5), ", ")).alias("problem"))
    b = blocks(lines).where(~F.array_join("parts", " ").rlike(ILLUSTRATION)).select("book", F.col("start").alias("at"), "end", F.array_join("parts", " ").alias("name"))
    # The first block after each heading, by a window over both.
    both = b.withColumn("kind", F.lit(1)).unionByName(found.select("book", F.col("start").alias("at"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("kind")))
    ahead = Window.partitionBy("book").orderBy("at", "kind").rowsBetween(1, Window.unboundedFollowing)
    nxt = both.withColumn("next", F.first(F.when((F.col("kind") == 1) & F.col("name").isNotNull(), F.struct("at", "end", "name")), ignorenulls=True).over(ahead)).where("kind = 0")
    # The heading is a block too; what counts is the one after it.
    after = Window.partitionBy("book").orderBy("at")
    own = b.withColumn("then", F.lead(F.struct("at", "end", "name")).over(after)).select("book", F.col("at").alias("start"), "then")
    starts = found.join(own, ["book", "start"], "left").join(nxt.select("book", F.col("at").alias("start"), "next"), ["book", "start"], "left")
    block = F.coalesce("then", F.when(F.col("next.at") > F.col("start"), F.col("next")))
    told = F.col("told") != ""
    starts = starts.select("book", "start", "number", F.when(told, F.col("start")).otherwise(F.coalesce(block["end"], F.col("start"))).alias("end"), F.when(told, F.col("told")).otherwise(F.coalesce(block["name"], F.lit(""))).alias("title"))
    sections = _sections(lines, starts, least_words, tail)
    left_out = starts.where((F.col("number") < take_from) | F.col("number").isin(*(exclude or [-1]))).select("book", "start")
    return sections.join(left_out, ["book", "start"], "left_anti"), problems
