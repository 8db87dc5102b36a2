"""Filters, joins, sorts and set operations over the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import relational as R
from .base import Tables, query

#: Rows of a block of a join of all pairs.
PAIRED = 4096


@query("""SELECT printf('CC-%s-%03d', source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT)) AS story_id, doc_id, source AS book, lang AS language,
  CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS seq_in_book, 'ok' AS ml_processing_status, TRUE AS redistribution_allowed,
  'https://example.org/books/' || source AS source_url, length(text) AS char_count FROM documents""")
def pf01_story_row(t: Tables):
    seq = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return t.documents.select(F.format_string("CC-%s-%03d", "source", seq).alias("story_id"), "doc_id", F.col("source").alias("book"), F.col("lang").alias("language"), seq.alias("seq_in_book"), F.lit("ok").alias("ml_processing_status"), F.lit(True).alias("redistribution_allowed"), F.concat(F.lit("https://example.org/books/"), "source").alias("source_url"), F.length("text").cast("long").alias("char_count"))


@query("""WITH o AS (SELECT source FROM documents GROUP BY source HAVING count(*) = 50 AND min(n_chars) > 0) SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM o)""")
def pf02_quality_gate(t: Tables):
    good = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.min("n_chars").alias("least")).where("n = 50 AND least > 0")
    return t.documents.select("doc_id", "source").join(good, "source", "left_semi").select("doc_id", "source")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src3'")
def pf03_equality_filters(t: Tables):
    return R.where_given(t.documents, lang="en", source="src3", doc_id=None).select("doc_id", "lang", "source")


@query("SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'that')")
def pf04_array_contains(t: Tables):
    return t.documents.where(F.array_contains(F.split("text", " "), "that")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(lang), 'src1') OR len(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'src1'))) > 0")
def pf05_keyword(t: Tables):
    d = t.documents.withColumn("lines", F.split("text", "\n"))
    return d.where(R.matches_keyword("SRC1", ["source", "lang"], ["lines"])).select("doc_id")


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'a') OR contains(n_name, 'I') ORDER BY n_nationkey LIMIT 12")
def pf06_picker(t: Tables):
    return t.nation.where(F.lower("n_name").contains("a") | F.col("n_name").contains("I")).orderBy("n_nationkey").limit(12).select("n_nationkey", "n_name")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_discount FROM lineitem WHERE l_discount >= 0.05 AND (NOT TRUE OR NOT (l_partkey = l_suppkey))")
def pf07_edge_filter(t: Tables, least: float = 0.05, cross_only: bool = True):
    e = t.lineitem.where(F.col("l_discount") >= least)
    e = e.where(F.col("l_partkey") != F.col("l_suppkey")) if cross_only else e
    return e.select("l_orderkey", "l_partkey", "l_suppkey", "l_discount")


@query("SELECT d.doc_id, l.quality, l.quality IS NOT NULL AS mapped FROM documents d LEFT JOIN labels l USING (doc_id)")
def pf08_null_split(t: Tables):
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").withColumn("mapped", F.col("quality").isNotNull())


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en'")
def pf09_language_subset(t: Tables):
    return t.documents.where("lang = 'en'").select("doc_id", "n_chars")


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INT) AS n_words FROM documents WHERE lang = 'en' AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 300")
def pf10_length(t: Tables):
    return t.documents.where("lang = 'en'").select("doc_id", F.size(X.words(F.col("text"))).alias("n_words")).where("n_words >= 300")


@query(r"""WITH p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, turn FROM p WHERE b IS NOT NULL AND length(a) >= 30 AND len(list_filter(regexp_split_to_array(b, '\s+'), lambda x: x <> '')) >= 10""")
def pf11_paragraph_pairs(t: Tables):
    p = t.conversations.withColumn("b", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return p.where((F.length("text") >= 30) & (F.size(X.words(F.col("b"))) >= 10) & F.col("b").isNotNull()).select("conv_id", "turn")


@query("""SELECT doc_id, substring(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 60)[1], 1, 300) AS q FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 60)) > 0""")
def pf12_first_long_paragraph(t: Tables):
    long_ = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 60)
    return t.documents.where(F.size(long_) > 0).select("doc_id", F.substring(F.get(long_, F.lit(0)), 1, 300).alias("q"))


@query("""SELECT conv_id, string_agg(CAST(turn AS VARCHAR) || ':' || length(text), ',' ORDER BY turn) AS turns FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def pf13_labelled_rows(t: Tables):
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("rows"))
    kept = F.filter("rows", lambda r: r["role"] == "user")
    return rows.where(F.size(kept) > 0).select("conv_id", F.array_join(F.transform(kept, lambda r: F.concat_ws(":", r["turn"], r["n"])), ",").alias("turns"))


@query("SELECT doc_id, n_chars, CASE WHEN (SELECT avg(toxic) FROM labels) < 0.5 THEN lang END AS lang FROM documents")
def pf14_conditional_column(t: Tables):
    gate = t.labels.agg((F.avg("toxic") < 0.5).alias("open"))
    return t.documents.crossJoin(F.broadcast(gate)).select("doc_id", "n_chars", F.when(F.col("open"), F.col("lang")).alias("lang"))  # one row


@query()
def pf15_suspicious_edges(t: Tables):
    p = X.lines(F.col("text"))
    d = t.documents.where(F.size(p) > 0)
    return d.select("doc_id", F.array_join(X.suspicious_edge(F.get(p, F.lit(0)), False), ";").alias("head"), F.array_join(X.suspicious_edge(F.element_at(p, -1), True), ";").alias("tail"))


@query()
def pf16_edge_report(t: Tables):
    p = X.lines(F.col("text"))
    d = t.documents.where(F.size(p) > 0).select("doc_id", F.get(p, F.lit(0)).alias("first"), F.element_at(p, -1).alias("last"))
    structural = F.col("first").rlike(r"(?i)^\s*(?:CHAPTER|PART|BOOK|SECTION)\s+[IVXLC\d]+\.?\s*$")
    d = d.withColumn("why", F.concat(F.when(structural, F.array().cast("array<string>")).otherwise(X.suspicious_edge(F.col("first"), False)), X.suspicious_edge(F.col("last"), True)))
    return d.where(F.size("why") > 0).select("doc_id", F.size("why").alias("n_reasons"))


@query("""SELECT page_id, contains(html, '<article>') AND contains(html, '</article>') AND length(html) >= 2000 AS ok,
 CASE WHEN NOT contains(html, '<article>') THEN 'no start' WHEN NOT contains(html, '</article>') THEN 'no end' WHEN length(html) < 2000 THEN 'short' END AS reason FROM pages""")
def pf17_source_verification(t: Tables):
    h = F.col("html")
    reason = F.when(~h.contains("<article>"), "no start").when(~h.contains("</article>"), "no end").when(F.length(h) < 2000, "short")
    return t.pages.select("page_id", reason.isNull().alias("ok"), reason.alias("reason"))


@query(r"""SELECT doc_id, regexp_matches(text, '[\x{0400}-\x{052F}]') AS cyrillic, regexp_matches(text, '[\x{1100}-\x{11FF}\x{AC00}-\x{D7AF}]') AS hangul, regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') AS control FROM documents""")
def pf18_hygiene(t: Tables):
    h = X.hygiene(F.col("text"))
    return t.documents.select("doc_id", *[F.array_contains(h, k).alias(k) for k in ("cyrillic", "hangul", "control")])


@query("SELECT page_id, contains(replace(html, chr(13) || chr(10), ''), chr(13)) AS stray_cr FROM pages")
def pf19_stray_cr(t: Tables):
    return t.pages.select("page_id", X.stray_cr(F.col("html")).alias("stray_cr"))


@query("SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')")
def pf20_control_chars(t: Tables):
    """Texts with a control character put into every fifth one, and with tabs and line ends, which are none, into the others."""
    odd = F.when(F.col("doc_id") % 5 == 0, F.char(1 + F.col("doc_id") % 8)).otherwise(F.lit("\t\r\n"))
    return t.documents.where(F.concat("text", odd, F.lit("end")).rlike(X.CONTROL)).select("doc_id")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def jn01_inner(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def jn02_left_default(t: Tables):
    return R.join_with_default(t.documents.select("doc_id"), t.labels, "doc_id", {"quality": -1, "toxic": -1})


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents")
def jn03_semi_flag(t: Tables):
    return R.flag_present(t.documents.select("doc_id"), t.labels, "doc_id", "labelled")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def jn04_anti(t: Tables):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def jn05_composite_resolve(t: Tables):
    left = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    with_part = R.require_all(left, t.part.select("p_partkey", "p_name"), ["p_partkey"], "part")
    return R.require_all(with_part, t.supplier.select("s_suppkey", "s_name"), ["s_suppkey"], "supplier").select("l_orderkey", "l_linenumber", "p_name", "s_name")


_SIM = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND a.s_nationkey <> b.s_nationkey")
def jn06_theta_self(t: Tables):
    """Suppliers meet in pairs of blocks, so all tasks have a share of the pairs and none holds the table."""
    rows = t.supplier.where("s_suppkey IS NOT NULL AND s_nationkey IS NOT NULL").select("s_suppkey", "s_nationkey")
    n = max(1, -(-rows.count() // PAIRED))
    block, others = F.pmod(F.xxhash64("s_suppkey"), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = rows.select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("na"), block.alias("i"), others.alias("j"))
    b = rows.select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("nb"), others.alias("i"), block.alias("j"))
    return a.hint("shuffle_merge").join(b, ["i", "j"]).where("a < b AND na <> nb").select("a", "b")


@query("SELECT (a.s_nationkey = b.s_nationkey) AS same, count(*) AS pairs, round(avg(abs(a.s_acctbal - b.s_acctbal)), 4) AS gap FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey GROUP BY 1")
def jn07_triangle(t: Tables):
    """Pairs of suppliers in the order of their keys, by whether they share a nation; counts and sums of gaps follow from groups of suppliers, without a row per pair."""
    from ..operators.aggregates import pair_gaps

    rows = t.supplier.where("s_suppkey IS NOT NULL").select("s_suppkey", "s_nationkey", "s_acctbal")
    again = rows.groupBy("s_suppkey").agg((F.count("*") > 1).alias("again")).where("again")
    # All pairs, those with both nations known, those within a nation; pairs of one key, which have no order, are taken away from each.
    kinds = lambda key: F.array(*[F.struct(F.lit(k).alias("kind"), n.alias("nation"), key.alias("key"), ok.alias("ok")) for k, n, ok in (("all", F.lit(None).cast("int"), F.lit(True)), ("known", F.lit(None).cast("int"), F.col("s_nationkey").isNotNull()), ("same", F.col("s_nationkey"), F.col("s_nationkey").isNotNull()))])
    every = rows.select("s_acctbal", F.explode(kinds(F.lit(None).cast("long"))).alias("g"))
    one = rows.join(again, "s_suppkey", "left_semi").select("s_acctbal", F.explode(kinds(F.col("s_suppkey"))).alias("g"))
    got = pair_gaps(every.union(one).where("g.ok").select("g.kind", "g.nation", "g.key", "s_acctbal"), ["kind", "nation", "key"], "s_acctbal")
    total = lambda k, c: F.coalesce(F.sum(F.when(F.col("kind") == k, F.when(F.col("key").isNull(), F.col(c)).otherwise(-F.col(c)))), F.lit(0))
    sums = got.agg(*[total(k, c).alias(f"{k}_{c}") for k in ("all", "known", "same") for c in ("pairs", "valued", "gap")])
    part = lambda same, one, less: F.struct(F.lit(same).cast("boolean").alias("same"), *[(F.col(f"{one}_{c}") - (F.col(f"{less}_{c}") if less else F.lit(0))).alias(c) for c in ("pairs", "valued", "gap")])
    out = sums.select(F.explode(F.array(part(True, "same", None), part(False, "known", "same"), part(None, "all", "known"))).alias("p")).select("p.*").where("pairs > 0")
    return out.select("same", "pairs", F.round(F.when(F.col("valued") > 0, F.col("gap") / F.col("valued")), 4).alias("gap"))


@query("""WITH f(form, label) AS (VALUES ('the','det'), ('the','det'), ('that','det'), ('and','conj'), ('que','conj'), ('und','conj')), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS tok FROM documents)
SELECT doc_id, label, count(*) AS n FROM w JOIN f ON tok = form GROUP BY ALL""")
def jn12_lexicon_join(t: Tables):
    from ..operators.lexicon import count_lexicon

    forms = t.spark.createDataFrame([("the", "det"), ("the", "det"), ("that", "det"), ("and", "conj"), ("que", "conj"), ("und", "conj")], "form string, label string")
    return count_lexicon(t.documents, forms, "doc_id", "text")


@query("""WITH p AS (SELECT conv_id, role, list(text ORDER BY turn) AS ts FROM conversations GROUP BY ALL), a AS (SELECT conv_id, ts AS x FROM p WHERE role = 'user'), b AS (SELECT conv_id, ts AS y FROM p WHERE role = 'assistant'),
z AS (SELECT conv_id, x, y, unnest(range(1, len(x) + 1)) AS i FROM a JOIN b USING (conv_id) WHERE len(x) = len(y))
SELECT conv_id, CAST(i - 1 AS INT) AS pos, CAST(length(x[i]) AS INT) AS nx, CAST(length(y[i]) AS INT) AS ny FROM z""")
def jn13_zip(t: Tables):
    side = lambda r, n: t.conversations.where(F.col("role") == r).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias(n))
    z = side("user", "x").join(side("assistant", "y"), "conv_id").where(F.size("x") == F.size("y"))
    z = z.select("conv_id", F.posexplode(F.arrays_zip("x", "y")).alias("pos", "p"))
    return z.select("conv_id", "pos", F.length("p.x").alias("nx"), F.length("p.y").alias("ny"))


@query("""SELECT doc_id FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS tok FROM documents) WHERE tok IN ('the', 'from', 'with') GROUP BY doc_id HAVING count(*) = 3""")
def jn14_posting_intersection(t: Tables):
    from ..operators.search import search_all

    return search_all(t.documents, ["the", "from", "with"], "doc_id", "text")


@query("""WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events),
c AS (SELECT user_id, line - 1 AS voids FROM e WHERE event_type = 'refund' AND line > 1)
SELECT event_id FROM e WHERE event_type <> 'refund' AND NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = e.user_id AND c.voids = e.line)""")
def jn15_void_superseded(t: Tables):
    from ..operators.eventlog import without_voided

    e = t.events.withColumn("line", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    e = e.withColumn("supersedes", F.when((F.col("event_type") == "refund") & (F.col("line") > 1), F.col("line") - 1))
    return without_voided(e, "user_id", "line", "supersedes", F.col("event_type") == "refund").select("event_id")


@query("""SELECT o_orderkey, count(*) AS newer FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 90 DAY GROUP BY o_orderkey""")
def jn16_newer_inputs(t: Tables):
    j = t.orders.select("o_orderkey", "o_orderdate").join(t.lineitem.select("l_orderkey", "l_shipdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.where(F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 90 DAY")).groupBy("o_orderkey").agg(F.count("*").alias("newer"))


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def jn17_dimension(t: Tables):
    dim = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return t.supplier.join(dim, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query("SELECT l.doc_id, d.doc_id IS NULL AS rejected FROM (SELECT doc_id * 3 AS doc_id FROM labels) l LEFT JOIN documents d USING (doc_id)")
def jn18_reject_unknown(t: Tables):
    batch = t.labels.select((F.col("doc_id") * 3).alias("doc_id"))
    return batch.join(t.documents.select("doc_id", F.lit(1).alias("known")), "doc_id", "left").select("doc_id", F.col("known").isNull().alias("rejected"))


@query("""WITH c AS (SELECT source, list(doc_id ORDER BY doc_id)[1:6] AS ids FROM documents GROUP BY source), x AS (SELECT source, unnest(ids) AS doc_id FROM c) SELECT source, string_agg(lang || doc_id, ',' ORDER BY doc_id) AS titles FROM x JOIN documents d USING (source, doc_id) GROUP BY source""")
def jn19_cluster_titles(t: Tables):
    x = R.top_k(t.documents.select("doc_id", "lang", "source"), ["source"], [F.asc("doc_id")], 6)
    return x.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "lang"))), lambda r: F.concat(r["lang"], r["doc_id"])), ",").alias("titles"))


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY source, doc_id")
def so01_sort(t: Tables):
    return t.documents.select("doc_id", "source", "n_chars").orderBy("source", "doc_id")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def so04_edges_by_score(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20)


@query("SELECT c_mktsegment, median(c_acctbal) AS med FROM customer GROUP BY 1 ORDER BY med DESC")
def so05_by_median(t: Tables):
    return t.customer.groupBy("c_mktsegment").agg(F.median("c_acctbal").alias("med")).orderBy(F.desc("med"))


@query("SELECT vec_id, round(sqrt(pow(embedding[1]::DOUBLE, 2) + pow(embedding[2]::DOUBLE, 2)), 6) AS r FROM embeddings ORDER BY sqrt(pow(embedding[1]::DOUBLE, 2) + pow(embedding[2]::DOUBLE, 2)) DESC, vec_id LIMIT 26")
def so06_farthest(t: Tables):
    r = F.hypot(F.get("embedding", F.lit(0)).cast("double"), F.get("embedding", F.lit(1)).cast("double"))
    return t.embeddings.select("vec_id", r.alias("d")).orderBy(F.desc("d"), "vec_id").limit(26).select("vec_id", F.round("d", 6).alias("r"))


@query("""WITH z AS (SELECT doc_id, source, (n_chars - avg(n_chars) OVER w) / greatest(stddev_pop(n_chars) OVER w, 1e-9) AS z FROM documents WINDOW w AS (PARTITION BY source))
SELECT doc_id, source, round(z, 6) AS z FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY z DESC, doc_id) AS k FROM z WHERE z >= 0.3) WHERE k <= 4""")
def so07_threshold_then_cap(t: Tables):
    z = t.documents.select("doc_id", "source", R.zscore("n_chars", ["source"]).alias("z")).where("z >= 0.3")
    return R.top_k(z, ["source"], [F.desc("z"), F.asc("doc_id")], 4).select("doc_id", "source", F.round("z", 6).alias("z"))


@query("""WITH m AS (SELECT lang, source, avg(n_chars) AS a FROM documents GROUP BY ALL) SELECT source, round(stddev_pop(a), 4) AS spread, max_by(lang, (a, lang)) AS hi, min_by(lang, (a, lang)) AS lo FROM m GROUP BY source ORDER BY spread DESC, source LIMIT 20""")
def so08_spread(t: Tables):
    m = t.documents.groupBy("lang", "source").agg(F.avg("n_chars").alias("a"))
    s = m.groupBy("source").agg(F.round(F.stddev_pop("a"), 4).alias("spread"), F.max_by("lang", F.struct("a", "lang")).alias("hi"), F.min_by("lang", F.struct("a", "lang")).alias("lo"))
    return s.orderBy(F.desc("spread"), "source").limit(20)


@query("SELECT lang, count(*) AS total FROM documents GROUP BY lang ORDER BY total DESC, lang")
def so09_by_total(t: Tables):
    return t.documents.groupBy("lang").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "lang")


@query("SELECT l_partkey, min_by(l_suppkey, (l_extendedprice, l_suppkey)) AS best FROM lineitem GROUP BY l_partkey")
def so11_argmin(t: Tables):
    return t.lineitem.groupBy("l_partkey").agg(F.min_by("l_suppkey", F.struct("l_extendedprice", "l_suppkey")).alias("best"))


@query("SELECT doc_id AS id, 'd' AS kind FROM documents UNION ALL SELECT item_id, 'b' FROM benchmark")
def se01_union(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), F.lit("d").alias("kind")).unionByName(t.benchmark.select(F.col("item_id").alias("id"), F.lit("b").alias("kind")))


@query("""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS ws FROM documents), b AS (SELECT list_distinct(regexp_extract_all(lower(string_agg(text, ' ')), '[a-zà-ÿ]+')) AS q FROM benchmark)
SELECT doc_id, round(len(list_intersect(ws, q)) / greatest(1, len(ws)), 6) AS overlap FROM w, b""")
def se02_overlap(t: Tables):
    q = t.benchmark.select(F.explode(X.tokens(F.col("text"))).alias("w")).distinct().withColumn("in_", F.lit(1))
    # Tokens meet tokens: the other side has one row per token, whatever the benchmark's size.
    w = t.documents.select("doc_id", F.explode_outer(F.array_distinct(X.tokens(F.col("text")))).alias("w")).join(q, "w", "left")
    return w.groupBy("doc_id").agg(F.round(F.count("in_") / F.greatest(F.lit(1), F.count("w")), 6).alias("overlap"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def se03_difference(t: Tables):
    return t.documents.select("doc_id").exceptAll(t.labels.select("doc_id").distinct())


@query("""WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem) SELECT least(a, b) AS lo, greatest(a, b) AS hi, min(a) AS first_src FROM e GROUP BY 1, 2""")
def se04_undirected(t: Tables):
    e = t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return R.undirected(e, "a", "b", [F.asc("a"), F.asc("b")]).select("lo", "hi", F.col("a").alias("first_src"))


@query("""WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS tok FROM benchmark UNION SELECT unnest(['the', 'of'])) SELECT tok, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS tok FROM documents) WHERE tok NOT IN (SELECT tok FROM s) GROUP BY tok HAVING count(*) >= 30""")
def se05_stop_union(t: Tables):
    stop = t.benchmark.select(F.explode(X.tokens(F.col("text"))).alias("tok")).union(t.spark.createDataFrame([("the",), ("of",)], "tok string")).distinct()
    return t.documents.select(F.explode(X.tokens(F.col("text"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("n")).where("n >= 30").join(stop, "tok", "left_anti").select("tok", "n")


@query(r"""WITH p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT conv_id, turn, len(regexp_extract_all(a, '\d+')) < 2 OR len(list_intersect(regexp_extract_all(a, '\d+'), regexp_extract_all(b, '\d+'))) > 0 AS ok FROM p WHERE b IS NOT NULL""")
def se06_shared_numerals(t: Tables):
    p = t.conversations.withColumn("b", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    n = lambda c: F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    return p.select("conv_id", "turn", ((F.size(n("text")) < 2) | F.arrays_overlap(n("text"), n("b"))).alias("ok"))
