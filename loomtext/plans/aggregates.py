"""Aggregations and ordered sequences over the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as V
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import relational as R
from ..operators.lexicon import count_lexicon, trigger_counts
from ..operators.search import inverted_index, term_counts
from .base import Tables, query

_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
_TOK = "regexp_extract_all(lower(text), '[a-zà-ÿ]+')"
_TRIGGERS = {"article": ["the", "das"], "motion": ["ing", "tion"]}
_CNT = lambda c, k: f"(length({c}) - length(replace({c}, '{k}', ''))) // {len(k)}"


@query(f"""WITH d AS (SELECT lower(text) AS t, len({_WORDS}) AS n FROM documents) SELECT round(greatest(1e-9, sum({_CNT('t', 'the')} + {_CNT('t', 'das')}) / greatest(1, sum(n))), 9) AS article, round(greatest(1e-9, sum({_CNT('t', 'ing')} + {_CNT('t', 'tion')}) / greatest(1, sum(n))), 9) AS motion FROM d""")
def ag01_event_rates(t: Tables):
    d = t.documents.select(trigger_counts(F.lower("text"), _TRIGGERS).alias("c"), F.size(X.words(F.col("text"))).alias("n"))
    rate = lambda k: F.round(F.greatest(F.lit(1e-9), F.sum(f"c.{k}") / F.greatest(F.lit(1), F.sum("n"))), 9).alias(k)
    return d.agg(rate("article"), rate("motion"))


@query("""WITH f(form, label) AS (VALUES ('of','prep'), ('of','prep'), ('de','prep'), ('is','verb'), ('es','verb')), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS tok FROM documents)
SELECT doc_id, label, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, label) AS rank FROM (SELECT doc_id, label, count(*) AS n FROM w JOIN f ON tok = form GROUP BY ALL)""")
def ag02_lexicon_counts(t: Tables):
    forms = t.spark.createDataFrame([("of", "prep"), ("of", "prep"), ("de", "prep"), ("is", "verb"), ("es", "verb")], "form string, label string")
    n = count_lexicon(t.documents, forms, "doc_id", "text")
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "label")).cast("long"))


@query(r"SELECT tok, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ɏ'']+')) AS tok FROM documents) WHERE regexp_matches(tok, '^[a-zß-ÿ]') AND length(tok) > 2 GROUP BY tok")
def ag03_lowercase_frequency(t: Tables):
    return t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(X.NAME_WORD), F.lit(0))).alias("tok")).where(F.col("tok").rlike("^[a-zß-ÿ]") & (F.length("tok") > 2)).groupBy("tok").agg(F.count("*").alias("n"))


@query("""SELECT r_name, count(*) AS n, CAST(count(*) FILTER (c_mktsegment = 'BUILDING') AS BIGINT) AS building, CAST(count(*) FILTER (c_mktsegment = 'MACHINERY') AS BIGINT) AS machinery
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def ag04_region_labels(t: Tables):
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    m = j.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n")).groupBy("r_name").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n"))).alias("by_label"))
    return m.select("r_name", "n", F.coalesce(F.col("by_label")["BUILDING"], F.lit(0).cast("long")).alias("building"), F.coalesce(F.col("by_label")["MACHINERY"], F.lit(0).cast("long")).alias("machinery"))


@query("""WITH c AS (SELECT lang, quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL) SELECT lang, round(sum(n) FILTER (quality IS NULL) / sum(n), 6) AS empty_rate, round(max(n) FILTER (quality IS NOT NULL) / sum(n), 6) AS top_share FROM c GROUP BY lang""")
def ag05_label_distribution(t: Tables):
    c = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left").groupBy("lang", "quality").agg(F.count("*").alias("n"))
    return c.groupBy("lang").agg(F.round(F.sum(F.when(F.col("quality").isNull(), F.col("n"))) / F.sum("n"), 6).alias("empty_rate"), F.round(F.max(F.when(F.col("quality").isNotNull(), F.col("n"))) / F.sum("n"), 6).alias("top_share"))


@query("""WITH l AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, CAST(sum(n) AS BIGINT) AS size, string_agg(lang, ',' ORDER BY n DESC, lang) AS langs FROM l GROUP BY source""")
def ag06_cluster_rollup(t: Tables):
    c = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    return c.groupBy("source").agg(F.sum("n").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "lang"))), lambda s: s["lang"]), ",").alias("langs"))


@query("""WITH q AS (SELECT source, count(*) AS n, min(n_chars) AS mn, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS med, quantile_cont(n_chars, 0.75) AS q3, max(n_chars) AS mx, avg(n_chars) AS mean, coalesce(stddev_samp(n_chars), 0) AS sd FROM documents GROUP BY source),
i AS (SELECT d.source, min(n_chars) AS wl, max(n_chars) AS wh FROM documents d JOIN q USING (source) WHERE n_chars BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY d.source),
o AS (SELECT source, string_agg(n_chars, ',' ORDER BY n_chars DESC) AS outliers FROM (SELECT d.source, n_chars, row_number() OVER (PARTITION BY d.source ORDER BY n_chars DESC) AS k FROM documents d JOIN q USING (source) WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)) WHERE k <= 12 GROUP BY source)
SELECT source, n, mn, q1, med, q3, mx, round(mean, 6) AS mean, round(sd, 6) AS sd, wl, wh, outliers FROM q JOIN i USING (source) LEFT JOIN o USING (source)""")
def ag07_five_numbers(t: Tables):
    f = A.five_numbers(t.documents, ["source"], "n_chars")
    return f.select("source", "n", F.col("min").alias("mn"), "q1", "med", "q3", F.col("max").alias("mx"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.col("whisker_low").alias("wl"), F.col("whisker_high").alias("wh"), F.array_join("outliers", ",").alias("outliers"))


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS books, count(*) < 110 AS small FROM documents GROUP BY lang")
def ag08_region_driver(t: Tables):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.size(F.collect_set("source")).cast("long").alias("books"), (F.count("*") < 110).alias("small"))


@query("""WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x, 1 + vec_id % 3 AS w FROM embeddings), m AS (SELECT label, d, sum(x * w) / sum(w) AS m FROM e GROUP BY ALL)
SELECT label, d - 1 AS dim, round(m / greatest(sqrt(sum(m * m) OVER (PARTITION BY label)), 1e-12), 6) AS x FROM m""")
def ag09_weighted_mean(t: Tables):
    m = A.vector_mean(t.embeddings, ["label"], "embedding", 1 + F.col("vec_id") % 3)
    return m.select("label", F.posexplode(V.l2(F.col("mean"))).alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query("""WITH e AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) % 2 AS half, embedding[1]::DOUBLE AS x FROM embeddings) SELECT label, CAST(half AS INT) AS half, round(avg(x), 6) AS m FROM e GROUP BY ALL""")
def ag10_half_means(t: Tables):
    e = t.embeddings.withColumn("half", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) % 2).cast("int"))
    return A.vector_mean(e, ["label", "half"], "embedding").select("label", "half", F.round(F.get("mean", F.lit(0)), 6).alias("m"))


@query("""SELECT least(a.label, b.label) AS la, greatest(a.label, b.label) AS lb, round(avg(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1, 2""")
def ag11_group_similarity(t: Tables):
    from ..operators.vectors import mean_similarity

    return mean_similarity(t.embeddings, "vec_id", "embedding", "label").select("la", "lb", F.round("sim", 6).alias("sim"))


@query("""WITH p AS (SELECT a.label = b.label AS same, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id), g AS (SELECT same, count(*) AS n, avg(s) AS m, var_samp(s) AS v FROM p GROUP BY same)
SELECT x.n AS n_within, y.n AS n_between, round(x.m - y.m, 6) AS diff, round((x.m - y.m) / sqrt((x.v + y.v) / 2), 5) AS d FROM g x JOIN g y ON x.same AND NOT y.same""")
def ag12_within_between(t: Tables):
    from ..operators.vectors import within_between

    w = within_between(t.embeddings, "vec_id", "embedding", "label")
    return w.select("n_within", "n_between", F.round("diff", 6).alias("diff"), F.round("d", 5).alias("d"))


@query(f"SELECT tok, count(*) AS n FROM (SELECT unnest({_TOK}) AS tok FROM documents) GROUP BY tok ORDER BY n DESC, tok LIMIT 100")
def ag13_top_words(t: Tables):
    return t.documents.select(F.explode(X.tokens(F.col("text"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tok").limit(100)


@query(r"WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS tok FROM documents) SELECT lower(tok) AS word FROM w GROUP BY 1 HAVING count(*) >= 5 AND count(*) FILTER (tok <> lower(tok)) >= 0.9 * count(*)")
def ag14_name_like(t: Tables):
    return A.name_like(t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("tok")))


@query(f"""WITH w AS (SELECT DISTINCT doc_id, unnest({_TOK}) AS term FROM documents), f AS (SELECT term, count(*) AS df FROM w GROUP BY term HAVING count(*) <= floor((SELECT count(*) FROM documents) * 0.4)) SELECT term, df, doc_id // 65536 AS shard, md5(string_agg(doc_id, ',' ORDER BY doc_id)) AS postings FROM w JOIN f USING (term) GROUP BY term, df, doc_id // 65536""")
def ag15_inverted_index(t: Tables):
    return inverted_index(t.documents, "doc_id", "text").select("term", "df", "shard", F.md5(F.array_join("postings", ",")).alias("postings"))


@query(f"""WITH w AS (SELECT source, unnest({_TOK}) AS tok FROM documents) SELECT source, count(*) FILTER (tok = 'the') AS the, count(*) FILTER (tok = 'of') AS of, count(*) FILTER (tok = 'que') AS que FROM w WHERE tok IN ('the', 'of', 'que') GROUP BY source""")
def ag16_contingency(t: Tables):
    w = t.documents.select("source", F.explode(X.tokens(F.col("text"))).alias("tok")).where(F.col("tok").isin("the", "of", "que"))
    return A.contingency(w, "source", "tok", ["the", "of", "que"])


@query("SELECT conv_id, max(length(text)) AS score, min_by(turn, (-length(text), turn)) AS position FROM conversations GROUP BY conv_id")
def ag17_max_over_chunks(t: Tables):
    c = t.conversations.withColumn("n", F.length("text").cast("long"))
    return c.groupBy("conv_id").agg(F.max("n").alias("score"), F.min_by("turn", F.struct(-F.col("n"), "turn")).alias("position"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) SELECT user_id, max(value) AS best, round(avg(value) FILTER (k <= 3), 6) AS top3 FROM r GROUP BY user_id""")
def ag18_owner_score(t: Tables):
    r = t.events.select("user_id", "value", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("k")).where("k <= 3")
    return r.groupBy("user_id").agg(F.max("value").alias("best"), F.round(F.avg("value"), 6).alias("top3"))


@query("""SELECT source, count(*) AS total, count(quality) AS done, CAST(coalesce(sum(n_chars) FILTER (quality IS NOT NULL), 0) AS BIGINT) AS done_chars, round(count(quality) / count(*), 6) AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def ag19_progress(t: Tables):
    j = t.documents.select("doc_id", "source", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("total"), F.count("quality").alias("done"), F.coalesce(F.sum(F.when(F.col("quality").isNotNull(), F.col("n_chars"))), F.lit(0)).alias("done_chars"), F.round(F.count("quality") / F.count("*"), 6).alias("share"))


@query("SELECT n_regionkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, 1")
def ag20_region_order(t: Tables):
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "n_regionkey")


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, list_aggregate(list_sort(list(DISTINCT lang)), 'string_agg', ',') AS list FROM documents GROUP BY source")
def ag21_home_grouping(t: Tables):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("lang")).alias("l")).select("source", "n", F.size("l").cast("long").alias("langs"), F.array_join("l", ",").alias("list"))


@query("WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_discount >= 0.08) SELECT kind, id, count(*) AS degree FROM (SELECT 'p' AS kind, a AS id FROM e UNION ALL SELECT 's', b FROM e) GROUP BY ALL")
def ag22_degree(t: Tables):
    e = t.lineitem.where("l_discount >= 0.08").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    ends = F.explode(F.array(F.struct(F.lit("p").alias("kind"), F.col("a").alias("id")), F.struct(F.lit("s").alias("kind"), F.col("b").alias("id"))))
    return e.select(ends.alias("e")).groupBy("e.kind", "e.id").agg(F.count("*").alias("degree"))


@query("SELECT DISTINCT unnest([lang, source]) AS label FROM documents ORDER BY 1")
def ag23_label_universe(t: Tables):
    return t.documents.select(F.explode(F.array("lang", "source")).alias("label")).distinct().orderBy("label")


@query("""WITH t AS (SELECT lang, count(DISTINCT doc_id) AS total FROM documents GROUP BY lang), r AS (SELECT d.lang, d.source, count(DISTINCT doc_id) / any_value(total) AS rate FROM documents d JOIN t USING (lang) GROUP BY d.lang, d.source),
b AS (SELECT source FROM r GROUP BY source ORDER BY max(rate) DESC, source LIMIT 14) SELECT lang, source, round(rate, 6) AS rate FROM r WHERE source IN (SELECT source FROM b)""")
def ag24_rate_matrix(t: Tables):
    return A.rate_matrix(t.documents, "lang", "source", "doc_id").select("lang", "source", F.round("rate", 6).alias("rate"))


@query("SELECT role, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM conversations GROUP BY role")
def ag26_state_share(t: Tables):
    n = t.conversations.groupBy("role").agg(F.count("*").alias("n"))
    return n.select("role", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("share"))


@query("SELECT lang, round(avg(quality), 6) AS rate, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang HAVING avg(quality) < 0.95")
def ag27_assignment_distribution(t: Tables):
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang").agg(F.avg("quality").alias("q"), F.count("*").alias("n")).where("q < 0.95").select("lang", F.round("q", 6).alias("rate"), "n")


@query("""SELECT doc_id, concat_ws(';', CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN contains(text, '%%%') THEN 'noise' END, CASE WHEN contains(text, ' | ') THEN 'table' END) AS reasons FROM documents""")
def ag28_threshold_reasons(t: Tables):
    c = F.col("text")
    r = F.array_compact(F.array(F.when(F.col("n_chars") < 200, "short"), F.when(c.contains("%%%"), "noise"), F.when(c.contains(" | "), "table")))
    return t.documents.select("doc_id", F.array_join(r, ";").alias("reasons"))


@query("SELECT event_type, count(*) AS failures, count(*) >= 2 AS needs_hc, bool_or(value > 100) AS any_ref FROM events WHERE value > 20 GROUP BY event_type")
def ag29_two_strike(t: Tables):
    return t.events.where("value > 20").groupBy("event_type").agg(F.count("*").alias("failures"), (F.count("*") >= 2).alias("needs_hc"), F.bool_or(F.col("value") > 100).alias("any_ref"))


@query("""SELECT user_id, min_by(event_type, (ts, event_id)) AS first_type, max_by(event_type, (ts, event_id)) AS last_type, count(*) FILTER (event_type = 'click') AS clicks, max(ts) FILTER (event_type = 'purchase') AS last_purchase FROM events GROUP BY user_id""")
def ag30_loop_facts(t: Tables):
    o = F.struct("ts", "event_id")
    return t.events.groupBy("user_id").agg(F.min_by("event_type", o).alias("first_type"), F.max_by("event_type", o).alias("last_type"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_purchase"))


@query("SELECT count(*) AS n, count(*) FILTER (toxic = 1) AS stale, bool_and(quality IN (0, 1)) AS all_disclosed FROM labels")
def ag31_freshness(t: Tables):
    return t.labels.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("stale"), F.bool_and(F.col("quality").isin(0, 1)).alias("all_disclosed"))


@query("SELECT source, median(n_chars) AS med FROM documents GROUP BY source ORDER BY med DESC, source LIMIT 5")
def ag32_top_medians(t: Tables):
    return t.documents.groupBy("source").agg(F.median("n_chars").alias("med")).orderBy(F.desc("med"), "source").limit(5)


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events QUALIFY event_type = 'purchase'")
def wn01_rank_of_target(t: Tables):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return t.events.select("user_id", "event_id", "event_type", F.row_number().over(w).cast("long").alias("rank")).where("event_type = 'purchase'").drop("event_type")


@query("SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 6")
def wn02_top_k(t: Tables):
    return R.top_k(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 6).select("c_nationkey", "c_custkey", F.col("rank").cast("long").alias("rank"))


@query("""WITH n AS (SELECT conv_id, turn, string_split(text, chr(10)) AS ps, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) SELECT conv_id, turn, len(ps) > 1 AND regexp_replace(upper(ps[len(ps)]), '[^A-Z0-9]+', '', 'g') IS NOT DISTINCT FROM regexp_replace(upper(nxt), '[^A-Z0-9]+', '', 'g') AS trimmed FROM n""")
def wn03_lead_title(t: Tables):
    n = t.conversations.select("conv_id", "turn", F.split("text", "\n").alias("ps"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("nxt"))
    return n.select("conv_id", "turn", ((F.size("ps") > 1) & X.key_of(F.element_at("ps", -1)).eqNullSafe(X.key_of(F.col("nxt")))).alias("trimmed"))


@query("SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), 9999) AS stop FROM conversations")
def wn04_section_end(t: Tables):
    return t.conversations.select("conv_id", "turn", F.coalesce(F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(9999)).alias("stop"))


@query("SELECT doc_id, row_number() OVER w AS seq, lead(doc_id) OVER w IS NULL AS is_last FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def wn05_sequence(t: Tables):
    w = Window.partitionBy("source").orderBy("doc_id")
    return t.documents.select("doc_id", F.row_number().over(w).cast("long").alias("seq"), F.lead("doc_id").over(w).isNull().alias("is_last"))


@query("SELECT l_orderkey, l_linenumber, prev FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS prev FROM lineitem) WHERE prev IS NOT NULL AND l_linenumber <> prev + 1")
def wn06_continuity(t: Tables):
    lag = F.lag("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return t.lineitem.select("l_orderkey", "l_linenumber", lag.alias("prev")).where("prev IS NOT NULL AND l_linenumber <> prev + 1")


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / greatest(stddev_pop(c_acctbal) OVER w, 1e-9), 6) AS z FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def wn07_zscore(t: Tables):
    return t.customer.select("c_custkey", F.round(R.zscore("c_acctbal", ["c_mktsegment"]), 6).alias("z"))


@query("SELECT vec_id, dim, round((x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-9), 5) AS z FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) WINDOW w AS (PARTITION BY vec_id)")
def wn08_row_zscore(t: Tables):
    e = t.embeddings.select("vec_id", F.posexplode("embedding").alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.col("x").cast("double").alias("x"))
    return e.select("vec_id", "dim", F.round(R.zscore("x", ["vec_id"]), 5).alias("z"))


@query("SELECT event_id, round((value - min(value) OVER w) / CASE WHEN max(value) OVER w = min(value) OVER w THEN 1 ELSE max(value) OVER w - min(value) OVER w END, 6) AS y FROM events WINDOW w AS (PARTITION BY user_id)")
def wn09_min_max(t: Tables):
    from ..functions.numeric import min_max

    w = Window.partitionBy("user_id")
    return t.events.select("event_id", F.round(min_max(F.col("value"), F.min("value").over(w), F.max("value").over(w)), 6).alias("y"))


@query("SELECT conv_id, turn, CAST(least(4, floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / count(*) OVER (PARTITION BY conv_id) * 5)) AS INT) AS quintile FROM conversations")
def wn10_quintile(t: Tables):
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return t.conversations.select("conv_id", "turn", F.least(F.lit(4), F.floor(i / F.count("*").over(Window.partitionBy("conv_id")) * 5)).cast("int").alias("quintile"))


@query("SELECT role AS state, nxt, count(*) AS n FROM (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL GROUP BY ALL")
def wn11_transitions(t: Tables):
    nxt = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select(F.col("role").alias("state"), nxt.alias("nxt")).where("nxt IS NOT NULL").groupBy("state", "nxt").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events), g AS (SELECT user_id, max(value) FILTER (k = 1) - max(value) FILTER (k = 2) AS gap FROM r GROUP BY user_id) SELECT round(median(gap), 6) AS gap FROM g")
def wn12_gap(t: Tables):
    r = R.top_k(t.events.select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.asc("event_id")], 2)
    g = r.groupBy("user_id").agg((F.max(F.when(F.col("rank") == 1, F.col("value"))) - F.max(F.when(F.col("rank") == 2, F.col("value")))).alias("gap"))
    return g.agg(F.round(F.median("gap"), 6).alias("gap"))


@query("""WITH m AS (SELECT lang, source, CAST(sum(n_chars) AS DOUBLE) AS m FROM documents GROUP BY ALL), c AS (SELECT *, sum(m) OVER (PARTITION BY lang ORDER BY m DESC, source ROWS UNBOUNDED PRECEDING) AS cum, sum(m) OVER (PARTITION BY lang) AS tot FROM m) SELECT lang, count(*) AS n FROM c WHERE cum - m < tot * 0.5 GROUP BY lang""")
def wn13_half_mass(t: Tables):
    m = t.documents.groupBy("lang", "source").agg(F.sum("n_chars").cast("double").alias("m"))
    w = Window.partitionBy("lang").orderBy(F.desc("m"), "source").rowsBetween(Window.unboundedPreceding, 0)
    c = m.select("*", F.sum("m").over(w).alias("cum"), F.sum("m").over(Window.partitionBy("lang")).alias("tot"))
    return c.where("cum - m < tot * 0.5").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE prev IS DISTINCT FROM role")
def wn14_dedup_consecutive(t: Tables):
    prev = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", "role", prev.alias("prev")).where("NOT prev <=> role").drop("prev")


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type = 'view' AS f FROM events), g AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS run FROM e) SELECT user_id, CAST(run AS BIGINT) AS run, min(n) AS first, max(n) AS last, count(*) AS length FROM g WHERE f GROUP BY user_id, run""")
def wn17_islands(t: Tables):
    e = t.events.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("n"), (F.col("event_type") == "view").alias("f"))
    return R.islands(e, ["user_id"], "n", "f")


@query("SELECT user_id, bool_or(ts < prev) AS broken FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) GROUP BY user_id")
def wn19_chronology(t: Tables):
    prev = F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.events.select("user_id", (F.col("ts") < prev).alias("b")).groupBy("user_id").agg(F.bool_or("b").alias("broken"))


@query("SELECT conv_id, turn, round((length(text) - avg(length(text)) OVER w) / greatest(stddev_pop(length(text)) OVER w, 1e-9), 6) AS z FROM conversations WINDOW w AS (PARTITION BY conv_id)")
def wn20_feature_standardisation(t: Tables):
    c = t.conversations.select("conv_id", "turn", F.length("text").alias("n"))
    return c.select("conv_id", "turn", F.round(R.zscore("n", ["conv_id"]), 6).alias("z"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) % 2 = 0 AS even FROM documents")
def wn21_even_odd(t: Tables):
    return t.documents.select("doc_id", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) % 2 == 0).alias("even"))


@query("""WITH q AS (SELECT quantile_cont(n_chars, 1/3.0) AS lo, quantile_cont(n_chars, 2/3.0) AS hi FROM documents), j AS (SELECT n_chars, quality, lo, hi FROM documents JOIN labels USING (doc_id), q)
SELECT round(avg(quality) FILTER (n_chars <= lo), 6) AS low, round(avg(quality) FILTER (n_chars > hi), 6) AS high FROM j""")
def wn22_tertiles(t: Tables):
    q = t.documents.agg(F.percentile("n_chars", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    j = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").crossJoin(F.broadcast(q))  # one row
    return j.agg(F.round(F.avg(F.when(F.col("n_chars") <= F.get("q", F.lit(0)), F.col("quality"))), 6).alias("low"), F.round(F.avg(F.when(F.col("n_chars") > F.get("q", F.lit(1)), F.col("quality"))), 6).alias("high"))
