"""Further joins, searches, splits and controls over the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as V
from ..operators import evaluation as E
from ..operators import pairscore as P
from ..operators import relational as R
from ..operators import vectors as K
from .base import Tables, query

_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"""WITH s AS (SELECT a.vec_id AS q, b.label AS owner, b.vec_id AS w, {_DOT} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) SELECT q, owner, round(max(s), 6) AS score FROM s GROUP BY ALL""")
def jn09_query_windows(t: Tables):
    """Best window of every owner for each query; owners are few, so each query keeps one row per owner."""
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    pool = t.embeddings.select(F.col("vec_id").alias("w"), F.col("label").alias("owner"), "embedding")
    return K.best_by_owner(q, pool, "q", "qv", "owner", "embedding").select("q", "owner", F.round("score", 6).alias("score"))


@query("""WITH l AS (SELECT label, list(embedding ORDER BY vec_id)[1] AS v FROM embeddings GROUP BY label) SELECT e.vec_id, l.label AS topic, round(list_dot_product(e.embedding::DOUBLE[], l.v::DOUBLE[]), 6) AS s FROM embeddings e, l""")
def jn10_label_descriptions(t: Tables):
    labels = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).select(F.col("label").alias("topic"), "v")
    return t.embeddings.crossJoin(F.broadcast(labels)).select("vec_id", "topic", F.round(V.dot(F.col("embedding"), F.col("v")), 6).alias("s"))  # one row per label


@query("""WITH h(label, w) AS (VALUES ('long', 1), ('short', -1)) SELECT conv_id, turn, label, length(text) * w AS score FROM conversations, h""")
def jn11_hypotheses(t: Tables):
    h = t.spark.createDataFrame([("long", 1), ("short", -1)], "label string, w int")
    return t.conversations.crossJoin(F.broadcast(h)).select("conv_id", "turn", "label", (F.length("text") * F.col("w")).cast("long").alias("score"))


@query(f"""WITH s AS (SELECT a.label AS la, b.label AS lb, a.vec_id AS x, b.vec_id AS y, {_DOT} AS s FROM embeddings a JOIN embeddings b ON a.label < b.label), r AS (SELECT la, lb, x, max(s) AS m FROM s GROUP BY ALL), c AS (SELECT la, lb, y, max(s) AS m FROM s GROUP BY ALL)
SELECT la, lb, round((x.m + y.m) / 2, 6) AS s FROM (SELECT la, lb, avg(m) AS m FROM r GROUP BY ALL) x JOIN (SELECT la, lb, avg(m) AS m FROM c GROUP BY ALL) y USING (la, lb)""")
def jn20_set_match(t: Tables):
    best = K.best_by_owner(t.embeddings.select("vec_id", F.col("embedding").alias("v"), F.col("label").alias("mine")), t.embeddings, "vec_id", "v", "label", "embedding", keep=["mine"])
    m = best.where("mine <> label").groupBy(F.least("mine", "label").alias("la"), F.greatest("mine", "label").alias("lb"), "mine").agg(F.avg("score").alias("m"))
    return m.groupBy("la", "lb").agg(F.round(F.avg("m"), 6).alias("s"))


@query(f"""WITH o AS (SELECT label, min(vec_id) AS k FROM embeddings GROUP BY label), s AS (SELECT b.vec_id AS q, a.vec_id AS w, {_DOT} AS s FROM o JOIN embeddings b ON b.vec_id = o.k JOIN embeddings a ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT q, max_by(w, (s, -w)) AS target FROM s GROUP BY q""")
def jn21_nearest_in_owner(t: Tables):
    q = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("q"), F.min_by("embedding", "vec_id").alias("v"))
    j = t.embeddings.join(q, "label").where("vec_id <> q").withColumn("s", V.dot(F.col("v"), F.col("embedding")))
    return j.groupBy("q").agg(F.max_by("vec_id", F.struct("s", -F.col("vec_id"))).alias("target"))


@query(f"""WITH s AS (SELECT a.vec_id AS q, b.label, max({_DOT}) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 GROUP BY ALL) SELECT q, label, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, label) AS k FROM s) WHERE k <= 5""")
def so02_window_search(t: Tables):
    """The five best owners of each query by their best window."""
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    s = K.best_by_owner(q, t.embeddings, "q", "qv", "label", "embedding")
    return R.top_k(s, ["q"], [F.desc("score"), F.asc("label")], 5).select("q", "label", F.round("score", 6).alias("score"))


@query(f"SELECT q, vec_id, round(s, 6) AS s FROM (SELECT a.vec_id AS q, b.vec_id, {_DOT} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE k <= 10")
def so03_whole_search(t: Tables):
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding")
    return K.knn(q, t.embeddings, "q", "vec_id", "embedding", 10).select("q", "vec_id", F.round("score", 6).alias("s"))


@query("SELECT source, count(*) AS n_top FROM documents WHERE n_chars > 3000 GROUP BY source ORDER BY n_top DESC, source")
def so10_topics_by_size(t: Tables):
    return t.documents.where("n_chars > 3000").groupBy("source").agg(F.count("*").alias("n_top")).orderBy(F.desc("n_top"), "source")


@query(f"""WITH s AS (SELECT a.vec_id AS x, b.vec_id AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), n AS (SELECT x, y FROM s WHERE k = 1) SELECT a.x AS lo, a.y AS hi FROM n a JOIN n b ON a.x = b.y AND a.y = b.x WHERE a.x < a.y""")
def se07_mutual_nearest(t: Tables):
    n = K.knn(t.embeddings, t.embeddings, "vec_id", "vec_id", "embedding", 1).select(F.col("vec_id").alias("lo"), F.col("neighbour").alias("hi"))
    return n.intersect(n.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))).where("lo < hi")


@query("""WITH p AS (SELECT a.label = b.label AS same, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id), g AS (SELECT same, count(*) AS n, avg(s) AS m, var_samp(s) AS v FROM p GROUP BY same)
SELECT round((x.m - y.m) / sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2)), 5) AS d FROM g x JOIN g y ON x.same AND NOT y.same""")
def ss07_group_effect(t: Tables):
    from ..functions.numeric import cohen_d_pooled

    st = K.pair_statistics(t.embeddings, "vec_id", "embedding", "label").groupBy((F.col("ga") == F.col("gb")).alias("same")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    st = st.select("same", "n", (F.col("s") / F.col("n")).alias("m"), ((F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("v"))
    p = lambda same, c: F.max(F.when(F.col("same") == same, F.col(c)))
    return st.agg(F.round(cohen_d_pooled(p(True, "m"), p(True, "v"), p(True, "n"), p(False, "m"), p(False, "v"), p(False, "n")), 5).alias("d"))


@query("SELECT conv_id, string_agg(turn, ',' ORDER BY md5(concat(conv_id, ':', turn, ':5'))) AS shuffled FROM conversations GROUP BY conv_id")
def ss14_shuffled_order(t: Tables):
    h = F.md5(F.concat_ws(":", "conv_id", "turn", F.lit("5")))
    c = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(h.alias("h"), "turn"))).alias("r"))
    return c.select("conv_id", F.array_join(F.transform("r", lambda x: x["turn"]), ",").alias("shuffled"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), i AS (SELECT doc_id, list_aggregate(w[1:len(w) // 2] || ['a', 'child', 'is', 'born'] || w[len(w) // 2 + 1:], 'string_agg', ' ') AS t FROM w), c AS (SELECT doc_id, (length(lower(t)) - length(replace(lower(t), 'child', ''))) // 5 AS after FROM i),
b AS (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'child', ''))) // 5 AS before FROM documents) SELECT count(*) FILTER (after > 0) / count(*) AS hit_rate, count(*) FILTER (after = before + 1) / count(*) AS gain_rate, count(*) FILTER (before > 0) / count(*) AS base_rate FROM c JOIN b USING (doc_id)""")
def ss13_positive_control(t: Tables):
    """A sentence is put into the middle of each text; the label's own trigger counter has to see it, once, and not before."""
    from ..functions import text as X

    d = t.documents.select("text", X.insert_middle(X.words(F.col("text")), "a child is born").alias("with"))
    d = d.select(X.occurrences(F.lower("text"), "child").alias("before"), X.occurrences(F.lower("with"), "child").alias("after"))
    return d.agg((F.count_if(F.col("after") > 0) / F.count("*")).alias("hit_rate"), (F.count_if(F.col("after") == F.col("before") + 1) / F.count("*")).alias("gain_rate"), (F.count_if(F.col("before") > 0) / F.count("*")).alias("base_rate"))


@query("""WITH r AS (SELECT CAST(quality = toxic AS INT) AS x, CAST(toxic AS INT) AS g FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), c AS (SELECT count(*) AS n, CAST(sum(x) AS BIGINT) AS k, CAST(sum(g) AS BIGINT) AS m, CAST(sum(x * g) AS BIGINT) AS h FROM r),
v AS (SELECT j, exp(lgamma(k + 1) - lgamma(j + 1) - lgamma(k - j + 1) + lgamma(n - k + 1) - lgamma(m - j + 1) - lgamma(n - k - m + j + 1) - lgamma(n + 1) + lgamma(m + 1) + lgamma(n - m + 1)) AS p, abs(j / m - (k - j) / (n - m)) >= abs(h / m - (k - h) / (n - m)) - 1e-12 AS far FROM c, range(greatest(0, m + k - n), least(m, k) + 1) t(j)),
s AS (SELECT j, far, sum(p) OVER (ORDER BY j) AS upto FROM v), u AS (SELECT r, CAST('0x' || substr(md5(concat(r, ':0')), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM range(1, 5001) t(r)), d AS (SELECT r, min_by(far, j) AS far FROM u JOIN s ON upto >= u GROUP BY r)
SELECT (SELECT round(h / m - (k - h) / (n - m), 6) FROM c) AS seen, round((count(*) FILTER (far) + 1) / 5001, 6) AS p, (SELECT round(least(1.0, sum(p) FILTER (far)), 6) FROM v) AS exact FROM d""")
def ss12_pair_agreement(t: Tables):
    """Agreement of two labels over all labelled documents: 5000 permutations from four counts, and the share of all permutations."""
    d = t.labels.select((F.col("quality") == F.col("toxic")).alias("agree"), "toxic")
    return E.permutation_two_valued(d, "agree", "toxic", rounds=5000).select(*[F.round(c, 6).alias(c) for c in ("seen", "p", "exact")])


@query(f"""WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT vec_id, label, d, x - avg(x) OVER (PARTITION BY label, d) AS y FROM e), n AS (SELECT vec_id, label, CAST(list(y ORDER BY d) AS FLOAT[]) AS v FROM (SELECT vec_id, label, d, y / greatest(sqrt(sum(y * y) OVER (PARTITION BY vec_id)), 1e-12) AS y FROM c) GROUP BY vec_id, label),
a AS (SELECT 'after' AS variant, a.vec_id, a.label AS la, max_by(b.label, (list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[]), -b.vec_id)) AS lb FROM n a JOIN n b ON a.vec_id <> b.vec_id GROUP BY ALL), z AS (SELECT 'before' AS variant, a.vec_id, a.label AS la, max_by(b.label, ({_DOT}, -b.vec_id)) AS lb FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY ALL)
SELECT variant, round(avg(CASE WHEN la = lb THEN 1.0 ELSE 0.0 END), 6) AS hit1 FROM (SELECT * FROM a UNION ALL SELECT * FROM z) GROUP BY variant""")
def ir09_debias(t: Tables):
    """Nearest-neighbour label hits before and after the labels' means are taken off."""
    from ..operators.aggregates import vector_mean

    m = vector_mean(t.embeddings, ["label"], "embedding")
    after = t.embeddings.join(m, "label").select("vec_id", "label", F.transform(V.l2(V.minus(F.col("embedding"), F.col("mean"))), lambda x: x.cast("float")).alias("embedding"))
    hits = []
    for name, d in (("before", t.embeddings), ("after", after)):
        k = K.knn(d, d, "vec_id", "vec_id", "embedding", 1).join(d.select("vec_id", "label"), "vec_id").join(d.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("lb")), "neighbour")
        hits.append(k.agg(F.lit(name).alias("variant"), F.round(F.avg(F.when(F.col("label") == F.col("lb"), 1.0).otherwise(0.0)), 6).alias("hit1")))
    return hits[0].union(hits[1])


@query("SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS BIGINT) AS following FROM conversations")
def wn16b_next_turns(t: Tables):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, 3)
    return t.conversations.select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("following"))


@query(f"""WITH s AS (SELECT a.vec_id, a.label AS la, b.vec_id AS n, b.label AS lb, {_DOT} AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, n) AS k FROM s)
SELECT vec_id, '{{"vec_id":' || vec_id || ',"label":' || any_value(la) || ',"neighbours":[' || string_agg('{{"vec_id":' || n || ',"score_e4":' || CAST(round(s * 10000) AS BIGINT) || ',"same_label":' || CASE WHEN la = lb THEN 'true' ELSE 'false' END || '}}', ',' ORDER BY k) || ']}}' AS document FROM r WHERE k <= 12 GROUP BY vec_id""")
def sk06_denormalised(t: Tables):
    """One JSON document per vector with its twelve neighbours in order."""
    label = t.embeddings.select("vec_id", "label")
    near = K.knn(t.embeddings, t.embeddings, "vec_id", "vec_id", "embedding", 12).join(label, "vec_id").join(label.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("lb")), "neighbour")
    one = F.struct("rank", F.struct(F.col("neighbour").alias("vec_id"), F.round(F.col("score") * 10000).cast("long").alias("score_e4"), (F.col("label") == F.col("lb")).alias("same_label")).alias("d"))
    rows = near.groupBy("vec_id", "label").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["d"]).alias("neighbours"))
    return rows.select("vec_id", F.to_json(F.struct("vec_id", "label", "neighbours")).alias("document"))


_HYPOTHESES = {"wh": "the wh and of", "de": "der die und zu", "que": "de la que el"}
_ASKED = ", ".join(f"('{k}', '{v}')" for k, v in _HYPOTHESES.items())


def _shares():
    """A scorer: the share of a hypothesis' words that the premise has."""
    import numpy as np

    def score(pairs):
        return np.array([np.mean([w in held for w in h.split()]) for held, h in ((set(p.split()), h) for p, h in pairs)])

    return score


@query(f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS ws FROM documents), c AS (SELECT doc_id, i AS chunk, list_slice(ws, i * 300 + 1, (i + 1) * 300) AS ws FROM w, LATERAL (SELECT unnest(range(0, greatest(1, (len(ws) + 299) // 300))) AS i)), h(label, h) AS (VALUES {_ASKED}),
s AS (SELECT doc_id, label, chunk, len(list_filter(string_split(h, ' '), lambda x: list_contains(ws, x))) / len(string_split(h, ' ')) AS score FROM c, h)
SELECT doc_id AS id, label, max(score) AS score, CAST(min_by(chunk, (-score, chunk)) AS BIGINT) AS position, max(score) >= 0.5 AS assigned FROM s GROUP BY doc_id, label""")
def ml15_pair_scores(t: Tables):
    """Every chunk of every text against three hypotheses; the best chunk of a text and where it is."""
    s = P.chunk_scores(t.documents, "doc_id", "text", _HYPOTHESES, _shares, "shares of words")
    return P.document_scores(s, _HYPOTHESES).withColumn("position", F.col("position").cast("long"))


@query("SELECT doc_id, md5(text) AS fp FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))")
def ml16_incremental(t: Tables):
    """Rows whose fingerprint the cache doesn't have yet."""
    d = t.documents.select("doc_id", F.md5("text").alias("fp"))
    return d.join(d.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("fp").distinct(), "fp", "left_anti").select("doc_id", "fp")


@query("""WITH e AS (SELECT event_type AS q, user_id AS o, user_id % 20 AS b, value AS s, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC) AS k FROM events WHERE value IS NOT NULL), w AS (SELECT q, o, b, max(s) AS best, avg(s) AS mean FROM e WHERE k <= 3 GROUP BY ALL),
p AS (SELECT 'best' AS variant, q, o, b, best AS s FROM w UNION ALL SELECT 'mean', q, o, b, mean FROM w), z AS (SELECT variant || ' by book' AS variant, q, o, CASE WHEN count(*) OVER g > 2 THEN (s - avg(s) OVER g) / greatest(1e-9, stddev_pop(s) OVER g) ELSE s END AS s FROM p WINDOW g AS (PARTITION BY variant, q, b)),
r AS (SELECT *, row_number() OVER (PARTITION BY variant, q ORDER BY s DESC, o) AS k FROM (SELECT variant, q, o, s FROM p UNION ALL SELECT * FROM z)), t AS (SELECT variant, q, max(s) - min(s) AS gap FROM r WHERE k <= 2 GROUP BY ALL HAVING count(*) = 2)
SELECT variant, round(median(gap), 6) AS gap, median(gap) >= 0.009 AS wide FROM t GROUP BY variant""")
def ir12_rank_variants(t: Tables):
    """Four ways to score users by their events of a kind, users in books of twenty, and how far the first is from the second."""
    rows = t.events.select("event_type", "user_id", (F.col("user_id") % 20).alias("book"), "value")
    v = E.rank_variants(rows, "event_type", "user_id", "book", "value")
    return E.median_gaps(v, "event_type", "user_id", 0.009).select("variant", F.round("gap", 6).alias("gap"), "wide")
