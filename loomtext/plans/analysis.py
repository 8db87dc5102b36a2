"""Vectors, retrieval, models, statistics and event logs over the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as V
from ..functions import numeric as N
from ..functions import text as X
from ..operators import alignment as Align
from ..operators import density as D
from ..operators import evaluation as E
from ..operators import eventlog as G
from ..operators import ivf as Ivf
from ..operators import latent as Latent
from ..operators import manifold as Manifold
from ..operators import models as M
from ..operators import relational as R
from ..operators import search as S
from ..operators import vectors as K
from ..operators.written import written
from .base import Tables, query

_TOK = "regexp_extract_all(lower(text), '[a-zà-ÿ]+')"
_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_TFIDF = lambda key, table: f"""SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM (SELECT {key}, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM {table})) / (1 + count(*) OVER (PARTITION BY term))) + 1) AS w FROM (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({_TOK}) AS term FROM {table}) GROUP BY ALL))"""


@query()
def ve01_encode(t: Tables):
    d = K.encode(t.documents.select("doc_id", "text"), "text", K.hashing_encoder(64), 64)
    return d.select("doc_id", F.round(V.norm(F.col("vec")), 4).alias("norm"))


@query("SELECT conv_id, round(sum(length(text) * CASE WHEN role = 'user' THEN 1 ELSE 0 END) / greatest(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END), 1e-9), 6) AS pooled FROM conversations GROUP BY conv_id")
def ve02_masked_mean(t: Tables):
    m = F.when(F.col("role") == "user", 1).otherwise(0)
    return t.conversations.groupBy("conv_id").agg(F.round(F.sum(F.length("text") * m) / F.greatest(F.sum(m), F.lit(1e-9)), 6).alias("pooled"))


@query("SELECT vec_id, d, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12), 6) AS x FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::DOUBLE * 3 AS x FROM embeddings)")
def ve03_l2(t: Tables):
    v = V.l2(F.transform("embedding", lambda x: x.cast("double") * 3))
    return t.embeddings.select("vec_id", F.posexplode(v).alias("d", "x")).select("vec_id", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


_NEAREST = f"""WITH s AS (SELECT a.vec_id, b.vec_id AS neighbour, {_DOT} AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) SELECT vec_id, neighbour, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour) AS rank FROM s) WHERE rank <= 20"""


@query(_NEAREST)
def jn08_ve05_neighbours(t: Tables):
    return K.knn(t.embeddings, t.embeddings, "vec_id", "vec_id", "embedding", 20).select("vec_id", "neighbour", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_NEAREST)
def ve05_inverted_file(t: Tables):
    """The same neighbours through the inverted-file index, in its exact form."""
    index = Ivf.build(t.embeddings, "vec_id", "embedding", lists=32)
    got = Ivf.search(index, t.embeddings, "vec_id", "embedding", 20, probes=4, exact=True)
    return got.select(F.col("q").alias("vec_id"), F.col("key").alias("neighbour"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def ve13_residual_map(t: Tables):
    """Loss by epoch of a residual map from vectors to a bent form of them."""
    pairs = t.embeddings.select("vec_id", F.col("embedding").alias("x"), V.l2(F.transform("embedding", lambda x: F.abs(x) + 0.3 * x)).alias("y"))
    model = Align.fit_residual(pairs, "vec_id", "x", "y", hidden=64, epochs=6, rate=5e-3)
    rows = F.array(*[F.struct(F.lit(i).alias("epoch"), F.lit(x).alias("loss")) for i, x in enumerate(model.losses)])
    return t.embeddings.agg(F.count("*").alias("n")).select("n", F.explode(rows).alias("r")).select("r.epoch", "r.loss", "n")


@query("""WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT vec_id, d, x - avg(x) OVER (PARTITION BY label, d) AS y FROM e), n AS (SELECT vec_id, d, y / greatest(sqrt(sum(y * y) OVER (PARTITION BY vec_id)), 1e-12) AS y FROM c)
SELECT vec_id, round(sum(y), 5) AS total FROM n GROUP BY vec_id""")
def ve06_centring(t: Tables):
    from ..operators.aggregates import vector_mean

    m = vector_mean(t.embeddings, ["label"], "embedding")
    c = t.embeddings.join(m, "label").select("vec_id", V.l2(V.minus(F.col("embedding"), F.col("mean"))).alias("v"))
    return c.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(f"""WITH s AS (SELECT a.vec_id AS q, b.vec_id AS p, {_DOT} / 8 AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) SELECT q, max_by(p, (s, -p)) AS best, round(max(s), 6) AS s FROM s GROUP BY q""")
def ve08_shape_similarity(t: Tables):
    k = K.knn(t.embeddings.withColumnRenamed("vec_id", "q"), t.embeddings, "q", "vec_id", "embedding", 1)
    return k.select("q", F.col("vec_id").alias("best"), F.round(F.col("score") / 8, 6).alias("s"))


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT max(abs(x)) AS s FROM e) SELECT vec_id, d, CAST(greatest(-127, least(127, round_even(x / s * 127, 0))) AS INT) AS q FROM e, s""")
def ve09_quantise(t: Tables):
    scale = t.embeddings.select(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))).alias("m")).agg(F.max("m").alias("scale"))
    q = t.embeddings.crossJoin(F.broadcast(scale)).select("vec_id", F.posexplode(V.quantise(F.col("embedding"), F.col("scale"))).alias("d", "q"))  # one row
    return q.select("vec_id", F.col("d").cast("long").alias("d"), "q")


_FLAT = "SELECT vec_id, d, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 4) AS x FROM (SELECT vec_id, unnest(range(len(embedding))) AS d, unnest(list_reverse(embedding))::DOUBLE AS x FROM embeddings)"


def _flat(df):
    return df.select("vec_id", F.posexplode("embedding").alias("d", "x")).select("vec_id", F.col("d").cast("long").alias("d"), F.round("x", 4).alias("x"))


@query(_FLAT)
def ve10_procrustes(t: Tables):
    """The targets are the vectors turned round, which an orthogonal map reaches exactly."""
    pairs = t.embeddings.select("vec_id", "embedding", F.reverse("embedding").alias("target"))
    m = M.fit_procrustes(pairs, "embedding", "target")
    return _flat(M.apply_map(pairs.select("vec_id", "embedding"), "embedding", m))


@query(_FLAT)
def ve11_ridge(t: Tables):
    """As above; with next to no penalty the linear map is that turn too."""
    pairs = t.embeddings.select("vec_id", "embedding", F.reverse("embedding").alias("target"))
    m = M.fit_ridge(pairs, "embedding", "target", 1e-9)
    return _flat(M.apply_map(pairs.select("vec_id", "embedding"), "embedding", m))


@query(f"SELECT doc_id, term, round(w, 6) AS w FROM ({_TFIDF('doc_id', 'documents')})")
def ir01_tfidf(t: Tables):
    return S.tfidf(t.documents, "doc_id", "text").select("doc_id", "term", F.round("w", 6).alias("w"))


@query(f"""WITH d AS ({_TFIDF('doc_id', 'documents')}), q AS ({_TFIDF('item_id', 'benchmark')}), s AS (SELECT item_id, doc_id, sum(q.w * d.w) AS s FROM q JOIN d USING (term) GROUP BY ALL) SELECT item_id, doc_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS k FROM s) WHERE k <= 10""")
def ir02_cosine_rank(t: Tables):
    s = S.cosine(S.tfidf(t.benchmark, "item_id", "text"), S.tfidf(t.documents, "doc_id", "text"), "item_id", "doc_id")
    return R.top_k(s.withColumn("o", F.round("score", 9)), ["item_id"], [F.desc("o"), F.asc("doc_id")], 10).select("item_id", "doc_id", F.round("score", 6).alias("score"))


_BM25 = f"""WITH d AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL), l AS (SELECT doc_id, len({_TOK}) AS dl FROM documents), a AS (SELECT count(*) AS n, avg(dl) AS m FROM l),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(q * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / m))) AS s FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l USING (doc_id), a GROUP BY ALL)"""


@query(_BM25 + " SELECT item_id, doc_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS k FROM s) WHERE k <= 10")
def ir03_bm25(t: Tables):
    s = S.bm25(t.benchmark, t.documents, "item_id", "doc_id").withColumn("o", F.round("score", 9))
    return R.top_k(s, ["item_id"], [F.desc("o"), F.asc("doc_id")], 10).select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query()
def ir04_lsa(t: Tables):
    """Dimensions, and how much of a document's unit length lies in them, with its place on the first axis, which has no fixed sign."""
    squares = F.aggregate(F.transform("vec", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    return Latent.lsa(t.documents, "doc_id", "text").select("doc_id", F.size("vec").alias("dims"), F.round(F.sqrt(squares), 6).alias("held"), F.round(F.abs(F.get("vec", F.lit(0))), 6).alias("first_axis"))


@query(f"""WITH s AS (SELECT a.vec_id AS q, b.label AS lb, a.label AS la, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), r AS (SELECT q, min(k) FILTER (la = lb) AS rank FROM s GROUP BY q)
SELECT round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS p1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS p5 FROM r""")
def ir05_ir06_retrieval(t: Tables):
    k = K.knn(t.embeddings, t.embeddings, "vec_id", "vec_id", "embedding", 5)
    lab = t.embeddings.select("vec_id", "label")
    j = k.join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("lb")), "neighbour")
    r = t.embeddings.select("vec_id").join(j.where("label = lb").groupBy("vec_id").agg(F.min("rank").alias("rank")), "vec_id", "left")
    return E.retrieval(r).select(F.round("p1", 6).alias("p1"), F.round("p5", 6).alias("p5"))


@query(_BM25 + """, r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS k FROM s), g AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), h AS (SELECT item_id, min(k) AS rank FROM g JOIN r USING (item_id, doc_id) GROUP BY item_id)
SELECT round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS p1, round(avg(1 / rank), 6) AS mrr, count(*) AS n FROM h""")
def ir07_gold_retrieval(t: Tables):
    parts, q = S.bm25_parts(t.benchmark, t.documents, "item_id", "doc_id")
    h = S.best_rank(parts, q, written(S.containing(t.benchmark, t.documents, "item_id", "doc_id"), "gold"), "item_id", "doc_id")
    return h.agg(F.round(F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)), 6).alias("p1"), F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT a.vec_id AS q, b.label AS lb, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT lb AS label, round(count(*) FILTER (k = 1) / (SELECT count(*) FROM embeddings), 6) AS top1, round(count(*) / (10 * (SELECT count(*) FROM embeddings)), 6) AS top10 FROM s WHERE k <= 10 GROUP BY lb""")
def ir08_bias(t: Tables):
    k = K.knn(t.embeddings, t.embeddings, "vec_id", "vec_id", "embedding", 10).join(t.embeddings.select(F.col("vec_id").alias("neighbour"), "label"), "neighbour")
    n = t.embeddings.agg(F.count("*").alias("n"))
    return k.groupBy("label").agg(F.count_if(F.col("rank") == 1).alias("a"), F.count("*").alias("b")).crossJoin(F.broadcast(n)).select("label", F.round(F.col("a") / F.col("n"), 6).alias("top1"), F.round(F.col("b") / (10 * F.col("n")), 6).alias("top10"))  # one row


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat(doc_id, ':7')), doc_id) AS k FROM documents) WHERE k <= 6")
def ir10_held_out_queries(t: Tables):
    return R.top_k(t.documents, ["source"], [F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7"))), F.asc("doc_id")], 6).select("doc_id", "source")


@query("WITH s AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY md5(source || ':7'), source) AS k, count(*) OVER () AS n FROM s) SELECT source, k <= n // 3 AS held FROM r")
def ir11_group_split(t: Tables):
    s = t.documents.select("source").distinct()
    w = Window.partitionBy(F.lit(1))
    return s.select("source", (F.row_number().over(w.orderBy(F.md5(F.concat("source", F.lit(":7"))), "source")) <= F.floor(F.count("*").over(w) / 3)).alias("held"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events), a AS (SELECT user_id, max(value) AS v1, avg(value) FILTER (k <= 3) AS v2 FROM r GROUP BY user_id)
SELECT 'best' AS variant, round(avg(v1), 6) AS score, avg(v1) >= 20 AS adopted FROM a UNION ALL SELECT 'top3', round(avg(v2), 6), avg(v2) >= 20 FROM a""")
def ir12_variants(t: Tables):
    r = R.top_k(t.events.select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.asc("event_id")], 3)
    a = r.groupBy("user_id").agg(F.max("value").alias("best"), F.avg("value").alias("top3")).agg(F.avg("best").alias("best"), F.avg("top3").alias("top3"))
    rows = a.select(F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("s")) for v in ("best", "top3")])).alias("x"))
    return rows.select("x.variant", F.round("x.s", 6).alias("score"), E.gate(F.col("x.s"), 20).alias("adopted"))


@query()
def ir13_rank_preservation(t: Tables):
    """Overlap of the ten nearest neighbours under full and byte vectors."""
    scale = t.embeddings.select(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))).alias("m")).agg(F.max("m").alias("scale"))
    small = t.embeddings.crossJoin(F.broadcast(scale)).select("vec_id", F.transform(V.dequantise(V.quantise(F.col("embedding"), F.col("scale")), F.col("scale")), lambda x: x.cast("float")).alias("embedding"))  # one row
    near = lambda d, n: K.knn(d, d, "vec_id", "vec_id", "embedding", 10).groupBy("vec_id").agg(F.collect_set("neighbour").alias(n))
    j = near(t.embeddings, "a").join(near(small, "b"), "vec_id")
    return j.select("vec_id", (F.size(F.array_intersect("a", "b")) / 10).alias("overlap"))


@query(f"""WITH s AS (SELECT a.vec_id AS q, a.label AS la, b.label AS lb, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) SELECT count(*) FILTER (la <> lb) AS failures, round(avg(CASE WHEN la = lb THEN 1.0 ELSE 0.0 END), 6) AS same FROM s WHERE k = 1""")
def ir14_failures(t: Tables):
    k = K.knn(t.embeddings, t.embeddings, "vec_id", "vec_id", "embedding", 1)
    j = k.join(t.embeddings.select("vec_id", "label"), "vec_id").join(t.embeddings.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("lb")), "neighbour")
    return j.agg(F.count_if(F.col("label") != F.col("lb")).alias("failures"), F.round(F.avg(F.when(F.col("label") == F.col("lb"), 1.0).otherwise(0.0)), 6).alias("same"))


@query("""WITH c AS (SELECT conv_id, length(text) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, i <= n // 2 AS first_half, round(avg(x), 6) AS m FROM c GROUP BY ALL""")
def ir15_half_means(t: Tables):
    w = Window.partitionBy("conv_id")
    c = t.conversations.select("conv_id", F.length("text").alias("x"), (F.row_number().over(w.orderBy("turn")) <= F.floor(F.count("*").over(w) / 2)).alias("first_half"))
    return c.groupBy("conv_id", "first_half").agg(F.round(F.avg("x"), 6).alias("m"))


@query()
def ml01_layout(t: Tables):
    return Manifold.layout(t.embeddings, "vec_id", "embedding")


@query()
def ml02_clusters(t: Tables):
    """Density clusters of the layout in eight dimensions."""
    return D.density_clusters(Manifold.embedded(t.embeddings, "vec_id", "embedding", dims=8, min_dist=0.0), "vec_id", "p")


@query(f"""WITH d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, avg(1 - {_DOT}) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY ALL), s AS (SELECT vec_id, min(d) FILTER (la = lb) AS a, min(d) FILTER (la <> lb) AS b FROM d GROUP BY vec_id) SELECT round(avg((b - a) / greatest(a, b)), 5) AS silhouette FROM s WHERE a IS NOT NULL""")
def ml03_silhouette(t: Tables):
    """Cosine silhouette of unit vectors: mean distances to a group follow from the group's sum alone."""
    from ..operators.aggregates import vector_mean

    g = vector_mean(t.embeddings, ["label"], "embedding").join(t.embeddings.groupBy("label").agg(F.count("*").alias("n")), "label").select(F.col("label").alias("lb"), "mean", "n")
    j = t.embeddings.crossJoin(F.broadcast(g))  # one row per label
    same = F.col("label") == F.col("lb")
    s = V.dot(F.col("embedding"), F.col("mean")) * F.col("n")
    own = V.dot(F.col("embedding"), F.col("embedding"))
    d = F.when(same, 1 - (s - own) / F.when(F.col("n") > 1, F.col("n") - 1)).otherwise(1 - s / F.col("n"))
    x = j.select("vec_id", same.alias("same"), d.alias("d")).groupBy("vec_id").agg(F.min(F.when(F.col("same"), F.col("d"))).alias("a"), F.min(F.when(~F.col("same"), F.col("d"))).alias("b"))
    return x.where("a IS NOT NULL").agg(F.round(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")), 5).alias("silhouette"))


@query()
def ml04_ag25_topics(t: Tables):
    model, theta, _ = M.topics(t.documents, "doc_id", "text", k=12, rounds=20)
    from pyspark.ml.functions import vector_to_array

    x = theta.select("doc_id", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "p")).join(t.documents.select("doc_id", "source"), "doc_id")
    return x.groupBy("topic", "source").agg(F.round(F.sum("p"), 4).alias("mass"))


@query("""WITH c AS (SELECT lang, source, count(*) AS c FROM documents GROUP BY ALL), n AS (SELECT sum(c) AS n FROM c), a AS (SELECT lang, sum(c) AS ca FROM c GROUP BY lang), b AS (SELECT source, sum(c) AS cb FROM c GROUP BY source)
SELECT round((SELECT sum(c / n * ln(c * n / (ca * cb))) FROM c JOIN a USING (lang) JOIN b USING (source), n) / (((SELECT -sum(ca / n * ln(ca / n)) FROM a, n) + (SELECT -sum(cb / n * ln(cb / n)) FROM b, n)) / 2), 6) AS nmi""")
def ml05_nmi(t: Tables):
    return E.nmi(t.documents, "lang", "source").select(F.round("nmi", 6).alias("nmi"))


@query()
def ml06_ml09_hmm(t: Tables):
    f = t.conversations.select("conv_id", "turn", F.length("text").cast("double").alias("f1"), F.regexp_count("text", F.lit("[.!?]")).cast("double").alias("f2"))
    f = written(f.select("conv_id", "turn", R.zscore("f1", ["conv_id"]).alias("f1"), R.zscore("f2", ["conv_id"]).alias("f2")), "features")
    model = M.hmm_fit(f, "conv_id", "turn", ["f1", "f2"], k=5, rounds=30)
    return M.viterbi(f, "conv_id", "turn", ["f1", "f2"], model)


_DELTA = f"""t AS (SELECT doc_id, unnest({_TOK}) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS c FROM t GROUP BY ALL), w AS (SELECT word FROM c GROUP BY word ORDER BY sum(c) DESC, word LIMIT 150), s AS (SELECT doc_id, sum(c) AS total FROM c GROUP BY doc_id),
f AS (SELECT s.doc_id, w.word, coalesce(c.c, 0) / s.total AS f FROM s CROSS JOIN w LEFT JOIN c ON c.doc_id = s.doc_id AND c.word = w.word), z AS (SELECT doc_id, word, (f - avg(f) OVER p) / greatest(stddev_pop(f) OVER p, 1e-9) AS z FROM f WINDOW p AS (PARTITION BY word))"""


@query(f"WITH {_DELTA} SELECT doc_id, word, round(z, 4) AS z FROM z")
def ml10_delta_profile(t: Tables):
    return M.delta_profile(t.documents, "doc_id", "text", 150).select("doc_id", "word", F.round("z", 4).alias("z"))


@query(f"""WITH {_DELTA}, p AS (SELECT z.doc_id, word, z, lang FROM z JOIN documents USING (doc_id)), g AS (SELECT lang AS other, word, sum(z) AS s, count(*) AS n FROM p GROUP BY ALL),
d AS (SELECT doc_id, lang, other, avg(abs(z - CASE WHEN lang = other THEN (s - z) / (n - 1) ELSE s / n END)) AS d FROM p JOIN g USING (word) GROUP BY ALL) SELECT doc_id, lang, min_by(other, (round(d, 9), other)) AS guess FROM d GROUP BY ALL""")
def ml11_ml12_attribution(t: Tables):
    p = M.profiles(t.documents, "doc_id", "text", 150)
    return M.attribute(p, t.documents.select("doc_id", "lang"), "doc_id", "lang").select("doc_id", "lang", "guess")


@query()
def ml13_correspondence(t: Tables):
    c = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    out, _ = M.correspondence(c, "source", "lang", "n")
    return out.select("source", "axis", F.round("x", 5).alias("x"))


@query()
def ml14_correspondence_without(t: Tables):
    c = t.documents.where("source <> 'src0'").groupBy("source", "lang").agg(F.count("*").alias("n"))
    out, _ = M.correspondence(c, "source", "lang", "n")
    return out.select("source", "axis", F.round("x", 5).alias("x"))


@query("""SELECT doc_id, round(((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3) * 1000.0 / greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))), 6) AS score FROM documents""")
def ml17_baseline_scores(t: Tables):
    return t.documents.select("doc_id", F.round(X.occurrences(F.lower("text"), "the") * 1000.0 / F.greatest(F.lit(1), F.size(X.words(F.col("text")))), 6).alias("score"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem")
def ss01_pearson(t: Tables):
    return t.lineitem.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"))


def _permutation_sql(rows: str, rounds: int = 5000) -> str:
    return f"""WITH d AS ({rows}), n AS (SELECT CAST(sum(g) AS BIGINT) AS ones, avg(x) FILTER (g = 1) - avg(x) FILTER (g = 0) AS seen FROM d),
e AS (SELECT r, x, row_number() OVER (PARTITION BY r ORDER BY md5(concat(k, ':', r, ':0')), k) AS place FROM d, range(1, {rounds + 1}) t(r)),
s AS (SELECT r, avg(x) FILTER (place <= ones) - avg(x) FILTER (place > ones) AS d FROM e, n GROUP BY r)
SELECT round(first(seen), 6) AS seen, round((count(*) FILTER (abs(d) >= abs(seen) - 1e-12) + 1) / {rounds + 1}, 6) AS p FROM s, n"""


@query(_permutation_sql("SELECT source || '/' || lang AS k, avg(CAST(n_chars AS DOUBLE)) AS x, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS g FROM documents GROUP BY source, lang"))
def ss02_ss04_permutation(t: Tables):
    """Labels permuted over books (the documents of one source and language), not over their texts."""
    d = t.documents.groupBy("source", "lang").agg(F.avg(F.col("n_chars").cast("double")).alias("x"))
    d = d.select(F.concat_ws("/", "source", "lang").alias("k"), "x", F.when(F.col("lang") == "en", 1).otherwise(0).alias("g"))
    return E.permutation_p(d, "x", "g", "k", rounds=5000).select(F.round("seen", 6).alias("seen"), F.round("p", 6).alias("p"))


@query("""WITH p AS (SELECT s_suppkey % 5 AS a, (s_suppkey * 3 + s_nationkey) % 5 AS b, s_acctbal AS x, s_acctbal * 0.5 + s_nationkey * 100 AS y FROM supplier), g AS (SELECT DISTINCT a AS k FROM p UNION SELECT DISTINCT b FROM p)
SELECT k AS "left", round(corr(x, y), 6) AS r FROM g JOIN p ON a <> k AND b <> k GROUP BY k""")
def ss03_leave_one_out(t: Tables):
    p = t.supplier.select((F.col("s_suppkey") % 5).alias("a"), ((F.col("s_suppkey") * 3 + F.col("s_nationkey")) % 5).alias("b"), F.col("s_acctbal").alias("x"), (F.col("s_acctbal") * 0.5 + F.col("s_nationkey") * 100).alias("y"))
    return E.leave_one_out_corr(p, "x", "y", "a", "b").select("left", F.round("r", 6).alias("r"))


_CUTS = " + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in E.POISSON_CUTS)


@query(f"""WITH e AS (SELECT r, quality AS x, CAST('0x' || substr(md5(concat(doc_id, ':', r, ':0')), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM labels, range(1, 2001) t(r)), m AS (SELECT r, sum(({_CUTS}) * x) / sum({_CUTS}) AS m FROM e GROUP BY r)
SELECT round((SELECT avg(quality) FROM labels), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def ss05_bootstrap(t: Tables):
    return E.bootstrap_ci(t.labels, "quality", "doc_id", rounds=2000).select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query("SELECT round((avg(n_chars) FILTER (toxic = 1) - avg(n_chars) FILTER (toxic = 0)) / sqrt(((count(*) FILTER (toxic = 1) - 1) * var_samp(n_chars) FILTER (toxic = 1) + (count(*) FILTER (toxic = 0) - 1) * var_samp(n_chars) FILTER (toxic = 0)) / (count(*) - 2)), 6) AS d FROM documents JOIN labels USING (doc_id)")
def ss06_cohen_d(t: Tables):
    j = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    f = lambda k: F.when(F.col("toxic") == k, F.col("n_chars"))
    s = j.agg(*[g(f(k)).alias(f"{n}{k}") for k in (0, 1) for n, g in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    return s.select(F.round(N.cohen_d_pooled(F.col("m1"), F.col("v1"), F.col("n1"), F.col("m0"), F.col("v0"), F.col("n0")), 6).alias("d"))


@query("""WITH s AS (SELECT n_chars AS score, quality AS y FROM documents JOIN labels USING (doc_id)) SELECT round(sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 8) AS auc FROM s a, s b WHERE a.y = 1 AND b.y = 0""")
def ss08_auc(t: Tables):
    j = t.documents.select("doc_id", F.col("n_chars").alias("score")).join(t.labels, "doc_id")
    return E.auc(j, [], "score", "quality").select(F.round("auc", 8).alias("auc"))


@query("""WITH s AS (SELECT lang, n_chars AS score, quality AS y FROM documents JOIN labels USING (doc_id)), g AS (SELECT lang FROM s GROUP BY lang HAVING count(*) FILTER (y = 1) >= 3 AND count(*) FILTER (y = 0) >= 3), a AS (SELECT a.lang, sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM s a JOIN s b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 WHERE a.lang IN (SELECT lang FROM g) GROUP BY a.lang) SELECT round(avg(auc), 8) AS macro_auc, count(*) AS n_labels FROM a""")
def ss09_macro_auc(t: Tables):
    j = t.documents.select("doc_id", "lang", F.col("n_chars").alias("score")).join(t.labels, "doc_id")
    return E.macro_auc(j, "lang", "score", "quality").select(F.round("macro_auc", 8).alias("macro_auc"), "n_labels")


@query("WITH m AS (SELECT avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS po, avg(quality) AS pa, avg(toxic) AS pb FROM labels) SELECT round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 8) AS kappa FROM m")
def ss10_kappa(t: Tables):
    return E.kappa(t.labels, "quality", "toxic").select(F.round("kappa", 8).alias("kappa"))


@query("SELECT round(2 * sum(quality * toxic) / (sum(quality) + sum(toxic)), 8) AS f1 FROM labels")
def ss11_f1(t: Tables):
    return E.f1(t.labels, "quality", "toxic").select(F.round("f1", 8).alias("f1"))


@query("SELECT vec_id, CASE WHEN abs(embedding[1]) < 0.01 THEN 'supported' WHEN abs(embedding[1]) <= 0.10 THEN 'weak' ELSE 'not supported' END AS verdict, embedding[2] >= 0.05 AS passed FROM embeddings")
def ss15_verdicts(t: Tables):
    return t.embeddings.select("vec_id", E.band(F.abs(F.get("embedding", F.lit(0)).cast("double"))).alias("verdict"), E.gate(F.get("embedding", F.lit(1)).cast("double"), 0.05).alias("passed"))


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat(doc_id, ':3')), doc_id) AS k FROM documents), a AS (SELECT doc_id FROM r WHERE k = 1), b AS (SELECT doc_id FROM r WHERE k > 1 ORDER BY md5(concat(doc_id, ':3')), doc_id LIMIT 15) SELECT * FROM a UNION ALL SELECT * FROM b""")
def ss16_stratified_sample(t: Tables):
    h = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":3")))
    r = t.documents.select("doc_id", "source", h.alias("h"), F.row_number().over(Window.partitionBy("source").orderBy(h, "doc_id")).alias("k"))
    return r.where("k = 1").select("doc_id").union(r.where("k > 1").orderBy("h", "doc_id").limit(15).select("doc_id"))


@query("SELECT doc_id, CASE WHEN quality = toxic THEN quality END AS gold FROM labels")
def ss17_agreement(t: Tables):
    return t.labels.select("doc_id", F.when(F.col("quality") == F.col("toxic"), F.col("quality")).alias("gold"))


def _log(t: Tables):
    e = t.events.select("event_id", "user_id", "event_type", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("line"))
    return e.withColumn("supersedes", F.when((F.col("event_type") == "view") & (F.col("line") > 2), F.col("line") - 2))


_LOG = "e AS (SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events), k AS (SELECT user_id, line - 2 AS line FROM e WHERE event_type = 'view' AND line > 2)"


@query(f"WITH {_LOG} SELECT event_type, count(*) AS n FROM e JOIN k USING (user_id, line) WHERE event_type <> 'view' GROUP BY event_type")
def lg01_voided_counts(t: Tables):
    return G.voided(_log(t), "user_id", "line", "supersedes", F.col("event_type") == "view").groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""WITH {_LOG}, c AS (SELECT a.user_id, a.line, b.event_type AS target FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.line = a.line - 2 AND a.line > 2 WHERE a.event_type = 'view') SELECT user_id, line, CASE WHEN target IS NULL THEN 'no such line' ELSE 'corrects a correction' END AS why FROM c WHERE target IS NULL OR target = 'view'""")
def lg02_violations(t: Tables):
    b = G.bad_corrections(_log(t), "user_id", "line", "supersedes", F.col("event_type") == "view")
    return b.select("user_id", F.col("line").cast("long").alias("line"), "why")


@query(f"WITH {_LOG}, v AS (SELECT user_id, count(*) AS voided FROM e JOIN k USING (user_id, line) WHERE event_type <> 'view' GROUP BY user_id), p AS (SELECT user_id, count(*) AS replaced FROM e WHERE event_type = 'purchase' GROUP BY user_id) SELECT user_id, coalesce(replaced, 0) < voided AS open FROM v LEFT JOIN p USING (user_id)")
def lg03_repair_slot(t: Tables):
    e = _log(t)
    v = G.voided(e, "user_id", "line", "supersedes", F.col("event_type") == "view").groupBy("user_id").agg(F.count("*").alias("voided"))
    p = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("replaced"))
    return v.join(p, "user_id", "left").select("user_id", (F.coalesce("replaced", F.lit(0)) < F.col("voided")).alias("open"))


@query(f"WITH {_LOG} SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS purchases, max_by(value, line) AS last_value FROM e GROUP BY user_id")
def lg04_summary(t: Tables):
    return _log(t).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.max_by("value", "line").alias("last_value"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), p(rule, re) AS (VALUES ('private key', '-----BEGIN [A-Z ]*PRIVATE KEY-----'), ('cloud key', 'AKIA[0-9A-Z]{16}'), ('credential', '(?i)(password|secret|token)\s*[=:]\s*\S{6,}'), ('eval', 'eval\('))
SELECT doc_id, rule, count(*) AS n FROM l JOIN p ON regexp_matches(line, re) GROUP BY ALL""")
def lg06_secret_scan(t: Tables):
    rules = {"private key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "cloud key": "AKIA[0-9A-Z]{16}", "credential": r"(?i)(password|secret|token)\s*[=:]\s*\S{6,}", "eval": r"eval\("}
    line = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    hit = line.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.col("line").rlike(p), k) for k, p in rules.items()]))).alias("rule"))
    return hit.groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


@query("SELECT source, CAST(sum(n_chars) AS BIGINT) AS size, count(*) AS files, sum(n_chars) > 120000 AS over FROM documents GROUP BY source")
def lg07_size_gate(t: Tables):
    return t.documents.groupBy("source").agg(F.sum("n_chars").alias("size"), F.count("*").alias("files"), (F.sum("n_chars") > 120000).alias("over"))


@query("SELECT doc_id, CASE WHEN contains(text, 'Traceback') THEN 'launch failure' WHEN NOT regexp_matches(text, '[0-9]+') THEN 'not run' ELSE 'ran' END AS verdict FROM documents")
def lg08_classify_run(t: Tables):
    c = F.col("text")
    return t.documents.select("doc_id", F.when(c.contains("Traceback"), "launch failure").when(~c.rlike("[0-9]+"), "not run").otherwise("ran").alias("verdict"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'tests/test_b.py::test_' || (doc_id % 7) ELSE 'tests/test_a.py::test_x[' || (doc_id % 9) || ']' || ',' || 'tests/test_b.py::test_' || (doc_id % 7) END AS ids FROM documents WHERE doc_id % 4 <> 0")
def lg09_failed_ids(t: Tables):
    """Names of failed tests in logs that tell them twice, in a run's lines and in its summary."""
    one, two = F.concat(F.lit("FAILED tests/test_b.py::test_"), (F.col("doc_id") % 7).cast("string"), F.lit(" - boom\n")), F.concat(F.lit("FAILED tests/test_a.py::test_x["), (F.col("doc_id") % 9).cast("string"), F.lit("]\n"))
    log = F.concat(F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(one, F.when(F.col("doc_id") % 4 > 1, two).otherwise(""), one)), F.lit("1 passed, FAILED none\n"), F.col("text"))
    ids = F.array_sort(F.array_distinct(F.regexp_extract_all(log, F.lit(r"(?m)^FAILED (\S+::\S+)"), F.lit(1))))
    return t.documents.select("doc_id", ids.alias("ids")).where(F.size("ids") > 0).select("doc_id", F.array_join("ids", ",").alias("ids"))


_LEVEL = lambda inner: f"SELECT o // 4096 AS o, sha256(string_agg(r, chr(10) ORDER BY o)) AS r FROM ({inner}) GROUP BY o // 4096"


@query(f"""SELECT substr(sha256(string_agg(r, chr(10) ORDER BY o)), 1, 16) AS fingerprint FROM ({_LEVEL(_LEVEL(_LEVEL("SELECT doc_id AS o, doc_id || '|' || source || '|' || n_chars AS r FROM documents")))})""")
def sk02_fingerprint(t: Tables):
    from ..sources.sinks import fingerprint

    return fingerprint(t.documents, ["doc_id", "source", "n_chars"], "doc_id")


@query("SELECT conv_id, turn, role, CAST(CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END AS INT) AS version FROM conversations")
def sk10_upsert(t: Tables):
    old = t.conversations.select("conv_id", "turn", "role", F.lit(1).alias("version"))
    new = t.conversations.where("turn % 2 = 0").select("conv_id", "turn", "role", F.lit(2).alias("version"))
    return R.latest_wins(old, new, ["conv_id", "turn"], "version").select("conv_id", "turn", "role", "version")


@query("SELECT e.event_id, e.user_id, e.event_type, r.n AS type_count FROM events e JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) r USING (event_type)")
def sk12_star_schema(t: Tables):
    dim = t.events.groupBy("event_type").agg(F.count("*").alias("type_count"))
    return t.events.select("event_id", "user_id", "event_type").join(dim, "event_type").select("event_id", "user_id", "event_type", "type_count")


@query("""SELECT doc_id, '{"id":' || doc_id || ',"lang":"' || lang || '","n":' || n_chars || '}' AS j FROM documents""")
def sk05_light_index(t: Tables):
    return t.documents.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), "lang", F.col("n_chars").alias("n"))).alias("j"))
