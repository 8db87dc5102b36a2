"""Urls, mixing, perplexity, toxicity, media and decontamination."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import decontam, kneser, media, mixing, toxicity, urls

from .conftest import prose


def test_segmentation_finds_the_cheapest_split():
    cost = {"free": 3.0, "bets": 3.0, "freeb": 9.0, "ets": 9.0, "a": 1.0}
    assert urls.best_split("freebets", cost, 20.0) == ["free", "bets"]
    assert urls.best_split("freeqbets", cost, 20.0) == ["free", "q", "bets"]
    assert urls.best_split("", cost, 20.0) == []


def test_urls(spark):
    rows = [(1, "https://Sub.Example.ORG/es/x?q"), (2, "http://example.org/en/12#a"), (3, "http://x.com/de/1"), (4, "http://x.com/fr/1"), (5, "http://a.org"), (6, None), (7, "no scheme"), (8, "http://notexample.org/es/"), (9, "http://casinowin.example.net/en/3"), (10, "http://poems.example.net/en/4"), (10, "http://poems.example.net/en/4"), (11, "ftp://h?x://y/z"), (None, "http:///p")]
    pages = spark.createDataFrame([(k, u, "<p>casino win poems of the day</p>") for k, u in rows], "page_id long, url string, html string").withColumn("host", F.lit("z")).withColumn("words", F.lit(1))
    got = {(r.page_id, r.host): r for r in urls.judge(pages).collect()}
    assert urls.judge(pages).count() == len(rows)
    assert (got[1, "sub.example.org"].rule, got[1, "sub.example.org"].verdict) == ("example.org/es/", "block")
    assert (got[2, "example.org"].rule, got[2, "example.org"].verdict) == ("example.org/en/1", "block")
    assert got[3, "x.com"].rule == "com/de/" and got[4, "x.com"].verdict == "allow"
    assert got[5, "a.org"].rule is None and got[5, "a.org"].path == ""
    assert (got[6, ""].path, got[7, ""].rule) == ("", None)
    assert got[8, "notexample.org"].rule == "org/"
    assert got[9, "casinowin.example.net"].words[:2] == ["casino", "win"] and got[9, "casinowin.example.net"].verdict == "block"
    assert got[10, "poems.example.net"].verdict == "allow"
    assert got[11, "h"].path == "" and got[None, ""].path == "/p"
    assert urls.judge(pages.limit(0)).count() == 0


def test_urls_equal_a_brute_force_version(spark):
    rnd = random.Random(11)
    words = ["poem", "poems", "day", "casino", "win", "wind", "river", "a", "bet", "bets", "alpha", "be", "t"]
    name = lambda: "".join(rnd.choices(words, k=rnd.randint(1, 3)))
    ends = ["", "/", "/en/1", "/en/12?x=/de/", "/es/a", "/fr/b#c", "/de/win-big/Day", "#only", "?q"]
    rows = [(i, f"{rnd.choice(['http', 'HTTPS', 'x'])}://{rnd.choice(['', 'WWW.', '-.'])}{name()}{rnd.choice(['.com', '.example.org', '.net', '7.org', ''])}{rnd.choice(ends)}", rnd.choice([None, "", "<p>poems of the day</p><script>win win</script>", "<style>bet</style>a Casino by the river", "wind BE t"])) for i in range(300)]
    rows += [(900, "http://hot.net/" + "casino/" * 30, "x")] * 60 + [(901, "http://" + "ab" * 400 + ".net/" + "day-" * 2000, "y" * 3000), (902, None, None), (None, "", "")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()

    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u[u.index("://") + 3 :]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        tail = rest[cut:]
        return rest[:cut].lower(), tail[: min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]

    def runs(t):
        return [x for x in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in t.lower()).split(" ") if x]

    def plain(html):
        out, i, low = [], 0, html or ""
        while i < len(low):
            if low[i] == "<" and ">" in low[i:]:
                tag = next((x for x in ("script", "style") if low.startswith(f"<{x}", i) and f"</{x}>" in low[i:]), None)
                i = low.index(f"</{tag}>", i) + len(tag) + 3 if tag else low.index(">", i) + 1
                out.append(" ")
            else:
                out.append(low[i])
                i += 1
        return "".join(out)

    counts = {w: urls.SEED_COUNT for w in urls.SEEDS}
    for _, _, h in rows:
        for w in runs(plain(h)):
            if len(w) <= urls.LONGEST:
                counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    costs = {w: -math.log(n / total) for w, n in counts.items()}

    def cheapest(label):
        # All splits from the back, kept per place: (cost, words).
        best = [(0.0, [])] + [None] * len(label)
        for j in range(1, len(label) + 1):
            for i in range(j):
                w = label[i:j]
                c = costs.get(w, -math.log(urls.UNKNOWN) if len(w) == 1 else None)
                if c is not None and (best[j] is None or best[i][0] + c < best[j][0]):
                    best[j] = (best[i][0] + c, [*best[i][1], w])
        return best[-1][0]

    worth = lambda ws: sum(costs.get(w, -math.log(urls.UNKNOWN)) for w in ws)
    classes, bags = [{}, {}], []
    for r in got:
        host = [w for label in runs(r.host) for w in [label]]
        path = runs(r.path)
        ws = list(r.words)
        split = ws[: len(ws) - len(path)]
        assert "".join(sorted("".join(split))) == "".join(sorted("".join(host))) and ws[len(split) :] == path
        assert worth(split) == pytest.approx(sum(cheapest(x) for x in host))
        bad = bool(set(split) & set(urls.SEEDS))
        bags.append((ws, bad))
        for w in ws:
            classes[bad][w] = classes[bad].get(w, 0) + 1
    size = len(classes[0].keys() | classes[1].keys())
    n = [sum(c.values()) + size + 1 for c in classes]  # one more for a word not seen
    n_bad = sum(bad for _, bad in bags)
    prior = math.log((n_bad + 1) / (len(rows) - n_bad + 1))
    urls_of = {}
    for k, u, _ in rows:
        urls_of.setdefault(k, u)
    assert len(got) == len(rows) and 0 < n_bad < len(rows)
    for r, (ws, _) in zip(got, bags, strict=True):
        assert (r.host, r.path) == parts(urls_of[r.page_id])
        score = prior + sum(math.log((classes[1].get(w, 0) + 1) / n[1]) - math.log((classes[0].get(w, 0) + 1) / n[0]) for w in ws)
        assert r.score == pytest.approx(score, abs=1e-6)
        fits = [(h + p, v) for h, p, v in urls.RULES if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "block" if score > 0 else "allow")
        assert (r.rule, r.verdict) == (rule, verdict), r


def test_raked_weights_meet_their_targets(spark):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randint(1, 60), rnd.choice(["en", "en", "fr"]), "hot" if rnd.random() < 0.4 else f"s{rnd.randint(0, 5)}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"lang": {"en": 0.5, "fr": 0.5}, "source": {"hot": 0.1}}
    got = mixing.mix(docs, targets=targets, rounds=24).toPandas()
    w = got.n_tokens * got.probability
    assert (w[got.lang == "en"].sum() / w.sum()) == pytest.approx(0.5, abs=0.01)
    assert (w[got.source == "hot"].sum() / w.sum()) == pytest.approx(0.1, abs=0.01)
    assert got.probability.max() == pytest.approx(1.0) and 0.05 < got.kept.mean() < 0.95
    assert got.n_tokens.tolist() == [len(t.split()) for _, t, _, _ in sorted(rows, key=lambda r: got.k.tolist().index(r[0]))]
    more = mixing.mix(docs, budget=10_000.0).where("kept").select("k").toPandas().k
    less = mixing.mix(docs, budget=2_000.0).where("kept").select("k").toPandas().k
    assert set(less) < set(more)


def test_raking_ends_when_targets_are_met_and_tells_when_they_are_not(spark):
    rows = [("a", "x", 10.0), ("a", "y", 30.0), ("b", "x", 5.0), ("b", "y", 1.0)]
    cells = spark.createDataFrame(rows, "source string, lang string, mass double")
    targets = {"source": {"a": 0.3, "b": 0.7}, "lang": {"x": 0.6, "y": 0.4}}
    got = mixing.rake(cells, ["source", "lang"], targets).toPandas()
    for c, want in targets.items():
        assert got.groupby(c).weight.sum().to_dict() == pytest.approx(want, rel=1e-5)
    # Nothing of source b is in language y, and nothing of a in x: the marginals contradict each other.
    with pytest.warns(UserWarning, match="misses its target"):
        mixing.rake(cells.where("(source = 'a') = (lang = 'y')"), ["source", "lang"], targets, rounds=8)


def test_one_rare_document_does_not_decide_the_draw(spark):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randint(20, 60), rnd.choice(["en", "en", "fr"]), "hot" if rnd.random() < 0.4 else f"s{rnd.randint(0, 5)}") for i in range(900)]
    kept, fits = [], []
    for more in ([], [(900, "a b c d e", "new", "new")]):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, source string")
        got = mixing.mix(docs).toPandas()
        w = got.n_tokens * got.probability
        kept.append(got.n_tokens[got.kept].sum() / got.n_tokens.sum())
        assert w.sum() / got.n_tokens.sum() == pytest.approx(mixing.SHARE, abs=0.001)
        got = mixing.mix(docs, targets={"lang": {"en": 0.5}}).toPandas()
        w = got.n_tokens * got.probability
        fits.append(w.sum() / got.n_tokens.sum())
        assert w[got.lang == "en"].sum() / w.sum() == pytest.approx(0.5, abs=0.01)
        assert mixing.mix(docs, budget=9_000.0).selectExpr("sum(n_tokens * probability)").first()[0] == pytest.approx(9_000, abs=1)
        assert mixing.mix(docs, budget=1e9).where("NOT kept").count() == 0
    assert kept == pytest.approx([mixing.SHARE] * 2, abs=0.05) and fits[1] > 0.8 * fits[0]


def test_topics_are_kinds_of_characters(spark):
    cases = {"prose": "plain words, here. " * 50, "short": "a few words", "figures": "12 345 6 and 78 " * 50, "marked": "<td>{a}</td> if x == y " * 50}
    docs = spark.createDataFrame(list(cases.items()), "kind string, text string")
    assert all(r.kind == r.topic for r in docs.select("kind", mixing.topic_of("text").alias("topic")).collect())
    marked = spark.createDataFrame([("100 %%% of the words | and more!! " + "words " * 200,)], "text string")
    assert marked.select(mixing.topic_of("text")).first()[0] == "prose"


def test_tokens_and_topics_cost_less_than_by_whole_rewrites(spark):
    """The same values as from texts that are rewritten character by character, at well under their time."""
    import time

    t = F.coalesce(F.col("text"), F.lit(""))
    flat = F.trim(F.regexp_replace(t, r"[\x20\x09-\x0D]+", " "))
    tokens = F.when(flat == "", F.lit(0)).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")
    some = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    topic = F.when(some(mixing.DIGITS) > mixing.FIGURES * F.length(t), "figures").when(some(mixing.SIGNS) > mixing.MARKED * F.length(t), "marked").when(F.length(t) < mixing.BRIEF, "short").otherwise("prose")
    rnd = random.Random(4)
    odd = [None, "", " ", " \n\t ", "\n a", "a \x0b\x0c\r b ", "\x1c a \x85 b\u00a0c", "😀 😀", "1|2 ^_`", "\\[]-*$@"]
    odd += ["".join(rnd.choice("ab1 2\n|-^]\\[é中\t.") for _ in range(rnd.randint(0, 900))) for _ in range(300)]
    docs = spark.createDataFrame([(x,) for x in odd], "text string")
    assert docs.where(~(tokens.eqNullSafe(mixing.tokens_of("text")) & topic.eqNullSafe(mixing.topic_of("text")))).count() == 0
    long = spark.range(0, 4000, 1, 2).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("Some words of a text, and more."), 300)).alias("text"))

    def seconds(*columns):
        took = []
        for _ in range(3):
            start = time.perf_counter()
            long.select(F.sum(F.hash(*columns))).collect()
            took.append(time.perf_counter() - start)
        return min(took)

    assert seconds(mixing.tokens_of("text"), mixing.topic_of("text")) < 0.7 * seconds(tokens, topic)


def test_mixing_has_no_python_on_its_path(spark, odd_docs, no_docs):
    out = mixing.sampled(odd_docs)
    assert out.columns == odd_docs.columns and mixing.sampled(no_docs).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert out.where("text IS NULL").count() == 1


class PlainKneserNey:
    """Modified Kneser-Ney by its definition, over one sequence of symbols per text, with plain dictionaries."""

    def __init__(self, texts, order=5):
        self.order, self.count = order, {n: {} for n in range(1, order + 1)}
        for t in texts:
            for g in self.read(t):
                self.count[len(g)][g] = self.count[len(g)].get(g, 0) + 1
        for n in range(order - 1, 0, -1):
            for g in self.count[n + 1]:
                self.count[n][g[1:]] = self.count[n].get(g[1:], 0) + 1
        self.off = {}
        for n, c in self.count.items():
            of = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
            if all(of):
                y = of[0] / (of[0] + 2 * of[1])
                self.off[n] = [min(max(k - (k + 1) * y * of[k] / of[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]
            else:
                self.off[n] = [0.5, 1.0, 1.5]

    def read(self, text):
        """n-grams of all predicted symbols: the characters of each word and its end."""
        for w in text.split():
            line = "\x02" + w + "\x03"
            for j in range(1, len(line)):
                yield line[: j + 1][-self.order :]

    def p(self, g):
        if not g:
            return 1 / 65536
        n, h = len(g), g[:-1]
        after = {x: c for x, c in self.count[n].items() if x[:-1] == h}
        total = sum(after.values())
        if not total:
            return self.p(g[1:])
        off = lambda c: min(self.off[n][min(c, 3) - 1], c)
        mine = after.get(g, 0)
        return (mine - off(mine) if mine else 0) / total + sum(map(off, after.values())) / total * self.p(g[1:])

    def perplexity(self, text):
        logs = [math.log(self.p(g)) for g in self.read(text)]
        return math.exp(-sum(logs) / len(logs)) if logs else None


@pytest.mark.parametrize("max_entries", [kneser.MAX_ENTRIES, 0])
def test_perplexity_is_that_of_the_definition(spark, odd_docs, no_docs, max_entries):
    rnd = random.Random(2)
    texts = {i: " ".join(rnd.choice(["the", "then", "other", "tone", "note", "of", "été"]) for _ in range(rnd.randint(5, 25))) for i in range(40)}
    texts |= {100: "QX!! ZZ%% JJ## " * 4, 101: None, 102: "then\tother\nthe", 103: "", 104: "o", 105: "the the the"}
    docs = spark.createDataFrame([(k, t, "en" if (k or 1) % 3 else None) for k, t in [*texts.items(), (102, texts[102]), (None, "note of"), (102, "tone")]], "doc_id long, text string, lang string").withColumn("k", F.lit("x")).withColumn("t", F.lit(1))
    trusted = spark.createDataFrame([(i,) for i in range(30)] + [(None,)], "doc_id long")
    fold = {r.k for r in spark.range(200).select(F.col("id").alias("k")).where(F.pmod(F.xxhash64("k", F.lit(7)), F.lit(kneser.FOLDS)) == 0).collect()}
    plain = PlainKneserNey([texts[i] for i in range(30) if i not in fold])
    got = kneser.perplexities(docs, trusted, max_entries=max_entries).collect()
    assert len(got) == len(texts) + 3 and 2 <= len(fold & set(range(30))) <= 20
    unseen = {}
    for r in got:
        if r.doc_id is not None and r.doc_id != 102:
            want = plain.perplexity(texts[r.doc_id] or "")
            assert r.perplexity == (None if want is None else pytest.approx(want, rel=1e-9))
            assert r.symbols == sum(len(w) + 1 for w in (texts[r.doc_id] or "").split())
            if r.doc_id in fold and r.doc_id < 30:
                unseen.setdefault(r.lang, []).append(want)
    for r in got:
        assert r.threshold == pytest.approx(max(unseen[r.lang])) and r.kept == (r.symbols > 0 and r.perplexity <= r.threshold)
    two = [r for r in got if r.doc_id == 102]
    assert sorted(r.symbols for r in two) == [5, 15, 15] and len({r.perplexity for r in two}) == 2
    assert kneser.perplexities(odd_docs, odd_docs.select("doc_id"), max_entries=max_entries).count() == odd_docs.count()
    assert kneser.perplexities(no_docs, trusted).count() == 0
    assert {r.kept for r in kneser.perplexities(docs, trusted.limit(0)).where("symbols > 0").collect()} == {True}


def test_probabilities_of_the_next_symbol_add_up(spark):
    rnd = random.Random(1)
    docs = spark.createDataFrame([(" ".join(rnd.choice(["the", "then", "other", "tone", "note"]) for _ in range(50)),)], "t string")
    table = kneser.model(docs)
    seen = [r.g for r in table.where("length(g) = 1 AND logp IS NOT NULL").collect()]
    histories = ["\x02", "\x02th", "th", "the", "zz", ""]
    asked = spark.createDataFrame([(h + c,) for h in histories for c in [*seen, "☃"]], "g string")
    got = {r.g: math.exp(r.s) for r in kneser.gram_scores(asked, table).collect()}
    for h in histories:
        assert sum(got[h + c] for c in seen) + (kneser.UNKNOWN - len(seen)) * got[h + "☃"] == pytest.approx(1.0)


def test_toxicity_learns_words_and_their_misspellings():
    rnd = random.Random(4)
    bad = ["worthless", "disgusting", "pathetic"]

    def text(toxic, n=80):
        w = prose(rnd, n, 900).split()
        if toxic:
            w[rnd.randrange(n)] = rnd.choice(bad)
        return " ".join(w)

    y = [int(i % 3 == 0) for i in range(600)]
    scorer = toxicity.Scorer(toxicity.train([text(v) for v in y], y))
    held = [(scorer(text(v, 300)), v) for v in y[:200]]
    assert np.mean([s >= 0.5 for s, v in held if v]) > 0.9 and np.mean([s >= 0.5 for s, v in held if not v]) < 0.1
    assert scorer("w1 w2 disgustting w3") > scorer("w1 w2 w5 w3")


def test_toxicity_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd_docs, labels)
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(no_docs, model).count() == 0
    none = toxicity.fit(odd_docs, labels.limit(0))
    assert {r.score for r in toxicity.score(odd_docs, none).collect()} == {0.0}


def picture(seed, cells=8, cell=14):
    g = np.random.default_rng(seed).integers(0, 255, (cells, cells)).astype(np.uint8)
    return np.kron(g, np.ones((cell, cell), np.uint8))


def test_copies_are_found_and_others_are_not(spark):
    a, b = picture(1), picture(2)
    cases = {0: a, 1: a, 2: a[12:, 9:], 3: np.rot90(a).copy(), 4: (a * 0.6 + 30).astype(np.uint8), 5: np.clip(a + np.random.default_rng(0).normal(0, 3, a.shape), 0, 255).astype(np.uint8), 10: b, 11: b[:, :95].copy(), 20: picture(3), 21: picture(4), 22: np.zeros((80, 80), np.uint8), 23: np.zeros((3, 3), np.uint8)}
    rows = [(k, bytearray(media.encode(v))) for k, v in cases.items()] + [(30, None), (31, bytearray(b"no picture")), (None, bytearray(media.encode(picture(9))))]
    got = {r.image_id: r for r in media.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert len(got) == len(rows)
    assert {got[k].component_id for k in range(6)} == {0} and {got[k].component_id for k in (10, 11)} == {10}
    assert all(got[k].component_id == k for k in (20, 21, 22, 23, 30, 31)) and got[30].n_corners == 0
    assert media.copies(spark.createDataFrame([], "image_id long, image binary")).count() == 0
    assert got[None].component_id is None


def edited(grey, degrees, scale, noise, seed):
    h, w = grey.shape
    y, x = np.mgrid[: int(h * scale), : int(w * scale)]
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    v, u = (y - h * scale / 2) / scale, (x - w * scale / 2) / scale
    r, q = np.clip(c * v - s * u + h / 2, 0, h - 1.001), np.clip(s * v + c * u + w / 2, 0, w - 1.001)
    i, j = r.astype(int), q.astype(int)
    a, b, g = r - i, q - j, grey.astype(float)
    g = g[i, j] * (1 - a) * (1 - b) + g[i, j + 1] * (1 - a) * b + g[i + 1, j] * a * (1 - b) + g[i + 1, j + 1] * a * b
    return np.clip(g + np.random.default_rng(seed).normal(0, noise, g.shape), 0, 255).astype(np.uint8)


def test_edited_copies_become_candidates(spark):
    edits = [(7, 1, 0), (17, 1, 0), (33, 1, 0), (0, 0.8, 0), (0, 1.25, 0), (12, 0.9, 0), (0, 1, 15), (5, 1, 8), (25, 0.8, 12), (0, 1, 25)]
    sources = {100 * n: picture(50 + n, 12, 13) for n in range(6)}
    pictures = dict(sources) | {k + 1 + i: edited(g, *e, seed=k + i) for k, g in sources.items() for i, e in enumerate(edits)}
    found = {k: media.features(g) for k, g in pictures.items()}
    reps = spark.createDataFrame([(k, bytearray(d.tobytes())) for k, (_, d) in found.items()], "key long, descriptors binary")
    seen = {}
    for r in media._tables(reps).collect():
        seen.setdefault(r.key, {}).setdefault(r.bucket, set()).add(r.corner)
    good = [(k - k % 100, k) for k in pictures if k % 100 and media.consensus(*found[k - k % 100], *found[k]) >= media.CONSENSUS]
    met = [len(set().union(*[c for x, c in seen[b].items() if x in seen[a]])) >= media.VOTES for a, b in good]
    assert len(good) >= 50 and np.mean(met) >= 0.9


def agree(a, b):
    """Corners of b that share a table's chunk with a."""
    chunk = lambda d: [{(t, bytes(row)) for t, row in enumerate(np.packbits(x[media.CHUNKS], axis=1))} for x in np.unpackbits(d, axis=1)]
    have = set().union(*chunk(a), set())
    return sum(bool(x & have) for x in chunk(b))


def test_components_are_those_of_all_pairs(spark):
    a, b = picture(70), picture(71, 9, 13)
    noisy = lambda g, k, by: np.clip(g + np.random.default_rng(k).normal(0, by, g.shape), 0, 255).astype(np.uint8)
    pictures = {k: noisy(a, k, 2) for k in range(40)} | {100: edited(a, 20, 1, 3, 1), 101: edited(a, 0, 0.8, 2, 2), 102: a[:, :80].copy(), 103: noisy(a, 9, 45)}
    pictures |= {200 + k: noisy(b, k, 6) for k in range(6)} | {300 + k: picture(80 + k) for k in range(8)}
    # A mark in the corner of pictures that have nothing else in common.
    for k in range(8):
        pictures[400 + k] = picture(90 + k, 10, 12)
        pictures[400 + k][:40, :40] = a[:40, :40]
    found = {k: media.features(g) for k, g in pictures.items()}
    best = {k: k for k in pictures}

    def root(k):
        while best[k] != k:
            k = best[k]
        return k

    for x in sorted(pictures):
        for y in sorted(pictures):
            if x < y and agree(found[x][1], found[y][1]) >= media.VOTES and media.consensus(*found[x], *found[y]) >= media.CONSENSUS:
                lo, hi = sorted((root(x), root(y)))
                best[hi] = lo
    got = media.copies(spark.createDataFrame([(k, bytearray(media.encode(g))) for k, g in pictures.items()], "image_id long, image binary").withColumn("key", F.lit("k")).withColumn("bucket", F.lit(1))).collect()
    assert {r.image_id: r.component_id for r in got} == {k: root(k) for k in pictures}
    assert {root(k) for k in range(40)} == {0} and root(101) == 0 and root(102) == 0 and len({root(300 + k) for k in range(8)}) == 8


def test_votes_of_small_and_large_buckets_add_up(spark):
    # Two corners that agree in a small bucket and one in a large one are three votes.
    rows = [(5, 6, 1), (5, 6, 2), (5, 6, 70), (1, 9, 3), (1, 9, 3), (1, 9, 4)]
    pairs = media._voted(spark.createDataFrame(rows, "a long, b long, corner int"), 90).collect()
    assert [tuple(r) for r in pairs] == [(5, 6)]


def test_pictures_that_agree_once_make_no_rows(spark, monkeypatch):
    rnd = random.Random(8)
    # One bucket that all share, and a few buckets that tell which share more; keys of a component are equal modulo 50.
    rows = [(-1, 0, k) for k in range(300)] + [(rnd.randrange(150), c, k) for k in range(300) for c in range(8) for _ in range(2)]
    have, comp = {}, spark.createDataFrame([(k, k % 50) for k in range(50, 300)], "node long, component long")
    for b, c, k in rows:
        have.setdefault(k, {}).setdefault(b, set()).add(c)
    votes = lambda a, b: len(set().union(*[c for x, c in have[b].items() if x in have[a]]))
    want = sorted((a, b) for a in range(300) for b in range(a + 1, 300) if a % 50 != b % 50 and votes(a, b) >= media.VOTES)
    monkeypatch.setattr(media, "AT_ONCE", 500)
    shared = spark.createDataFrame(rows, "bucket long, corner int, key long")
    assert sorted(map(tuple, media._between(shared, comp).collect())) == want and 0 < len(want) < 20000
    # More blocks than a mask has bits.
    monkeypatch.setattr(media, "BLOCKS", 70)
    assert sorted(map(tuple, media._between(shared, comp).collect())) == want


def test_large_pictures_keep_corners_everywhere():
    g = picture(33, 26, 14)
    crop = g[182:, 182:].copy()
    whole, part = media.features(g), media.features(crop)
    assert len(whole[0]) > 4 * media.CORNERS and media.consensus(*whole, *part) >= media.CONSENSUS and agree(whole[1], part[1]) >= media.VOTES


def test_netpbm_pictures():
    assert media.decode(b"P5 2 1 255\n\x01\x02").tolist() == [[1, 2]]
    assert media.decode(b"P5 9 9 255\n\x01") is None and media.decode(b"GRY1") is None


def test_longest_common_subsequence():
    rnd = random.Random(6)
    for _ in range(200):
        a, b = [[rnd.randint(0, 4) for _ in range(rnd.randint(0, 12))] for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontam.lcs(a, b) == t[-1][-1]


def test_leaks_are_found_as_by_brute_force(spark):
    rnd = random.Random(7)
    items = [(i, prose(rnd, rnd.randint(12, 90), 3000)) for i in range(40)] + [(90, "Three short words"), (91, ""), (92, None)]
    rows = []
    for i in range(150):
        t = prose(rnd, rnd.randint(10, 400), 3000)
        if i % 10 == 0:
            w = items[i // 10][1].split()
            kept = [x for x in w if rnd.random() > (0.25 if i % 20 else 0.0)]
            t = f"{t} {' '.join(kept).upper()} {prose(rnd, 50, 3000)}"
        if i % 2:
            t += f" {items[39][1]}"  # one item in half of all documents
        rows.append((i, t))
    rows += [(200, "so three, short words."), (201, "three words short"), (202, None)]
    got = {(r.k, r.item_id) for r in decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for k, t in rows:
        w = decontam.words_of(t or "")
        for i, x in items:
            item = decontam.Item(i, x or "")
            n = len(item.words)
            if n and any(item.held_by(w[max(0, p - n) : p + 64 + n])[0] for p in range(0, max(1, len(w) - 32), 32)):
                want.add((k, i))
    assert got == want and (200, 90) in want and (201, 90) not in want


def test_paraphrases_are_found_whatever_words_they_change(spark, monkeypatch):
    rnd = random.Random(17)
    vocabulary = [f"v{i}" for i in range(6000)]
    zipf = [1 / (i + 60) for i in range(6000)]
    text = lambda n: rnd.choices(vocabulary, zipf, k=n)
    items = [(i, " ".join(text(rnd.randint(30, 70)))) for i in range(40)]
    rows, planted = [(i, " ".join(text(rnd.randint(40, 500)))) for i in range(600)], {}
    rank = {w: i for i, w in enumerate(vocabulary)}
    for i, t in items:
        w = t.split()
        rare = set(sorted(set(w), key=lambda x: -rank[x])[:6])
        for kind in ("drop", "swap", "rare", "rare and swap"):
            new = [x for x in w if rnd.random() > 0.3] if kind == "drop" else [rnd.choice(vocabulary[:200]) if (x in rare and "rare" in kind) or ("swap" in kind and rnd.random() < (0.25 if kind == "swap" else 0.1)) else x for x in w]
            if decontam.Item(i, t).held_by(decontam.words_of(" ".join(new)))[0]:
                planted[1000 + len(rows), i] = kind
                rows.append((1000 + len(rows), " ".join([*text(80), *new, *text(60)])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = []
    for size in (1000, 15):
        monkeypatch.setattr(decontam, "BLOCK_ITEMS", size)
        found.append({(r.k, r.item_id) for r in decontam.matches(docs, bench).collect()})
    assert len(planted) > 100
    for got in found:
        for kind in set(planted.values()):
            assert np.mean([p in got for p, k in planted.items() if k == kind]) >= 0.9, kind
    assert len(found[0] ^ found[1]) <= 0.05 * len(planted)


def test_candidates_have_enough_of_an_item(spark, monkeypatch):
    """Texts that share rare words of an item, but less of it than the check asks for, aren't read again, and the others are all found."""
    rnd = random.Random(8)
    items = [(i, " ".join(f"q{rnd.randint(0, 900)}" for _ in range(rnd.choice([1, 5, 30, 90]))) + f". r{i} r{i} u{i}") for i in range(60)]
    docs = []
    for d in range(400):
        i, w = d % 60, items[d % 60][1].split()
        part = w[-6:] if d % 4 else w[: max(1, int(len(w) * rnd.choice([0.4, 0.55, 0.8, 1.0])))]
        docs.append((d, " ".join([f"z{rnd.randint(0, 500)}" for _ in range(rnd.randint(0, 120))] + part + ["end"] * rnd.randint(0, 60))))
    read, checked = [], decontam._checked
    monkeypatch.setattr(decontam, "_checked", lambda rows, near, items: read.append((near.select("k", "item").distinct().collect(), items)) or checked(rows, near, items))
    got = {(r.k, r.item_id) for r in decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    near, told = read[0]
    text = {d: decontam.words_of(t) for d, t in docs}
    enough = lambda k, item: sum(item.times[w] for w in item.distinct & set(text[k])) >= decontam.PARAPHRASE * len(item.words)
    assert near and all(enough(r.k, told[r.item]) for r in near)
    want = {(k, x.id) for k, w in text.items() for x in told if x.held_by(w)[0]}
    assert len(got & want) >= 0.95 * len(want) and got <= want


def test_decontamination_of_odd_documents(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "word"), (2, None)], "item_id long, text string")
    got = decontam.decontaminate(odd_docs, bench).collect()
    assert len(got) == odd_docs.count() and {r.doc_id for r in got if r.contaminated} == {3, None}
    assert decontam.clean(odd_docs, bench).columns == odd_docs.columns
    assert decontam.clean(odd_docs, bench.limit(0)).count() == odd_docs.count() and decontam.clean(no_docs, bench).count() == 0


def test_items_without_an_id_are_searched(spark):
    docs = spark.createDataFrame([(1, "so three, short words."), (2, "and four quite short ones"), (3, "three short words, four quite short ones"), (4, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "Three short words"), (7, "Four quite short"), (None, "short ones")], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontam.decontaminate(docs, bench).collect()}
    assert got == {1: [None], 2: [None, 7], 3: [None, 7], 4: []}
    assert [r.doc_id for r in decontam.clean(docs, bench).collect()] == [4]
