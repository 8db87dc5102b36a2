"""Unit vectors of the text, array and numeric functions."""

import pytest
from pyspark.sql import functions as F

from loomtext.functions import arrays as V
from loomtext.functions import numeric as N
from loomtext.functions import text as X


def one(spark, value, kind, col):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x")).alias("y")).first().y


def words(n):
    return [f"w{i}" for i in range(n)]


@pytest.mark.parametrize(("n", "sizes"), [(400, [150, 150, 100]), (224, [224]), (225, [150, 75]), (0, [0])])
def test_windows(spark, n, sizes):
    got = one(spark, words(n), "array<string>", lambda c: V.windows(c))
    assert [len(x) for x in got] == sizes and sum(got, []) == words(n)


def test_disjoint_chunks(spark):
    assert [len(x) for x in one(spark, words(731), "array<string>", lambda c: V.chunks(c, 300, 0))] == [300, 300, 131]
    assert one(spark, [], "array<string>", lambda c: V.chunks(c, 300, 0)) == [[]]


def test_overlapping_chunks_cover_every_word(spark):
    got = one(spark, words(1000), "array<string>", lambda c: V.chunks(c))
    assert set(sum(got, [])) == set(words(1000)) and max(map(len, got)) <= 300
    assert got[0][250:] == got[1][:50]


def test_segments_of_a_short_text(spark):
    got = one(spark, words(5), "array<string>", lambda c: V.segments(c))
    assert [len(x) for x in got] == [1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]


@pytest.mark.parametrize(("raw", "title"), [("XII. THE KING OF THE HILLS", "The King of the Hills"), ("A Plain Title.", "A Plain Title")])
def test_titles(spark, raw, title):
    assert one(spark, raw, "string", X.clean_title) == title


@pytest.mark.parametrize(("roman", "n"), [("XIV", 14), ("MCMXC", 1990), ("IIII", None), ("", None)])
def test_roman(spark, roman, n):
    assert one(spark, roman, "string", X.roman_to_int) == n


def test_clean_text(spark):
    raw = "a  \r\n\r\n\r\n\r\nb\n [Illustration: x]\n\nc"
    assert one(spark, raw, "string", X.clean_text) == "a\n\nb\n\nc"


def test_markers(spark):
    assert one(spark, "x\n*** START OF A ***\nbody\n*** END OF A ***\ny", "string", X.strip_boilerplate).strip() == "body"


@pytest.mark.parametrize(("p", "why"), [("He went home.--(Told by him, 1886.)", []), ("and so he went on his way to the town, then", ["no end mark"]), ("XIV", ["numeral", "short capitals"])])
def test_edges(spark, p, why):
    assert one(spark, p, "string", lambda c: X.suspicious_edge(c, True)) == why


def test_trim_numerals(spark):
    assert one(spark, ["XLIX", "a", "b", "12."], "array<string>", X.trim_numerals) == ["a", "b"]
    assert one(spark, ["I"], "array<string>", X.trim_numerals) == []


def test_occurrences_do_not_overlap(spark):
    assert one(spark, "aaaa metal met", "string", lambda c: X.occurrences(c, "met")) == 2
    assert one(spark, "aaaa", "string", lambda c: X.occurrences(c, "aa")) == 2


def test_numeric(spark):
    d = spark.range(1).select(N.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("h"), N.ring_area(F.array(*map(F.lit, (0.0, 2.0, 2.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 3.0, 3.0)))).alias("a"), N.erf(F.lit(1.0)).alias("e")).first()
    assert d.h == pytest.approx(20015.086, abs=0.01) and d.a == 6.0 and d.e == pytest.approx(0.8427008, abs=1e-6)


def test_quantise_round_trip(spark):
    v = [0.5, -1.0, 0.004]
    q = one(spark, v, "array<double>", lambda c: V.quantise(c, F.lit(1.0)))
    back = one(spark, q, "array<int>", lambda c: V.dequantise(c, F.lit(1.0)))
    assert q[1] == -127 and max(abs(a - b) for a, b in zip(v, back, strict=True)) <= 0.5 / 127


def test_keys_take_compatible_forms_for_one(spark):
    assert one(spark, "“Ｔｈｅ\u00a0Fox”—e\u0301 \ufb01n!", "string", X.key_of) == "THE FOX É FIN"
    assert one(spark, "XIV. The  fox", "string", X.key_without_numeral) == "THE FOX"
    assert one(spark, "", "string", X.key_of) == "" and one(spark, None, "string", X.key_of) is None
    assert one(spark, "cafe\u0301", "string", X.clean_text) == "caf\u00e9"


def test_normal_forms(spark):
    assert one(spark, "e\u0301\uff21", "string", X.normalise) == "\u00e9\uff21"
    assert one(spark, "e\u0301\uff21", "string", lambda c: X.normalise(c, "NFKC")) == "\u00e9A"
    assert one(spark, None, "string", X.normalise) is None


def test_catalogue_of_a_publisher(spark):
    prices = "[Two Shillings]\n\nB\n\n[Sixpence]\n\nC"
    assert one(spark, f"tale\n\nA\n\n{prices}", "string", X.cut_catalogue) == "tale"
    assert one(spark, f"tale\n\nLONDON: X\n\nA\n\n{prices}", "string", X.cut_catalogue) == "tale"
    assert one(spark, "last prose\n\nTHE NEW BOOKS of the year\n[Two Shillings]\n\nB\n\n[Sixpence]", "string", X.cut_catalogue) == "last prose"
    assert one(spark, "[Two Shillings]\n[Sixpence]", "string", X.cut_catalogue) == "[Two Shillings]\n[Sixpence]"
    assert one(spark, "tale\n\n[Sixpence]", "string", X.cut_catalogue) == "tale\n\n[Sixpence]"


def test_strings_by_hand(spark):
    cases = {
        "strip_boilerplate": [("noise\n*** START OF THE BOOK ***\nbody one\n\nbody two\n*** END OF THE BOOK ***\ntail", "body one\n\nbody two"), ("no marks at all", "no marks at all"), ("x\n***START OF A\nonly start", "only start"), (None, None)],
        "clean_title": [("XII. THE KING OF THE HILLS", "The King of the Hills"), ('3) "Old Tom",', 'Old Tom"'), ("A Plain Title.", "A Plain Title"), ("", "")],
        "clean_entry": [("The Fox . . . . . 12", "The Fox"), ("Tom Thumb 7", "Tom Thumb 7"), ("The story of 1001", "The story of 1001"), ("A tale . . . xii", "A tale"), ("Tom Thumb   XL ", "Tom Thumb"), ("Plain", "Plain"), ("Dots ....", "Dots"), ("", "")],
        "roman_to_int": [("XIV", 14), ("MCMXC", 1990), ("IIII", None), ("", None), ("abc", None), ("xlix", 49)],
        "decode_macrons": [("T[=o]ky[=o] [=O] [=u]", "Tōkyō Ō ū"), ("[=x]", "[=x]"), (None, None)],
    }
    for name, rows in cases.items():
        d = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, s string")
        got = [r.x.strip(" \n") if isinstance(r.x, str) else r.x for r in d.select("i", getattr(X, name)(F.col("s")).alias("x")).orderBy("i").collect()]
        assert got == [b for _, b in rows], name
    d = spark.createDataFrame([("XLIX|body a|body b|12.",), ("body",), ("I|II",), ("a|XX|b",)], "s string")
    assert [r.x for r in d.select(F.array_join(X.trim_numerals(F.split("s", r"\|")), "|").alias("x")).collect()] == ["body a|body b", "body", "", "a|XX|b"]
    got = spark.createDataFrame([("plain _strong_ end",)], "s string").select(X.emphasis(F.col("s")).alias("x")).first().x
    assert [(r.text, r.emphasised) for r in got] == [("plain ", False), ("strong", True), (" end", False)]
