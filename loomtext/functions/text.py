"""Text functions as columns. Patterns are Java's; (?U) makes \\s, \\w and \\b Unicode-aware."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and lists whose results have to be the same elsewhere.
BLANKS = r"(?U)\s+"
LATIN_WORD = "[a-zà-ÿ]+"
NAME_WORD = "[A-Za-zÀ-ɏ']+"
PROFILE_WORD = "[A-Za-zÀ-ÿ']+"
START_LINE = r"(?m)^\*\*\* ?START OF.*$"
END_LINE = r"(?m)^\*\*\* ?END OF.*$"
ILLUSTRATION = r"(?m)^[ \t\n]*\[Illustration[^\]]*\][ \t]*$"
LEADING_NUMERAL = r"^\s*(?:[IVXLCDM]+|\d+)\s*[.．—–:)-]?\s+"
BARE_NUMERAL = r"^\s*(?:[IVXLCDM]{1,8}|\d{1,3})\.?\s*$"
BACKMATTER_ANY = r"(?im)^\s*(?:Transcriber'?s? Note.*|End of (?:the )?Project Gutenberg.*|\*\*\* END OF .*)\s*$"
BACKMATTER_LAST = r"(?m)^\s*(?:(?:\*\s*){3,}\*?|THE END\.?|FINIS\.?|Inhalt|INHALT|Printed by .*|NOTES AND REFERENCES|NOTES?|FOOTNOTES?|APPENDIX|GLOSSARY|BIBLIOGRAPHY|INDEX|_?Uniform with this Volume_?|BY THE SAME AUTHOR.*)\s*$"
PRICE_LINE = r"(?m)^\s*\[[^\]\n]{0,40}(?:Shillings?|Pence|Sixpence|Guinea)"
IMPRINT = r"(?i)LONDON:|FIELD\s*(?:&|AND)\s*TUER|Leadenhall Press|_?By the same author"
BACKMATTER_WORDS = r"(?i)Printed (?:at|by)|University Press|Leadenhall|Field & Tuer|Transcriber|Project Gutenberg|COPYRIGHT|All rights reserved|Shillings?|Sixpence"
SMALL_WORDS = ["a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with", "who", "how", "why"]
KANJI_DIGITS, DIGITS = "〇一二三四五六七八九", "0123456789"
MACRONS = [("[=a]", "ā"), ("[=e]", "ē"), ("[=i]", "ī"), ("[=o]", "ō"), ("[=u]", "ū"), ("[=A]", "Ā"), ("[=E]", "Ē"), ("[=I]", "Ī"), ("[=O]", "Ō"), ("[=U]", "Ū")]
CJK = "[ぁ-んァ-ヶ一-龯]"
ENDS = ".,;:!?\"'()"
ANSI = "\\x1B\\[[0-9;]*[A-Za-z]"
CYRILLIC, HANGUL = "[\\x{0400}-\\x{052F}]", "[\\x{1100}-\\x{11FF}\\x{AC00}-\\x{D7AF}]"
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"


def words(c: Column) -> Column:
    """White-space words, none empty."""
    return F.filter(F.split(c, BLANKS), lambda w: w != "")


def tokens(c: Column, pattern: str = LATIN_WORD) -> Column:
    """Lower-case tokens of a pattern."""
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def paragraphs(c: Column) -> Column:
    """Blank-line paragraphs, line breaks inside as one space, none empty."""
    return F.filter(F.transform(F.split(c, "\n{2,}"), lambda p: F.trim(F.regexp_replace(p, BLANKS, " "))), lambda p: p != "")


def lines(c: Column) -> Column:
    return F.filter(F.split(c, "\n"), lambda p: F.trim(p) != "")


def occurrences(c: Column, part: str) -> Column:
    """Non-overlapping occurrences of a substring."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("long")


def strip_boilerplate(c: Column) -> Column:
    """What stands between the START and END marker lines, or all that there is."""
    after = F.when(F.regexp_instr(c, F.lit(START_LINE)) > 0, F.element_at(F.split(c, START_LINE, 2), 2)).otherwise(c)
    return F.trim(F.element_at(F.split(after, END_LINE, 2), 1))


def clean_text(c: Column) -> Column:
    """Composed characters; line ends, trailing blanks, illustration lines and blank-line runs set right."""
    t = F.replace(F.replace(normalise(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    t = F.regexp_replace(F.regexp_replace(t, ILLUSTRATION, ""), r"\n{3,}", "\n\n")
    return F.btrim(t, F.lit(" \n\t"))


def title_case(c: Column) -> Column:
    """All-capital titles in title case, small words small but for the first; others as they are."""
    small = [F.lit(w) for w in SMALL_WORDS]
    parts = F.transform(words(F.lower(c)), lambda w, i: F.when((i > 0) & w.isin(*small), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))))
    return F.when((F.upper(c) == c) & (F.lower(c) != c), F.array_join(parts, " ")).otherwise(c)


def clean_title(c: Column) -> Column:
    t = F.trim(F.regexp_replace(F.trim(c), LEADING_NUMERAL, ""))
    t = F.trim(F.btrim(t, F.lit("\"“”«»'")))
    return title_case(F.trim(F.rtrim(t, F.lit(",;:."))))


def trim_numerals(paras: Column) -> Column:
    """Paragraphs without those at either end that are a numeral alone."""
    is_text = F.transform(paras, lambda p: ~p.rlike(BARE_NUMERAL))
    first = F.array_position(is_text, True)
    last = F.size(paras) - F.array_position(F.reverse(is_text), True) + 1
    return F.when(first > 0, F.slice(paras, first.cast("int"), (last - first + 1).cast("int"))).otherwise(F.array().cast("array<string>"))


def cut_backmatter(c: Column, is_last: Column) -> Column:
    """The text before the first back-matter line; some lines end only a book's last text."""
    cut = lambda t, p: F.when(F.regexp_instr(t, F.lit(p)) > 0, F.element_at(F.split(t, p, 2), 1)).otherwise(t)
    t = cut(c, BACKMATTER_ANY)
    return F.rtrim(F.when(is_last, cut(t, BACKMATTER_LAST)).otherwise(t), F.lit(" \n\t"))


def cut_catalogue(c: Column) -> Column:
    """Texts with two price lines end before the paragraph that names an imprint; without an imprint, before the paragraph of the first price line.

    A catalogue's heading stands above its prices, so a cut inside the paragraph would leave it in.
    """
    paras = F.split(c, "\n\n")
    at = F.array_position(F.transform(paras, lambda p: p.rlike(IMPRINT)), True)
    first = F.element_at(F.split(c, PRICE_LINE, 2), 1)
    above = F.split(first, "\n\n")
    before = F.array_join(F.slice(above, F.lit(1), F.size(above) - 1), "\n\n")
    cut = F.when(at > 0, F.rtrim(F.array_join(F.slice(paras, F.lit(1), (at - 1).cast("int")), "\n\n"), F.lit(" \n\t"))).when(before != "", before).otherwise(c)
    return F.when(F.regexp_count(c, F.lit(PRICE_LINE)) >= 2, cut).otherwise(c)


def normalise(c: Column, form: str = "NFC") -> Column:
    """A Unicode normal form. Spark has no function for it, so texts go to Python in Arrow batches; ASCII texts stay in the JVM's hands."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.str.normalize(form)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    ascii_only = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_only, c).otherwise(F.pandas_udf(run, "string")(F.when(ascii_only, F.lit("")).otherwise(c)))


def key_of(c: Column, form: str | None = "NFKC") -> Column:
    """Upper case, everything but letters and digits as single spaces; compatible forms of characters are one unless ``form`` is None."""
    t = F.upper(normalise(c, form) if form else c)
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^0-9A-ZÀ-ɏ ]+", " "), " +", " "))


def key_without_numeral(c: Column, form: str | None = "NFKC") -> Column:
    return key_of(F.regexp_replace(F.trim(c), LEADING_NUMERAL, ""), form)


def clean_entry(c: Column) -> Column:
    """A line of a table of contents without dot leaders and page: a number at the end is a page only behind leaders or two blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"\s*(?:\.\s?){2,}\s*[\dIVXLCivxlc]*\s*$", ""), r"\s{2,}[\dIVXLC]+\s*$", ""))


def halves(ws: Column) -> Column:
    half = F.floor(F.size(ws) / 2).cast("int")
    return F.struct(F.slice(ws, F.lit(1), half).alias("first"), F.slice(ws, half + 1, F.size(ws)).alias("second"))


def insert_middle(ws: Column, sentence: str) -> Column:
    half = F.floor(F.size(ws) / 2).cast("int")
    return F.array_join(F.concat(F.slice(ws, F.lit(1), half), F.array(F.lit(sentence)), F.slice(ws, half + 1, F.size(ws))), " ")


def language_of(c: Column) -> Column:
    return F.when(c.rlike(CJK), "ja").otherwise("en")


def kanji_to_arabic(c: Column) -> Column:
    return F.translate(c, KANJI_DIGITS, DIGITS)


def decode_macrons(c: Column) -> Column:
    for a, b in MACRONS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_ends(c: Column, marks: str = ENDS) -> Column:
    return F.btrim(c, F.lit(marks))


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, ANSI, "")


def roman_to_int(c: Column) -> Column:
    """Value of a roman numeral; null for other strings."""
    value = F.create_map(*[F.lit(x) for p in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in p])
    v = F.transform(F.split(F.upper(c), ""), lambda x: value[x])
    total = F.aggregate(F.transform(v, lambda x, i: F.when(x < F.coalesce(F.get(v, i + 1), F.lit(0)), -x).otherwise(x)), F.lit(0), lambda a, x: a + x)
    valid = F.upper(c).rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (F.length(c) > 0)
    return F.when(valid, total)


def parse_pairs(c: Column) -> Column:
    """``k=v`` words as a map."""
    return F.map_from_entries(F.transform(F.filter(F.split(c, " "), lambda x: x.contains("=")), lambda x: F.struct(F.substring_index(x, "=", 1), F.regexp_replace(x, "^[^=]*=", ""))))


def hygiene(c: Column) -> Column:
    """Names of the character classes that a line shouldn't have."""
    return F.array_compact(F.array(F.when(c.rlike(CYRILLIC), "cyrillic"), F.when(c.rlike(HANGUL), "hangul"), F.when(c.rlike(CONTROL), "control")))


def stray_cr(c: Column) -> Column:
    return F.regexp_instr(c, F.lit("\r(?!\n)")) > 0


def suspicious_edge(p: Column, is_last: bool) -> Column:
    """Why a first or last paragraph may not be prose."""
    s = F.trim(p)
    tail = F.regexp_replace(F.regexp_replace(s, r"\s*\[\d+\]\s*$", ""), r"(?<=[.!?])[)\]_]+\s*$", "")
    reasons = [
        F.when(s.rlike(r"^\s*(?:[IVXLCDM]{1,8}|\d{1,3})[.)]?\s*$"), "numeral"),
        F.when(s.rlike("^[^A-Za-zÀ-ɏ぀-ヿ一-鿿]+$"), "no letters"),
        F.when((F.length(s) < 40) & (s == F.upper(s)) & (F.lower(s) != F.upper(s)), "short capitals"),
        F.when((F.length(s) < 200) & s.rlike(BACKMATTER_WORDS), "back matter"),
    ]
    if is_last:
        reasons.append(F.when((F.length(tail) > 30) & ~tail.rlike("[.!?。」』”\"'’—-]\\s*$"), "no end mark"))
    return F.array_compact(F.array(*reasons))


def emphasis(c: Column) -> Column:
    """Runs of ``_emphasised_`` and plain text, in order."""
    return F.filter(F.transform(F.split(c, "_"), lambda x, i: F.struct(x.alias("text"), (i % 2 == 1).alias("emphasised"))), lambda x: x["text"] != "")
