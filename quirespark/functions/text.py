"""Column functions over texts. Null in, null out, unless said otherwise."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quirespark.functions import patterns as P
from quirespark.functions.regex import WS, java


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace(t: Column, pattern: str, by: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(t, java(pattern, ignore_case), by)


def count(t: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.regexp_count(t, F.lit(java(pattern, ignore_case)))


def matches(t: Column, pattern: str, ignore_case: bool = False) -> Column:
    return t.rlike(java(pattern, ignore_case))


def trim(t: Column) -> Column:
    return F.regexp_replace(t, rf"^{WS}+|{WS}+\z", "")


def nfc(t: Column) -> Column:
    """Composed form; ASCII texts and texts without combining marks stay in the JVM."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return F.when(t.rlike(r"[^\x00-\x{2FF}]"), compose(t)).otherwise(t)


def split_filter(t: Column, pattern: str) -> Column:
    """The non-blank parts between matches of a pattern."""
    return F.filter(F.split(t, java(pattern)), lambda x: x.rlike(r"[^\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"))


def words(t: Column) -> Column:
    return F.filter(F.split(t, WS + "+"), lambda x: x != "")


def word_count(t: Column) -> Column:
    return F.size(words(t)).cast("long")


def line_count(t: Column) -> Column:
    return F.size(F.split(t, "\n")).cast("long")


def sentence_count(t: Column) -> Column:
    return F.size(split_filter(t, r"[.!?]+")).cast("long")


def paragraph_count(t: Column) -> Column:
    return F.size(split_filter(t, r"\n\s*\n")).cast("long")


def syllables(t: Column) -> Column:
    """Vowel groups of each ASCII word, one less for a final e, at least one."""
    tokens = F.regexp_extract_all(F.lower(t), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    groups = lambda w: F.regexp_count(w, F.lit("[aeiouäöüy]+"))
    return F.aggregate(tokens, F.lit(0), lambda a, w: a + F.greatest(F.lit(1), groups(w) - F.when(w.endswith("e") & (groups(w) > 1), 1).otherwise(0))).cast("long")


def readability(t: Column) -> Column:
    """Reading ease between 0 and 100; 0 without sentences or words."""
    s, w = sentence_count(t).cast("double"), word_count(t).cast("double")
    raw = 206.835 - 1.015 * (w / s) - 84.6 * (syllables(t).cast("double") / w)
    return F.when(t.isNotNull(), F.round(F.when((s > 0) & (w > 0), F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).otherwise(0.0), 6))


def normalize(t: Column) -> Column:
    return trim(F.regexp_replace(nfc(t), WS + "+", " "))


_LETTER = "a-zA-ZäöüÄÖÜß"


def remove_garbage(t: Column) -> Column:
    """Long runs of blanks and isolated signs that are no letters."""
    x = replace(t, rf"([^{_LETTER}])\s{{6,}}([^{_LETTER}])", "$1 $2")
    x = replace(x, rf"([^{_LETTER}])\s{{6,}}", "$1 ")
    x = replace(x, rf"\s{{6,}}([^{_LETTER}])", " $1")
    x = replace(x, r"\s{6,}", " ")
    x = replace(x, rf"\s([^{_LETTER}])\s", " ")
    x = replace(replace(x, rf"^([^{_LETTER}])\s", ""), rf"\s([^{_LETTER}])$", "")
    return trim(replace(x, r"\s{2,}", " "))


def _fragments(pattern: str) -> list[str]:
    """Small-letter strings of which a text must hold one for the pattern to match."""
    body = re.sub(r"\(\?=.*\)$", "", pattern.replace(r"\b", ""))
    m = re.fullmatch(r"(.*?)\[(\w+)\](.*)", body)
    if "(" in body:
        return [re.sub(r"\(\[a-zA-Z\]\+\)", "", body).lower()]
    return [f"{m[1]}{c}{m[3]}".lower() for c in m[2]] if m else [body.lower()]


def fix_umlauts(t: Column, rules: list[tuple[str, bool, str]] | None = None) -> tuple[Column, Column]:
    """The corrected text, and how often the rules match the text as it was.

    Most texts hold none of the rules' letters; a plain substring test spares
    them the expressions without changing any result.
    """
    rules = P.UMLAUT_RULES if rules is None else rules
    low = F.lower(t)
    out, n, some = t, F.lit(0), F.lit(False)
    for pattern, ignore, by in rules:
        held = F.lit(False)
        for f in _fragments(pattern):
            held = held | F.contains(low, F.lit(f))
        out = replace(out, pattern, by, ignore)
        n = n + F.when(held, count(t, pattern, ignore)).otherwise(0)
        some = some | held
    return F.when(some, out).otherwise(t), F.when(t.isNotNull(), n).cast("long")


def collapse_blanks(t: Column) -> Column:
    """Two and more blanks or line ends become one blank; a single line end stays."""
    return F.regexp_replace(t, WS + WS + "+", " ")


def boundaries(t: Column, before: Column, after: Column) -> dict[str, Column]:
    """The text between two markers; a marker that is missing or null sets no boundary.

    Where the end would come before the start, the whole text is kept.
    """
    x = nfc(collapse_blanks(t))
    at = F.when(before.isNotNull() & (before != ""), F.position(before, x)).otherwise(0)
    start = F.when(at > 0, at + F.char_length(before)).otherwise(1)
    end_at = F.when(after.isNotNull() & (after != ""), F.position(after, x, start)).otherwise(0)
    end = F.when(end_at > 0, end_at).otherwise(F.char_length(x) + 1)
    body = F.when(start >= end, x).otherwise(F.call_function("substring", x, start, end - start))
    return {"text": body, "start_found": F.coalesce(at > 0, F.lit(False)), "end_found": F.coalesce(end_at > 0, F.lit(False))}


def fix_mojibake(t: Column) -> Column:
    for bad, good in P.MOJIBAKE:
        t = F.replace(t, F.lit(bad), F.lit(good))
    return t


CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def drop_control(t: Column) -> Column:
    return F.regexp_replace(t, CONTROL, "")


def clean_plain(t: Column) -> Column:
    """The plain-text normaliser: line ends, control characters, composition, blanks, decoding faults, empty lines."""
    x = F.regexp_replace(t, "\r\n|\r", "\n")
    x = fix_mojibake(F.replace(nfc(drop_control(x)), F.lit("\u00a0"), F.lit(" ")))
    return trim(F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), "\n{3,}", "\n\n"))


def strip_html(t: Column) -> Column:
    """Tags away, named and numeric entities decoded, blanks collapsed. Texts without entities by number stay in the JVM."""
    x = F.regexp_replace(t, "<[^>]*>", "")
    for name, by in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " ")):
        x = F.replace(x, F.lit(name), F.lit(by))

    @F.pandas_udf("string")
    def numeric(s: pd.Series) -> pd.Series:
        def one(m: re.Match) -> str:
            n = int(m[1]) if m[1] else int(m[2], 16)
            return chr(n & 0xFFFF) if n < 0x110000 and not 0xD800 <= n & 0xFFFF < 0xE000 else "�"

        return s.map(lambda v: None if v is None else re.sub(r"&#(\d+);|&#x([0-9a-fA-F]+);", one, v))

    x = F.when(x.rlike("&#(?:[0-9]+|x[0-9a-fA-F]+);"), numeric(x)).otherwise(x)
    return trim(F.regexp_replace(x, WS + "+", " "))


def debris_count(t: Column) -> Column:
    n = F.lit(0)
    for p in P.DEBRIS:
        n = n + count(t, p)
    return n.cast("long")


def broken_words(t: Column) -> Column:
    return count(t, P.BROKEN_WORD, True).cast("long")


def replace_debris(t: Column) -> Column:
    for p, by in P.DEBRIS_REPLACEMENTS:
        t = F.regexp_replace(t, p, by)
    x = trim(t)
    return F.when(x == "", F.lit(" ")).otherwise(x)


def language(t: Column) -> Column:
    """'de', 'en' or, on a tie, 'auto', by hints among the first 1000 characters; this is the reference rule, a property of the beginning of a text."""
    x = F.lower(F.substring(t, 1, 1000))
    de = sum((F.contains(x, F.lit(w)).cast("int") for w in P.GERMAN_HINTS), F.lit(0))
    en = sum((F.contains(x, F.lit(w)).cast("int") for w in P.ENGLISH_HINTS), F.lit(0))
    return F.when(de > en, "de").when(en > de, "en").when(t.isNotNull(), "auto")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def runs(t: Column, least: int) -> Column:
    """Maximal runs of one character, at least so long; line ends do not count."""
    return F.regexp_count(t, F.lit(rf"(?s)([^\n\r\x{{2028}}\x{{2029}}])\1{{{least - 1},}}"))


def cleanliness(t: Column) -> Column:
    bad = count(t, P.NON_LATIN) + runs(t, 4)
    return F.when(F.char_length(t) > 0, clamp(1 - bad / F.char_length(t), 0.0, 1.0)).when(t.isNotNull(), 0.0)


def validation_metrics(t: Column) -> dict[str, Column]:
    """Length, counts and the three scores of the quality validation."""
    s, w, p = sentence_count(t), word_count(t), paragraph_count(t)
    per = F.when(s > 0, w / s).otherwise(0.0)
    return {
        "text_length": F.char_length(t).cast("long"),
        "word_count": w,
        "sentence_count": s,
        "paragraph_count": p,
        "readability_score": F.when(t.isNotNull(), F.round(clamp(1 - (per - 15) / 50, 0.0, 1.0), 6)),
        "structure_score": F.round(F.least(F.lit(1.0), p / 10), 6),
        "cleanliness_score": F.round(cleanliness(t), 6),
    }


def quality(t: Column, kind: str, utf8: Column | bool = True, chapters: Column | None = None) -> dict[str, Column]:
    """Quality score, confidence and issue types of a text from a txt, pdf or epub source."""
    n = F.char_length(t)
    rules: list[tuple[str, Column, int]] = [
        ("missing_text", F.char_length(trim(t)) < 100, 30),
        ("encoding", F.contains(t, F.lit("�")), 20),
    ]
    if kind == "txt":
        rules += [("encoding", F.contains(t, F.lit("â€")) | F.contains(t, F.lit("Ã")), 15), ("corruption", t.rlike(CONTROL), 10)]
    elif kind == "pdf":
        rules.append(("corruption", runs(t, 6) > 0, 15))
    else:
        rules += [("formatting", t.rlike("[<>]"), 15), ("missing_text", (chapters if chapters is not None else F.lit(0)) == 0, 15)]
    rules.append(("formatting", ~matches(t, r"[.!?]\s+[A-Z]") & (n > 500), 10))
    score, confidence = F.lit(100), F.lit(1.0)
    for _, bad, points in rules:
        score = score - F.when(bad, points).otherwise(0)
        confidence = confidence - F.when(bad, points / 100).otherwise(0.0)
    if kind == "txt":
        bonus = F.lit(utf8) if isinstance(utf8, bool) else utf8
        score, confidence = score + F.when(bonus, 5).otherwise(0), confidence + F.when(bonus, 0.05).otherwise(0.0)
    ok = t.isNotNull()
    return {
        "score": F.when(ok, clamp(score, 0, 100)).cast("long"),
        "confidence": F.when(ok, F.round(clamp(confidence, 0.0, 1.0), 6)),
        "issues": F.when(ok, F.array_join(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad, _ in rules])), ",")),
    }


def duration(ms: Column) -> Column:
    """Milliseconds as ms, s, m s or h m s."""
    s = F.floor(ms / 1000)
    return (
        F.when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit("ms")))
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor(s % 3600 / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
    )


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """``{key}`` replaced by its value; a key without value keeps its place."""
    for k, v in values.items():
        template = F.when(v.isNotNull(), F.replace(template, F.lit("{" + k + "}"), v)).otherwise(template)
    return template


def remove_patterns(t: Column, patterns: list[str], bare_is_regex: bool) -> tuple[Column, Column]:
    """Removal patterns in order; ``/x/`` is a regular expression, anything else one, too, or a literal.

    Also gives the matches of each pattern, counted on the text it is applied
    to. Patterns that do not compile are left out.
    """
    n = F.lit(0)
    for p in patterns:
        m = re.fullmatch(r"/(.*)/([a-z]*)", p, re.S)
        if not m and not bare_is_regex:
            n = n + (F.char_length(t) - F.char_length(F.replace(t, F.lit(p), F.lit("")))) / F.lit(len(p) or 1)
            t = F.replace(t, F.lit(p), F.lit(""))
            continue
        body, flags = (m[1], m[2]) if m else (p, "")
        try:
            re.compile(body)
        except re.error:
            continue
        n = n + count(t, body, "i" in flags)
        t = replace(t, body, "", "i" in flags)
    return t, n.cast("long")


def info(t: Column) -> dict[str, Column]:
    """Lines, words, characters, control characters and language of a text as it came."""
    return {"lines": line_count(t), "words": word_count(t), "chars": F.char_length(t).cast("long"), "has_control": t.rlike(CONTROL), "language": language(t)}


def character_replacement(c: Column) -> Column:
    """The plain character for one that recognition put; '' for any other."""
    table = F.create_map(*[F.lit(x) for pair in P.CHARACTERS.items() for x in pair])
    return F.when(c.isNotNull(), F.coalesce(F.try_element_at(table, c), F.lit("")))
