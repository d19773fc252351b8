"""Finding and applying corrections in texts: issues with offsets, the enhancer, the preprocessing chain."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.functions import patterns as P
from quirespark.functions import text as T
from quirespark.operators import lines as L

_JS_SPACE = "\\s\u00a0\ufeff\u2028\u2029"
# everything that is no word sign, blank, punctuation or symbol; \\p{P} and \\p{S} by category
_DEBRIS = [None, re.compile(r"[|]{2,}"), re.compile(r"[~]{2,}"), re.compile(r"[`]{2,}"), re.compile(r"[_]{3,}"), re.compile(r"[.]{4,}")]
_BROKEN = re.compile(rf"(?<![A-Za-z0-9_])[a-zA-Z][{_JS_SPACE}]+[a-zA-Z]{{2,}}(?![A-Za-z0-9_])")

ISSUES = "id long, type string, position int, length int, problem string, fix string, confidence double, severity string"


def find_issues(text: str) -> list[tuple]:
    """``(type, position, length, problem, fix, confidence, severity)``: debris by pattern, then broken words, each in order of place."""
    import unicodedata

    out = [("ocr_debris", i, 1, c, None, 0.8, "medium") for i, c in enumerate(text) if ord(c) > 127 and not c.isspace() and unicodedata.category(c)[0] not in "PS"]
    for rx in _DEBRIS[1:]:
        out += [("ocr_debris", m.start(), m.end() - m.start(), m[0], None, 0.8, "medium") for m in rx.finditer(text)]
    return out + [("broken_word", m.start(), m.end() - m.start(), m[0], re.sub(rf"[{_JS_SPACE}]+", "", m[0]), 0.7, "medium") for m in _BROKEN.finditer(text)]


def replacement(debris: str) -> str:
    for p, by in P.DEBRIS_REPLACEMENTS:
        debris = re.sub(p, by, debris)
    return debris.strip() or " "


def apply_issues(text: str, issues: list[tuple], parity: bool = True) -> str:
    """Debris, then broken words, each from the end to the beginning.

    With ``parity`` the second round uses the places of the original text on
    the changed one, as it always did; without it the places are moved along,
    and of overlapping issues the first one counts.
    """
    debris = sorted((x for x in issues if x[0] == "ocr_debris"), key=lambda x: -x[1])
    broken = sorted((x for x in issues if x[0] == "broken_word"), key=lambda x: -x[1])
    if parity:
        for _, at, n, problem, _, _, _ in debris:
            text = text[:at] + replacement(problem) + text[at + n :]
        for _, at, n, _, fix, _, _ in broken:
            text = text[:at] + fix + text[at + n :]
        return text
    out, last = [], 0
    for kind, at, n, problem, fix, _, _ in sorted(issues, key=lambda x: x[1]):
        if at >= last:
            out += [text[last:at], replacement(problem) if kind == "ocr_debris" else fix]
            last = at + n
    return "".join(out) + text[last:]


def issues(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per issue; null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *x) for i, t in zip(b["id"], b["t"]) for x in find_issues(t)]
            yield pd.DataFrame(rows, columns=["id", "type", "position", "length", "problem", "fix", "confidence", "severity"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).filter("t IS NOT NULL").mapInPandas(run, ISSUES)


def enhance(df: DataFrame, id_col: str, text_col: str, parity: bool = True) -> DataFrame:
    """``id, text, fixed, debris, words, confidence``: the corrected text and what was done; confidence 1 where nothing was."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["t"]):
                x = find_issues(t)
                d = sum(k[0] == "ocr_debris" for k in x)
                rows.append((i, apply_issues(t, x, parity), len(x), d, len(x) - d, round(sum(k[5] for k in x) / len(x), 6) if x else 1.0))
            yield pd.DataFrame(rows, columns=["id", "text", "fixed", "debris", "words", "confidence"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).filter("t IS NOT NULL").mapInPandas(run, "id long, text string, fixed long, debris long, words long, confidence double")


def preprocess(df: DataFrame, id_col: str, text_col: str, patterns: list[str]) -> DataFrame:
    """``id, text, removed, joined``: removal patterns, then, where a text's lines need it, joined paragraphs.

    Paragraphs are separated by an empty line; texts that need no joining stay as they are.
    """
    out, n = T.remove_patterns(F.col(text_col), patterns, bare_is_regex=False)
    x = df.select(F.col(id_col).alias("id"), out.alias("t"), n.alias("removed")).filter("t IS NOT NULL").dropDuplicates(["id"])
    need = L.needs_joining(x, "id", "t").select("id", "needs_joining")
    x = x.join(need, "id")
    joined = L.join_lines(x.filter("needs_joining"), "id", "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("paragraph_no", "text"))).alias("p"), F.sum("joined").alias("joined"))
    y = x.join(joined, "id", "left")
    return y.select("id", F.when(F.col("needs_joining"), F.coalesce(F.array_join("p.text", "\n\n"), F.lit(""))).otherwise(F.col("t")).alias("text"), "removed", F.coalesce("joined", F.lit(0)).alias("joined"))
