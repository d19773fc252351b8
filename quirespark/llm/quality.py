"""Problem 1: per-document text quality statistics and the prose rule list.

Statistics are native expressions. A text is cut into segments, runs of lines
of one form (list-like, other, blank lines between), and the words of each
segment are found once for all figures.

Method: incremental reduced-error pruning. An ordered list of rules "not
prose if a and b and ..." about the statistics of a segment is induced from
labelled documents: each rule is grown condition by condition on two thirds of
the labelled segments, pruned from its end on the other third, and kept while it
is right more often than wrong there; segments it covers leave the training
set. The learned thresholds are exported to one SQL ``CASE`` expression that
Spark evaluates natively over a text's segments; a text is not prose if at least
three quarters of its characters stand in segments that the list names.

The labelled documents are a bounded sample: ``LABELLED`` texts composed in
this module (natural sentence frames with invented words, in many forms; lists,
tables, indexes, contents, rulers, junk). ``RULES`` holds what learn()
finds with its default parameters, so that no query has to learn first.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.common import blank

LABELLED = 3000  # labelled documents; a parameter of learn()
NOT_PROSE = 0.75  # share of a text's characters, from the task

# --- fixed values: common words of English and German ------------------------
COMMON_EN = (
    "the of and a to in is was it that for on are as with they be at from by this have or had not but what all were when we there can an which their if will about out up them then "
    "she many some so these would other into has more her him see could no than been its who now over after also did most only where much before through because such well between both "
    "under never while last off few those always without within against neither nor nobody whenever although since unless until upon behind beside near above across around along however "
    "every one each really hardly often how you your my our us do does any whether"
)
COMMON_DE = (
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei wird sind war noch wie einer um am nach wenn nur oder aber vor zur bis mehr "
    "durch man dann sei sie ihr ihre ihren weil damit obwohl während nachdem bevor sooft niemals viele diese dieser dieses einige alle so waren schon seien weder sehr da ohne gegen wirklich "
    "hatte haben werden wurde wurden kann können muss ich wir zum vom beim über unter zwischen hier dort jede jeder kein keine etwa"
)
COMMON = frozenset((COMMON_EN + " " + COMMON_DE).split())
# ------------------------------------------------------------------------------

#: what a segment is judged by
FEATURES = ["common_per_100", "common_share", "common_letters", "mean_word_length", "symbol_ratio", "digit_ratio", "letter_ratio", "words_per_100", "distinct_share", "punct_line_share", "words_per_line", "list_form"]
_LIST_LINE = r"^\s*(?:[-*·•–—▪+]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)]|\|)\s|[|;\t].*[|;\t]|[.]{4,}|\S\s{3,}\S|,? [0-9]+(?: ff?[.])?$|^[^\p{L}]*$"
_ENDED = r"[.!?:;,»”\"'-]\s*$"
_CUT = "\u0001"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.when(b > 0, b), F.lit(0.0))


def _segments(text: Column) -> Column:
    """Runs of lines that are list-like or not, blank lines between them; null for null text."""
    form = lambda x: F.when(~x.rlike(r"\S"), 0).when(x.rlike(_LIST_LINE), 1).otherwise(2)
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), form(x).alias("form")))
    joined = lambda z: F.array_join(F.transform(z, lambda v, i: F.concat(F.when(i == 0, "").when(F.get(z, i - 1)["form"] != v["form"], _CUT).otherwise("\n"), v["line"])), "")
    return F.filter(F.split(_let(lines, joined), _CUT), lambda x: x.rlike(r"\S"))


def _figures(s: Column) -> Column:
    """The counts of one segment, and the ratios that the rules are about."""

    def with_words(w: Column) -> Column:
        lines = F.filter(F.split(s, "\n"), lambda x: x.rlike(r"\S"))
        return F.struct(
            w.alias("words"), F.char_length(F.trim(s)).alias("chars"), F.size(w).alias("n_words"), F.filter(w, lambda x: x.isin(*sorted(COMMON))).alias("common"),
            F.char_length(F.array_join(w, "")).alias("letters"), F.char_length(F.regexp_replace(s, "[^0-9]+", "")).alias("digits"), F.char_length(F.regexp_replace(s, r"\s+", "")).alias("visible"),
            F.size(lines).alias("n_lines"), F.size(F.filter(lines, lambda x: x.rlike(_ENDED))).alias("n_ended"), F.get(lines, F.lit(0)).rlike(_LIST_LINE).cast("int").alias("list_form"),
        )

    def with_ratios(k: Column) -> Column:
        n, v = k["n_words"], k["visible"]
        return F.struct(
            k.alias("k"), _share(100 * F.size(k["common"]), k["chars"]).alias("common_per_100"), _share(F.size(k["common"]), n).alias("common_share"), _share(F.char_length(F.array_join(k["common"], "")), v).alias("common_letters"), _share(k["letters"], n).alias("mean_word_length"),
            _share(v - k["letters"] - k["digits"], v).alias("symbol_ratio"), _share(k["digits"], v).alias("digit_ratio"), _share(k["letters"], v).alias("letter_ratio"), _share(100 * n, k["chars"]).alias("words_per_100"),
            _share(F.size(F.array_distinct(k["words"])), n).alias("distinct_share"), _share(k["n_ended"], k["n_lines"]).alias("punct_line_share"), _share(n, k["n_lines"]).alias("words_per_line"), k["list_form"].alias("list_form"),
        )

    return _let(_let(F.regexp_extract_all(F.lower(s), F.lit(r"\p{L}+"), F.lit(0)), with_words), with_ratios)


def _with_segments(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.col("__text")
    return df.select(F.col(id_col), F.col(text_col).alias("__text")).withColumn("__segments", F.transform(_segments(t), _figures))


def _statistics(t: Column, segments: Column) -> dict[str, Column]:
    total = lambda name: F.aggregate(segments, F.lit(0), lambda a, x: a + x["k"][name])
    n_words, n_lines, letters, digits, visible = (total(x) for x in ("n_words", "n_lines", "letters", "digits", "visible"))
    n_common = F.aggregate(segments, F.lit(0), lambda a, x: a + F.size(x["k"]["common"]))
    listed = F.aggregate(segments, F.lit(0), lambda a, x: a + x["k"]["n_lines"] * x["k"]["list_form"])
    n_chars, distinct = F.char_length(t), F.size(F.array_distinct(F.flatten(F.transform(segments, lambda x: x["k"]["words"]))))
    ratio = lambda a, b: F.round(_share(a, b), 6)
    out = {
        "n_chars": n_chars.cast("long"),
        "n_tokens": F.regexp_count(t, F.lit(r"\S+")).cast("long"),
        "n_words": n_words.cast("long"),
        "n_lines": n_lines.cast("long"),
        "mean_word_length": ratio(letters, n_words),
        "symbol_ratio": ratio(visible - letters - digits, visible),
        "digit_ratio": ratio(digits, visible),
        "letter_ratio": ratio(letters, visible),
        "punct_line_share": ratio(total("n_ended"), n_lines),
        "list_line_share": ratio(listed, n_lines),
        "common_share": ratio(n_common, n_words),
        "common_per_100": ratio(100 * n_common, n_chars),
        "words_per_100": ratio(100 * n_words, n_chars),
        "distinct_share": ratio(distinct, n_words),
    }
    # null text: the sizes of null arrays must not count as -1
    return {k: F.when(t.isNotNull(), v) for k, v in out.items()}


def with_statistics(df: DataFrame, id_col: str = "enhancement_id", text_col: str = "enhanced_text") -> DataFrame:
    """``id, statistics...``: one row per row; null text gives null figures, blank text zeros."""
    x = _with_segments(df, id_col, text_col)
    return x.select(id_col, *[c.alias(k) for k, c in _statistics(F.col("__text"), F.col("__segments")).items()])


# --- labelled documents -------------------------------------------------------
_SYLLABLES = "ba be bo da de du fa fe ga ge ha he ka ke la le li lo ma me mi na ne no pa pe ra re ri ro sa se si ta te ti to va ve wa we".split()


def _pseudo(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(2, 4))) + r.choice(["", "n", "s", "r", "ung", "ing"])


#: frames of natural sentences: N a noun, A an adjective or verb, D a number
_FRAMES_EN = (
    "When we came back from the N, somebody had already taken the A N away.|It is hard to say why the N was so A that winter.|My brother and I used to walk to the N before breakfast.|There were D of them, and none was A enough for the N.|What she wanted most of all was a N.|The A N, which nobody had seen for years, stood beside the N.|If you ask me, they should have left the N where it was.|He told us that his N would be A by the end of the week.|Neither of the two N looked A.|At first the N seemed A; later on it became clear how wrong we had been.|According to the N, about D people lived there until the N was A.|Those who know the N will understand what is meant by this.|Can anyone explain how such a N gets into the N?|In D the N of N gave up its A N and never asked for another.|I do not think that these N are A, though some of them might be.|As soon as the rain stopped, everyone went down to the N to look at the A boats.|Once again the N was A, and so was the N behind it.|The N did what it could, but it was too late for the N.|Just as the N turned A, all of the N began to A.|Each N has its own N, and yet they all share the same A roof.|You may well A the N without any N at all.|They had been told to A the N twice a day."
).split("|")
_FRAMES_DE = (
    "Als wir vom N zurückkamen, hatte jemand das A N schon weggenommen.|Es läßt sich schwer sagen, warum der N in jenem Winter so A war.|Mein Bruder und ich gingen damals immer vor dem Frühstück zum N.|Es gab D davon, doch keines war A genug für die N.|Was sie sich am meisten wünschte, war ein N.|Der A N, den seit Jahren niemand gesehen hatte, stand neben der N.|Wenn du mich fragst, hätten sie die N lassen sollen, wo sie war.|Er erzählte uns, daß seine N bis zum Ende der Woche A sein würden.|Keiner von beiden N sah A aus.|Zuerst schien der N A; erst später merkten wir, wie sehr wir uns geirrt hatten.|Nach den N lebten dort ungefähr D Leute, bis die N A wurde.|Wer die N kennt, wird verstehen, was damit gemeint ist.|Kann mir jemand erklären, wie so ein N in die N gerät?|Im Jahre D gab die N von N ihre A N auf und verlangte nie wieder danach.|Ich glaube nicht, daß diese N A sind, obwohl manche davon es sein könnten.|Sobald der Regen aufhörte, liefen alle zum N hinunter, um sich die A Boote anzusehen.|Wieder einmal war der N A, und ebenso die N dahinter.|Die N taten, was sie konnten, aber für den N kam es zu spät.|Gerade als die N A wurden, fingen sämtliche N an zu A.|Jedes N hat seine eigene N, und doch teilen sie sich dasselbe A Dach.|Viele N sind A, manche freilich bloß für die N.|Man sollte das N täglich zweimal A."
).split("|")


def _sentence(r: random.Random, frames: list[str]) -> str:
    word = {"N": lambda: _pseudo(r).capitalize(), "A": lambda: _pseudo(r), "D": lambda: str(r.randint(2, 1990))}
    return "".join(word[c]() if c in word and (k == 0 or not x[k - 1].isalpha()) and (k + 1 == len(x) or not x[k + 1].isalpha()) else c for x in [r.choice(frames)] for k, c in enumerate(x))


def _prose(r: random.Random, chars: int) -> str:
    frames = r.choice([_FRAMES_EN, _FRAMES_DE])
    s: list[str] = []
    while sum(map(len, s)) < chars:
        s.append(_sentence(r, frames))
    t = " ".join(s)
    form = r.randrange(6)
    if form in (1, 5):  # hard line ends
        out, line, width = [], "", r.randint(28, 70)
        for w in t.split():
            if len(line) + len(w) > width:
                out.append(line)
                line = w
            else:
                line = f"{line} {w}".strip()
        t = "\n".join([*out, line])
    if form in (2, 5):  # bad scan
        rate = r.choice([0.02, 0.05, 0.09, 0.14])
        t = "".join(r.choice("fnucel1") if c.isalpha() and r.random() < rate else c for c in t)
    elif form == 3:  # no punctuation
        t = "".join(c for c in t if c not in ".,?!;")
    elif form == 4:  # paragraphs
        t = "\n\n".join(" ".join(s[i : i + 3]) for i in range(0, len(s), 3))
    return t


def _listing(r: random.Random, chars: int) -> str:
    n, kind = lambda: r.randint(1, 999), r.randrange(17)
    name = lambda: _pseudo(r).capitalize()
    # entries of contents and lists hold small words, too
    open_, link = r.choice([(["The", "Of the", "On the", "How the", "A"], ["of the", "and the", "in", "at the"]), (["Von den", "Über die", "Der", "Die", "Vom"], ["der", "und die", "in den", "für"])])
    if kind in (13, 14):
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/" if kind == 13 else ".,;:!|/\\~*^_-=#<>[]{}()1lI \n") for _ in range(chars))
    if kind == 15:
        w = [_pseudo(r) for _ in range(r.randint(1, 2))]
        return r.choice([" ", "\n", ", "]).join(" ".join(w) for _ in range(1 + chars // sum(len(x) + 1 for x in w)))
    if kind == 16:
        out = []
        while sum(map(len, out)) < chars:
            out.append("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 11))))
        return " ".join(out)
    make: list[Callable[[int], str]] = [
        lambda i: f"{r.choice('-*·•–')} {_pseudo(r)} {_pseudo(r)}",
        lambda i: f"({i}) {_pseudo(r)}, {_pseudo(r)} {_pseudo(r)}",
        lambda i: f"{chr(97 + i % 26)}) {name()} – {_pseudo(r)} ({1700 + n() % 300})",
        lambda i: f"{i}. {name()} {_pseudo(r)} {'.' * r.randint(8, 40)} {n()}",
        lambda i: f"| {_pseudo(r)} | {n()} | {n()},{n() % 100:02d} |",
        lambda i: f"{name()}, {n()}, {n()}, {n()} f.",
        lambda i: f"{name():<26} {n():>5}   {n():>6}   {n():>6}",
        lambda i: f"{n()};{name()};{_pseudo(r)};{1700 + n() % 300};{n()}",
        lambda i: r.choice("*~=._-x") * r.randint(20, 60),
        lambda i: f"{i}. {r.choice(open_)} {name()} {r.choice(link)} {name()} {'.' * r.randint(8, 40)} {n()}",
        lambda i: f"{r.choice('-*•–')} {r.choice(open_)} {_pseudo(r)} {r.choice(link)} {_pseudo(r)} {_pseudo(r)}",
        lambda i: f"{r.choice(open_)} {name()} {r.choice(link)} {name()}, {n()}",
        lambda i: "|---|---|" if i == 2 else f"| {r.choice('abcdefghij')} | {n() % 10} |",
    ]
    out: list[str] = []
    while sum(map(len, out)) < chars:
        out.append(make[kind](len(out) + 1))
    return "\n".join(out)


def labelled(n: int = LABELLED, seed: int = 11) -> list[tuple[int, str, bool]]:
    """``(id, text, not_prose)``: half of each."""
    r = random.Random(seed)
    size = lambda: r.choice([30, 60, 150, 400, 800, 1600])
    return [(i, _listing(r, size()), True) if r.random() < 0.5 else (i, _prose(r, size()), False) for i in range(n)]


def mixtures(n: int, seed: int) -> list[tuple[int, str, bool]]:
    """``(id, text, not_prose)``: prose and lists in one text, labelled by their share of the characters."""
    r, out = random.Random(seed), []
    for i in range(n):
        share, size = r.choice([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.86, 0.9, 0.95]), r.choice([600, 1200, 2400])
        a, b = _prose(r, int(size * (1 - share))), _listing(r, int(size * share))
        out.append((i, f"{a}\n\n{b}" if r.random() < 0.5 else f"{b}\n\n{a}", len(b) >= NOT_PROSE * (len(a) + len(b))))
    return out


# --- incremental reduced-error pruning ----------------------------------------
Rule = list[tuple[int, str, float]]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, op, v in rule:
        ok &= x[:, f] <= v if op == "<=" else x[:, f] > v
    return ok


def _grow(x: np.ndarray, y: np.ndarray) -> Rule:
    """Adds the condition of the largest information gain until at most two in a hundred covered rows are negative."""
    rule: Rule = []
    inside = np.ones(len(x), bool)
    while (inside & ~y).sum() > 0.02 * inside.sum() and len(rule) < x.shape[1]:
        p0, n0 = (inside & y).sum(), (inside & ~y).sum()
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for f in range(x.shape[1]):
            v = x[inside, f]
            order = np.argsort(v, kind="stable")
            v, pos = v[order], np.cumsum(y[inside][order])
            at = np.flatnonzero(v[1:] > v[:-1])
            if not len(at):
                continue
            p, t = pos[at], at + 1.0
            for op, pp, tt in (("<=", p, t), (">", p0 - p, p0 + n0 - t)):
                gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1e-9) / tt) - base), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, op, float((v[at[k]] + v[at[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside = covers(rule, x)
    return rule


def _worth(rule: Rule, x: np.ndarray, y: np.ndarray) -> float:
    c = covers(rule, x)
    p, n = (c & y).sum(), (c & ~y).sum()
    return (p - n) / (p + n) if p + n else -1.0


def induce(x: np.ndarray, y: np.ndarray, seed: int = 3) -> list[Rule]:
    """The ordered rules; a row that none covers is prose."""
    rng, rules = np.random.default_rng(seed), []
    while y.any() and (~y).any():
        order = rng.permutation(len(y))
        cut = 2 * len(y) // 3
        g, p = order[:cut], order[cut:]
        if not y[g].any():
            break
        rule = _grow(x[g], y[g])
        best = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda q: _worth(q, x[p], y[p]), default=[])
        if not best or _worth(best, x[p], y[p]) < 0.5:
            break
        rules.append(best)
        left = ~covers(best, x)
        x, y = x[left], y[left]
    return rules


def to_sql(rules: list[Rule], of: str = "s") -> str:
    """The rule list as one CASE expression over a segment's figures: 1 is not prose."""
    when = " ".join("WHEN " + " AND ".join(f"{of}.{FEATURES[f]} {op} {v!r}D" for f, op, v in rule) + " THEN 1" for rule in rules)
    return f"CASE {when} ELSE 0 END" if rules else "0"


def learn(spark: SparkSession, n: int = LABELLED, seed: int = 11) -> str:
    """Fits the rule list on the segments of ``n`` labelled documents (at most 20,000) and returns its SQL."""
    rows = labelled(min(n, 20_000), seed)
    x = _with_segments(spark.createDataFrame(rows, "id long, t string, y boolean"), "id", "t").select("id", F.posexplode("__segments").alias("pos", "s"))
    got = x.select("id", "pos", *[F.col(f"s.{f}").cast("double").alias(f) for f in FEATURES]).orderBy("id", "pos").collect()
    label = {i: y for i, _, y in rows}
    return to_sql(induce(np.round(np.array([[r[f] for f in FEATURES] for r in got]), 4), np.array([label[r["id"]] for r in got])))


#: learn() with its default parameters; a test learns it anew
RULES = "CASE WHEN s.common_letters <= 0.06355D THEN 1 WHEN s.list_form > 0.5D AND s.words_per_line <= 7.5D AND s.distinct_share <= 0.9642999999999999D THEN 1 WHEN s.list_form > 0.5D AND s.words_per_line <= 6.5D AND s.digit_ratio <= 0.0755D AND s.common_per_100 > 3.42855D THEN 1 ELSE 0 END"


def classify(df: DataFrame, rules_sql: str = RULES, id_col: str = "enhancement_id", text_col: str = "enhanced_text") -> DataFrame:
    """``id, statistics..., prose_share, text_class``: 'prose', 'not_prose', or null for null, empty and blank texts.

    ``prose_share`` is the share of a text's characters, without blanks around its
    segments, in segments that no rule covers.
    """
    x = _with_segments(df, id_col, text_col)
    bad = F.expr(f"aggregate(__segments, 0, (a, s) -> a + s.k.chars * ({rules_sql}))")
    every = F.expr("aggregate(__segments, 0, (a, s) -> a + s.k.chars)")
    x = x.select(id_col, "__text", *[c.alias(k) for k, c in _statistics(F.col("__text"), F.col("__segments")).items()], bad.alias("__bad"), every.alias("__all"))
    kind = F.when(F.col("__bad") >= NOT_PROSE * F.col("__all"), "not_prose").otherwise("prose")
    return x.withColumns({"prose_share": F.when(F.col("__text").isNotNull(), F.round(_share(F.col("__all") - F.col("__bad"), F.col("__all")), 6)), "text_class": F.when(~blank(F.col("__text")), kind)}).drop("__text", "__bad", "__all")


def found(df: DataFrame, id_col: str = "enhancement_id", text_col: str = "enhanced_text", rules_sql: str = RULES) -> DataFrame:
    return classify(df, rules_sql, id_col, text_col).filter("text_class = 'not_prose'").select(id_col).distinct()
