"""Problem 8: template residue and error-page text.

Method: posts are cut into units (lines and their sentences) outside code,
quotations and quoted phrases, and every unit is masked to a template: words
that hold a digit are masked, and so are marked slots. Templates of the whole
corpus are compared:

* Whole pages: a template that mostly stands behind a message known by its form
  (a status line, a notice about scripts) or behind a line learned before,
  until nothing is added, in different posts, or alone as a whole post, is the
  text of error pages wherever a line begins with it. No sentence of such a page
  is listed here.
* Slots are induced by alignment: units that agree but for one place share a
  frame, and a frame that different fillings share has a slot there. A slot
  that is left blank, holds a default in brackets or the name of a variable
  makes its records residue. Marked slots (``{{name}}``) need no alignment.

What a post says about such things stays out: instructions that name a
placeholder ("Replace <YOUR_TOKEN> with your own value") keep the same filling in
every record of their template, and quoted or coded examples are removed
before the units are made.

The texts are read by one pass that leaves one row of digests per post. A second
one only reads the posts that share the first or last words of a unit whose
slot may be unfilled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import durable, small

BROADCAST_ROWS = 200_000  # digests that are sent to every task; more are joined by a shuffle

# --- fixed values -----------------------------------------------------------
_NAME = r"[A-Za-z][\w.\-]*"
SLOT = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\$\{{\s*{_NAME}\s*\}}|<%=?\s*{_NAME}\s*%>|\[\[\s*{_NAME}\s*\]\]|@@[A-Z][A-Z_.\-]*@@|__[A-Z][A-Z_.\-]*__"
    rf"|%[A-Za-z][\w.\-]*[A-Za-z]%|(?<![\w#])#{_NAME}#|(?<![\w{{$]){{{_NAME}}}|<[A-Z][A-Z_.\-]{{2,}}>"
)
STATUS = (
    "Bad Request|Unauthorized|Payment Required|Forbidden|Access Denied|Access denied|Page Not Found|Page not found|Not Found|Method Not Allowed|Not Acceptable|Request Timeout|Conflict|Gone|Too Many Requests|Too many requests"
    "|Internal Server Error|Not Implemented|Bad Gateway|Service Unavailable|Service Temporarily Unavailable|Gateway Timeout|Gateway Time-out"
    "|Zugriff verweigert|Nicht gefunden|Seite nicht gefunden|Interner Serverfehler|Dienst nicht verfügbar|Nicht autorisiert|Zu viele Anfragen|Ungültige Anfrage|Zeitüberschreitung"
)
ERROR = re.compile(
    rf"^(?:(?:HTTP(?:[ -](?:Status|Fehler|Error))?|Error|Fehler)\s+\d{{3}}\s*[:–—-]?\s*(?:{STATUS})\b(?!\s+[a-zäöü])"
    r"|(?:HTTP(?:[ -](?:Status|Fehler|Error))?|Error|Fehler)\s+[45]\d\d(?:\s*[:–—-]\s*[A-ZÄÖÜ][\w'’-]*(?:\s[\w'’-]+){0,3})?[.!]?$"
    rf"|(?:Oops!|Whoops!|Sorry!|Hoppla!)?\s*(?:\d{{3}}\s*[:–—-]?\s*)?(?:{STATUS})(?:\s*\(\d{{3}}\))?(?=\s*$|[.!]?\s+(?:[A-ZÄÖÜ\[(/]|Reference|Request id))"
    r"|\d{3}\. (?:That's an error|Das ist ein Fehler)\b|undefined \w+ on Invalid Date|\[object Object\]$|NaN \w+, undefined \w+|Traceback: .{0,80}could not be rendered)"
)
_JS = r"(?:Java ?Script|JS|scripts|scripting|Skripten?|die Ausführung von Skripten)"
_SEEN = r"(?:page|site|app|posts?|thread|answers?|questions?|Seite|Beitrag|Antwort|Frage|Faden)"
_USE = r"(?:continue|go on|view|see|use|load|read|show|display|access)"
NOTICE = re.compile(
    rf"^(?:Checking your browser before\b|noscript\s*\d*$|A required part of this site couldn't load\b"
    rf"|{_JS} (?:is|are) (?:turned off|disabled|switched off|blocked|not enabled|required|needed)(?:, so\b| in your browser\b| to {_USE}\b|[.!]?$)"
    rf"|(?:We could not load \w+(?: \w+)?(?: \w+)?: )?your browser does not (?:run|support|allow) {_JS}\b"
    rf"|(?:To go on, |You must |You need to |Please )(?:check that {_JS} is allowed|(?:enable|activate|allow|turn on|switch on) {_JS} (?:to \w+|and reload)|turn {_JS} on (?:to \w+|and reload))"
    rf"|(?:Enable|Activate|Allow|Turn on) {_JS} (?:in your browser )?to {_USE}\b"
    rf"|(?:this|the) (?:full )?{_SEEN} (?:needs?|requires?) {_JS}(?:[.!]|$| to (?:work|run|be shown)\b)|(?:Diese|Die) {_SEEN} (?:benötigt|braucht|erfordert) {_JS}\b|{_JS} ist in Ihrem Browser (?:abgeschaltet|deaktiviert)\b"
    rf"|Ohne {_JS} lässt sich [^.]{{0,60}}nicht anzeigen\b|Für [^.]{{0,40}} wird {_JS} benötigt\b|Bitte (?:aktivieren|erlauben) Sie {_JS}\b)",
    re.I,
)
DEFAULT = re.compile(
    r"^(?:\[(?:INSERT|ENTER|YOUR|HIER|IHR|DEIN)\b[^\]\n]{0,60}\]|\[(?:Description|Beschreibung|Text|Titel|Title|Name)\]|(?:Your )?(?:content|text|answer|title|code) goes here\.?|(?:Insert|Enter|Type|Write|Paste) (?:your |the |some )?\w+(?: \w+)? here\.?"
    r"|(?:Sample text|Blindtext|Beispieltext|Mustertext|Dummy text)\.?|TBD\.?|TODO: \w+ (?:the|your|an?) \w+\.?|TODO\.?|Placeholder\b.{0,3}replace before publishing\.?|\(no (?:description|text|content) provided\)|Coming soon: \w+ \w+\.?"
    r"|Hier steht später der Text\.?|Beschreibung folgt\.?|(?:Text|Inhalt) folgt\.?|Please describe your problem here\.?)$"
    r"|^(?:Hello|Hi|Dear|Hallo|Liebe[rs]?|Sehr geehrte[rs]?) \[[^\W\d_][\w .'-]{0,40}\]",
    re.I,
)
LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua".split())
#: strings in small letters of which every unit of a kind holds at least one
HINTS = {
    "error": ("error", "fehler", "http", "invalid date", "[object", "undefined", "traceback"),
    "notice": ("script", "skript", "js ", "js.", "checking your browser", "required part"),
    "default": ("here", "hier ", "text", "tbd", "todo", "placeholder", " provided)", "coming soon", " folgt", "[insert", "[enter", "[your", "[ihr", "[dein", "[description", "[beschreibung", "[titel", "[title", "[name", "hello [", "hi [", "dear [", "hallo [", "liebe [", "lieber [", "liebes [", "geehrte [", "geehrter [", "geehrtes ["),
}
INSTRUCTION = re.compile(r"\b(?:replace|substitute|with your own|placeholders?|ersetzen?|Platzhalter|durch (?:den|deinen|Ihren) eigenen)\b", re.I)
# -----------------------------------------------------------------------------

_FENCE = re.compile(r"\s*(```+|~~~+)\s*([\w+-]*)\s*$")
_TAG = re.compile(r"</?[a-z][a-z0-9]*[\s/>]")  # a line of markup is code
_QUOTED = re.compile(r'"[^"\n]{0,200}"|„[^“”\n]{0,200}[“”]|“[^”\n]{0,200}”|«[^»\n]{0,200}»')
_PROSE = re.compile(r"[A-ZÄÖÜ][\wäöüß'-]*(?: [\w'äöüß,-]+){3,}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_LETTERS = re.compile(r"[^\W\d_]+")
_MARKED = re.compile(r"[{%#@<]|\[\[|__")  # every marked slot begins with one of these
_NUMBER = re.compile(r"(?<!\S)[^\s\d]*\d\S*")
_DIGIT = re.compile(r"\d")
_made: dict[str, object] = {}


def _automaton() -> ahocorasick.Automaton:
    """All hints in one automaton: a text is scanned once for all of them."""
    if not _made:
        words: dict[str, set[str]] = {}
        for kind, hints in [*HINTS.items(), ("error", STATUS.lower().split("|")), ("filler", LATIN)]:
            for h in hints:
                words.setdefault(h, set()).add(kind)
        a = ahocorasick.Automaton()
        for h, kinds in words.items():
            a.add_word(h, (h, frozenset(kinds)))
        a.make_automaton()
        _made["hints"] = a
    return _made["hints"]


def _hints(low: str) -> set[str]:
    """The kinds that a text in small letters may have; holds every kind that kind_of() could give."""
    kinds, latin = set(), set()
    for _, (h, of) in _automaton().iter(low):
        if "filler" in of:
            latin.add(h)
        kinds |= of
    kinds.discard("filler")
    if _MARKED.search(low):
        kinds.add("variable")
    if len(latin) >= 3 or any(_one_word(u) for u in _SENTENCE.split(low)):
        kinds.add("filler")
    return kinds


def _one_word(low: str) -> bool:
    """Whether a unit may consist of one word again and again."""
    first = _LETTERS.search(low)
    return first is not None and low.count(first[0]) >= 8


def _code_looking(line: str) -> bool:
    return bool(re.match(r"\s*(?:[$#<>{}()\[\]/]|//|return\b|for\b|if\b|def\b|SELECT\b|FROM\b|WHERE\b|GROUP\b|\w+\s*=)", line)) or not _PROSE.match(line.strip())


def prose_lines(text: str) -> list[str]:
    """Lines outside code and quotations.

    Left out: fenced blocks (an unclosed fence ends at the first empty line
    that prose follows), lines indented by four or more blanks or a tab,
    ``<pre>``/``<code>`` elements, ``>`` quotations, inline code.
    """
    text = re.sub(r"(?is)<(pre|code)\b[^>]*>.*?(?:</\1>|\Z)", " ", text) if "<pre" in text or "<code" in text else text
    out, fence, lines = [], "", text.split("\n")
    for i, line in enumerate(lines):
        m = _FENCE.match(line) if "```" in line or "~~~" in line else None
        if m:
            same = fence and m[1][0] == fence
            fence = m[1][0] if not same or m[2] else ""
            continue
        if fence:
            if line.strip():
                continue
            after = next((x for x in lines[i + 1 :] if x.strip()), "")
            if after.startswith(("    ", "\t")) or _FENCE.match(after) is None and _code_looking(after):
                continue
            if _FENCE.match(after):
                continue
            fence = ""
        if line.startswith(("    ", "\t")) or line.lstrip().startswith(">"):
            continue
        line = re.sub(r"`[^`\n]*`", " ", line).strip() if "`" in line else line.strip()
        if line and not _TAG.match(line):
            out.append(line)
    return out


def _filler(unit: str) -> bool:
    w = _LETTERS.findall(unit.lower())
    if len(w) >= 4 and len(LATIN & {*w}) >= 3 and sum(x in LATIN for x in w) >= 0.12 * len(w):
        return True
    return len(w) >= 8 and len({*w}) == 1


def _mask(unit: str) -> str:
    if _MARKED.search(unit):
        unit = SLOT.sub("‹slot›", unit)
    return _NUMBER.sub("‹n›", unit) if _DIGIT.search(unit) else unit


ALL = frozenset(("variable", "default", "filler", "error", "notice"))


def kind_of(unit: str, line_start: bool, may: frozenset[str] | set[str] = ALL) -> str | None:
    """The residue kind of one unit, before templates are compared; only kinds that it ``may`` have are tried."""
    if "variable" in may and SLOT.search(unit):
        return "variable"
    if "default" in may and DEFAULT.match(unit) or "filler" in may and _filler(unit):
        return "default"
    if line_start and "error" in may and ERROR.match(unit):
        return "error"
    if "notice" in may and NOTICE.match(_QUOTED.sub(" ", unit).strip()):
        return "notice"
    return None


def _post(text: str) -> list[tuple]:
    """``kind, unit, slots, instruction, starts`` of each unit of a post in their order; ``starts``: at a line's start."""
    out = []
    for line in prose_lines(text):
        may = _hints(line.lower())
        kind = kind_of(line, True, may) if may else None
        if kind and not ("variable" in may and SLOT.search(line)):
            out.append((kind, line, [], bool(INSTRUCTION.search(line)), True))
            m = kind == "error" and ERROR.match(line) or kind == "notice" and NOTICE.match(line)
            rest = line[m.end() :] if m else ""
            if m and line[m.end() - 1] not in ".!?":  # what is left of the message's own sentence
                rest = "".join(_SENTENCE.split(rest, maxsplit=1)[1:])
            out += [(None, x, [], False, False) for x in _SENTENCE.split(rest.strip(" .!:")) if x]
            continue
        for n, unit in enumerate(_SENTENCE.split(line)):
            kind = kind_of(unit, n == 0, may) if may else None
            out.append((kind, unit, [m[0] for m in SLOT.finditer(unit)] if kind else [], kind is not None and bool(INSTRUCTION.search(unit)), n == 0))
    return out


# --- alignment -------------------------------------------------------------------
_TOKEN = re.compile(r"‹[a-z]+›|\w+(?:[-'’.]\w+)*|[^\w\s]")
_BLANK = re.compile(r"(?<=\w)[ ]+(?=[,;:.!?](?:\s|$))|(?<=\w)[ ]{2,}(?=\w)|(?<=\()\s*(?=\))|(?<=\[)\s*(?=\])")
_MAYBE_BLANK = ("  ", " ,", " ;", " :", " .", " !", " ?", "()", "( ", "[]", "[ ")
_BRACKETS = re.compile(r"\[(?:your|insert|ihr|dein|hier)\b[^\]\n]{0,60}\]", re.I)
_VARIABLE = re.compile(r"^(?:[A-Za-z]+(?:_[A-Za-z]+)+|[a-z]+(?:[A-Z][a-z]+)+)$")
_MAYBE_VARIABLE = re.compile(r"[A-Za-z]_[A-Za-z]|[a-z][A-Z]")
_ODD = (1 << 64) - 59
_NEAR = 3  # words at a unit's end that decide whether it is compared at all


def _digest(t: str) -> int:
    return xxhash.xxh64_intdigest(t) - (1 << 63)


def _template_digest(template: str) -> int:
    """A digest that is even for templates of fewer than four words besides masked ones, and never 0."""
    long = template.count(" ") - template.count("‹") >= 3
    return (_digest(template) | 1) if long else (_digest(template) & ~1 or 2)


def _masked(words: list[str]) -> str:
    t = " ".join(words)
    return _NUMBER.sub("‹n›", t) if _DIGIT.search(t) else t


def _bare(unit: str) -> str:
    return SLOT.sub("‹slot›", unit) if _MARKED.search(unit) else unit


def _ends(bare: str) -> list[int]:
    """What decides with which units one is compared: its first and last words, of short units the outermost ones, too."""
    w = bare.split()
    if not w:
        return []
    out = []
    if len(w) >= _NEAR:
        out += [_digest("<" + _masked(w[:_NEAR])), _digest(">" + _masked(w[-_NEAR:]))]
    if len(w) <= 2 * _NEAR + 1:
        out += [_digest("(" + _masked(w[:1])), _digest(")" + _masked(w[-1:]))] if len(w) > 1 else [_digest("|")]
    return out


def _end(bare: str, start: int, end: int) -> int:
    """The one of ``_ends`` that a unit must have to share the frame that is open from start to end."""
    before = re.split(r"\s+", bare[:start].lstrip())[:-1]  # whole words only
    after = re.split(r"\s+", bare[end:].rstrip())[1:]
    if len(before) >= _NEAR:
        return _digest("<" + _masked(before[:_NEAR]))
    if len(after) >= _NEAR:
        return _digest(">" + _masked(after[-_NEAR:]))
    if before:
        return _digest("(" + _masked(before[:1]))
    return _digest(")" + _masked(after[-1:])) if after else _digest("|")


def _frames(bare: str, ordinary: bool) -> list[tuple[int, str, str, int]]:
    """``frame, filling, what, end``: the frames in which a unit stands with one place open.

    ``what`` is 'blank', 'default', 'name' (of the form of a variable's name)
    or, for ordinary units, 'word'. Frames without two words beside the open place
    tell too little, except those of a greeting, which end with a sign behind it.
    """
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(bare)]
    mask = ["‹n›" if _DIGIT.search(t) else t for _, _, t in tokens]
    fore, back, h = [0], [0], xxhash.xxh64()
    for t in mask:
        h.update(t + " ")
        fore.append(h.intdigest())
    h = xxhash.xxh64()
    for t in reversed(mask):
        h.update(t + " ")
        back.append(h.intdigest())
    n, words = len(mask), [t[0].isalpha() for t in mask]
    n_words = sum(words)

    def frame(a: int, b: int) -> int | None:
        left = n_words - sum(words[a:b])
        if left < 2 and not (left == 1 and b < n and not words[b]):
            return None
        return (fore[a] * 31 + back[n - b] * _ODD) % (1 << 64) - (1 << 63)

    out = []
    for k, t in enumerate(mask):
        if words[k] and ordinary != bool(_VARIABLE.match(t)):
            start, end = tokens[k][:2]
            out.append((frame(k, k + 1), t, "word" if ordinary else "name", 0 if ordinary else _end(bare, start, end)))
    if not ordinary:
        marks = [(m.start(), m.end(), "default", m[0]) for m in _BRACKETS.finditer(bare)]
        marks += [(m.start(), m.end(), "blank", "") for m in _BLANK.finditer(bare)]
        for start, end, what, filling in marks:
            a = sum(e <= start for _, e, _ in tokens)
            out.append((frame(a, a + sum(s >= start and e <= end for s, e, _ in tokens)), filling, what, _end(bare, start, end)))
    return [x for x in out if x[0] is not None]


def _may_be_open(unit: str) -> bool:
    return any(x in unit for x in _MAYBE_BLANK) or "[" in unit or _MAYBE_VARIABLE.search(unit) is not None


def _unquoted(line: str) -> str:
    return _QUOTED.sub(' "" ', line) if '"' in line or "„" in line or "“" in line or "«" in line else line


def _aligned_units(text: str) -> list[str]:
    return [unit for line in prose_lines(text) for unit in _SENTENCE.split(_unquoted(line))]


# --- the pass over all texts ---------------------------------------------------------
_SCAN = (
    "doc_id long, t array<long>, starts array<boolean>, ends array<long>, known array<struct<kind:string, template:string, slots:array<string>, instruction:boolean>>, "
    "open array<struct<frame:long, what:string, name:string, end:long, template:string>>"
)
_SCAN_COLUMNS = ["doc_id", "t", "starts", "ends", "known", "open"]


def scan(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per post: ``t`` digests the templates of its units in their order (0 for a known message, 4 for other residue), ``starts``
    says which begin a line, ``ends`` digests the words at the units' ends, ``known`` holds the units that are residue by
    themselves, ``open`` those whose slot may be unfilled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b["doc_id"], b["text"]):
                ts, starts, known, ends, opened = [], [], [], set(), []
                for kind, unit, slots, instruction, at_start in _post(text):
                    starts.append(at_start)
                    template = _mask(unit)
                    if kind:
                        known.append({"kind": kind, "template": template, "slots": slots, "instruction": instruction})
                        ts.append(0 if kind in ("error", "notice") else 4)
                    else:
                        ts.append(_template_digest(template))
                for unit in _aligned_units(text):
                    bare = _bare(unit)
                    ends.update(_ends(bare))
                    if _may_be_open(unit):
                        opened += [{"frame": f, "what": what, "name": filling if what == "name" else None, "end": end, "template": _mask(unit)} for f, filling, what, end in _frames(bare, False)]
                if ts:
                    rows.append((i, ts, starts, list(ends), known, opened))
            yield pd.DataFrame(rows, columns=_SCAN_COLUMNS)

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    return docs.mapInPandas(run, _SCAN)


def _few(df: DataFrame) -> DataFrame:
    """Broadcast behind a count; a larger side is shuffled by the join."""
    return F.broadcast(df) if small(df, BROADCAST_ROWS) else df


def units(p: DataFrame) -> DataFrame:
    """``doc_id, kind, template, slots, instruction``: the units of each post that are residue by themselves."""
    return p.select("doc_id", F.explode("known").alias("k")).select("doc_id", "k.*")


def templates(u: DataFrame) -> DataFrame:
    """Induced templates: how many records share one, and whether their slots hold different fillings."""
    fill = F.array_join("slots", "\u0001")
    return u.groupBy("template").agg(F.count("*").alias("n_units"), F.min(fill).alias("least"), F.max(fill).alias("most"), F.first("kind").alias("kind"), F.max("instruction").alias("instruction")).select(
        "template", "kind", "n_units", (F.col("least") != F.col("most")).alias("fillings_vary"), "instruction"
    )


def page_lines(p: DataFrame) -> DataFrame:
    """``t``: templates that are learned as text of error pages.

    At least half of the posts that hold a template must hold it behind page text,
    alone, or in a post of which all the rest is page text, and these must lie
    in different surroundings: a post that was written twice proves nothing.
    Each round looks only for what stands beside the lines known by then.
    """
    spark = p.sparkSession
    x = F.aggregate("t", F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v))
    prev = F.concat(F.array(F.lit(None).cast("long")), F.slice("t", 1, F.greatest(F.lit(0), F.size("t") - 1)))
    base = p.select("doc_id", F.expr("t[0]").alias("first"), F.size("t").alias("size"), x.alias("x"), F.explode(F.arrays_zip("t", prev.alias("prev"))).alias("u"))
    base = base.select("doc_id", "first", "size", "x", "u.t", "u.prev").filter("t NOT IN (0, 4)")
    posts = p.select(F.size("t").alias("size"), F.explode(F.array_distinct("t")).alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.count_if(F.col("size") == 1).alias("alone"))
    posts = durable(posts.filter("n > 1 AND t NOT IN (0, 4)"))
    learned, n = spark.createDataFrame([], "t long"), 0
    while True:
        few = F.broadcast if n < BROADCAST_ROWS else lambda df: df
        behind = base.join(few(spark.createDataFrame([(0,)], "prev long").union(learned)), "prev", "left_semi").select("doc_id", "t", F.col("first").alias("place"))
        rest = base.join(few(learned), "t", "left_semi").groupBy("doc_id").agg(F.count("*").alias("k"), F.min("t").alias("place"), F.bit_xor("t").alias("known"), F.first("x").alias("x"), F.first("size").alias("size"))
        last = rest.filter("size - k = 1").select("doc_id", F.col("x").bitwiseXOR(F.col("known")).alias("t"), "place")  # the one that is left
        near = behind.union(last).groupBy("t", "doc_id").agg(F.min("place").alias("a"), F.max("place").alias("b")).groupBy("t").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("k"))
        good = posts.join(_few(durable(near.filter("a < b").select("t", "k"))), "t").filter("2 * (k + alone) >= n").select("t")
        learned = durable(good.union(learned).distinct())
        now = learned.count()
        if now == n:  # nothing is ever taken back, so this ends
            return learned
        n = now


def unfilled(documents: DataFrame, p: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, kind, template``: units whose slot, induced by alignment, was not filled.

    A frame has a slot if units of at least three other posts stand in it with
    at least two different words there, and more than its unfilled ones. A name
    counts if it is that of a marked slot somewhere in the corpus. Only posts
    that share the words at an open unit's end are aligned with it.
    """
    names = units(p).filter("kind = 'variable' AND NOT instruction").select(F.explode("slots").alias("s")).select(F.regexp_extract("s", r"[A-Za-z][\w.\-]*\w", 0).alias("name")).filter(F.col("name").rlike("[_A-Z]")).distinct()
    o = p.filter(F.size("open") > 0).select("doc_id", F.explode("open").alias("o")).select("doc_id", "o.*")
    c = durable(o.join(names.withColumn("known", F.lit(True)), "name", "left").filter("what != 'name' OR known").select("doc_id", "frame", "what", "end", "template"))
    wanted = _few(c.select("end").distinct())
    beside = durable(p.select("doc_id", F.explode("ends").alias("end")).join(wanted, "end", "left_semi").select(F.col("doc_id").alias("__id")).distinct())
    frames = _few(c.select("frame").distinct())
    # while the open units' ends are few, the units of the posts are chosen by them, too
    ends = p.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in c.select("end").distinct().collect()) if small(c.select("end").distinct(), BROADCAST_ROWS) else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chosen = ends.value
        for b in batches:
            rows = []
            for i, text in zip(b["doc_id"], b["text"]):
                for unit in _aligned_units(text):
                    bare = _bare(unit)
                    if chosen is None or not chosen.isdisjoint(_ends(bare)):
                        rows += [(i, f, _digest(filling)) for f, filling, _, _ in _frames(bare, True)]
            yield pd.DataFrame(rows, columns=["doc_id", "frame", "filling"])

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).join(_few(beside), F.col("doc_id") == F.col("__id"), "left_semi")
    fill = docs.mapInPandas(run, "doc_id long, frame long, filling long").join(frames, "frame", "left_semi")
    slots = fill.groupBy("frame").agg(F.countDistinct("doc_id").alias("n"), F.min("filling").alias("a"), F.max("filling").alias("b")).filter("n >= 3 AND a < b")
    empty = c.groupBy("frame").agg(F.countDistinct("doc_id").alias("e"))
    good = slots.join(empty, "frame").filter("n > e").select("frame")
    return c.join(good, "frame", "left_semi").select("doc_id", F.when(F.col("what") == "name", "variable").otherwise(F.col("what")).alias("kind"), "template").distinct()


def _known(p: DataFrame) -> DataFrame:
    """``doc_id, kind, template``: units that are residue by themselves, instructions only where their fillings vary."""
    u = units(p)
    unsure = u.filter("kind = 'variable' AND instruction")
    varying = templates(unsure).filter("fillings_vary").select("template")
    return u.filter("NOT (kind = 'variable' AND instruction)").union(unsure.join(varying, "template", "left_semi").select(u.columns)).select("doc_id", "kind", "template")


def _page_hits(p: DataFrame) -> DataFrame:
    """``doc_id, t``: learned page text at a line's start; a short line such as a reference number tells too little by itself."""
    rows = p.select("doc_id", F.explode(F.arrays_zip("t", "starts")).alias("u")).select("doc_id", "u.t", "u.starts").filter("starts AND t % 2 != 0")
    return rows.join(_few(page_lines(p)), "t", "left_semi").select("doc_id", "t").distinct()


def flagged(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, kind, template``: units that stand in place of content.

    Kinds: 'variable', 'default', 'blank', 'error', 'notice', and 'page' for
    learned lines of error pages. A slot with a variable's name counts unless
    its template is an instruction whose filling is the same in all its records.
    Null and empty texts have no units; equal rows give one result.
    """
    p = durable(scan(documents, doc_id, text))
    hit = durable(_page_hits(p))
    again = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(_few(hit.select(F.col("doc_id").alias("__id")).distinct()), F.col("doc_id") == F.col("__id"), "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, _template_digest(_mask(unit)), _mask(unit)) for i, text in zip(b["doc_id"], b["text"]) for kind, unit, _, _, _ in _post(text) if not kind]
            yield pd.DataFrame(rows, columns=["doc_id", "t", "template"])

    page = again.mapInPandas(run, "doc_id long, t long, template string").join(hit, ["doc_id", "t"], "left_semi").select("doc_id", F.lit("page").alias("kind"), "template")
    return _known(p).union(page).union(unfilled(documents, p, doc_id, text)).distinct().withColumnRenamed("doc_id", doc_id)


def found(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids of flagged(), without the second look for the text of page lines."""
    p = durable(scan(documents, doc_id, text))
    return _known(p).select("doc_id").union(_page_hits(p).select("doc_id")).union(unfilled(documents, p, doc_id, text).select("doc_id")).distinct().withColumnRenamed("doc_id", doc_id)


def kept(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without residue, all columns kept."""
    bad = found(documents, doc_id, text).withColumnRenamed(doc_id, "__residue_id")
    return documents.join(bad, documents[doc_id] == F.col("__residue_id"), "left_anti")
