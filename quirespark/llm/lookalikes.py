"""Problem 4: visually identical text with different characters.

Method: script-aware repair. A text is first brought to one character form
(composed letters, plain letters for full-width, joined, numeral and
mathematical forms, one kind of blank, nothing that leaves no mark). Then the
scripts of each token's letters are counted. In a token of mixed scripts the
letters outside its dominant script are replaced by their look-alikes of that
script, or, where that leaves it mixed or the result is unknown or stands more
rarely in the corpus, those outside the next one or the text's own. The result is accepted only if it exists in the corpus
vocabulary, which holds words as they stand, never as they would be repaired;
otherwise the token stays as it is.

A token wholly of look-alikes of one script inside a text of another counts as
mixed, too, but only if no word beside it is truly of its own script, and it
is repaired only if the result stands more often in the corpus than the token
itself. Words truly written in another script are left alone.

What a reader can tell apart is kept: spelling, case, accents, digits, line
breaks. Blanks at line ends and at the ends of a text leave no mark.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import durable, small

# --- fixed values: letters of other scripts and the Latin ones they look like ---
CYRILLIC = "АВЕЅІЈКМНОРСТХУҮԌԚԜѴаеорсухѕіјһԁԛԝѵӏ"
CYRILLIC_LATIN = "ABESIJKMHOPCTXYYGQWVaeopcyxsijhdqwvl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονι"
GREEK_LATIN = "ABEZHIKMNOPTYXovi"
# marks that cannot be seen: soft hyphen, zero-width characters, joiners, direction marks, byte order mark
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff\ufe0e\ufe0f"
BLANKS = "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# ----------------------------------------------------------------------------------

BROADCAST_ROWS = 100_000  # decisions on tokens, and ids delivered twice, that are sent to every task; more are joined
_TO_LATIN = str.maketrans(CYRILLIC + GREEK, CYRILLIC_LATIN + GREEK_LATIN)


def _towards(letters: str, latin: str, others: tuple[str, str]) -> dict[int, int]:
    """Latin letters, and those of a third script that look like them, to the letters of one script; the first of several."""
    back: dict[str, str] = {}
    for a, b in zip(letters, latin):
        back.setdefault(b, a)
    return {ord(c): ord(back[x]) for c, x in [*zip(back, back), *zip(*others)] if x in back}


_TO = {"L": _TO_LATIN, "C": _towards(CYRILLIC, CYRILLIC_LATIN, (GREEK, GREEK_LATIN)), "G": _towards(GREEK, GREEK_LATIN, (CYRILLIC, CYRILLIC_LATIN))}
_OWN = {"C": frozenset(CYRILLIC), "G": frozenset(GREEK)}  # letters that have a look-alike
_PLAIN = {ord(c): None for c in INVISIBLE} | {ord(c): " " for c in BLANKS}
_WIDE = re.compile("[․-…]|([！-￮ﬀ-ﬆⅠ-ⅿ\U0001d400-\U0001d7ff]+)")
_TOKEN = re.compile(r"[^\W\d_]+")
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")


def plain(text: str) -> str:
    """One character form: composed, narrow, unjoined, visible, with plain blanks."""
    t = text.replace("\r\n", "\n").replace("\r", "\n").translate(_PLAIN)
    t = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[1]) if m[1] else m[0], t)
    t = unicodedata.normalize("NFC", t)
    return re.sub(r" +(?=\n|$)", "", t.strip(" "))


def _script(c: str) -> str:
    """L, C, G, or O for every other script."""
    o = ord(c)
    if 0x400 <= o < 0x530:
        return "C"
    if 0x370 <= o < 0x400:
        return "G"
    return "L" if o < 0x2B0 or 0x1E00 <= o < 0x1F00 or 0x2C60 <= o < 0x2C80 or 0xA720 <= o < 0xA800 else "O"


def _truly(token: str) -> str | None:
    """The script other than Latin of which a token holds a letter that no Latin one looks like."""
    return next((s for c in token for s in [_script(c)] if s in _OWN and c not in _OWN[s]), None)


def _skeleton(token: str) -> str:
    """The token with all look-alikes of one script; equal for tokens that look alike, whatever their letters are."""
    return token.translate(_TO[_truly(token) or "L"])


def repairs(text: str) -> list[tuple[int, str, str, str, str, bool]]:
    """``(offset, token, skeleton, first, second, whole)`` of tokens whose letters may not be what they look like.

    ``first`` and ``second`` are the possible repairs in order of preference, '' for none;
    ``whole`` marks tokens of one script inside a text of another.
    """
    if not _FOREIGN.search(text):
        return []
    found = [(m.start(), m[0]) for m in _TOKEN.finditer(text)]
    main = Counter({"L": sum(len(t) for _, t in found)})
    for c in _FOREIGN.findall(text):
        main[_script(c)] += 1
        main["L"] -= 1
    here = main.most_common(1)[0][0]
    out = []
    for k, (at, token) in enumerate(found):
        if not _FOREIGN.search(token):
            continue
        n = Counter(map(_script, token))
        skeleton, tries, whole = _skeleton(token), [], len(n) == 1
        if "O" in n:
            pass
        elif not whole:
            order = sorted({*n, here} - {"O"}, key=lambda s: (-n[s], s != here))
            tries = [x for s in order for x in [token.translate(_TO[s])] if {*map(_script, x)} == {s}]
        elif here not in n and not _truly(token):
            own = next(iter(n))
            beside = [found[i][1] for i in (k - 1, k + 1) if 0 <= i < len(found)]
            fixed = token.translate(_TO[here])
            if {*map(_script, fixed)} == {here} and not any(_truly(x) == own for x in beside):
                tries = [fixed]
        if tries or skeleton != token:
            first, second = (*tries, "", "")[:2]
            out.append((at, token, skeleton, first, second, whole))
    return out


def _long(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """``id, field, text`` of non-empty values."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in text_cols]))
    return df.select(F.col(id_col).cast("long").alias("id"), parts.alias("f")).select("id", "f.field", "f.text").filter("id IS NOT NULL AND text IS NOT NULL AND text != ''")


def _is_clean(text: str) -> bool:
    """Whether a text is in its final form already: a fast test by whole-string operations only, never true by mistake."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    if text.isprintable():
        return "\xa0" not in text and "\xad" not in text and not text.startswith(" ") and not text.endswith(" ")
    rest = text.replace("\n", "")
    return rest.isprintable() and " \n" not in text and not text.startswith(" ") and not text.endswith(" ")


#: bytes of Latin-1 letters stay, all others separate words
_LETTERS = bytes(c if chr(c).isalpha() else 0x20 for c in range(256))


def _put(text: str, at: list[int], tokens: list[str]) -> str:
    """Tokens in their places; substitution keeps the number of code points, so offsets stay valid."""
    out, last = [], 0
    for a, new in zip(at, tokens):
        out += [text[last:a], new]
        last = a + len(new)
    return "".join(out) + text[last:]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _raw(text: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))


_KEYS = "word string, n long, id long, field string, raw long, key1 long, key2 long, at array<int>, token array<string>, skeleton array<string>, first array<string>, second array<string>, whole array<boolean>"


def _keyed(long: DataFrame) -> DataFrame:
    """Digests and possible repairs of every field value (``word`` null), and the words as they stand with their counts, in one pass over the texts.

    Words are counted in small letters.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, plainly, other = [], Counter(), Counter()
            for i, f, t in zip(b["id"], b["field"], b["text"]):
                raw, fix = _raw(t), []
                if _is_clean(t):
                    plainly.update(t.lower().encode("latin-1").translate(_LETTERS).split())
                else:
                    t = plain(t)
                    fix = repairs(t)
                    other.update(_TOKEN.findall(t.lower()))
                cols = [list(x) for x in zip(*fix)] if fix else [[] for _ in range(6)]
                key = xxhash.xxh3_128_intdigest((_put(t, cols[0], cols[2]) if fix else t).encode("utf-8", "surrogatepass"))
                rows.append((None, 0, i, f, raw, _signed(key >> 64), _signed(key & ((1 << 64) - 1)), *cols))
            for w, n in plainly.items():
                other[w.decode("latin-1")] += n
            rows.extend((w, n, 0, None, 0, 0, 0, [], [], [], [], [], []) for w, n in other.items())
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _KEYS.split(", ")])

    return long.select("id", "field", "text").mapInPandas(run, _KEYS)


_CASE = ["token", "first", "second", "whole"]


def _tokens(values: DataFrame) -> DataFrame:
    z = F.explode(F.arrays_zip("at", "token", "skeleton", "first", "second", "whole"))
    return values.filter(F.size("at") > 0).select("id", "field", "raw", z.alias("z")).select("id", "field", "raw", "z.*")


def _decisions(both: DataFrame) -> DataFrame:
    """``token, first, second, whole, final``: for each different case of a possible repair, what the token becomes."""
    cases = durable(_tokens(both.filter("word IS NULL")).filter("first != ''").select(*_CASE).distinct())
    wanted = cases.select(F.explode(F.array(*[F.lower(c) for c in ("token", "first", "second")])).alias("word")).filter("word != ''").distinct()
    known = durable(both.filter("word IS NOT NULL").select("word", "n").join(wanted, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n")))
    for c in ("token", "first", "second"):
        cases = cases.withColumn("w", F.lower(c)).join(known.select(F.col("word").alias("w"), F.col("n").alias(f"n_{c}")), "w", "left").drop("w")
    least = F.when(F.col("whole"), F.coalesce("n_token", F.lit(0))).otherwise(0)
    first, second = F.coalesce("n_first", F.lit(0)), F.coalesce("n_second", F.lit(0))
    return cases.select(*_CASE, F.when((first > least) & (first >= second), F.col("first")).when(F.col("n_second") > least, F.col("second")).otherwise(F.col("token")).alias("final"))


def keys(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """``id, field, raw, key1, key2``: equal keys mean equal repaired text.

    The key digests the text with the skeletons of all doubtful tokens, and apart
    from that the positions and letters of those that end up otherwise; so
    texts need not be rebuilt, nor leave the pass that reads them.
    """
    both = durable(_keyed(_long(df, id_col, text_cols)))
    values = both.filter("word IS NULL").drop("word", "n")
    final = F.coalesce("final", "token")
    odd = _tokens(values).join(durable(_decisions(both)), _CASE, "left").filter(final != F.col("skeleton"))
    odd = odd.groupBy("id", "field", "raw").agg(F.xxhash64(F.array_sort(F.collect_set(F.struct("at", final.alias("final"))))).alias("odd"))
    return values.select("id", "field", "raw", "key1", "key2").join(odd, ["id", "field", "raw"], "left").select("id", "field", "raw", "key1", F.when(F.col("odd").isNotNull(), F.xxhash64("key2", "odd")).otherwise(F.col("key2")).alias("key2"))


_GROUP = ["field", "key1", "key2"]


def _classes(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """``field, key1, key2, raw, id`` of the values that read like another one stored differently."""
    k = durable(keys(df, id_col, text_cols).distinct())
    many = k.groupBy(*_GROUP).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).filter("lo < hi").select(*_GROUP)
    return k.join(many, _GROUP, "left_semi")


def found(df: DataFrame, id_col: str = "extraction_id", text_cols: tuple[str, ...] = ("extracted_text", "ocr_text")) -> DataFrame:
    """``<id>_a, <id>_b``: pairs of ids with a field that differs as stored and is equal once repaired.

    Pairs are made of stored forms; only then are the ids that hold them put in,
    so exact copies never meet each other, and every row made is a row asked
    for. A form that very many ids hold is a hot key with few pairs, which the
    joins' adaptive skew splitting spreads.
    """
    k = durable(_classes(df, id_col, list(text_cols)))
    forms = k.select(*_GROUP, "raw").distinct()
    pairs = forms.withColumnRenamed("raw", "raw_a").join(forms.withColumnRenamed("raw", "raw_b"), _GROUP).filter("raw_a < raw_b")
    side = lambda c: k.select(*_GROUP, F.col("raw").alias(f"raw_{c}"), F.col("id").alias(c))
    out = pairs.join(side("a"), [*_GROUP, "raw_a"]).join(side("b"), [*_GROUP, "raw_b"]).filter("a != b")
    return out.select(F.least("a", "b").alias(f"{id_col}_a"), F.greatest("a", "b").alias(f"{id_col}_b")).distinct()


def classes(df: DataFrame, id_col: str = "extraction_id", text_cols: tuple[str, ...] = ("extracted_text", "ocr_text")) -> DataFrame:
    """``id, field, class_id, n_forms, n_links``: one row per value that reads like one stored differently.

    ``class_id`` is the least id of its class; ``n_links`` counts the values of the class in another stored form.
    """
    k = durable(_classes(df, id_col, list(text_cols)))
    forms = k.groupBy(*_GROUP, "raw").agg(F.count("*").alias("same"), F.min("id").alias("lo"))
    size = forms.groupBy(*_GROUP).agg(F.sum("same").alias("n"), F.count("*").alias("n_forms"), F.min("lo").alias("class_id"))
    rows = k.join(forms.drop("lo"), [*_GROUP, "raw"]).join(size, _GROUP)
    return rows.groupBy(F.col("id").alias(id_col), "field").agg(F.min("class_id").alias("class_id"), F.max("n_forms").alias("n_forms"), F.max(F.col("n") - F.col("same")).alias("n_links"))


_FORM = "id long, field string, text string, n long"


def repaired(df: DataFrame, id_col: str = "extraction_id", text_cols: tuple[str, ...] = ("extracted_text", "ocr_text")) -> DataFrame:
    """``id, field, text, repaired_tokens``: every non-empty field value in its one consistent form; equal rows give one.

    The texts are read twice: for the words and the possible repairs, and to be
    put into their form. Decisions on tokens and the list of values that
    were delivered twice are sent to every task while they are few
    (``BROADCAST_ROWS``); else they are joined. Only values delivered twice are shuffled then.
    """
    long = _long(df, id_col, list(text_cols))
    both = durable(_keyed(long))
    do = durable(_decisions(both).filter("final != token"))
    if small(do, BROADCAST_ROWS):
        known = {(r["token"], r["first"], r["second"], r["whole"]): r["final"] for r in do.collect()}
        shared = df.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            final = shared.value
            for b in batches:
                out, n = [], []
                for t in b["text"]:
                    if not _is_clean(t):
                        t = plain(t)
                        new = [(x[0], final[k]) for x in repairs(t) for k in [(x[1], *x[3:])] if k in final]
                        n.append(len(new))
                        out.append(_put(t, [a for a, _ in new], [w for _, w in new]))
                    else:
                        n.append(0)
                        out.append(t)
                yield pd.DataFrame({"id": b["id"], "field": b["field"], "text": out, "n": n})

        form = lambda x: x.select("id", "field", "text").mapInPandas(run, _FORM)
    else:
        done = _tokens(both.filter("word IS NULL")).join(do, _CASE).groupBy("id", "field", "raw").agg(F.array_sort(F.collect_set(F.struct("at", "final"))).alias("do"))

        def rejoin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [_put(t if _is_clean(t) else plain(t), [] if d is None else [x["at"] for x in d], [] if d is None else [x["final"] for x in d]) for t, d in zip(b["text"], b["do"])]
                yield pd.DataFrame({"id": b["id"], "field": b["field"], "text": out, "n": [0 if d is None else len(d) for d in b["do"]]})

        raw = F.pandas_udf(lambda s: s.map(_raw), "long")
        form = lambda x: x.withColumn("raw", raw("text")).join(done, ["id", "field", "raw"], "left").select("id", "field", "text", "do").mapInPandas(rejoin, _FORM)
    twice = durable(both.filter("word IS NULL").groupBy("id", "field").agg(F.count("*").alias("k")).filter("k > 1").select("id", "field"))
    if small(twice, BROADCAST_ROWS):
        twice = F.broadcast(twice)
    marked = long.join(twice.withColumn("again", F.lit(True)), ["id", "field"], "left")
    out = form(marked.filter("again IS NULL")).union(form(marked.filter("again").dropDuplicates(["id", "field", "text"])))
    return out.select(F.col("id").alias(id_col), "field", "text", F.col("n").alias("repaired_tokens"))
