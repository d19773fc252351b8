"""Regular expressions with ECMAScript meaning, for Java and for RE2.

The documents' rules were written for ECMAScript: ``\\s`` knows all Unicode
blanks, ``\\b``, ``\\w`` and ``\\d`` are ASCII, ``$`` is the absolute end. ``java()``
and ``re2()`` translate one pattern into the dialects of Spark and of the SQL
used for checking.
"""

from __future__ import annotations

import re

_BLANKS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{_BLANKS}]"
NOT_WS = f"[^{_BLANKS}]"


_WORD = "[A-Za-z0-9_]"


def _boundary(pattern: str, after: int, general: str) -> str:
    """A word boundary; a single look-around where a word sign surely follows or precedes it."""
    if not general.startswith("(?"):
        return general
    if re.match(r"\(?(?:[A-Za-z0-9_](?![?*{])|\[[a-zA-Z0-9-]+\](?![?*{]))", pattern[after:]):
        return f"(?<!{_WORD})"
    if re.search(r"[A-Za-z0-9_]$", pattern[: after - 2]) and not re.search(r"\\.$", pattern[: after - 2]):
        return f"(?!{_WORD})"
    return general


def _translate(pattern: str, boundary: str, end: str) -> str:
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            i += 2
            if n == "s":
                out.append(_BLANKS if inside else WS)
            elif n == "S" and not inside:
                out.append(NOT_WS)
            elif n == "b" and not inside:
                out.append(_boundary(pattern, i, boundary))
            elif n == "w":
                out.append("A-Za-z0-9_" if inside else "[A-Za-z0-9_]")
            elif n == "d":
                out.append("0-9" if inside else "[0-9]")
            else:
                out.append("\\" + n)
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        elif c == "$" and not inside:
            c = end
        out.append(c)
        i += 1
    return "".join(out)


def java(pattern: str, ignore_case: bool = False) -> str:
    boundary = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    return ("(?iu)" if ignore_case else "") + _translate(pattern, boundary, r"\z")


def re2(pattern: str, ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + _translate(pattern, r"\b", r"\z")
