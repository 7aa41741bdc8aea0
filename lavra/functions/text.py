"""Text primitives with the semantics of the rules: white space, word edges, folding, windows around a match."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space: ASCII blanks, no-break blanks, the byte order mark, Unicode separators.
BLANK = r"\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_BLANKS = " \t\n\v\f\r" + "".join(map(chr, [0xA0, 0xFEFF, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
UNKNOWN = "[NÃO IDENTIFICADO]"
CNJ = r"\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}"


def java(pattern: str, flags: str = "iu") -> str:
    """A rule's pattern for Spark: ASCII word edges, wide white space, Unicode case folding."""
    out, inside = [], False
    for part in re.findall(r"\\.|.", pattern, re.S):
        if part == r"\b":
            out.append(_EDGE)
        elif part == r"\s":
            out.append(BLANK if inside else f"[{BLANK}]")
        else:
            inside = part == "[" or (inside and part != "]")
            out.append(part)
    return (f"(?{flags})" if flags else "") + "".join(out)


#: Characters beside its two cases that match a letter when case is ignored as Unicode has it.
_FOLDED = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def openings(pattern: str) -> str:
    """All characters that a match of a pattern can begin with, case aside; none if one of its alternatives begins
    with anything but an ASCII letter (after a word edge or not) that must stand there."""
    depth, alternatives = 0, [""]
    for part in re.findall(r"\\.|.", pattern, re.S):
        depth += (part in "([") - (part in ")]")
        if part == "|" and depth == 0:
            alternatives.append("")
        else:
            alternatives[-1] += part
    heads = [re.match(r"(?:\\b)?([A-Za-z])(?![?*{])", x) for x in alternatives]
    if not all(heads):
        return ""
    return "".join(sorted({c for h in heads for c in h[1].lower() + h[1].upper() + _FOLDED.get(h[1].lower(), "")}))


def _ahead(pattern: str, flags: str, ahead: str) -> str:
    """A rule's pattern for Spark. What a match can begin with is looked at, as a plain class, before edges and
    alternatives are tried: `openings` if case is ignored, or what `ahead` names."""
    ahead = ahead or (openings(pattern) if "i" in flags else "")
    return (f"(?=[{re.sub(r'([^\w])', r'\\\1', ahead)}])" if ahead else "") + java(pattern, flags)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def has(text: Column, pattern: str, flags: str = "iu", ahead: str = "") -> Column:
    return text.rlike(_ahead(pattern, flags, ahead))


def first(text: Column, pattern: str, group: int = 0, flags: str = "iu", ahead: str = "") -> Column:
    """The group of the first match, '' if there is none."""
    return F.regexp_extract(text, _ahead(pattern, flags, ahead), group)


def every(text: Column, pattern: str, group: int = 0, flags: str = "iu", ahead: str = "") -> Column:
    return F.regexp_extract_all(text, F.lit(_ahead(pattern, flags, ahead)), F.lit(group))


def replace(text: Column, pattern: str, by: str, flags: str = "iu", ahead: str = "") -> Column:
    return F.regexp_replace(text, _ahead(pattern, flags, ahead), by)


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def squeeze(text: Column) -> Column:
    """Each run of white space as one blank, trimmed. Runs that are one blank already are passed over."""
    return trim(F.regexp_replace(text, f" [{BLANK}]+|[{BLANK}&&[^ ]][{BLANK}]*", " "))


@cache
def _latin() -> tuple[str, str]:
    """Composed Latin letters and their base letters, by the rule of canonical decomposition."""
    pairs = []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(cp):
            pairs.append((chr(cp), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unaccent(text: Column) -> Column:
    source, target = _latin()
    return F.regexp_replace(F.translate(text, source, target), r"\p{M}", "")


def fold(text: Column) -> Column:
    return F.lower(unaccent(text))


def around(text: Column, pattern: str, before: int = 40, after: int = 80) -> Column:
    """The first match with its surroundings, squeezed; '' if there is none. The text is searched once."""

    def cut(at: Column) -> Column:
        start = F.greatest(F.lit(1), at - before)
        stop = at + F.length(first(F.substr(text, at), pattern)) + after
        return F.when(at > 0, squeeze(F.substring(text, start, stop - start))).otherwise("")

    return let(F.regexp_instr(text, F.lit(_ahead(pattern, "iu", ""))), cut)


def labelled(text: Column, label: str) -> Column:
    """The value of a line 'label: value', at most 180 characters; '' if there is none."""
    return F.substring(trim(first(text, rf"(?:^|\n)\s*{label}\s*:\s*([^\n]+)", 1)), 1, 180)


def distinct_matches(text: Column, pattern: str, group: int = 0, flags: str = "iu", ahead: str = "") -> Column:
    return F.array_distinct(every(text, pattern, group, flags, ahead))
