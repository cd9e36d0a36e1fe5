"""Text expressions: cleaning, CJK segmentation, exact-match normalisation, passage reflow.

Java's \\s leaves out no-break and other Unicode spaces, so white space is spelled as SPACE.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .han import simplified_map
from .rows import once  # noqa: F401  its callers know it here

SPACE = r"[\s\p{Z}\x{FEFF}]"
#: All of SPACE but the plain space.
ODD_SPACE = r"[\t-\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CJK = r"[\p{script=Han}\p{script=Hiragana}\p{script=Katakana}\p{script=Hangul}]"
HAN = r"\p{script=Han}"
WORD = r"[\p{L}\p{N}]+"


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def compact(c: Column) -> Column:
    """White space runs to one space, ends trimmed. Texts that are so already, the most, are only looked through."""

    def one(x: Column) -> Column:
        loose = x.contains("  ") | x.startswith(" ") | x.endswith(" ") | x.rlike(ODD_SPACE)
        return F.when(loose, F.regexp_replace(F.regexp_replace(x, SPACE + "+", " "), "^ | $", "")).otherwise(x)

    return bound(c, one)


def clean_text(c: Column) -> Column:
    """Drops CR and NUL, blanks at line ends and third and further newlines in a row; trims. Each pattern is run only on
    texts that hold a character it is about."""

    def lines(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, r"(?<![ \t])[ \t]+\n", "\n"), r"\n{3,}", "\n\n")

    c = bound(c, lambda x: F.when(x.contains("\r") | x.contains("\0"), F.regexp_replace(x, r"[\r\x00]", "")).otherwise(x))
    c = bound(c, lambda x: F.when(x.contains("\n"), lines(x)).otherwise(x))
    return bound(c, lambda x: stripped(x, SPACE))


def stripped(c: Column, space: str = r"\p{Zs}") -> Column:
    """Without white space at both ends, by default that of SQL's trim (space separators). Time is linear in runs of it."""
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(ends.rlike(space), F.regexp_replace(c, rf"^{space}+|(?<!{space}){space}+\z", "")).otherwise(c)


def not_blank(c: Column) -> Column:
    """Whether stripped() leaves anything."""
    return c.rlike(r"[^\p{Zs}]")


def segment_cjk(c: Column) -> Column:
    """A space between neighbours of which either is CJK and neither is a space, newline or tab."""
    return F.regexp_replace(c, rf"(?<={CJK})(?=[^ \n\t])|(?<=[^ \n\t])(?={CJK})", " ")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """Compatibility composition; has no built-in, so it is a vectorised function."""
    return _nfkc(c)


def collapse_cjk(c: Column) -> Column:
    """Joins runs of single-CJK-character tokens, and only those."""
    return F.regexp_replace(c, rf"(?<=(?:^| ){CJK}) (?={CJK}(?: |$))", "")


def words_only(c: Column) -> Column:
    """Lower case, everything but letters and numbers to single spaces, trimmed, CJK runs collapsed."""
    spaced = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")
    return collapse_cjk(F.regexp_replace(spaced, "^ +| +$", ""))


def exact_text(c: Column, simplify: bool = True) -> Column:
    """Key for exact comparison: NFKC, Traditional-to-Simplified folding, then words_only."""
    c = nfkc(c)
    return words_only(han_fold(c) if simplify else c)


@functools.cache
def latin_bases() -> dict[str, str]:
    """Latin letters with marks -> their base letters, in both cases."""
    found = {chr(i): unicodedata.normalize("NFD", chr(i)) for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
    return {c: d[0] for c, d in found.items() if len(d) > 1 and d[0] != c and all(unicodedata.combining(x) for x in d[1:])}


def diacritic_fold(c: Column) -> Column:
    """Latin letters to their base letters, and combining marks dropped; ASCII texts are left as they are."""
    bases = latin_bases()
    based = F.when(c.rlike(r"[\x{C0}-\x{24F}\x{1E00}-\x{1EFF}]"), F.translate(c, "".join(bases), "".join(bases.values()))).otherwise(c)
    return F.when(F.octet_length(c) > F.length(c), F.regexp_replace(based, r"\p{Mn}+", "")).otherwise(c)


def han_fold(c: Column) -> Column:
    """Traditional to Simplified characters, of texts that have Han characters."""
    simple = simplified_map()
    return F.when(c.rlike(HAN), F.translate(c, "".join(simple), "".join(simple.values()))).otherwise(c)


def fold_word(word: str) -> str:
    """What tokens() makes of a word of a query."""
    simple, bases = simplified_map() if any(ord(c) > 0x2E7F for c in word) else {}, latin_bases()
    return "".join(bases.get(c, simple.get(c, c)) for c in word.lower() if not unicodedata.combining(c))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and numbers without diacritics, CJK characters apart and simplified; only texts that
    have such characters are changed. CJK scripts begin above U+1100, which is far cheaper to look for than a script."""
    apart = F.when(c.rlike(r"[\x{1100}-\x{10FFFF}]") & c.rlike(CJK), segment_cjk(han_fold(c))).otherwise(c)
    folded = F.regexp_extract_all(F.lower(diacritic_fold(apart)), F.lit(WORD), F.lit(0))
    return F.when(F.octet_length(c) == F.length(c), F.regexp_extract_all(F.lower(c), F.lit("[0-9a-z]+"), F.lit(0))).otherwise(folded)


def occurrences(c: Column, literal: str) -> Column:
    """How often a literal occurs, overlaps included."""
    return F.regexp_count(c, F.lit(f"(?=\\Q{literal}\\E)")) if literal else F.lit(0)


def reflow(c: Column) -> Column:
    """A passage as prose: hyphenated and CJK line breaks joined, others to spaces; edge ellipses stay."""
    rest = F.regexp_replace(c, "^…", "")
    lead, trail = F.when(c.startswith("…"), "…").otherwise(""), F.when(rest.endswith("…"), "…").otherwise("")
    core = F.regexp_replace(rest, "…$", "")
    core = F.regexp_replace(core, rf"([A-Za-z])-{SPACE}*\n+{SPACE}*([a-z])", "$1$2")
    core = F.regexp_replace(core, rf"({CJK}){SPACE}*\n+{SPACE}*({CJK})", "$1$2")
    core = F.regexp_replace(core, rf"{SPACE}*\n+{SPACE}*", " ")
    core = F.regexp_replace(core, "[ \t]{2,}", " ")
    return F.concat(lead, F.regexp_replace(core, rf"^{SPACE}+|{SPACE}+$", ""), trail)


def window(text: Column, center: Column, radius: int, ellipsis: bool = True) -> Column:
    """What lies within radius characters of an offset, with an ellipsis on each side that was cut."""
    size = F.length(text)
    begin, end = F.greatest(F.lit(0), center - radius), F.least(size, center + radius)
    cut = F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int"))
    if not ellipsis:
        return cut
    return F.concat(F.when(begin > 0, "…").otherwise(""), cut, F.when(end < size, "…").otherwise(""))
