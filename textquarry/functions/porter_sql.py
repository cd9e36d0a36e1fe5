"""The Porter stemmer as SQL, for comparing stemmed queries with another engine.

The definition is that of functions.porter, by regular expressions over the consonant and vowel runs of a word: with
C a consonant run and V a vowel run, a word is [C](VC)^m[V]. A leading y is a consonant and is written Y meanwhile.
"""

from __future__ import annotations

from .porter import STEP2, STEP3, STEP4

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_SOME = f"^({_C})?{_V}{_C}"  # m > 0
_ONE = f"^({_C})?{_V}{_C}({_V})?$"  # m = 1
_MORE = f"^({_C})?{_V}{_C}{_V}{_C}"  # m > 1
_VOWEL = f"^({_C})?[aeiouy]"
_SHORT = f"^{_C}[aeiouy][^aeiouwxyY]$"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _cut(x: str, n: int) -> str:
    return f"left({x}, length({x}) - {n})"


def _mended(x: str) -> str:
    """What follows the removal of -ed and -ing."""
    double = f"length({x}) > 1 AND right({x}, 1) = left(right({x}, 2), 1) AND {_has(x, '[^aeiouylsz]$')}"
    return f"CASE WHEN {_has(x, '(at|bl|iz)$')} THEN {x} || 'e' WHEN {double} THEN {_cut(x, 1)} WHEN {_has(x, _ONE)} AND {_has(x, _SHORT)} THEN {x} || 'e' ELSE {x} END"


def _suffixes(x: str, table: dict[str, str], condition) -> str:
    """The longest suffix of a table that fits decides; its stem must meet the condition."""
    cases = "".join(f" WHEN suffix({x}, '{s}') THEN CASE WHEN {condition(_cut(x, len(s)), s)} THEN {_cut(x, len(s))} || '{to}' ELSE {x} END" for s, to in sorted(table.items(), key=lambda kv: -len(kv[0])))
    return f"CASE{cases} ELSE {x} END"


def stem_steps(source: str, term: str) -> str:
    """A query giving term and stem of the distinct terms of a table."""
    some = lambda x, _: _has(x, _SOME)
    last = lambda x, s: _has(x, _MORE) + (f" AND {_has(x, '[st]$')}" if s == "ion" else "")
    steps = [
        f"CASE WHEN {_has('w', '(sses|ies)$')} THEN {_cut('w', 2)} WHEN {_has('w', '[^s]s$')} OR w = 's' THEN {_cut('w', 1)} ELSE w END",
        f"CASE WHEN suffix(w, 'eed') THEN CASE WHEN {_has(_cut('w', 3), _SOME)} THEN {_cut('w', 1)} ELSE w END"
        f" WHEN suffix(w, 'ed') AND {_has(_cut('w', 2), _VOWEL)} THEN {_mended(_cut('w', 2))} WHEN suffix(w, 'ing') AND {_has(_cut('w', 3), _VOWEL)} THEN {_mended(_cut('w', 3))} ELSE w END",
        f"CASE WHEN suffix(w, 'y') AND {_has(_cut('w', 1), _VOWEL)} THEN {_cut('w', 1)} || 'i' ELSE w END",
        _suffixes("w", STEP2, some),
        _suffixes("w", STEP3, some),
        _suffixes("w", dict.fromkeys(STEP4, ""), last),
        f"CASE WHEN suffix(w, 'e') AND ({_has(_cut('w', 1), _MORE)} OR ({_has(_cut('w', 1), _ONE)} AND NOT {_has(_cut('w', 1), _SHORT)})) THEN {_cut('w', 1)} ELSE w END",
        f"CASE WHEN suffix(w, 'll') AND {_has('w', _MORE)} THEN {_cut('w', 1)} ELSE w END",
    ]
    out = f"SELECT DISTINCT {term} AS term, regexp_replace({term}, '^y', 'Y') AS w FROM {source}"
    for step in steps:
        out = f"SELECT term, {step} AS w FROM ({out})"
    return f"SELECT term, CASE WHEN length(term) < 3 OR length(term) > 64 THEN term ELSE regexp_replace(w, '^Y', 'y') END AS stem FROM ({out})"
