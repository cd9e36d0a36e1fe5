"""The Porter stemmer (M. F. Porter, "An algorithm for suffix stripping", Program 14(3), 1980)."""

from __future__ import annotations

import functools
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

#: Letters that some suffix ends with; words that end otherwise are their stems.
_LAST = frozenset(x[-1] for x in (*STEP2, *STEP3, *STEP4, "s", "d", "g", "y", "e", "l"))
_ENDS = {2: tuple(STEP2), 3: tuple(STEP3), 4: STEP4}
_SHAPES = str.maketrans({chr(i): "v" if chr(i) in "aeiou" else "c" for i in range(128)})


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    if "y" not in word and word.isascii():
        return word.translate(_SHAPES)
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    """Ends with a consonant twice; y is none here, as in functions.porter_sql."""
    return len(stem) > 1 and stem[-1] == stem[-2] and stem[-1] not in "aeiouy"


def stem(word: str) -> str:
    """Stem of a lower-case word; words of fewer than three or over 64 letters stay."""
    if len(word) < 3 or len(word) > 64 or word[-1] not in _LAST:
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(x)] for x in ("ed", "ing") if w.endswith(x) and _has_vowel(w[: -len(x)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for step, table in ((2, STEP2), (3, STEP3)):
        suffix = max((x for x in table if w.endswith(x)), key=len) if w.endswith(_ENDS[step]) else None
        if suffix and _measure(w[: -len(suffix)]) > 0:
            w = w[: -len(suffix)] + table[suffix]
    suffix = max((x for x in STEP4 if w.endswith(x)), key=len) if w.endswith(_ENDS[4]) else None
    if suffix:
        rest = w[: -len(suffix)]
        if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
            w = rest
    if w.endswith("e"):
        rest = w[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short(rest)):
            w = rest
    if _measure(w) > 1 and _double(w) and w[-1] == "l":
        w = w[:-1]
    return w


def least_prefix(stemmed: str) -> str:
    """What every word begins with whose stem is, or begins with, this one. Steps cut a word's end, and what they put
    there instead differs from it in an e, an i, or an le of which the e may go."""
    return stemmed[:-2] if stemmed.endswith("le") else stemmed[:-1] if stemmed.endswith(("e", "i", "l")) else stemmed


SLACK = 8


def _before(stemmed: str, start: str = "") -> set[str]:
    """All words that begin with start whose stem this may be, and more: every step backwards, without its conditions. What
    later steps take from a word's end is less than SLACK."""

    def near(words: set[str]) -> set[str]:
        return {w for w in words if w[: max(0, len(w) - SLACK)][: len(start)] == start[: max(0, len(w) - SLACK)]}

    found = near({stemmed} | ({stemmed + "l"} if stemmed.endswith("l") else set()))
    found |= {w + "e" for w in found}
    found |= near({w + x for w in found for x in STEP4})
    for table in (STEP3, STEP2):
        found |= near({w[: len(w) - len(to)] + x for w in found for x, to in table.items() if w.endswith(to)})
    found |= {w[:-1] + "y" for w in found if w.endswith("i")}
    bare = found | {w[:-1] for w in found if w.endswith("e")} | {w + w[-1:] for w in found}
    found |= near({w + x for w in bare for x in ("ed", "ing")} | {w + "d" for w in found if w.endswith("ee")})
    return found | {w + "s" for w in found} | {w + "es" for w in found if w.endswith(("ss", "i"))}


@functools.lru_cache(512)
def words_of_stem(stemmed: str) -> frozenset[str]:
    """The words, finitely many, whose stem this is."""
    return frozenset(w for w in _before(stemmed) if w and stem(w) == stemmed)


@functools.lru_cache(512)
def words_of_prefix(start: str) -> tuple[frozenset[str], frozenset[str]]:
    """The words whose stem begins with this are those that begin so themselves, but for the first set, and the second."""
    heads = {start[:k] + x for k in range(len(start) + 1) for x in ("", "e", "i", "l", "le")} - {""}
    lost = {w for h in heads for w in _before(h, start) if w.startswith(start) and not stem(w).startswith(start)}
    more = {w for h in heads if h.startswith(start) for w in words_of_stem(h) if not w.startswith(start)}
    return frozenset(lost), frozenset(more)


# The stemmer as patterns over a line of words, each for all its words at once: no Python, and no expression a word. The line
# is reversed, with a space before each word, so that a pattern sees a word's end first and goes on only with the words it
# is about. A y that is a consonant stands as Y meanwhile, a word that stays as it is has the mark \x01 at its end, and one
# that lost -ed or -ing, or the d of -eed, \x02. By the measure m, what is left of a word has the form of _SOME (m > 0) or _MORE (m > 1).
_CON, _ANY, _DONE = r"[^aeiouy \x01\x02]", "[aeiouy]", "(?![^ ])"
_SOME = f"{_ANY}*+{_CON}++{_ANY}"
_MORE = f"{_SOME}++{_CON}++{_ANY}"
_VOWEL = f"{_CON}*+{_ANY}"
_SHORT = rf"[^aeiouywxY \x01\x02]{_ANY}{_CON}++{_DONE}"
_LINE_STEPS = (
    (f"y(?=(?:yy)*+(?:y[^aeiouy ]|[aeiou]|{_DONE}))", "Y"),
    (f" (?=Y[aeiou]{_DONE}|[^ ]{{65}})", " \x01"),
    (" (?:se(?=ss|i)|s(?=[^s ][^ ]))", " "),
    (f" (?:d(?=ee{_SOME})|(?:de(?!e)|gni)(?={_VOWEL}))", " \x02"),
    (f" \x02(?=ta|lb|zi|{_SHORT})", " e"),
    (r" \x02(?:([^aeiouylszY \x01\x02])(?=\1))?", " "),
    (f" [yY](?={_VOWEL})", " i"),
    (f" (?:lanoi(?=ta{_SOME})|noi(?=ta(?!zi){_SOME})|noita(?=zi{_SOME})|ro(?=ta{_SOME})|i(?=(?:cn[ae]|lba){_SOME})|iti(?=vi{_SOME}))", " e"),
    (f" itili(?=b{_SOME})", " el"),
    (f" (?:la(?=noit{_SOME})|r(?=ezi{_SOME})|il(?=(?:la|tne|suo|e){_SOME})|(?:msi|iti)(?=la{_SOME})|ssen(?=(?:evi|luf|suo){_SOME}))", " "),
    (f" (?:(?:eta|iti|la)(?=ci{_SOME})|ezi(?=la{_SOME})|(?:evita|luf|ssen)(?={_SOME}))", " "),
    (f" (?:la|ecn[ae]|re|ci|elb[ai]|tn(?:a|eme|em(?!e)|e(?!m))|noi(?=[st])|s?uo|msi|eta|iti|evi|ezi)(?={_MORE})", " "),
    (f" (?:e(?={_SOME})(?!{_SHORT})(?:(?={_MORE})l(?=l))?|(?={_MORE})l(?=l))", " "),
)


def stems(words: Column) -> Column:
    """Stems of an array of words (without nulls)."""
    line = F.concat(F.lit(" "), F.reverse(F.array_join(words, " ")))
    line = reduce(lambda c, step: F.regexp_replace(c, *step), _LINE_STEPS, line)
    return F.when(F.size(words) > 0, F.split(F.rtrim(F.reverse(F.translate(line, "Y\x01", "y"))), " ")).otherwise(words)


#: Stems a worker keeps from batch to batch.
KEPT = 50_000
_kept: dict[str, str] = {}


def _known(word: str) -> str:
    found = _kept.get(word)
    if found is None:
        if len(_kept) >= KEPT:
            _kept.clear()
        found = _kept[word] = stem(word)
    return found


@F.arrow_udf(ArrayType(StringType()))
def stem_all(words: pa.Array) -> pa.Array:
    """Stems of an array of words, batch by batch: each distinct word of a batch is stemmed once, and no word of a text
    becomes a Python object."""
    flat = words.flatten().dictionary_encode()
    stems = pa.array([_known(w) if w is not None else None for w in flat.dictionary.to_pylist()], pa.string())
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), stems.take(flat.indices), mask=words.is_null() if words.null_count else None)
