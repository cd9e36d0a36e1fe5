"""Small tables with the awkward rows: nulls, empties, ties, repeats, long texts, extra and clashing columns."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, n int, label int, value string, doc long, hash long, `__mix_key` string"
SPACES = re.compile(r"[^\x20\x09-\x0D]+")
ITEMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def texts():
    rng = random.Random(5)
    vocabulary = ["wort", "mot", "thing", "ding", "chose", "été", "über", "ALPHA", "Beta", "x1", "the", "of"]
    make = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randrange(60)) for _ in range(n))
    base, other = make(120), make(90)
    near = base.split()
    near[60] = "changed"
    out = [None, "", " \n\t ", "one", "one two three", base, base, " ".join(near), base.upper(), other, f"{other}\n{other}", make(5000)]
    out += [f"shared passage of boilerplate words here now ok\n{make(30)}" for _ in range(14)]
    out += ["Ünïcödé … 漢字 text with spaces\x0bhere", "a\nA \n a\nb", "tail\n", "😀 emoji 😀"]
    return out


def rows():
    out = [(i, t, None if i % 7 == 0 else "en" if i % 2 else "de", None if i % 9 == 0 else f"s{i % 4}", len(t or ""), "w", 1, 2, "v", 3, 4, "k") for i, t in enumerate(texts())]
    return [*out, out[5], out[5], (None, "no id at all but words", None, None, 0, None, None, None, None, None, None, None)]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def space_words(text):
    return SPACES.findall(text or "")


def item_words(text):
    return ITEMS.findall((text or "").translate(LOWER))
