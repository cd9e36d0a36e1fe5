"""Traditional to Simplified characters, one to one, from the ICU rules that ship with Spark."""

from __future__ import annotations

import functools

from pyspark.sql import SparkSession

RULES = "Traditional-Simplified"
#: First and last of the characters that are mapped.
SPAN = (0x4E00, 0x9FFF)
#: Characters that keep their form, because a map of single characters folds them wrongly.
KEPT = "乾"


@functools.cache
def simplified_map(kept: str = KEPT) -> dict[str, str]:
    """Character -> simplified character, of those that differ. One call into the driver's JVM, once; phrase rules do
    not apply, so it approximates a dictionary converter."""
    spark = SparkSession.active()
    chars = [chr(i) for i in range(SPAN[0], SPAN[1] + 1) if chr(i) not in kept]
    icu = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance(RULES)
    out = icu.transliterate("\n".join(chars)).split("\n")
    return {a: b for a, b in zip(chars, out, strict=True) if a != b and len(b) == 1}
