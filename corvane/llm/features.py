"""Document features as built-in Spark expressions (no Python in the scan), for operators 5 and 10.

All lie in [0, 1] and grow as a text gets worse; a null or empty text has 0 in each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that running prose does without.
SYMBOLS = r"[^\p{L}\p{N}\s.,;:?'\"()\-]"
NAMES = ("symbols", "capitals", "sameness", "line_repeats")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def feature_columns(text: Column) -> dict[str, Column]:
    """The features of a text column by name.

    ``symbols``       share of characters that are symbols;
    ``capitals``      share of characters that are capital letters;
    ``sameness``      1 - log(distinct words) / log(words), which unlike a plain share of distinct
                      words doesn't fall as clean texts get longer; 0 for fewer than 8 words;
    ``line_repeats``  share of lines that repeat an earlier one.
    """
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    words = F.split(t, r"\s+")
    lines = F.split(t, "\n")
    w, l = F.size(words), F.size(lines)
    herdan = F.log(F.size(F.array_distinct(words)).cast("double")) / F.log(w.cast("double"))
    return {
        "symbols": _share(F.regexp_count(t, F.lit(SYMBOLS)).cast("double"), n.cast("double")),
        "capitals": _share(F.regexp_count(t, F.lit(r"\p{Lu}")).cast("double"), n.cast("double")),
        "sameness": F.when(w >= 8, F.round(1 - herdan, 9)).otherwise(F.lit(0.0)),
        "line_repeats": (l - F.size(F.array_distinct(lines))).cast("double") / l.cast("double"),
    }
