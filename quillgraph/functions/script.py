"""Script conversion by a dictionary of characters and phrases, which is given as a table.

At every place of a text the longest entry that begins there is replaced, from left to right; what no entry covers stays. The identity variant of a conversion is the text itself, so a name is compared in all its forms.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Entries that a dictionary may have to be sent to the workers; larger ones are joined to the texts' own windows.
MOST_SENT = 200_000


def _checked(dictionary: DataFrame, source: str, target: str, most: int) -> dict[str, str]:
    """The dictionary as a map, the least target of each source; bounded."""
    entries = dictionary.where((F.length(source) > 0) & F.col(target).isNotNull()).groupBy(F.col(source).alias("s")).agg(F.min(target).alias("t")).limit(most + 1).collect()
    if len(entries) > most:
        raise ValueError(f"a dictionary of more than {most} entries")
    return {r["s"]: r["t"] for r in entries}


def converter(dictionary: DataFrame, source: str, target: str, most: int = MOST_SENT):
    """A column function that replaces, leftmost and longest first, the entries of ``dictionary(source, target)``; null stays null. Reads the dictionary once, ``most`` entries at most, else an error."""
    table = _checked(dictionary, source, target, most)
    lengths: dict[str, list[int]] = {}  # by first character, longest first
    for entry in table:
        lengths.setdefault(entry[0], []).append(len(entry))
    lengths = {c: sorted(set(n), reverse=True) for c, n in lengths.items()}

    def convert(text: str | None) -> str | None:
        if text is None:
            return None
        out, at, plain = [], 0, 0
        while at < len(text):
            for n in lengths.get(text[at], ()):
                if (found := table.get(text[at : at + n])) is not None and at + n <= len(text):
                    out += (text[plain:at], found)
                    plain = at = at + n
                    break
            else:
                at += 1
        return "".join(out) + text[plain:] if out else text

    @F.pandas_udf(StringType())
    def column(x: pd.Series) -> pd.Series:
        return x.map(convert)

    return column


def forms(text: Column, *conversions) -> Column:
    """The distinct forms of a text: as it is, and by each conversion."""
    return F.array_distinct(F.array(text, *(c(text) for c in conversions)))
