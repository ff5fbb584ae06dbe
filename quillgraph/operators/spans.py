"""From token places to characters, and from scored ends to spans, by arrays of places."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def offsets(rows: DataFrame, key: str, tokens: str, gap: int = 0) -> DataFrame:
    """``rows(key, tokens array<string>)`` -> (key, starts array<int>, stops array<int>): where each token stands in the text that the tokens make with ``gap`` characters between; code points, ends exclusive.

    Places are prefix sums over the tokens' lengths, made once a row whatever its number of tokens; a null token has no length, a null array gives null."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def ends(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda n: None if n is None else np.cumsum(np.asarray(n, np.int64) + gap) - gap)

    size = F.transform(tokens, lambda t: F.coalesce(F.length(t), F.lit(0)))
    return rows.select(key, size.alias("n"), ends(size).alias("stops")).select(key, F.zip_with("stops", "n", lambda e, n: e - n).alias("starts"), "stops")


def characters(spans: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """``spans(key, first, last, ..)``, tokens from 0 with both ends included, and :func:`offsets` -> with ``start`` and ``stop`` in characters. Spans beyond the tokens are left out."""
    both = spans.join(placed, key).where((F.col("first") >= 0) & (F.col("last") < F.size("stops")) & (F.col("first") <= F.col("last")))
    return both.withColumn("start", F.get("starts", F.col("first"))).withColumn("stop", F.get("stops", F.col("last"))).drop("starts", "stops")


def decoded(scores: DataFrame, first: float = 0.4, later: float = 0.7, most: int = 8) -> DataFrame:
    """``scores(line_id, type_idx, heads array<array<double>>, tails array<double>)`` -> (line_id, type_idx, start, length).

    ``heads[p][d]`` scores a span of ``d + 1`` tokens that begins at ``p``, ``tails[p]`` one that ends there; both are over the threshold, which is lower for one token. Ends are found by their place in the array: nothing is exploded but
    the spans, and nothing is joined."""
    cut = lambda d: F.when(d == 0, F.lit(first)).otherwise(F.lit(later))

    def at(head: Column, p: Column) -> Column:
        good = F.filter(F.sequence(F.lit(0), F.least(F.lit(most), F.size(head)) - 1), lambda d: (F.get(head, d) > cut(d)) & (F.get(F.col("tails"), p + d) > cut(d)))
        return F.transform(F.when(F.size(head) > 0, good).otherwise(F.array().cast("array<int>")), lambda d: F.struct(p.alias("start"), (d + 1).alias("length")))

    return scores.select("line_id", "type_idx", F.explode(F.flatten(F.transform("heads", at))).alias("x")).select("line_id", "type_idx", "x.start", "x.length")
