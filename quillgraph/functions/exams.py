"""The five tests by which the analyses tell a palace examination; they differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm, to_simplified

# Literal keys of an examination's level, and the words that mark the palace examination.
LEVEL_KEYS = ["考试等级", "科举等级", "考试级别", "等级", "level", "Level", "examLevel", "ExamLevel"]
PALACE = "殿试"
WORDS = ["殿试", "殿", "Palace", "御试", "廷对"]


def _any(values: Column, words: list[str]) -> Column:
    return F.coalesce(F.exists(values, lambda v: F.coalesce(v.rlike("|".join(words)), F.lit(False))), F.lit(False))


def palace_by_any_literal(literals: Column, local_name: Column) -> Column:
    """Places: any literal (array<string>) has the word, or the local name has it or its English form."""
    return _any(literals, [PALACE]) | F.coalesce(local_name.rlike(f"{PALACE}|Palace"), F.lit(False))


def palace_by_either_level(exam_levels: Column, participation_levels: Column) -> Column:
    """People: a level (array<string>) of the examination or of the participation has the word or its English form."""
    return _any(F.concat(exam_levels, participation_levels), [PALACE, "Palace"])


def palace_by_equal_level(level: Column) -> Column:
    """Positions: the level, normalised and simplified, is the word."""
    return F.coalesce(norm(to_simplified(level)) == PALACE, F.lit(False))


def palace_by_level_keys(props: Column, local_name: Column) -> Column:
    """Timeline: a value of any level key of the literal map has one of the words, or the local name has one."""
    values = F.flatten(F.array(*(F.coalesce(F.try_element_at(props, F.lit(k)), F.array().cast("array<string>")) for k in LEVEL_KEYS)))
    return _any(values, WORDS) | F.coalesce(local_name.rlike("Palace|殿|御试|廷对"), F.lit(False))


def palace_by_level_or_name(level: Column, local_name: Column) -> Column:
    """Yearly trend: the level or the local name has one of the words."""
    return F.coalesce(level.rlike("|".join(WORDS)), F.lit(False)) | F.coalesce(local_name.rlike("|".join(WORDS)), F.lit(False))
