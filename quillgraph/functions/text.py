"""Names, normal forms, script conversion and highlighting."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Traditional characters and their simplified forms, as the analytics define them.
SCRIPT = {
    "蘇": "苏", "劉": "刘", "張": "张", "趙": "赵", "錢": "钱", "孫": "孙", "國": "国", "會": "会", "試": "试", "鄉": "乡",
    "進": "进", "舉": "举", "階": "阶", "級": "级", "歷": "历", "鄭": "郑", "黃": "黄", "萬": "万", "陳": "陈", "楊": "杨",
    "馬": "马", "許": "许", "鄧": "邓", "吳": "吴", "葉": "叶", "羅": "罗", "齊": "齐", "祿": "禄", "祯": "祯", "禎": "祯",
}


_TO_SIMPLE, _TO_OLD = str.maketrans(SCRIPT), str.maketrans({simple: old for old, simple in SCRIPT.items()})
#: A text as it is, in simplified and in traditional form; all keep its length.
CONVERSIONS = (lambda x: x, lambda x: x.translate(_TO_SIMPLE), lambda x: x.translate(_TO_OLD))


def local_name_a(iri: Column) -> Column:
    """What follows the last ``#``, ``/`` or ``:``."""
    return F.regexp_extract(iri, r"([^#/:]*)$", 1)


def local_name_b(iri: Column) -> Column:
    """What follows the last ``#`` if there is one, else the last ``/``; colons stay."""
    return F.when(iri.contains("#"), F.substring_index(iri, "#", -1)).otherwise(F.substring_index(iri, "/", -1))


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark SQL lacks."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def strip_ws(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+", "")


def norm(x: Column) -> Column:
    """NFKC without white space and zero-width characters."""
    return F.regexp_replace(nfkc(x), r"(?U)[\s​-‍﻿]+", "")


def to_simplified(x: Column) -> Column:
    return F.translate(x, "".join(SCRIPT), "".join(SCRIPT.values()))


def to_traditional(x: Column) -> Column:
    """The inverse table; of several traditional forms the last listed."""
    inverse = {simple: old for old, simple in SCRIPT.items()}
    return F.translate(x, "".join(inverse), "".join(inverse.values()))


def norm_token(x: Column) -> Column:
    return to_simplified(strip_ws(nfkc(x)))


def contains_any_script(body: Column, name: Column) -> Column:
    """Whether the body holds the name in raw, simplified or traditional form."""
    return (F.instr(body, name) > 0) | (F.instr(to_simplified(body), to_simplified(name)) > 0) | (F.instr(to_traditional(body), to_traditional(name)) > 0)


def script_variants(term: str) -> set[str]:
    """A term as it is, in simplified and in traditional form."""
    return {convert(term) for convert in CONVERSIONS}


def highlight(body: Column, terms: list[str], scripts: bool = False) -> Column:
    """Marks every term in one pass, the longest first, so inserted marks are never matched again; with ``scripts`` in all its forms."""
    every = {v for t in terms for v in (script_variants(t) if scripts else (t,))}
    pattern = "|".join(re.escape(t) for t in sorted(every, key=lambda t: (-len(t), t)) if t)
    return F.regexp_replace(body, f"({pattern})", "<mark>$1</mark>") if pattern else body


def truncated(x: Column, most: int = 46) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)


def escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def tooltip(kind: Column, props: Column) -> Column:
    """The type and each non-blank property of a node, escaped, a line each."""
    lines = F.transform(F.filter(F.array_sort(F.map_entries(props)), lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != ""), lambda e: F.concat(escaped(e["key"]), F.lit(": "), escaped(e["value"])))
    return F.array_join(F.concat(F.array(F.concat(F.lit("<b>"), escaped(kind), F.lit("</b>"))), lines), "<br>")


def display_name(label: Column, props: Column) -> Column:
    """What a node of the property graph is called, by its label."""
    # Properties that name a node, and what stands in for them.
    named = {"Person": (["姓名"], "未知人物"), "Official Position": (["官职名称"], "未知官职"), "ImperialExam": (["考试等级"], "科举"), "Place": (["历史名称", "现代名称"], "未知地点")}
    out = label
    for kind, (keys, other) in named.items():
        values = [F.nullif(F.trim(F.try_element_at(props, F.lit(k))), F.lit("")) for k in keys]
        out = F.when(label == kind, F.coalesce(*values, F.lit(other))).otherwise(out)
    content = F.substring(F.trim(F.try_element_at(props, F.lit("content"))), 1, 20)
    return F.when(label == "Text", F.coalesce(F.nullif(content, F.lit("")), F.lit("文本片段"))).otherwise(out)


def without_reasoning(x: Column) -> Column:
    """A model's output without its reasoning and what stands before the first brace."""
    x = F.regexp_replace(x, r"(?s)<think>.*?</think>", "")
    return F.when(F.instr(x, "{") > 0, F.regexp_replace(x, r"(?s)^[^{]*", "")).otherwise(x)
