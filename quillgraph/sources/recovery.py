"""Records out of a model's raw output: a row each, whatever stands around them.

An output that is JSON as a whole gives its items. Else every line that is JSON by itself is kept, and what lies between such lines is searched for objects: a scanner
follows braces, strings and escapes, and takes the outermost braces that close, so prose, indices, fences and an object that never closes cost no other record.
Each object is read as JSON, else as JSON with the usual faults mended, else as a Python literal; what is none of these is left out. A text is scanned once, in time that grows with its length.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.staging import dealt

#: Raw outputs that a task reads.
OUTPUTS = 50_000
RECORD = "type string, label string, properties map<string,string>, start map<string,string>, `end` map<string,string>, text string"
_REASONING = re.compile(r"<think>.*?</think>", re.DOTALL)
_FENCE = re.compile(r"^\s*```\w*\s*$", re.MULTILINE)
_MARK = re.compile(r"[{}\"'\n]")
#: (what is mended, by what): commas doubled, trailing or missing at line ends, indices before objects.
_FAULTS = [
    (re.compile(r",(?:\s*,)+"), ","),
    (re.compile(r",(?=\s*[}\]])"), ""),
    (re.compile(r"(?<=[\"}\]\d])(\s++)(?=[\"{])"), lambda m: ("," if "\n" in m[1] else "") + m[1]),
    (re.compile(r"(?<=[\[,\n])(\s*)\d+\s*:\s*(?=\{)"), r"\1"),
    (re.compile(r"(?<=\})(\s*)(?=\{)"), r",\1"),
]


def outermost(text: str) -> list[tuple[int, int]]:
    """The spans of braces that close and lie within no others that close. Strings hold no braces; one that its line does not end is no string."""
    opened: list[int] = []
    spans: list[tuple[int, int]] = []
    quote, at = "", 0
    before = 0  # where the string being read began
    while m := _MARK.search(text, at):
        c, at = m[0], m.end()
        if quote:
            slashes = m.start() - 1
            while slashes >= before and text[slashes] == "\\":
                slashes -= 1
            if c == "\n":
                quote, at = "", before  # the quote was an apostrophe
            elif c == quote and (m.start() - slashes) % 2:
                quote = ""
        elif c == "{":
            opened.append(m.start())
        elif c == "}" and opened:
            start = opened.pop()
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, at))
        elif c in "\"'" and opened and (c == '"' or text[m.start() - 1] in "{[(,: "):
            quote, before = c, at
    return spans


def _items(value: object) -> list[dict]:
    return [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]


def _json(text: str) -> list[dict] | None:
    try:
        return _items(json.loads(text))
    except (ValueError, RecursionError):
        return None


def _literal(text: str) -> list[dict] | None:
    try:
        return _items(ast.literal_eval(text))
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


def _object(text: str) -> list[dict]:
    if (found := _json(text)) is not None:
        return found
    mended = text
    for fault, by in _FAULTS:
        mended = fault.sub(by, mended)
    found = _json(mended)
    return found if found is not None else _literal(text) or []


def records_in(raw: str | None) -> Iterator[dict]:
    """The objects of a raw output, in order."""
    text = _FENCE.sub("", _REASONING.sub("", (raw or "").replace("﻿", ""))).strip()
    if not text:
        return
    if (whole := _json(text)) is not None:
        yield from whole
        return
    between: list[str] = []

    def found() -> Iterator[dict]:
        piece = "\n".join(between)
        between.clear()
        for s, e in outermost(piece):
            yield from _object(piece[s:e])

    for line in text.split("\n"):
        bare = line.strip().rstrip(",")
        alone = _json(bare) if bare[:1] in ("{", "[") else None
        if alone:
            yield from found()
            yield from alone
        else:
            between.append(line)
    yield from found()


@F.pandas_udf(T.ArrayType(T.StringType()))
def each_record(raw: pd.Series) -> pd.Series:
    """The objects of a raw output, each as JSON."""
    return raw.map(lambda x: [json.dumps(r, ensure_ascii=False, default=str) for r in records_in(x)])


@F.pandas_udf(T.StringType())
def all_records(raw: pd.Series) -> pd.Series:
    """The objects of a raw output as one JSON array."""
    return raw.map(lambda x: json.dumps(list(records_in(x)), ensure_ascii=False, default=str))


def record_rows(df: DataFrame, raw: str) -> DataFrame:
    """``df`` with a row for each record of its raw outputs: ``ord`` from 0 in an output, and the record's fields as ``record``; objects without a type are left out, outputs without records give no row.

    Outputs are dealt to tasks first, by all that can be hashed, so that the files of the input, which may be few, do not bound how many are read at once."""
    hashed = [F.col(f"`{x.name}`") for x in df.schema if not re.search("map<|variant", x.dataType.simpleString())]
    found = dealt(df, *hashed, rows=OUTPUTS).select("*", F.posexplode(each_record(raw)).alias("ord", "record"))
    return found.withColumn("record", F.from_json("record", RECORD)).where("record.type is not null")
