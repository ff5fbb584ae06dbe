"""Turtle whose files are cut: many tasks read one file, and each statement is read on its own.

Lines come from Spark's text source, which cuts files into blocks. Whether a block begins within a long string, and at which statement of its file, depends on all before it; so a first pass runs every block from each of the three states
in which a line may begin, and the states and numbers of statement ends are composed over the blocks (a row for each reaches the driver). A second pass cuts every block into statements; those that cross blocks, two pieces of each block
at most, are put together by a grouping on file and number. Directives are gathered with their numbers, so a statement is read with the prefixes that stand before it in its file.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import settled
from . import rdf

#: States in which a line may begin: outside strings, in a long string of either quote.
OUTSIDE, LONG = 0, {1: '"""', 2: "'''"}
#: Directives that a folder may have.
MOST_DIRECTIVES = 100_000
_MARKS = re.compile(r"""(?P<long>\"{3}|'{3})|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|<[^<>"{}|^`\\\s]*>|\#.*|\\.|(?P<end>\.(?=[\s#]|\Z)|(?<=[>"'\])])\.)""")
_CLOSE = {1: re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""'), 2: re.compile(r"(?:[^'\\]|\\.|'(?!''))*'''")}
_DIRECTIVE = re.compile(r"""(?:\s|\#[^\n]*\n)*(?:(?:@prefix|(?i:prefix))\s+(?P<name>[\w.-]*):|@base|(?i:base)(?=[\s<]))\s*<(?P<iri>[^<>"{}|^`\\\s]*)>\s*\.?""")


def scan_line(line: str, state: int) -> tuple[int, list[int]]:
    """The state after a line that begins in ``state``, and the places behind the statement ends in it."""
    ends, at = [], 0
    while True:
        if state != OUTSIDE:
            if not (m := _CLOSE[state].match(line, at)):
                return state, ends
            state, at = OUTSIDE, m.end()
        m = _MARKS.search(line, at)
        if not m:
            return OUTSIDE, ends
        at = m.end()
        if m["long"]:
            state = 1 if m["long"] == LONG[1] else 2
        elif m["end"]:
            ends.append(at)


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """((file, start), lines) of each block of a task, in order."""
    rows = ((f, s, v) for b in it for f, s, v in zip(*(c.to_pylist() for c in b.columns), strict=True))
    row = next(rows, None)

    def lines(key: tuple[str, int]) -> Iterator[str]:
        nonlocal row
        while row is not None and row[:2] == key:
            value = row[2] or ""
            row = next(rows, None)
            yield value

    while row is not None:
        yield row[:2], lines(row[:2])


def _summaries(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, start), lines in _blocks(it):
        now, count = [OUTSIDE, *LONG], [0, 0, 0]
        for line in lines:
            after = {state: scan_line(line, state) for state in set(now)}
            count = [n + len(after[s][1]) for n, s in zip(count, now, strict=True)]
            now = [after[s][0] for s in now]
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start], pa.int64()), pa.array([now], pa.list_(pa.int32())), pa.array([count], pa.list_(pa.int64()))], ["file", "start", "states", "ends"])


def statements(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, body): the statements of Turtle files, numbered from 0 in each, directives among them; blank ones and comments after the last end are left out."""
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.regexp_replace("value", "^﻿", "").alias("value"))
    begins: dict[tuple[str, int], tuple[int, int]] = {}
    file, state, number = None, OUTSIDE, 0
    for r in lines.mapInArrow(_summaries, "file string, start long, states array<int>, ends array<long>").orderBy("file", "start").collect():  # a row for each block
        if r["file"] != file:
            file, state, number = r["file"], OUTSIDE, 0
        begins[file, r["start"]] = (state, number)
        state, number = r["states"][state], number + r["ends"][state]
    shared = spark.sparkContext.broadcast(begins)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "number", "start", "whole", "body"]
        for (file, start), lines in _blocks(it):
            state, number = shared.value[file, start]
            out, held, whole = [], [], start == 0

            def close(complete: bool) -> None:
                body = "\n".join(held)  # noqa: B023
                if body.strip():
                    out.append((file, number, start, complete, body))  # noqa: B023
                held.clear()  # noqa: B023

            for line in lines:
                state, ends = scan_line(line, state)
                at = 0
                for end in ends:
                    held.append(line[at:end])
                    close(whole)
                    number, whole, at = number + 1, True, end
                held.append(line[at:])
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names)
                    out = []
            close(False)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names)

    pieces = settled(lines.mapInArrow(cut, "file string, number long, start long, whole boolean, body string"))
    crossing = pieces.where("NOT whole").groupBy("file", "number").agg(F.array_join(F.sort_array(F.collect_list(F.struct("start", "body")))["body"], "\n").alias("body"))
    every = pieces.where("whole").select("file", "number", "body").unionAll(crossing)
    return every.where(F.regexp_replace("body", r"(?m)^\s*#.*$", "").rlike(r"\S"))


def _environments(spark: SparkSession, found: DataFrame) -> dict[str, tuple[list[int], list[tuple[dict[str, str], str]]]]:
    """Of each file the numbers behind which prefixes or base change, and what holds from there on."""
    head = found.where(F.col("body").rlike(r"(?is)^(?:\s|#[^\n]*\n)*(?:@?prefix|@?base)\b")).orderBy("file", "number").limit(MOST_DIRECTIVES + 1).collect()
    if len(head) > MOST_DIRECTIVES:
        raise ValueError(f"more than {MOST_DIRECTIVES} directives")
    out: dict[str, tuple[list[int], list]] = {}
    for r in head:
        numbers, worlds = out.setdefault(r["file"], ([], []))
        prefixes, base = (dict(worlds[-1][0]), worlds[-1][1]) if worlds else ({}, "")
        at = 0
        while m := _DIRECTIVE.match(r["body"], at):
            iri = m["iri"] if not base or re.match(r"[A-Za-z][\w+.-]*:", m["iri"]) else base + m["iri"]
            if m["name"] is not None:
                prefixes[m["name"]] = iri
            else:
                base = iri
            at = m.end()
        numbers.append(r["number"])
        worlds.append((prefixes, base))
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Distinct triples of Turtle files, in the columns of :func:`readers.parse_triples`. Blank nodes are named by file and statement, labelled ones by file; a statement that is not Turtle is an error that names it."""
    found = statements(spark, path)
    known = spark.sparkContext.broadcast(_environments(spark, found))

    def parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for file, mark, number, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                numbers, worlds = known.value.get(file, ([], []))
                k = bisect_left(numbers, number) - 1
                prefixes, base = worlds[k] if k >= 0 else ({}, "")
                try:
                    triples = rdf.turtle(body, prefixes, base, f"t{number}x")
                except ValueError as e:
                    raise ValueError(f"{file}, statement {number + 1}: {e}") from e
                own = lambda x, kind: f"_:f{mark & 0xFFFFFFFFFFFFFFFF:x}{x[2:]}" if kind == "bnode" else x  # noqa: B023, E731
                out += [(own(s, sk), p, own(o, ok), ok, lang, dtype, sk, re.search(r"[^#/:]*\Z", p)[0]) for s, sk, p, o, ok, lang, dtype in triples]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], [x.split()[0] for x in rdf.SCHEMA.split(", ")])

    return found.select("file", F.xxhash64("file").alias("mark"), "number", "body").mapInArrow(parse, rdf.SCHEMA).distinct()
