"""Line dedup by pairwise alignment of overlapping documents.

Lines (split at newlines, compared without surrounding white space) are hashed. Overlapping documents are found through shared line hashes. A rare line, one that stands
at ``RARE`` places at most, pairs all documents that have it. Commoner lines would pair a group with itself, so each of them, each 2, 4, 8, .. shared
lines in a row and each whole run of shared lines is linked to the earliest document that has it, a star
per run: no line is too common to be followed. (A whole copy is thereby aligned with its original or an equal of it, wherever its single
lines stand first; a passage with the earliest holder of each of its windows. A passage that is pieced together of common lines, no two of which stand together in the partner, may stay.) Each pair is aligned over all its common lines,
which are equal in 128 bits of two hashes,
by patience diff: equal lines at both ends align, then lines that occur once on both sides are anchors, the longest run of anchors in the same order on both sides stays
(found by patience sorting), and the ranges between them are aligned likewise. Aligned blocks of neighbouring lines with ``least_words`` words or more are deleted from the later document.

"Earlier" is by id. A document's own repeated lines stay. Lines of white space never match and part no block; those
within a deleted block go with it. Ties: of pairs with equally rare lines the smaller id is aligned first; which pair deletes a line changes no result. Rows: null text is empty; null ids take no part; rows of one id are the same document (its lines are taken from all of its rows, so texts of
one id should agree); extra columns are kept whatever their names. A document's shared lines are aligned in one task; its text is held by one task at a time.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_names, join_counted, mix, split_by_ids, staged, tasks_of, text_column, tidy

LEAST_WORDS = 5
#: Places of a line up to which it pairs all its documents: a bound of the pairs of one line, not of what is found; commoner lines link to their first.
RARE = 4
EXTRA = ("__n_lines", "__n_gone", "__partners")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos int, at int, h long, g long, words int) of each line that is not blank: its number among these, and among all lines."""
    bare = F.transform(F.split(text_column(docs, text_col), "\n"), lambda x, i: F.struct(i.alias("at"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("line")))
    each = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.posexplode(F.filter(bare, lambda x: x["line"] != "")).alias("pos", "x"))
    return each.select("id", "pos", "x.at", F.xxhash64("x.line").alias("h"), F.xxhash64(F.lit(7), "x.line").alias("g"), F.size(F.split("x.line", r"\s+")).alias("words")).distinct()


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(mine: list[int], theirs: list[int]) -> list[int]:
    """Indices in ``mine`` that a patience diff aligns with ``theirs``; lines of one side only are left out beforehand."""
    out: list[int] = []
    todo = [(0, len(mine), 0, len(theirs))]
    while todo:
        i, j, k, l = todo.pop()
        while i < j and k < l and mine[i] == theirs[k]:
            out.append(i)
            i, k = i + 1, k + 1
        while i < j and k < l and mine[j - 1] == theirs[l - 1]:
            j, l = j - 1, l - 1
            out.append(j)
        if i == j or k == l:
            continue
        here, there = Counter(mine[i:j]), Counter(theirs[k:l])
        at = {theirs[q]: q for q in range(k, l)}
        anchors = [p for p in range(i, j) if here[mine[p]] == 1 and there[mine[p]] == 1]
        picked = [anchors[x] for x in longest_increasing([at[mine[p]] for p in anchors])]
        for p in picked:
            todo.append((i, p, k, at[mine[p]]))
            i, k = p + 1, at[mine[p]] + 1
        out += picked
        if picked:
            todo.append((i, j, k, l))
    return out


def windows(run: np.ndarray) -> np.ndarray:
    """Hashes of the distinct windows of 1, 2, 4, 8, .. lines of a run, and of the whole run."""
    level, size, out = run.view(np.uint64), 1, [run.view(np.uint64)]
    while 2 * size <= len(run):
        level = mix(level[: len(run) - 2 * size + 1] * np.uint64(0xA24BAED4963EE407) + level[size:])
        size *= 2
        out.append(level)
    if size < len(run):  # two windows that overlap, and their distance
        out.append(mix(level[:1] * np.uint64(0x9FB21C651E98DF25) + level[-1:] + np.uint64(len(run) - size)))
    return np.unique(np.concatenate(out)).view(np.int64)


def pairs(shared: DataFrame, tasks: int) -> DataFrame:
    """(id, a): each document with the earliest holders of its runs of shared lines, and with all earlier holders of its rare lines."""

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_id, held_pos, held_h = (np.zeros(0, np.int64) for _ in range(3))
        for b in it:
            ids, pos, h = (np.concatenate([x, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for x, c in zip((held_id, held_pos, held_h), b.columns, strict=True))
            cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(pos) != 1)) + 1
            last = int(cuts[-1]) if len(cuts) else 0  # the last run may go on in the next batch
            held_id, held_pos, held_h = ids[last:], pos[last:], h[last:]
            yield from keys(ids[:last], h[:last], cuts[:-1])
        yield from keys(held_id, held_h, np.zeros(0, np.int64))

    def keys(ids: np.ndarray, h: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(ids):
            found = [windows(x) for x in np.split(h, cuts)]
            who = np.repeat(ids[np.concatenate([[0], cuts])], [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.concatenate(found))], ["id", "key"])

    ordered = shared.select("id", "pos", "h").repartition(tasks, "id").sortWithinPartitions("id", "pos")
    each = staged(ordered.mapInArrow(run, "id long, key long"), "windows")
    first = each.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count(F.lit(1)).alias("n")).where("a < z").select("key", "a", "n")
    stars = join_counted(each, staged(first, "firsts"), ["key"], "n", each.count()).where("id > a").select("id", "a")
    rare = shared.where(F.col("n") <= RARE).select("id", "h", "g").distinct()
    close = rare.join(rare.withColumnRenamed("id", "a"), ["h", "g"]).where("id > a").select("id", "a")
    return stars.union(close).distinct()


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, gone array<int>, partners int): the lines to delete of each document that loses some."""
    each = staged(lines(docs, id_col, text_col), "lines")
    multi = each.groupBy("h", "g").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("h", "g", "n")
    shared = join_counted(each, staged(multi, "common"), ["h", "g"], "n", each.count())
    shared = staged(shared.select("id", "pos", "at", "h", "g", "words", "n"), "shared")
    tasks = tasks_of(shared.count(), 200_000)
    found = staged(pairs(shared, tasks), "pairs")
    held = staged(shared.groupBy("id", "h", "g").agg(F.collect_list(F.struct("pos", "at")).alias("pos"), F.first("words").alias("words"), F.first("n").alias("n")), "held")
    theirs = held.select(F.col("id").alias("a"), "h", "g", F.col("pos.pos").alias("there"))
    both = found.join(held, "id").join(theirs, ["a", "h", "g"]).select("id", "a", "h", F.col("pos.pos").alias("pos"), F.col("pos.at").alias("at"), "there", "words", "n")

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, rows = None, []
        out: list[tuple[int, list[int], int]] = []

        def close() -> None:
            by_a: dict[int, list] = {}
            rare: dict[int, int] = {}
            words: dict[int, int] = {}
            line: dict[int, int] = {}
            for a, h, here, at, there, w, n in rows:
                by_a.setdefault(a, []).append((h, here, there))
                rare[a] = min(rare.get(a, n), n)
                words.update(dict.fromkeys(here, w))
                line.update(zip(here, at, strict=True))
            gone: set[int] = set()
            used = 0
            for a in sorted(by_a, key=lambda a: (rare[a], a)):  # the pair with the rarest shared line first
                mine = sorted((p, h) for h, here, _ in by_a[a] for p in here)
                other = sorted((p, h) for h, _, there in by_a[a] for p in there)
                found = {mine[i][0] for i in align([h for _, h in mine], [h for _, h in other])}
                used += bool(found - gone)
                gone |= found
            block: list[int] = []
            final: list[int] = []
            for p in [*sorted(gone), None]:
                if block and (p is None or p > block[-1] + 1):
                    if sum(words[q] for q in block) >= least_words:
                        final += range(line[block[0]], line[block[-1]] + 1)  # with the blank lines between
                    block = []
                block += [] if p is None else [p]
            if final:
                out.append((doc, final, used))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.int32())], ["id", "gone", "partners"])

        for b in it:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] != doc:
                    if rows:
                        close()
                    if len(out) >= 2000:
                        yield flush()
                    doc, rows = r[0], []
                rows.append(r[1:])
        if rows:
            close()
        if out:
            yield flush()

    ordered = both.repartition(tasks, "id").sortWithinPartitions("id")
    return ordered.mapInArrow(run, "id long, gone array<int>, partners int")


def rewritten(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, extra: tuple[str, str, str] = EXTRA) -> DataFrame:
    """``docs`` with the text cut, and the numbers of lines, of lines gone and of partners under the names ``extra``."""
    found = staged(deletions(docs, id_col, text_col, least_words), "deletions")
    names = docs.columns
    at = names.index(text_col)
    plain = docs.select(*(F.col(c).alias(f"__c{i}") for i, c in enumerate(names)), F.col(id_col).cast("long").alias("__id"))
    may, rest = split_by_ids(plain, F.col("__id"), found.select("id"))
    found = found.withColumnRenamed("id", "__id")
    touched = may.join(found.hint("merge"), "__id", "left")  # the same plan at every size: deletions grow with the data
    rest = rest.withColumns({c: F.lit(None).cast(found.schema[c].dataType) for c in ("gone", "partners")})  # texts that lose nothing stay where they are
    both = touched.unionByName(rest).drop("__id")
    schema = T.StructType([*(T.StructField(f"__c{i}", docs.schema[c].dataType if c != text_col else T.StringType()) for i, c in enumerate(names)), *(T.StructField(c, T.LongType()) for c in EXTRA)])

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts, n_lines, n_gone = [], [], []
            for t, g in zip(b.column(at), b.column("gone"), strict=True):
                text = t.as_py()
                parts = (text or "").split("\n")
                n_lines.append(len(parts))
                gone = set(g.as_py() or ())
                n_gone.append(len(gone))
                texts.append("\n".join(x for i, x in enumerate(parts) if i not in gone) if gone else text)
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64()), b.column("partners").fill_null(0).cast(pa.int64())], schema.names)

    return both.mapInArrow(run, schema).select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(names)), *(F.col(c).alias(x) for c, x in zip(EXTRA, extra, strict=True)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, n_chars_col: str | None = None) -> DataFrame:
    """The documents with aligned common blocks deleted; those left without any word by that go. ``n_chars_col`` is set anew where lines went."""
    extra = fresh_names(docs, 3)
    gone = F.col(extra[1])
    out = rewritten(docs, id_col, text_col, least_words, extra)
    if n_chars_col and n_chars_col in docs.columns:
        out = out.withColumn(n_chars_col, F.when(gone > 0, F.length(text_col).cast(docs.schema[n_chars_col].dataType)).otherwise(F.col(n_chars_col)))
    return out.where((gone == 0) | F.col(text_col).rlike(r"\S")).select(*(F.col(f"`{c}`") for c in docs.columns))
