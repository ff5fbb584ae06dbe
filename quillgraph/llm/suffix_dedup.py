"""Exact duplicate strings across a corpus: removes each byte covered by a ``length``-byte string that also starts earlier.

Method: hash-compared suffix sort. Suffixes are compared through prefix polynomial hashes: a binary search over equal hashes gives their
common extension in a logarithmic number of steps, and a bottom-up mergesort orders suffixes by it. Neighbours in that order whose
common extension reaches ``length`` hold the same string, which a comparison of the bytes verifies; the first in the corpus stays.

A suffix sort of a whole corpus in one place does not scale, so suffixes are dealt to buckets first:

1. Anchors. In every ``length``-byte window the k-gram with the smallest hash is its anchor (the leftmost of equal ones); equal windows have equal anchors.
   Consecutive windows with one anchor form an interval, whose bytes form its string. A chunk's intervals with an equal string
   earlier in the chunk are duplicates at once. Of the others, hashes, document, place and length are dealt by the anchor's hash: about one
   interval in 30 bytes, 21 bytes each.
2. In a bucket, intervals of equal strings (96 bits of two polynomial hashes, and the anchor's) keep their first as it is. Intervals that share an anchor but not the string
   may still share some windows; only these (the surroundings of edits) go on, as bytes.
3. Their suffixes are sorted as above, in the buckets of their anchors, by common prefix.
4. Every interval that equal hashes called a duplicate is compared, byte by byte, with the occurrence before it: runs of such intervals send their bytes to the document of that occurrence (so a string of any number of occurrences
   is sent once for each, to as many documents). Bytes that differ under equal hashes end the run with an error, as no result could be trusted; another ``BASE2`` then helps.

Order: by id, then start. Null text is empty; null ids come before all others and are one document only if their texts agree; repeated rows (same id, same text) are one
document: none is a copy of the other. Documents of one id but different text are ordered by start only. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE_INVERSE, binary_parts, long_hash, mix, powers, prefix_hash, release, slices, staged, tasks_of, text_column, tidy

LENGTH, GRAM = 100, 32
#: Intervals gathered before they are dealt; bytes of text and intervals that a task takes in the later steps.
FLUSH, TASK_BYTES, TASK_INTERVALS = 150_000, 24 << 20, 250_000
#: A text longer than this is cut into pieces for step 1. Its intervals at the cuts are shorter than others of their anchor, which step 3 settles.
LONG_BYTES = 1 << 19
#: Suffixes sorted at once in step 3, but for those of one anchor.
SLOT_SUFFIXES = 100_000
#: Runs from this width on are merged by binary search for each suffix's place, shorter ones step by step.
WIDE_MERGE = 64
BASE2 = 0xC2B2AE3D27D4EB4F
BASE2_INVERSE = pow(BASE2, -1, 1 << 64)
NULL_ID = -(1 << 63)
INTERVALS = np.dtype([("key", "<u4"), ("t", "<u8"), ("t2", "<u4"), ("at", "<u4"), ("n", "u1")])
REQUESTS = np.dtype([("doc", "<i8"), ("print", "<u4"), ("at", "<u4"), ("n", "<u4"), ("key", "<u8")])
#: Duplicates by hash, with the occurrence before.
LATER = np.dtype([("doc", "<i8"), ("print", "<u4"), ("at", "<u4"), ("n", "<u4"), ("src", "<i8"), ("sprint", "<u4"), ("sat", "<u4")])
#: Kinds of blobs: requests to remove, surroundings, bytes to compare, duplicates by hash; then texts.
REMOVE, OPEN, COMPARE, SAME, TEXT = 0, 1, 2, 3, 9


def _second_prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), BASE2), out=out[1:])
    return out


def intervals(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start in it, windows, anchor hash, string hash, second string hash) of each interval of the concatenated texts."""
    base = int(offsets[0])
    data, bounds = data[base : int(offsets[-1])], offsets - base
    n, w = len(data), length - gram + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if n < length:
        return none
    p = prefix_hash(data)
    inverse = powers(n + 1, BASE_INVERSE)
    g = mix((p[gram:] - p[:-gram]) * inverse[: n - gram + 1])
    bits = max(1, (n - 1).bit_length())
    packed = ((g >> np.uint64(bits)) << np.uint64(bits)) | np.arange(len(g), dtype=np.uint64)
    rows = -(-len(packed) // w)
    blocks = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(packed)] = packed
    ahead = np.minimum.accumulate(blocks.reshape(rows, w), axis=1).ravel()
    behind = np.minimum.accumulate(blocks.reshape(rows, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - length + 1], ahead[w - 1 : n - length + w])  # of w grams from each window's start
    anchor = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
    sizes = np.diff(bounds)
    room = np.repeat(bounds[1:], sizes) - np.arange(n)
    at = np.flatnonzero(room[: n - length + 1] >= length)
    if not len(at):
        return none
    a = anchor[at]
    new = np.append(True, (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1))
    first, last = at[new], at[np.append(new[1:], True)]
    end = last + length
    text = np.searchsorted(bounds, first, side="right") - 1
    t = mix((p[end] - p[first]) * inverse[first] + (end - first).astype(np.uint64))
    p2 = _second_prefix(data)
    t2 = mix((p2[end] - p2[first]) * powers(n + 1, BASE2_INVERSE)[first])
    return text, first - bounds[text], last - first + 1, g[a[new]], t, t2


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal rows in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _firsts(group: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by group, document and place: whether a row stands later than its group's first, and the row of the place before it."""
    head = np.append(True, group[1:] != group[:-1])
    start = np.flatnonzero(head)[np.cumsum(head) - 1]
    place = head | np.append(True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))
    return (doc != doc[start]) | (at != at[start]), np.flatnonzero(place)[np.cumsum(place) - 1] - 1


def _same(doc: np.ndarray, prints: np.ndarray, at: np.ndarray, n: np.ndarray, later: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The rows ``later``, each with the one ``before`` it; runs of neighbours with neighbouring sources put together."""
    out = np.empty(len(later), LATER)
    for name, c, rows in (("doc", doc, later), ("print", prints, later), ("at", at, later), ("n", n, later), ("src", doc, before), ("sprint", prints, before), ("sat", at, before)):
        out[name] = c[rows]
    return _merged_same(out)


def _merged_same(found: np.ndarray) -> np.ndarray:
    if not len(found):
        return found
    found = found[np.lexsort((found["at"], found["print"], found["doc"]))]
    at, end = found["at"].astype(np.int64), found["at"].astype(np.int64) + found["n"]
    shift = found["sat"].astype(np.int64) - at
    new = np.append(True, at[1:] > end[:-1])
    for c in (found["doc"], found["print"], found["src"], found["sprint"], shift):
        new[1:] |= c[1:] != c[:-1]
    heads = np.flatnonzero(new)
    out = found[heads].copy()
    out["n"] = np.maximum.reduceat(end, heads) - at[heads]
    return out


def _pack(parts: list[np.ndarray], dest: np.ndarray, extra: list[bytes] | None = None) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(dest, kind="stable")
    rows, dest = parts[0][order], dest[order]
    cuts = [0, *(np.flatnonzero(np.diff(dest)) + 1), len(dest)]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        if e > s:
            yield int(dest[s]), rows[s:e].tobytes()


def _requests(doc: np.ndarray, prints: np.ndarray, at: np.ndarray, n: np.ndarray, key: np.ndarray | int) -> np.ndarray:
    out = np.empty(len(doc), REQUESTS)
    out["doc"], out["print"], out["at"], out["n"], out["key"] = doc, prints, at, n, key
    return out


def _coalesced(found: np.ndarray) -> np.ndarray:
    """Requests without key with neighbouring and overlapping runs of one document put together."""
    if not len(found):
        return found
    found = found[np.lexsort((found["at"], found["print"], found["doc"]))]
    at, end = found["at"].astype(np.int64), found["at"].astype(np.int64) + found["n"]
    new = np.append(True, (found["doc"][1:] != found["doc"][:-1]) | (found["print"][1:] != found["print"][:-1]) | (at[1:] > end[:-1]))
    heads = np.flatnonzero(new)
    out = found[heads].copy()
    out["n"] = np.maximum.reduceat(end, heads) - at[heads]
    out["key"] = 0
    return out


def _merged(order: np.ndarray, start: np.ndarray, middle: np.ndarray, stop: np.ndarray, before: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``order`` with its sorted runs [start, middle) and [middle, stop) merged: each suffix moves by the number of those of the other run before it."""
    out, middle = order.copy(), np.minimum(middle, stop)
    for (a, z), (b, y), ties in (((start, middle), (middle, stop), False), ((middle, stop), (start, middle), True)):
        n = z - a
        mine = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        low, high = np.repeat(b, n), np.repeat(y, n)
        live = np.flatnonzero(low < high)
        while len(live):
            half = (low[live] + high[live]) // 2
            i, j = order[mine[live]], order[half]
            past = before(j, i) if ties else ~before(i, j)  # equals of the first run stand before those of the second
            low[live] = np.where(past, half + 1, low[live])
            high[live] = np.where(past, high[live], half)
            live = live[low[live] < high[live]]
        first, other = np.repeat(start, n), np.repeat(b, n)
        out[first + (mine - np.repeat(a, n)) + (low - other)] = order[mine]
    return out


def suffix_order(data: np.ndarray, at: np.ndarray, group: np.ndarray, rank: np.ndarray, length: int, prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mergesort of the suffixes ``at`` within each group (given sorted), to ``length`` bytes, ties by ``rank``.

    Returns the order and the common extension of each suffix with the one before it in its group (0 for the first).
    All groups' merges of one width run in step, so the arrays stay long while the runs are short."""
    p = prefix_hash(data) if prefix is None else prefix
    inverse = powers(len(p), BASE_INVERSE)

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        done = np.zeros(len(a), np.int64)
        step = 1 << (length.bit_length() - 1)
        while step:
            to = done + step
            fits = np.flatnonzero(to <= length)
            x, y, k = a[fits] + done[fits], b[fits] + done[fits], step
            same = (p[x + k] - p[x]) * inverse[x] == (p[y + k] - p[y]) * inverse[y]
            done[fits[same]] += step
            step >>= 1
        return done

    def before(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i stands before or with suffix j."""
        x, y = at[i], at[j]
        c = common(x, y)
        inner = np.minimum(c, length - 1)
        return np.where(c >= length, rank[i] <= rank[j], data[x + inner] < data[y + inner])

    order = np.arange(len(at))
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(at))
    width = 1
    while len(heads) and width < (ends - heads).max():
        pairs = -(-(ends - heads) // (2 * width))
        start = np.repeat(heads, pairs) + (np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)) * 2 * width
        stop = np.minimum(start + 2 * width, np.repeat(ends, pairs))
        middle = start + width
        left, right, out = start.copy(), middle.copy(), start.copy()
        if width >= WIDE_MERGE:
            order = _merged(order, start, middle, stop, before)
            width *= 2
            continue
        merged = order.copy()
        live = np.flatnonzero(middle < stop)
        while len(live):
            i, j = order[left[live]], order[right[live]]
            first = before(i, j)
            merged[out[live]] = np.where(first, i, j)
            out[live] += 1
            left[live] += first
            right[live] += ~first
            over = (left[live] >= middle[live]) | (right[live] >= stop[live])
            for k in live[over]:
                rest = order[left[k] : middle[k]] if left[k] < middle[k] else order[right[k] : stop[k]]
                merged[out[k] : out[k] + len(rest)] = rest
            live = live[~over]
        order = merged
        width *= 2
    lcp = np.zeros(len(at), np.int64)
    inside = np.flatnonzero(np.append(False, group[1:] == group[:-1])) if len(at) else np.zeros(0, np.int64)
    if len(inside):
        lcp[inside] = common(at[order[inside - 1]], at[order[inside]])
    return order, lcp


def duplicate_starts(data: np.ndarray, at: np.ndarray, key: np.ndarray, doc: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at each of ``at`` also stand at an earlier (doc, place) of the same key."""
    p, inverse = prefix_hash(data), powers(len(data) + 1, BASE_INVERSE)
    half = length // 2
    head = mix((p[at + half] - p[at]) * inverse[at] + key)
    rank = np.empty(len(at), np.int64)
    by_place = np.lexsort((place, doc))
    same = np.append(False, (doc[by_place][1:] == doc[by_place][:-1]) & (place[by_place][1:] == place[by_place][:-1]))
    rank[by_place] = np.cumsum(~same)
    order = np.lexsort((rank, head))
    group = _runs(head[order])
    size = np.bincount(group)
    later = np.zeros(len(at), bool)
    order = order[size[group] > 1]
    if not len(order):
        return later
    group = _runs(head[order])
    sorted_, lcp = suffix_order(data, at[order], group, rank[order], length, p)
    here = order[sorted_]
    joined = np.flatnonzero(lcp >= length)
    for s in range(0, len(joined), 10_000):  # verify: the bytes themselves
        part = joined[s : s + 10_000]
        reach = np.arange(length)
        equal = (data[at[here[part]][:, None] + reach] == data[at[here[part - 1]][:, None] + reach]).all(1)
        lcp[part[~equal]] = 0
    heads = np.flatnonzero(lcp < length)
    start = heads[np.cumsum(lcp < length) - 1]
    later[here] |= rank[here] != rank[here[start]]
    return later


def _prints(texts: pa.Array) -> np.ndarray:
    return np.fromiter((zlib.crc32(t.as_buffer() or b"") for t in texts), np.uint32, len(texts))


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, text binary, spans array<struct<start,stop>>): per row of ``docs`` the maximal removed runs, in bytes."""
    given = docs.select(F.col(id_col).cast("long").alias("id"), text_column(docs, text_col).cast("binary").alias("t"))
    size = given.agg(F.sum(F.octet_length("t")).alias("s")).first()["s"] or 0
    settlers, carriers = tasks_of(size / 30, TASK_INTERVALS), tasks_of(size, TASK_BYTES)
    buckets, places = 4 * settlers, 8 * carriers  # several to a task, so that tasks are alike though Spark hashes the numbers again
    blob = "dest long, kind int, id long, t binary"

    def place_of(doc: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return (long_hash(np.where(doc == NULL_ID, prints.astype(np.int64), doc)).view(np.int64) % places).astype(np.int64)

    def rows(dest: list[int], kind: int, data: list[bytes]) -> pa.RecordBatch:
        n = len(dest)
        return pa.RecordBatch.from_arrays([pa.array(dest, pa.int64()), pa.array([kind] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(data, pa.binary())], ["dest", "kind", "id", "t"])

    @tidy
    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, prints, at, n, key, t, t2 = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((at, doc, t2, t))
            later = np.zeros(len(doc), bool)
            flag, before = _firsts(_runs(t[order], t2[order]), doc[order], at[order])
            later[order] = flag
            if flag.any():
                found = _same(doc, prints, at, n, order[flag], order[before[flag]])
                out = list(_pack([found], place_of(found["doc"], found["print"])))
                yield rows([-1 - d for d, _ in out], SAME, [x for _, x in out])
            stay = np.flatnonzero(~later)
            stay = stay[np.lexsort((at[stay], prints[stay], doc[stay], (key[stay] >> np.uint64(32)) % np.uint64(buckets)))]
            dest = ((key[stay] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            body = np.empty(len(stay), INTERVALS)
            body["key"], body["t"], body["t2"], body["at"], body["n"] = key[stay] & np.uint64(0xFFFFFFFF), t[stay], t2[stay] >> np.uint64(32), at[stay], n[stay]
            d, f = doc[stay], prints[stay]
            cuts = [0, *(np.flatnonzero(np.diff(dest)) + 1), len(dest)]
            where, data = [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e == s:
                    continue
                run = _runs(d[s:e], f[s:e])
                head = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
                meta = np.array([e - s, len(head)], "<i8").tobytes() + d[s:e][head].astype("<i8").tobytes() + f[s:e][head].astype("<u4").tobytes() + np.diff(np.append(head, e - s)).astype("<i4").tobytes()
                where.append(int(dest[s]))
                data.append(meta + b"".join(body[name][s:e].tobytes() for name in INTERVALS.names))
            yield rows(where, 0, data)

        for b in it:
            data, offsets = binary_parts(b.column(1))
            ids, prints = _ids(b.column(0)), _prints(b.column(1))
            for s, e in slices(np.diff(offsets), LONG_BYTES):
                first, last = int(offsets[s]), int(offsets[e])
                for o in range(first, max(first + 1, last), LONG_BYTES) if e == s + 1 else (first,):  # a long text in pieces that overlap by length - 1
                    cut = offsets[s : e + 1] if e > s + 1 else np.array([o, min(last, o + LONG_BYTES + length - 1)])
                    text, at, n, key, t, t2 = intervals(data, cut, length, gram)
                    if len(text):
                        held.append((ids[s:e][text], prints[s:e][text], at + (o - first), n, key, t, t2))
                        count += len(text)
                    if count > FLUSH:
                        yield from flush()
                        held, count = [], 0
                        release()
        if held:
            yield from flush()

    def unpack(x: bytes) -> tuple[np.ndarray, ...]:
        n, m = np.frombuffer(x, "<i8", 2)
        at = 16
        cols = []
        for kind, k in (("<i8", m), ("<u4", m), ("<i4", m), *((INTERVALS[c], n) for c in INTERVALS.names)):
            cols.append(np.frombuffer(x, kind, k, at))
            at += cols[-1].nbytes
        return np.repeat(cols[0], cols[2]), np.repeat(cols[1], cols[2]), *cols[3:]

    @tidy
    def settle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in it:
            for dest, x in zip(b.column(0).to_pylist(), b.column(3), strict=True):
                if dest < 0:  # settled within its chunk
                    yield rows([-1 - dest], SAME, [x.as_py()])
                else:
                    held.setdefault(dest, []).append(unpack(x.as_py()))
        for bucket in sorted(held):
            release()
            doc, prints, key, t, t2, at, n = (np.concatenate(c) for c in zip(*held.pop(bucket), strict=True))
            order = np.lexsort((at, doc, t2, t, key))
            doc, prints, key, t, t2, at, n = (c[order] for c in (doc, prints, key, t, t2, at, n))
            group = _runs(key, t, t2)
            later, before = _firsts(group, doc, at)
            anchor = _runs(key)
            head = np.append(True, group[1:] != group[:-1])
            strings = np.bincount(anchor, head)
            open_ = ~later & (strings[anchor] > 1)
            if open_.any():
                wide = (key[open_].astype(np.uint64) << np.uint64(1)) * np.uint64(buckets) + np.uint64(2 * bucket + 1)
                found = _requests(doc[open_], prints[open_], at[open_], n[open_], wide)
                out = list(_pack([found], place_of(found["doc"], found["print"])))
                yield rows([d for d, _ in out], OPEN, [x for _, x in out])
            if later.any():
                found = _same(doc, prints, at, n, np.flatnonzero(later), before[later])
                out = list(_pack([found], place_of(found["doc"], found["print"])))
                yield rows([d for d, _ in out], SAME, [x for _, x in out])

    def beside(blobs: DataFrame) -> DataFrame:
        """The blobs of requests beside the documents they are about: a place's blobs come first."""
        place = F.pmod(F.xxhash64(F.coalesce(F.col("id"), F.crc32("t"))), F.lit(places))
        texts = given.select(place.alias("dest"), F.lit(TEXT).alias("kind"), "id", "t")
        return blobs.unionAll(texts).repartition(carriers, "dest").sortWithinPartitions("dest", "kind")

    def with_requests(it: Iterator[pa.RecordBatch], kinds: dict[int, np.dtype]) -> Iterator[tuple[pa.RecordBatch, int, dict[int, np.ndarray], list[tuple[np.ndarray, bytes]]]]:
        """(batch, row, requests of the document by kind, bytes to compare of its place) for each text."""
        now, held, tables, owners, bodies = None, {}, None, {}, []
        for b in it:
            dests, marks = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, (dest, mark) in enumerate(zip(dests, marks, strict=True)):
                if dest != now:
                    now, held, tables, bodies = dest, {k: [] for k in kinds}, None, []
                if mark == COMPARE:
                    x = b.column(3)[i].as_py()
                    n = int(np.frombuffer(x, "<i8", 1)[0])
                    meta = np.frombuffer(x, LATER, n, 8)
                    size = meta["n"].astype(np.int64) + length - 1
                    bodies.append((meta, 8 + meta.nbytes + np.cumsum(size) - size, x))
                    continue
                if mark != TEXT:
                    held[mark].append(np.frombuffer(b.column(3)[i].as_py(), kinds[mark]))
                    continue
                if tables is None:
                    tables = {}
                    for k, kind in kinds.items():
                        table = np.concatenate(held[k]) if held[k] else np.zeros(0, kind)
                        tables[k] = table[np.lexsort((table["at"], table["doc"]))]
                    held, owners = {k: [] for k in kinds}, {k: t["doc"].copy() for k, t in tables.items()}
                    sent = np.concatenate([m for m, _, _ in bodies]) if bodies else np.zeros(0, LATER)
                    by_source = np.argsort(sent["src"], kind="stable")
                    sent, sources = sent[by_source], sent["src"][by_source]
                    starts = np.concatenate([a for _, a, _ in bodies])[by_source] if bodies else np.zeros(0, np.int64)
                    blobs = np.repeat(np.arange(len(bodies)), [len(m) for m, _, _ in bodies])[by_source] if bodies else np.zeros(0, np.int64)
                doc = b.column(2)[i].as_py()
                doc = NULL_ID if doc is None else doc
                mine, near, own = {}, [], None
                for k, table in tables.items():
                    s, e = np.searchsorted(owners[k], doc, "left"), np.searchsorted(owners[k], doc, "right")
                    mine[k] = table[s:e]
                    if e > s:
                        own = zlib.crc32(b.column(3)[i].as_buffer() or b"") if own is None else own
                        mine[k] = mine[k][mine[k]["print"] == own]
                s, e = np.searchsorted(sources, doc, "left"), np.searchsorted(sources, doc, "right")
                if e > s:
                    own = zlib.crc32(b.column(3)[i].as_buffer() or b"") if own is None else own
                    near = [(sent[j], bodies[blobs[j]][2][starts[j] : starts[j] + int(sent["n"][j]) + length - 1]) for j in range(s, e) if sent["sprint"][j] == own]
                yield b, i, mine, near

    def packed(dest: np.ndarray, meta: np.ndarray, texts: list[bytes], kind: int) -> pa.RecordBatch:
        """Blobs of some rows and their bytes, one for each destination."""
        order = np.argsort(dest, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(dest[order])) + 1), len(dest)]
        where, data = [], []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            mine = order[s:e]
            where.append(int(dest[mine[0]]))
            data.append(np.array([len(mine)], "<i8").tobytes() + meta[mine].tobytes() + b"".join(texts[k] for k in mine))
        return rows(where, kind, data)

    @tidy
    def surroundings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of open intervals, for sorting; of duplicates by hash, for comparing; and what to remove if they are equal."""
        metas: dict[int, list[np.ndarray]] = {OPEN: [], SAME: []}
        texts: dict[int, list[bytes]] = {OPEN: [], SAME: []}
        size_ = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if metas[OPEN]:
                meta = np.concatenate(metas[OPEN])
                yield packed((mix(meta["key"]) % np.uint64(fine)).astype(np.int64), meta, texts[OPEN], OPEN)
            if metas[SAME]:
                meta = np.concatenate(metas[SAME])
                yield packed(place_of(meta["src"], meta["sprint"]), meta, texts[SAME], COMPARE)
                found = _coalesced(_requests(meta["doc"], meta["print"], meta["at"], meta["n"], 0))
                out = list(_pack([found], place_of(found["doc"], found["print"])))
                yield rows([d for d, _ in out], REMOVE, [x for _, x in out])
            for k in (OPEN, SAME):
                metas[k], texts[k] = [], []

        for b, i, by_kind, _ in with_requests(it, {OPEN: REQUESTS, SAME: LATER}):
            by_kind[SAME] = _merged_same(by_kind[SAME])
            if not any(map(len, by_kind.values())):
                continue
            text = b.column(3)[i].as_py()
            for k, mine in by_kind.items():
                if len(mine):
                    metas[k].append(mine)
                    cut = [text[a : a + n + length - 1] for a, n in zip(mine["at"].tolist(), mine["n"].tolist(), strict=True)]
                    texts[k] += cut
                    size_ += sum(map(len, cut))
            if size_ > 4 << 20:
                yield from flush()
                size_ = 0
        yield from flush()

    @tidy
    def sort(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in it:
            for dest, x in zip(b.column(0).to_pylist(), b.column(3), strict=True):
                held.setdefault(dest, []).append(x.as_py())
        for dest in sorted(held):
            metas, bodies = [], []
            for x in held.pop(dest):
                n = int(np.frombuffer(x, "<i8", 1)[0])
                metas.append(np.frombuffer(x, REQUESTS, n, 8))
                bodies.append(np.frombuffer(x, np.uint8, -1, 8 + metas[-1].nbytes))
            meta, body = np.concatenate(metas), np.concatenate(bodies)
            starts = np.cumsum(meta["n"].astype(np.int64) + length - 1) - (meta["n"] + length - 1)
            slot = (mix(meta["key"] + np.uint64(77)) % np.uint64(max(1, -(-int(meta["n"].sum()) // SLOT_SUFFIXES)))).astype(np.int64)
            for k in np.unique(slot):  # some anchors at a time: memory follows the slot
                mine = np.flatnonzero(slot == k)
                n = meta["n"][mine].astype(np.int64)
                wide = n + length - 1
                data = body[np.repeat(starts[mine] - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(np.cumsum(wide) - wide, n) + inner
                doc, prints = np.repeat(meta["doc"][mine], n), np.repeat(meta["print"][mine], n)
                place = np.repeat(meta["at"][mine].astype(np.int64), n) + inner
                later = duplicate_starts(data, at, np.repeat(meta["key"][mine], n), doc, place, length)
                if later.any():
                    found = _coalesced(_requests(doc[later], prints[later], place[later], 1, 0))
                    out = list(_pack([found], place_of(found["doc"], found["print"])))
                    yield rows([d for d, _ in out], REMOVE, [x for _, x in out])

    @tidy
    def cover(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        ids, texts, spans, size_ = [], [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()), pa.array(spans, kind)], ["id", "text", "spans"])

        for b, i, by_kind, near in with_requests(it, {REMOVE: REQUESTS}):
            ids.append(b.column(2)[i].as_py())
            texts.append(b.column(3)[i].as_py())
            size_ += len(texts[-1])
            mine = by_kind[REMOVE]
            for row, x in near:
                if texts[-1][int(row["sat"]) : int(row["sat"]) + len(x)] != x:
                    raise RuntimeError(f"equal hashes of different bytes in documents {row['doc']} and {row['src']}")
            if len(mine):
                mine = _coalesced(mine)
                s, e = mine["at"].astype(np.int64), mine["at"].astype(np.int64) + mine["n"] + length - 1
                new = np.append(True, s[1:] > e[:-1])
                heads = np.flatnonzero(new)
                stop = np.maximum.reduceat(e, heads)
                spans.append([{"start": x, "stop": y} for x, y in zip(s[heads].tolist(), stop.tolist(), strict=True)])
            else:
                spans.append([])
            if size_ > 4 << 20:
                yield batch()
                ids, texts, spans, size_ = [], [], [], 0
        if ids:
            yield batch()

    fine = 4 * buckets
    dealt = given.mapInArrow(deal, blob)
    settled = staged(dealt.repartition(settlers, "dest").mapInArrow(settle, blob), "settled")
    close = staged(beside(settled).mapInArrow(surroundings, blob), "surroundings")
    sorted_ = staged(close.where(F.col("kind") == OPEN).repartition(4 * settlers, "dest").mapInArrow(sort, blob), "sorted")
    return beside(close.where(F.col("kind") != OPEN).unionAll(sorted_)).mapInArrow(cover, "id long, text binary, spans array<struct<start:bigint,stop:bigint>>")


def digests(found: DataFrame) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of the rows of :func:`removals`."""

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for t, s in zip(b.column(1), b.column(2), strict=True):
                text, at, kept = t.as_py(), 0, hashlib.sha256()
                spans = s.as_py()
                for x in spans:
                    kept.update(text[at : x["start"]])
                    at = x["stop"]
                kept.update(text[at:])
                out.append((len(text), sum(x["stop"] - x["start"] for x in spans), len(spans), kept.hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
