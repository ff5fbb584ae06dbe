"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and other scripts' characters, ASCII lower-cased; in scripts written without spaces each character is a word. Every window of ``least_match`` words of a benchmark
item is a seed. Document windows that equal a seed are found by hash; the stretches of a document that seeds cover are then tiled
against the item: running Karp-Rabin windows find the longest matches of words not yet marked, which are marked longest first and never overlap, at ever
shorter window lengths down to ``least_match``; of equally long ones that which stands first in the item, then in the document. A document is contaminated by an item if the tiles cover ``threshold`` of the item's words, in whatever order they stand.
Words are equal where 61 bits of their hashes are.

The benchmark is the query set and goes to all executors in blocks of at most ``BLOCK_BYTES`` of text, one pass over the documents a block. Of several blocks each is collected, sent, used, written and dropped
before the next, so what the driver and executors hold does not grow with the benchmark; neither documents nor their windows are shuffled. Candidates are not capped.

Rows: null or empty texts match nothing; items of fewer than ``least_match`` words are never reported (they stand in too many clean documents); repeated documents and items each get
their own rows; a null id keeps its rows; very long texts are read whole, a slice of ``CHUNK_BYTES`` or one text at a time; extra columns, whatever their names, are ignored and kept by :func:`keep_uncontaminated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_parts, mix, prefix_hash, run_hash, slices, staged, text_column, tidy, without_ids

LEAST_MATCH, THRESHOLD = 5, 0.5
BLOCK_BYTES = 16 << 20
#: Length of the first windows; windows of longer matches are tried when one is twice as long.
FIRST_WINDOW = 20
#: Tilings that a task remembers (copies of a passage need tiling once), and tiles in all of them; stretches are remembered by 128 bits, whatever their length.
REMEMBERED, REMEMBERED_TILES = 20_000, 200_000
_LETTER = np.array([c >= 128 or chr(c).isalnum() for c in range(256)], bool)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_PRIME, _RADIX = (1 << 61) - 1, 1_000_003
SCHEMA = "id long, item long, tiles array<struct<item_start:int,doc_start:int,words:int>>, covered long, item_words long, coverage double"


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word of the concatenated texts."""
    base = int(offsets[0])
    data, bounds = _LOWER[data[base : int(offsets[-1])]], offsets - base
    letter = np.concatenate([[False], _LETTER[data], [False]])
    edge = letter[1:] != letter[:-1]
    inner = bounds[1:-1]
    lead = np.flatnonzero((data >= 0xE3) & (data <= 0xE9))  # U+3000 to U+9FFF
    inner = np.concatenate([inner, lead, lead + 3])
    inner = inner[(inner > 0) & (inner < len(data))]
    cut = inner[letter[inner] & letter[inner + 1]]  # a text's last and the next one's first word touch, or two characters that are words
    start = np.flatnonzero(edge & letter[1:])
    end = np.flatnonzero(edge & letter[:-1])
    if len(cut):
        cut = np.unique(cut)
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return run_hash(prefix_hash(data), start, end), np.searchsorted(bounds, start, side="right") - 1


def windows(h: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of each window of ``size`` words within one text."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = np.zeros(n, np.uint64)
    for k in range(size):
        w = w * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    return mix(w[at]), at


def _scan(item: list[int], doc: list[int], in_item: list[bool], in_doc: list[bool], size: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Maximal matches of at least ``size`` unmarked words; stops at one of over twice the size."""
    top = pow(_RADIX, size - 1, _PRIME)

    def hashes(words: list[int], marked: list[bool]) -> Iterator[tuple[int, int]]:
        value = run = 0
        for i, w in enumerate(words):
            if marked[i]:
                value = run = 0
                continue
            if run >= size:
                value = (value - words[i - size] * top) % _PRIME
            value = (value * _RADIX + w) % _PRIME
            run += 1
            if run >= size:
                yield value, i - size + 1

    table: dict[int, list[int]] = {}
    for value, i in hashes(item, in_item):
        table.setdefault(value, []).append(i)
    found, longest = [], 0
    for value, j in hashes(doc, in_doc):
        for i in table.get(value, ()):
            if i and j and not in_item[i - 1] and not in_doc[j - 1] and item[i - 1] == doc[j - 1]:
                continue  # not the start of a maximal match
            n = 0
            while i + n < len(item) and j + n < len(doc) and not in_item[i + n] and not in_doc[j + n] and item[i + n] == doc[j + n]:
                n += 1
            if n >= size:
                found.append((n, i, j))
                longest = max(longest, n)
                if n > 2 * size:
                    return longest, found
    return longest, found


def greedy_tiles(item: list[int], doc: list[int], least: int) -> list[tuple[int, int, int]]:
    """Non-overlapping tiles (item start, document start, words), longest first; negative words are gaps and match nothing."""
    in_item, in_doc = [False] * len(item), [w < 0 for w in doc]
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(FIRST_WINDOW, len(item)))
    while True:
        longest, found = _scan(item, doc, in_item, in_doc, size)
        if longest > 2 * size:
            size = longest
            continue
        queue = [(-n, i, j) for n, i, j in found]
        heapify(queue)
        while queue:
            n, i, j = heappop(queue)
            n = -n
            free = 0  # the part of the match that is not marked since
            while free < n and not in_item[i + free] and not in_doc[j + free]:
                free += 1
            if free < n:
                rest = free + 1
                while rest < n and (in_item[i + rest] or in_doc[j + rest]):
                    rest += 1
                for s, m in ((0, free), (rest, n - rest)):
                    if m >= size:
                        heappush(queue, (-m, i + s, j + s))
                continue
            in_item[i : i + n] = in_doc[j : j + n] = [True] * n
            tiles.append((i, j, n))
        if size <= least:
            return tiles
        size = size // 2 if size > 2 * least else least


class Block:
    """Seeds and words of the benchmark items of one block."""

    def __init__(self, items: list[tuple[int | None, bytes]], least: int):
        data = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in items])]).astype(np.int64)
        h, text = word_hashes(data, offsets)
        bounds = np.searchsorted(text, np.arange(len(items) + 1))
        self.ids, self.words = [i for i, _ in items], [(h[s:e] >> np.uint64(3)).astype(np.int64).tolist() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        seed, at = windows(h, text, least)
        order = np.argsort(seed, kind="stable")
        self.seed, first, count = np.unique(seed[order], return_index=True, return_counts=True)
        self.first, self.count = first, count
        self.item, self.at = text[at[order]], (at - bounds[text[at]])[order]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.seed & np.uint64((1 << 22) - 1)] = True

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, seed) for each window that is a seed."""
        at = np.flatnonzero(self.filter[w & np.uint64((1 << 22) - 1)])
        k = np.minimum(np.searchsorted(self.seed, w[at]), max(0, len(self.seed) - 1))
        same = self.seed[k] == w[at] if len(self.seed) else np.zeros(len(at), bool)
        return at[same], k[same]


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item that contaminates it; tiles are in words, of the whole document's and the item's."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), text_column(benchmark, item_text_col).alias("t"))
    size = items.agg(F.sum(F.octet_length("t")).alias("s")).first()["s"] or 0
    blocks = max(1, -(-size // (BLOCK_BYTES // 2)))
    given = docs.select(F.col(id_col).cast("long").alias("id"), text_column(docs, text_col).cast("binary").alias("t"))
    parts = []
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == k)
        rows = sorted(((r["item"], r["t"].encode()) for r in part.toLocalIterator()), key=lambda r: (r[0] is None, r))  # BLOCK_BYTES at most
        sent = docs.sparkSession.sparkContext.broadcast(Block(rows, least))
        found = _against(given, sent, least, threshold)
        if blocks > 1:
            found = staged(found, "contaminations")
            sent.destroy()
        parts.append(found)
    return reduce(DataFrame.unionAll, parts)


def _against(given: DataFrame, sent: Broadcast, least: int, threshold: float) -> DataFrame:
    kind = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("tiles", pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("words", pa.int32())]))), ("covered", pa.int64()), ("item_words", pa.int64()), ("coverage", pa.float64())])

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, known = sent.value, {}
        for b in it:
            data, offsets = binary_parts(b.column(1))
            out = []
            for s, e in slices(np.diff(offsets)):
                h, text = word_hashes(data, offsets[s : e + 1])
                w, at = windows(h, text, least)
                hit, seed = seeds.hits(w)
                if not len(hit):
                    continue
                where = at[hit]
                of = text[where]
                for d in np.unique(of):
                    mine = of == d if len(of) < 5000 else slice(*np.searchsorted(of, [d, d + 1]))
                    out += [(b.column(0)[s + int(d)].as_py(), *row) for row in _tile(seeds, h, where[mine], seed[mine], int(np.searchsorted(text, d)), least, threshold, known)]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in out], kind)

    return given.mapInArrow(run, SCHEMA)


def _tile(seeds: Block, h: np.ndarray, where: np.ndarray, seed: np.ndarray, first: int, least: int, threshold: float, known: dict) -> Iterator[tuple]:
    """Rows of one document, of the windows ``where`` that are seeds."""
    count = seeds.count[seed]
    post = np.repeat(seeds.first[seed] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    item, item_at, doc_at = seeds.item[post], seeds.at[post], np.repeat(where, count)
    order = np.argsort(item, kind="stable")
    item, item_at, doc_at = item[order], item_at[order], doc_at[order]
    cuts = [0, *(np.flatnonzero(np.diff(item)) + 1), len(item)]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        words = seeds.words[item[s]]
        reach = np.zeros(len(words) + 1, np.int64)
        np.add.at(reach, item_at[s:e], 1)
        np.add.at(reach, item_at[s:e] + least, -1)
        if np.count_nonzero(np.cumsum(reach)) < threshold * len(words):
            continue  # tiles consist of seeds, so they cover no more than all seeds together
        starts = np.unique(doc_at[s:e])
        run = np.append(True, starts[1:] > starts[:-1] + least)
        lo, hi = starts[run], starts[np.append(run[1:], True)] + least
        doc = [x for a, z in zip(lo, hi, strict=True) for x in [*(h[a:z] >> np.uint64(3)).astype(np.int64).tolist(), -1]]
        key = (int(item[s]), hashlib.blake2b(np.array(doc, np.int64).tobytes(), digest_size=16).digest())
        tiles = known.get(key)
        if tiles is None:
            tiles = greedy_tiles(words, doc, least)
            known["tiles"] = known.get("tiles", 0) + len(tiles)
            if len(known) > REMEMBERED or known["tiles"] > REMEMBERED_TILES:
                known.clear()
            known[key] = tiles
        covered = sum(n for _, _, n in tiles)
        if covered >= threshold * len(words):
            place = np.concatenate([np.append(np.arange(a, z), -1) for a, z in zip(lo, hi, strict=True)]) - first
            rows = [{"item_start": i, "doc_start": int(place[j]), "words": n} for i, j, n in sorted(tiles)]
            yield seeds.ids[item[s]], rows, covered, len(words), covered / len(words)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents that no benchmark item contaminates, with all their columns."""
    found = contaminations(docs, benchmark, id_col, text_col, **kw)
    return without_ids(docs, found.select("id"), id_col)
