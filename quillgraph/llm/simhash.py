"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a value within half the radius of both. So every distinct
fingerprint emits its variants within ``radius // 2`` bits, the variants are shuffled, and fingerprints that meet in a variant are
deduplicated as pairs and verified. A variant's destination is its leading bits only: a fingerprint is sent
once to each destination that some variant of it has, with the flips left, and the variants are spelled out there.
The rows shuffled are then tens a fingerprint instead of 2,081, of the same multiset of variants. A destination with too many
fingerprints for a task is split by further bits, so that near copies crowd no task.

Fingerprints in one variant's bucket are all within the radius of each other, so a bucket is joined as a star
and each task returns a spanning forest: output is linear in the fingerprints, however large a group of near copies is.

Rows: null text is empty text; a text without words has fingerprint zero and links like any other. A null id keeps its
row, with the component of its fingerprint, but never names a component unless all its members have null ids (then null). Repeated rows get equal results. A bit that exactly half the shingles set is 0; fingerprints at the radius itself link.
A very long text is fingerprinted whole by one task, in memory of some ten times its size. Extra columns, whatever their names, are ignored, and kept by the functions that keep documents.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import find_roots, mix, split_by_ids, staged, tasks_of, text_column, tidy, without_ids
from .components import connected_components

SHINGLE_WORDS, RADIUS, BITS = 4, 4, 64
#: Variants that are sorted at once in a task (some 60 bytes each).
VARIANTS_AT_ONCE = 1_500_000
#: Fingerprints of one destination that a task holds, and rows of many destinations that it reads.
PRINTS_AT_ONCE, ROWS_A_TASK = 2_000_000, 16_000_000
#: Further bits by which a crowded destination is split.
STEP_BITS = 6
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1].astype(np.int64)


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Majority bits of the XXH64 (seed 42) of all shingles of the lower-cased words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined, h64 = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle_words + 1
    hashes = np.fromiter((h64(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[shingle_words - 1 :].tolist(), strict=True)), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of ``hashes``, one at least."""
    n = len(hashes)
    octets = hashes.view(np.uint8).reshape(n, 8)
    if n < 200:
        ones = _BYTE_BITS[octets].sum(0)
    else:
        ones = np.stack([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits((2 * ones > n).reshape(-1), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp long): one row per document."""

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_column(docs, text_col).cast("binary").alias("t")).mapInArrow(run, "id long, fp long")


def _flips(bits: int, most: int) -> list[np.ndarray]:
    """[masks of exactly 0, 1, .. most flipped bits among the lowest ``bits``]."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    out = [np.zeros(1, np.uint64), one]
    while len(out) <= most:
        out.append(np.unique((out[-1][:, None] | one[None, :])[np.bitwise_count(out[-1][:, None] | one[None, :]) == len(out)]))
    return out[: most + 1]


def _meet(fp: np.ndarray, left: np.ndarray, bits: int, radius: int, out: list[np.ndarray]) -> None:
    """Pairs of fingerprints with a common variant; all variants here agree above the lowest ``bits``, ``left`` flips remain to each."""
    if len(fp) < 2:
        return
    sizes = np.array([sum(math.comb(bits, j) for j in range(k + 1)) for k in range(radius // 2 + 1)])
    if bits > 3 and sizes[left].sum() > VARIANTS_AT_ONCE:
        for s in range(8):
            away = np.bitwise_count(((fp >> np.uint64(bits - 3)) & np.uint64(7)) ^ np.uint64(s)).astype(np.int64)
            near = away <= left
            _meet(fp[near], (left - away)[near], bits - 3, radius, out)
        return
    low, masks = fp & np.uint64((1 << bits) - 1), _flips(bits, radius // 2)
    values, whose = [], []
    for k, mask in enumerate(masks):
        who = np.flatnonzero(left >= k)
        values.append((low[who][:, None] ^ mask[None, :]).ravel())
        whose.append(np.repeat(who, len(mask)))
    values, whose = np.concatenate(values), np.concatenate(whose)
    order = np.argsort(values)
    values = values[order]
    same = np.flatnonzero(values[1:] == values[:-1])
    if not len(same):
        return
    a, b = whose[order[same]], whose[order[same + 1]]
    pairs = np.unique(np.minimum(a, b) * len(fp) + np.maximum(a, b))
    a, b = pairs // len(fp), pairs % len(fp)
    near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
    out.append(np.stack([fp[a[near]], fp[b[near]]], 1))


def _by_prefix(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fingerprints, flips left) of one destination after the other, from rows sorted by it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now = None
    for b in it:
        to, fp, left = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        cuts = np.flatnonzero(np.diff(to)) + 1
        for s, e in zip([0, *cuts], [*cuts, len(to)], strict=True):
            if held and to[s] != now:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
            if e > s:
                now = to[s]
                held.append((fp[s:e].view(np.uint64), left[s:e].astype(np.int64)))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _forest(pairs: list[np.ndarray]) -> np.ndarray:
    """Edges from each fingerprint of ``pairs`` to the smallest that it is connected with."""
    ends, at = np.unique(np.concatenate(pairs), return_inverse=True)
    at = at.reshape(-1, 2)
    root = find_roots(len(ends), at[:, 0], at[:, 1])
    return np.stack([ends, ends[root]], 1)[root != np.arange(len(ends))]


def _meetings(sent: DataFrame, lead: int, tasks: int, radius: int) -> DataFrame:
    """Edges (a, b) within each destination of ``sent(to, fp, left)``, destinations being ``lead`` leading bits of variants."""

    @tidy
    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, left in _by_prefix(it):
            found: list[np.ndarray] = []
            _meet(fp, left, BITS - lead, radius, found)
            if found:
                e = _forest(found).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return sent.repartition(tasks, "to").sortWithinPartitions("to").mapInArrow(meet, "a long, b long")


def _sent_on(sent: DataFrame, step: int, half: int) -> DataFrame:
    """Rows of ``sent`` for destinations with ``step`` more bits: one row for each value of those bits that the flips left reach."""
    masks = _flips(step, half)

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            to, fp, left, bits = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for used, mask in enumerate(masks):
                who = np.flatnonzero(left >= used)
                if len(who) and len(mask):
                    own = (fp[who].view(np.uint64) >> (BITS - step - bits[who]).astype(np.uint64)) & np.uint64((1 << step) - 1)
                    onward = (to[who].view(np.uint64) << np.uint64(step))[:, None] | (own[:, None] ^ mask[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(onward.ravel().view(np.int64)), pa.array(np.repeat(fp[who], len(mask))), pa.array(np.repeat(left[who] - used, len(mask)).astype(np.int8))], ["to", "fp", "left"])

    return sent.mapInArrow(run, "to long, fp long, left byte")


def links(prints: DataFrame, n: int, radius: int = RADIUS, most: int = PRINTS_AT_ONCE) -> DataFrame:
    """``prints(fp long)``, distinct, ``n`` of them -> (a, b): edges that connect the same fingerprints as all pairs within ``radius`` bits.

    A destination of more than ``most`` fingerprints, as clusters of near copies make, is split by further bits of the variants, in steps up to all 64:
    within one whole variant are no more than the ball around it, 2,081 for a radius of 4."""
    half = radius // 2
    variants = sum(math.comb(BITS, k) for k in range(half + 1))
    lead = min(24, max(7, math.ceil(math.log2(max(1, n) * variants / (4 * VARIANTS_AT_ONCE) + 1))))
    flat = [(int(m), k) for k, group in enumerate(_flips(lead, half)) for m in group]

    @tidy
    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip, used = (np.array(x, np.uint64) for x in zip(*flat, strict=True))
        for b in it:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for s in range(0, len(fp), 20_000):
                part = fp[s : s + 20_000]
                to = ((part >> np.uint64(BITS - lead))[:, None] ^ flip[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(to.view(np.int64)), pa.array(np.repeat(part, len(flip)).view(np.int64)), pa.array(np.tile(half - used.astype(np.int64), len(part)).astype(np.int8))], ["to", "fp", "left"])

    sent = prints.select("fp").mapInArrow(send, "to long, fp long, left byte")
    total, done = n * len(flat), []
    # A destination above the bound has a leading value with its share of that many fingerprints.
    most_alike = prints.groupBy(F.shiftrightunsigned("fp", BITS - lead).alias("to")).count().agg(F.max("count")).first()[0] or 0
    while most_alike * len(flat) > most and lead < BITS:
        over = staged(sent.groupBy("to").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("to"), "crowded")
        if over.isEmpty():
            break
        over = F.broadcast(over)  # a row for more than ``most`` of the rows sent
        done.append(staged(_meetings(sent.join(over, "to", "left_anti"), lead, tasks_of(total, ROWS_A_TASK, 32), radius), "met"))
        step = min(STEP_BITS, BITS - lead)
        crowd = sent.join(over, "to", "left_semi").select("to", "fp", "left", F.lit(lead).alias("bits"))
        sent = staged(_sent_on(crowd, step, half), "sent")
        lead, total = lead + step, sent.count()
    return functools.reduce(DataFrame.union, done, _meetings(sent, lead, tasks_of(total, ROWS_A_TASK, 32), radius))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: (id long, fp long, component_id long), component_id the smallest id reachable by links."""
    each = staged(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    prints = staged(each.groupBy("fp").agg(F.min("id").alias("first")), "prints")
    n = prints.count()
    roots = connected_components(links(prints, n, radius))
    owned = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    owned = staged(owned, "owned")
    names = owned.groupBy("root").agg(F.min("first").alias("component_id"))
    named = staged(owned.join(names, "root").select("fp", "component_id"), "named")
    return each.join(named, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents but for near copies: of each group the one with the smallest id stays, with all its columns (rows of one id stay or go together)."""
    found = near_duplicates(docs, id_col, text_col)
    return without_ids(docs, found.where("id <> component_id").select("id"), id_col)


SIMILAR_WORDS, LEAST_SIMILAR, BANDS, ROWS = 5, 0.8, 16, 4
#: Sets, and shingles in them, of one bucket that a task holds; members of a larger bucket that are compared with all of it in each of some turns.
MEMBERS_AT_ONCE, SHINGLES_AT_ONCE, ASKERS, ASKING_TURNS = 2_000, 4_000_000, 4, 2
_MULTIPLIERS = np.random.default_rng(17).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, shingle_words: int = SIMILAR_WORDS) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of the shingles of the lower-cased words; of all words where they are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle_words + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[k : k + shingle_words]), 42) for k in range(n)), np.uint64, n))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key a band of min-hashes: a pair of similarity s shares one with probability 1 - (1 - s ** ROWS) ** BANDS, 0.9998 at 0.8."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(found), 2000):
        least = np.minimum(least, mix(found[s : s + 2000, None] * _MULTIPLIERS).min(0))
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = mix(out * np.uint64(0xA24BAED4963EE407) + column)
    return out.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    return min(len(x), len(y)) >= least * max(len(x), len(y)) and jaccard(x, y) >= least


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])


def _within(rows: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that connect what is similar in each bucket of ``rows(key, id, found)``, sorted by key; one bucket is held at a time."""

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: int | None = None
        groups: list[list[tuple[int, np.ndarray]]] = []

        def put(i: int, x: np.ndarray) -> list[tuple[int, int]]:
            """Links of one more member to the groups connected so far, which it joins into one."""
            near, far, edges = [(i, x)], [], []
            for group in groups:
                hit = next((j for j, y in group if _alike(x, y, least)), None)
                if hit is None:
                    far.append(group)
                else:
                    edges.append((i, hit))
                    near = group + near
            groups[:] = [*far, near]
            return edges

        for b in it:
            edges = []
            for k, i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if k != key:
                    key = k
                    groups.clear()
                edges += put(i, np.frombuffer(x.as_py(), np.uint64))
            if edges:
                yield _edges(edges)

    return rows.mapInArrow(run, "a long, b long")


def _asked(rows: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) between the askers and the others of each cell of ``rows(key, chunk, block, other, id, comp, found)``, sorted
    by all but the last two. The askers of a cell are held, the others stream by; pairs whose components are connected already are not compared."""

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple | None = None
        askers: list[tuple[int, int, np.ndarray]] = []
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        for b in it:
            edges = []
            columns = [b.column(k).to_pylist() for k in range(6)]
            for *here, other, i, c, x in zip(*columns, b.column(6), strict=True):
                if here != cell:
                    cell = here
                    askers.clear()
                    joined.clear()
                x = np.frombuffer(x.as_py(), np.uint64)
                if not other:
                    askers.append((i, c, x))
                    continue
                for j, d, y in askers:
                    if root(c) != root(d) and _alike(x, y, least):
                        joined[root(c)] = root(d)
                        edges.append((i, j))
            if edges:
                yield _edges(edges)

    return rows.mapInArrow(run, "a long, b long")


def _ask(askers: DataFrame, members: DataFrame, found: DataFrame, least: float, most_members: int, most_shingles: int) -> DataFrame:
    """Edges between ``askers`` and ``members``, both (key, id, size, comp), of each bucket: askers in chunks and members in blocks that a task can hold, each chunk against each block."""

    def parts(of: DataFrame, name: str) -> DataFrame:
        n = F.ceil(F.greatest(F.count(F.lit(1)) / most_members, F.sum("size") / most_shingles)).cast("int")
        return of.groupBy("key").agg(F.greatest(n, F.lit(1)).alias(name))

    cells = staged(parts(askers, "chunks").join(parts(members, "blocks"), "key"), "cells")
    own = lambda n, by: F.pmod(F.xxhash64("id", F.lit(by)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    from_ = askers.join(cells, "key").select("key", own("chunks", 1).alias("chunk"), every("blocks").alias("block"), F.lit(0).alias("other"), "id", "comp")
    to = members.join(cells, "key").select("key", every("chunks").alias("chunk"), own("blocks", 2).alias("block"), F.lit(1).alias("other"), "id", "comp")
    rows = staged(from_.union(to), "asked")
    cell = ["key", "chunk", "block"]
    dealt = rows.join(found, "id").select(*cell, "other", "id", "comp", "found").repartition(tasks_of(rows.count(), 20_000), *cell)
    return staged(_asked(dealt.sortWithinPartitions(*cell, "other", "id"), least), "answers")


def _in_crowds(crowds: DataFrame, found: DataFrame, links_: DataFrame, least: float, most_members: int, most_shingles: int) -> DataFrame:
    """``links_(a, b)`` with the links in buckets too large for one task, ``crowds(key, id, size)``, that connect further components.

    Some members of each bucket, spread by hash, are compared with all: in a group of near copies they connect most. Then all members outside the bucket's
    largest component are compared with all, chunk by block, so every pair that is not connected yet is compared."""

    def now() -> DataFrame:
        """Members, with their components, of buckets that more than one component has a part in."""
        roots = connected_components(links_)
        named = crowds.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "size", F.coalesce("root", "id").alias("comp"))
        named = staged(named, "crowds")
        return named.join(named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "key")

    for turn in range(ASKING_TURNS):
        open_ = staged(now(), "open")
        if open_.isEmpty():
            return links_
        order = F.xxhash64("id", "key", F.lit(turn))
        first = open_.groupBy("key", F.pmod(order, F.lit(ASKERS)).alias("slot")).agg(F.min_by(F.struct("id", "size", "comp"), order).alias("m")).select("key", "m.*")
        links_ = links_.union(_ask(first, open_, found, least, most_members, most_shingles))
    open_ = staged(now(), "open")
    if open_.isEmpty():
        return links_
    largest = open_.groupBy("key", "comp").count().groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("largest"))
    rest = staged(open_.join(largest, "key").where("comp <> largest").select("key", "id", "size", "comp"), "rest")
    return links_.union(_ask(rest, open_, found, least, most_members, most_shingles))


def _decided(proposed: DataFrame, given: DataFrame, sets: Callable, links_: DataFrame, least: float, most_members: int, most_shingles: int) -> DataFrame:
    """``links_(a, b)`` with the links that the shingles of ``given(id, t)``, read by ``sets``, show within the buckets of ``proposed(key, id, size)``."""
    # Near copies meet in many buckets: of those with the same members, by 128 bits of their hashes, one is compared.
    who = [F.bit_xor(F.xxhash64("id", "size", F.lit(k))).alias(f"who{k}") for k in (1, 2)]
    several = proposed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), *who).where("n > 1")
    several = several.groupBy("n", "shingles", "who1", "who2").agg(F.min("key").alias("key"))
    crowded = (F.col("n") > most_members) | (F.col("shingles") > most_shingles)
    members = staged(proposed.join(several, "key").select("key", "id", "size", crowded.alias("crowded")), "buckets")
    n = members.count()
    wanted = staged(members.select("id").distinct(), "wanted")
    found = staged(split_by_ids(given, F.col("id"), wanted)[0].join(wanted, "id", "left_semi").mapInArrow(sets, "id long, found binary").dropDuplicates(["id"]), "sets")
    ordered = members.where("NOT crowded").join(found, "id").select("key", "id", "found").repartition(tasks_of(n, 20_000), "key").sortWithinPartitions("key", "id")
    links_ = staged(_within(ordered, least).union(links_), "links")
    crowds = members.where("crowded")
    return links_ if crowds.isEmpty() else _in_crowds(crowds.select("key", "id", "size"), found, links_, least, most_members, most_shingles)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_SIMILAR, most_members: int = MEMBERS_AT_ONCE, most_shingles: int = SHINGLES_AT_ONCE, radius: int = RADIUS) -> DataFrame:
    """(id, component_id) over documents linked where the Jaccard similarity of their five-word shingles is ``least`` or more; null ids take no part.

    SimHash comes first: the fingerprints of the sets are linked by ball hashing (:func:`links`), and within each group of linked fingerprints the shingles decide. A pair at 0.8 differs in some ten bits, more than the radius reaches:
    what lies beyond it is proposed by bands of min-hashes, whose buckets count only where SimHash has left several groups in them, and decided by the shingles too.
    Equal sets are joined beforehand; a bucket's pairs are compared unless links connect them already, so near copies take few comparisons.
    A bucket of more than ``most_members`` sets or ``most_shingles`` shingles is compared in parts that a task can hold, with the same links."""

    @tidy
    def sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            same = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            keys = pa.array([band_keys(x) if len(x) else [] for x in sets], pa.list_(pa.int64()))
            fp = pa.array(np.fromiter((majority(x) if len(x) else 0 for x in sets), np.uint64, len(sets)).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), same, pa.array([len(x) for x in sets], pa.int64()), keys, fp], ["id", "same", "size", "keys", "fp"])

    @tidy
    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], ["id", "found"])

    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_column(docs, text_col).cast("binary").alias("t"))
    each = staged(given.mapInArrow(sketch, "id long, same binary, size long, keys array<long>, fp long"), "sketches")
    firsts = staged(each.groupBy("same").agg(F.min("id").alias("first")), "same")
    sets_ = staged(each.join(firsts, "same").where("id = first").select("id", "size", "keys", "fp", "same").dropDuplicates(["id", "same"]), "distinct")
    # SimHash: sets whose fingerprints are connected within the radius are one bucket, named by the fingerprint they come to.
    prints = staged(sets_.where("size > 0").select("fp").distinct(), "prints")
    balls = connected_components(links(prints, prints.count(), radius))
    near = sets_.where("size > 0").join(balls.withColumnRenamed("node", "fp"), "fp", "left").select("id", "size", F.coalesce("root", "fp").alias("key")).distinct()
    of_copies = each.join(firsts, "same").where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    links_ = _decided(staged(near, "balls"), given, sets, of_copies, least, most_members, most_shingles)
    # Beyond the radius: of the bands' buckets those that hold several of the groups so far.
    groups = sets_.select("id").distinct().join(connected_components(links_).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("comp"))
    bands = sets_.select("id", "size", F.explode("keys").alias("key")).distinct().join(staged(groups, "groups"), "id")
    bands = staged(bands, "bands")
    open_ = bands.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    links_ = _decided(bands.join(open_, "key").select("key", "id", "size"), given, sets, links_, least, most_members, most_shingles)
    roots = connected_components(links_)
    return each.select("id").distinct().join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("component_id"))


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents but for near copies at ``LEAST_SIMILAR``: of each group the one with the smallest id stays, with all its columns."""
    found = similar_documents(docs, id_col, text_col)
    return without_ids(docs, found.where("id <> component_id").select("id"), id_col)
