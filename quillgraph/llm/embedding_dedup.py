"""Embedding near-duplicates by randomised-rotation binary codes (after Gao and Long, "RaBitQ").

Unit vectors are rotated at random; the signs are a vector's code, and the inner product of the vector with its
code is stored as correction factor. From code, factor and the rotated other vector, the inner product of two vectors is estimated without bias, with a
confidence bound that shrinks with the dimension. Pairs whose bound excludes the threshold are dropped; all others are computed
exactly, in double precision.

Candidates: equal vectors of a label are one vector with a count. Leading signs of further rotations make hash tables of buckets of some hundreds of vectors; a pair
at the threshold itself meets in one of the tables with probability ``recall`` or more, a closer one nearly always. A pair counts in the first table where it meets.
Buckets over ``BLOCK`` rows are dealt as pairs of blocks to many tasks; links of a task are counted and joined there, so output is linear in
the vectors, not in the pairs.

Full vectors (in the column's own precision) travel to the tables beside their codes: the links of a group of n near copies are n * (n - 1) / 2 pairs, which are counted where they meet and never
become rows that vectors are fetched for.

Rows that link with nothing: null labels, null ids, vectors that are null, empty, zero, or hold null or non-finite components. Vectors of
different length never link. Repeated rows are other vectors like any copy; rows of one id count as so many vectors, of which the id names each. A pair at the threshold itself links. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import find_roots, staged, tasks_of, tidy
from .components import connected_components

THRESHOLD, RECALL = 0.93, 0.995
#: Vectors wanted in a bucket; rows of a block of a large bucket; rows multiplied at once.
BUCKET, BLOCK, TILE = 256, 4096, 1024
#: Standard deviations of the estimate's bound: a linked pair falls outside with a probability far below 1 - RECALL.
DEVIATIONS = 5.0
SEED = 20240


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def tables_for(bits: int, threshold: float, recall: float) -> int:
    """Tables of ``bits`` signs in which a pair at the threshold meets at least once with probability ``recall``."""
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if meet >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated, signs, correction factor) of unit vectors."""
    rotated = (unit @ turn.T).astype(np.float32)
    signs = np.where(rotated >= 0, 1, -1).astype(np.float32)
    return rotated, signs, np.abs(rotated).sum(1) / math.sqrt(unit.shape[1])


def estimates(rotated: np.ndarray, signs: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of coded vectors with rotated ones, and each coded vector's bound."""
    d = rotated.shape[1]
    guess = (signs @ rotated.T) / (math.sqrt(d) * factor[:, None])
    return guess, DEVIATIONS * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, d - 1))


def _linked(v: np.ndarray, norm: np.ndarray, c: tuple[np.ndarray, ...], a: slice, b: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    guess, bound = estimates(c[0][b], c[1][a], c[2][a])
    maybe = guess + bound[:, None] >= threshold
    if a == b:
        maybe = np.triu(maybe, 1)
    if np.count_nonzero(maybe) > 0.02 * maybe.size:  # many: one exact product for the whole tile
        exact = (v[a] @ v[b].T) / (norm[a][:, None] * norm[b][None, :])
        i, j = np.nonzero(maybe & (exact >= threshold))
    else:
        i, j = np.nonzero(maybe)
        x, y = v[a][i], v[b][j]
        near = np.einsum("ij,ij->i", x, y) / (norm[a][i] * norm[b][j]) >= threshold
        i, j = i[near], j[near]
    return i + a.start, j + b.start


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per vector: (id long, n_links long, component_id long)."""
    element = vectors.schema[vector_col].dataType.elementType
    single = isinstance(element, (T.FloatType, T.ByteType, T.ShortType))  # sent as four bytes a component, without loss
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))  # one zero
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    usable, rest = rows.where(fine), rows.where(~fine)
    same = [F.xxhash64(F.lit(k), "label", "v").alias(f"h{k}") for k in (1, 2)]  # 128 bits of label and vector: rows find their vector again without carrying it
    distinct = usable.groupBy("label", "v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    unique = staged(distinct.withColumn("key", F.monotonically_increasing_id()).select("*", *same), "vectors")
    shapes = unique.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    largest = unique.groupBy("label", F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    total = shapes.agg(F.sum("n")).first()[0] or 0
    bits = min(30, max(0, math.ceil(math.log2(max(1, largest) / BUCKET))))
    tables = tables_for(bits, threshold, recall)

    @tidy
    def hash_(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in it:
            lists = b.column("v")
            dims = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sent = flat.astype(np.float32) if single else flat
            starts = np.concatenate([[0], np.cumsum(dims)])
            buckets = np.zeros((b.num_rows, tables), np.int32)
            for d in np.unique(dims):
                if d not in turns:  # the signs used: enough rows of as many rotations as that takes
                    need = max(1, tables * bits)
                    turns[d] = np.concatenate([rotation(int(d), SEED + 1 + k) for k in range(-(-need // int(d)))])[: tables * bits]
                mine = np.flatnonzero(dims == d)
                x = flat[starts[mine][:, None] + np.arange(d)]
                signs = (x @ turns[d].T >= 0).reshape(len(mine), tables, bits)
                buckets[mine] = signs @ (1 << np.arange(bits)) if bits else 0
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "label", "n")), pa.array(dims.astype(np.int32)), pa.array([sent[s:e].tobytes() for s, e in zip(starts[:-1], starts[1:], strict=True)], pa.binary()), pa.array([r.tobytes() for r in buckets], pa.binary()), pa.array(list(buckets), pa.list_(pa.int32()))], ["key", "label", "n", "dim", "v", "codes", "buckets"])

    hashed = staged(unique.select("key", "label", "n", "v").mapInArrow(hash_, "key long, label string, n long, dim int, v binary, codes binary, buckets array<int>"), "hashed")
    where = ["label", "dim", "tbl", "bucket"]
    names = hashed.select("key", "label", "dim", F.posexplode("buckets").alias("tbl", "bucket"))
    large = staged(names.groupBy(*where).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK).select(*where, "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "large")
    copies = large.agg(F.sum(F.col("m") * (F.col("blocks") - 1))).first()[0] or 0  # a row of a large bucket is dealt once a block
    dealt = hashed.select("key", "label", "n", "dim", "v", "codes", F.posexplode("buckets").alias("tbl", "bucket")).join(large.drop("m"), where, "left")
    block = F.pmod(F.xxhash64("key", F.lit(3)), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = dealt.withColumn("mine", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    dealt = dealt.select("key", "n", "v", "codes", "tbl", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), F.xxhash64(*where, F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "label", "dim", "bucket")
    tasks = tasks_of(total * tables + copies, 40_000)

    def compared(cells: dict[tuple, list], turns: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for (_, dim, tbl, _, lo, hi), members in cells.items():
            members.sort(key=lambda m: (m[4], m[0]))
            keys, counts = (np.array([m[k] for m in members], np.int64) for k in (0, 1))
            side = np.array([m[4] for m in members])
            vec = np.frombuffer(b"".join(m[2] for m in members), np.float32 if single else np.float64).astype(np.float64).reshape(-1, dim)
            code = np.frombuffer(b"".join(m[3] for m in members), np.int32).reshape(-1, tables)
            norm = np.sqrt(np.einsum("ij,ij->i", vec, vec))
            with np.errstate(all="ignore"):
                odd = (norm == 0) | ~np.isfinite(norm)  # squares out of range: scaled first
                if odd.any():
                    vec = vec.copy()
                    vec[odd] /= np.abs(vec[odd]).max(1, keepdims=True)
                    norm = np.sqrt(np.einsum("ij,ij->i", vec, vec))
            turn = turns.setdefault(dim, rotation(dim, SEED))
            c = codes(vec / norm[:, None], turn)
            cut = int(np.searchsorted(side, lo, "right")) if lo != hi else len(members)
            pairs: list[tuple[slice, slice]] = []
            spans = [slice(s, min(s + TILE, stop)) for start, stop in ((0, cut), (cut, len(members))) for s in range(start, stop, TILE)]
            for x in spans:
                for y in spans:
                    if x.start <= y.start and (lo == hi or x.start < cut <= y.start):
                        pairs.append((x, y))
            links, a_all, b_all = np.zeros(len(members), np.int64), [], []
            for x, y in pairs:
                i, j = _linked(vec, norm, c, x, y, threshold)
                new = np.ones(len(i), bool)
                for t in range(tbl):
                    new &= code[i, t] != code[j, t]
                i, j = i[new], j[new]
                links += np.bincount(i, counts[j], len(members)).astype(np.int64) + np.bincount(j, counts[i], len(members)).astype(np.int64)
                root = find_roots(len(members), i, j)
                moved = np.flatnonzero(root != np.arange(len(members)))
                a_all.append(moved)
                b_all.append(root[moved])
            if a_all and links.any():
                root = find_roots(len(members), np.concatenate(a_all), np.concatenate(b_all))
                on = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(keys[on]), pa.array(links[on]), pa.array(keys[root[on]])], ["key", "links", "root"])

    @tidy
    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        cells: dict[tuple, list] = {}
        now = None
        for b in it:  # sorted by cell, so one cell's rows are held at a time
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key, n, vec, code, tbl, mine, lo, hi, cell, label, dim, bucket = r
                if cell != now:
                    yield from compared(cells, turns)
                    cells, now = {}, cell
                cells.setdefault((label, dim, tbl, bucket, lo, hi), []).append((key, n, vec, code, mine))
        yield from compared(cells, turns)

    met = staged(dealt.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(meet, "key long, links long, root long"), "links")
    roots = connected_components(met.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = met.groupBy("key").agg(F.sum("links").alias("links"))
    named = unique.join(counts, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left").select("h1", "h2", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("root", "key").alias("root"))
    named = staged(named, "named")
    smallest = staged(named.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    done = staged(named.join(smallest, "root").select("h1", "h2", "n_links", "component_id"), "done")
    out = usable.select("id", *same).join(done, ["h1", "h2"]).select("id", "n_links", "component_id")
    return out.unionAll(rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
