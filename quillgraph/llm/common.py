"""Helpers that the operators share: staged tables, Arrow batches cut by bytes, hashing of runs."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step works on at once; its temporaries take some 30 times as much.
CHUNK_BYTES = 1 << 20
#: Bytes of the Arrow batches that Spark sends to Python workers; rows alone would let long texts fill both sides.
ARROW_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where unset (local tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the driver and all executors")
        where = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def work_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/quillgraph/{what}-{uuid.uuid4().hex[:12]}"


def byte_count(size: str) -> int:
    """Bytes of a size as Spark's settings spell it, such as ``64m`` or ``8388608b``."""
    m = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", size.strip().lower())
    if not m:
        raise ValueError(f"not a size: {size!r}")
    return int(m[1]) << 10 * " kmgtp".index(m[2] or " ")


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, unless they are bounded lower already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if byte_count(spark.conf.get(name)) > ARROW_BYTES:
        spark.conf.set(name, f"{ARROW_BYTES}b")


def staged(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = work_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_column(df: DataFrame, text_col: str):
    """The whole text, null as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def tasks_of(n: float, each: float, least: int = 12) -> int:
    """Partitions for ``n`` rows or bytes of which a task takes ``each``; grows with the data."""
    return int(max(least, -(-n // each)))


def slices(lengths: Iterable[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items, balanced by bytes: each up to ``most`` bytes, or one larger item."""
    start, total = 0, 0
    i = -1
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if i >= start:
        yield start, i + 1


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls, not copied."""
    if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


#: Odd multiplier of the prefix polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def release() -> None:
    """Gives the worker's freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, after which the worker, which Spark keeps for other tasks, holds no more than before."""

    @functools.wraps(run)
    def whole(it: Iterator) -> Iterator:
        try:
            yield from run(it)
        finally:
            _powers.clear()
            release()

    return whole


def powers(n: int, base: int = BASE) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash serve as bucket numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def long_hash(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long column without nulls, as unsigned numbers."""
    one, two, three, four, five = (np.uint64(k) for k in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    h = turn(x.view(np.uint64) * two, 31) * one ^ (five + np.uint64(50))  # seed 42, eight bytes
    h = turn(h, 27) * one + four
    h = (h ^ (h >> np.uint64(33))) * two
    h = (h ^ (h >> np.uint64(29))) * three
    return h ^ (h >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] the sum of (data[j] + 1) * BASE**j for j < i, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def run_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end), the same wherever a run stands."""
    inverse = powers(len(prefix), BASE_INVERSE)
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def find_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest vertex of each of ``n`` vertices' component over the edges (a, b), vectorised."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def batches(rows: pa.Table | None, schema: pa.Schema, most: int = 50_000) -> Iterator[pa.RecordBatch]:
    if rows is not None and rows.num_rows:
        yield from rows.cast(schema).to_batches(max_chunksize=most)


def join_counted(rows: DataFrame, once: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``rows``, ``total`` of them, with ``once``, which has a row for each key and in ``n`` how many of ``rows`` have it.

    Keys with 1/2000 of the rows or more, which are 2000 at most, are broadcast, so that their rows stay where they are; only the others are shuffled."""
    bar = max(1000, total // 2000)
    large = F.broadcast(once.where(F.col(n) >= bar))
    rest = rows.join(large.select(*keys), keys, "left_anti").join(once.where(F.col(n) < bar), keys)
    return rows.join(large, keys).unionByName(rest)


def fresh_names(df: DataFrame, n: int) -> list[str]:
    """Column names that ``df`` does not have, whatever the case."""
    have, out = {c.lower() for c in df.columns}, []
    for k in range(n):
        name = f"extra{k}"
        while name in have:
            name = "_" + name
        out.append(name)
    return out


#: Bits a row, and bounds, of the filter that tells which documents a table of ids may name.
FILTER_BITS, LEAST_FILTER, MOST_FILTER = 32, 1 << 16, 1 << 26


def split_by_ids(docs: DataFrame, id_: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` that a written table ``ids(id)`` may name, among them all that it does, and the rows that it does not.

    Each id sets one bit of a filter; its words, a million at most whatever the number of ids, are or-ed together by Spark and broadcast, so no row is shuffled to tell. Where ids are too many for the bits, more rows pass, and none is lost."""
    bits = min(MOST_FILTER, max(LEAST_FILTER, 1 << (FILTER_BITS * ids.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(11)), F.lit(bits))
    word, bit = fresh_names(docs, 2)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))
    words = ids.select(place(F.col("id").cast("long")).alias("b")).groupBy(F.floor(F.col("b") / 64).alias(word)).agg(F.bit_or(mask).alias(bit))
    marked = docs.join(F.broadcast(staged(words, "filter")), F.floor(place(id_) / 64) == F.col(word), "left")
    held = F.coalesce(F.call_function("shiftright", F.col(bit), (place(id_) % 64).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    return marked.where(held).drop(word, bit), marked.where(~held).drop(word, bit)


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``gone(id)``, whatever their columns are called; null ids stay. Only rows that may be gone are joined, the others stay where they are."""
    (name,) = fresh_names(docs, 1)
    there = staged(gone.where("id is not null").select(F.col("id").cast("long").alias("id")).distinct(), "gone")
    id_ = docs[id_col].cast("long")
    may, rest = split_by_ids(docs, id_, there)
    return rest.unionAll(may.join(there.withColumnRenamed("id", name), id_ == F.col(name), "left_anti"))
