"""Quality classifier by importance resampling (after Xie et al., "Data Selection for Language Models via Importance Resampling").

Two generative models over hashed word unigrams and bigrams: the target's, from labelled good documents, and the
raw text's, from all documents. A document's log importance weight sums, over its n-grams, the log ratio of the target's share to the
raw share. The sample is a Gumbel top-k: every document's weight gets Gumbel noise drawn from its id, and the
k largest keys stay, which samples k documents without replacement in proportion to the ``SHARPNESS``-th power of their weights (2: sharper than the weights themselves, so
that a document far above the cut is hardly ever lost to the noise).

Three adjustments make the weight fit for filtering texts of very different lengths. Each n-gram counts once a document (one long or
repetitive document says no more than another). Counts are shrunk towards the raw model, and a ratio of either sign counts only where it is large
and the target's count differs from what the raw model expects by more than chance. Of a group of copies (equal in two min-hashes of their three-word shingles) that is large enough
to make its own words look rare in the target by itself, one document counts, in both models. So a document of plain words weighs the same at any length. k is the number of
documents whose weight reaches the cut that separates the labelled sample best; labels of rejected documents serve for that cut alone.

Every n-gram is hashed three times, and the ratio nearest to zero of its buckets counts: a rare word that shares a bucket with a word that tells is
not taken for it.

Bounds: the models have ``6 * buckets`` numbers each (unigrams and bigrams, three hashes); the labelled sample has at most about ``max_labelled`` rows (drawn by a hash of the id);
the groups of copies that are told to all tasks have over ``2 * documents / target documents`` members each, so they are at most half as many as the target's documents;
all counts, weights, the cut's rank and the k-th key cover all documents. A text is taken whole by one task, some 100 bytes a byte of text.

Rows: null text is empty (weight 0: kept); null ids all share one draw of noise, have no label, and do not stand for a group of copies; repeated rows count each; rows of equal keys at the k-th place
all stay; a table without any usable label, or of one class only, keeps every document; labels with null columns are not used, and a document labelled twice is good if it always is; extra columns are kept whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_parts, fresh_names, mix, prefix_hash, run_hash, slices, staged, tasks_of, text_column, tidy

BUCKETS, HASHES, MAX_LABELLED = 1 << 18, 3, 200_000
#: Pseudo-counts by which target counts are shrunk towards the raw model; log ratios and standard deviations below which an n-gram says nothing.
SHRINK, DEAD_ZONE, DEVIATIONS = 2.0, 1.2, 3.0
#: Gumbel noise is divided by this before it is added to log weights.
SHARPNESS, SEED = 2.0, 7
#: Stands for no id; no document has it.
NOBODY = (1 << 63) - 1
#: Classes of bytes: 0 white space, 1 letters, digits and bytes of other scripts, 2 the rest.
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_CLASS = np.array([0 if chr(c) in " \t\n\r\x0b\x0c" else 1 if c >= 128 or chr(c).isalnum() else 2 for c in range(256)], np.uint8)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word of the concatenated texts."""
    start0, end0 = int(offsets[0]), int(offsets[-1])
    data, bounds = data[start0:end0], offsets - start0
    kind = _CLASS[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[bounds] = True
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    real = kind[start] > 0
    start, end = start[real], end[real]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return run_hash(prefix_hash(_LOWER[data]), start, end), np.searchsorted(bounds, start, side="right") - 1


def signatures(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Two min-hashes of each text's three-word shingles as one number, likely shared by near copies only; of its words where they are fewer, 0 without any."""
    signs = np.zeros(n, np.uint64)
    if not len(h):
        return signs.view(np.int64)
    odd = np.uint64(0xA24BAED4963EE407)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    last = np.append(first[1:], len(doc)) - 1
    signs[doc[first]] = mix(h[first] * odd + h[last])  # for one or two words
    at = np.flatnonzero(doc[2:] == doc[:-2])
    if len(at):
        x = mix((h[at] * odd + h[at + 1]) * odd + h[at + 2])
        of = doc[at]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        signs[of[first]] = mix(np.minimum.reduceat(x, first) * odd + np.minimum.reduceat(mix(x ^ odd), first))
    return signs.view(np.int64)


def features(h: np.ndarray, doc: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(HASHES buckets, document) of each distinct n-gram of each text, given its words.

    Buckets: unigrams' by the first hash, bigrams' by the first, unigrams' by the second, and so on; ``buckets`` each, a power of two up to 2**18."""
    if not len(h):
        return np.zeros((HASHES, 0), np.int64), np.zeros(0, np.int64)
    two = doc[1:] == doc[:-1]
    pair = mix(h[:-1] * np.uint64(0xA24BAED4963EE407) + h[1:])[two]
    bits = buckets.bit_length() - 1
    packed = []  # document, kind, first and second bucket in one number
    for k, (x, of) in enumerate(((h, doc), (pair, doc[1:][two]))):
        both = (x >> np.uint64(64 - 2 * bits)).astype(np.int64)
        packed.append(((of * 2 + k) << (2 * bits)) | both)
    key = np.sort(np.concatenate(packed))
    key = key[np.append(True, key[1:] != key[:-1])]
    both = key & ((1 << 2 * bits) - 1)
    third = (mix(both + 1) >> np.uint64(64 - bits)).astype(np.int64)  # n-grams that share one of the others only part here
    which = (key >> (2 * bits)) & 1
    return np.stack([(2 * j + which) * buckets + x for j, x in enumerate((both >> bits, both & (buckets - 1), third))]), key >> (2 * bits + 1)


def _labelled(labels: DataFrame, most: int, id_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids of the good and of the other documents in the bounded sample."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    usable = usable.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
    n = usable.count()
    if n > most:
        usable = usable.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 31)) < int(most / n * (1 << 31)))
    rows = usable.toArrow()  # about ``most`` rows
    ids, good = rows["id"].to_numpy(), rows["good"].to_numpy()
    return np.sort(ids[good == 1]), np.sort(ids[good == 0])


def _is_in(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(ids), bool)
    return table[np.minimum(np.searchsorted(table, ids), len(table) - 1)] == ids


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def large_groups(given: DataFrame, n_docs: int, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, id that counts) of the groups of copies whose words the target would be expected to have at least twice. A labelled document counts first."""
    if not len(good):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sample = given.sparkSession.sparkContext.broadcast(good)

    @tidy
    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, offsets = binary_parts(b.column(1))
            signs = [signatures(*words(data, offsets[s : e + 1]), e - s) for s, e in slices(np.diff(offsets))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(signs)), pa.array(~_is_in(_ids(b.column(0)), sample.value))], ["id", "sign", "other"])

    each = given.mapInArrow(sign, "id long, sign long, other boolean").groupBy("sign")
    each = each.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("other", "id"))).alias("first"))
    rows = each.where(F.col("n") >= max(2.0, 2 * n_docs / len(good))).select("sign", F.coalesce("first.id", F.lit(NOBODY)).alias("id")).toArrow()  # half as many as good documents at most
    signs, ids = (rows[c].to_numpy() for c in ("sign", "id"))
    order = np.argsort(signs)
    return signs[order], ids[order]


def counts(docs: DataFrame, good: np.ndarray, id_col: str, text_col: str, buckets: int = BUCKETS) -> np.ndarray:
    """Documents that have each n-gram bucket: of all, and of the target."""
    blocks, spark = 64, docs.sparkSession
    size = 2 * HASHES * buckets
    width = size // blocks
    given = docs.select(F.col(id_col).cast("long").alias("id"), text_column(docs, text_col).cast("binary").alias("t"))
    large = large_groups(given, docs.count(), good)
    sample = spark.sparkContext.broadcast((good, *large))

    @tidy
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = (np.zeros(size, np.int64) for _ in range(2))
        chosen, signs, firsts = sample.value
        for b in it:
            data, offsets = binary_parts(b.column(1))
            ids = _ids(b.column(0))
            is_good = _is_in(ids, chosen)
            for s, e in slices(np.diff(offsets)):
                h, doc = words(data, offsets[s : e + 1])
                if len(signs):
                    mine = signatures(h, doc, e - s)
                    at = np.minimum(np.searchsorted(signs, mine), len(signs) - 1)
                    counted = (signs[at] != mine) | (firsts[at] == ids[s:e])
                    h, doc = h[counted[doc]], doc[counted[doc]]
                found, doc = features(h, doc, buckets)
                good_ones = is_good[s:e][doc]
                for bucket in found:
                    raw += np.bincount(bucket, minlength=size)
                    target += np.bincount(bucket[good_ones], minlength=size)
        if raw.any():
            for k in range(blocks):
                part = np.stack([x[k * width : (k + 1) * width] for x in (raw, target)])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["block", "counts"])

    @tidy
    def total(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in it:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(x.as_py()), np.int64).reshape(2, width)
                have = sums.setdefault(k, np.zeros((2, width), np.int64))
                have += part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    out = np.zeros((2, size), np.int64)
    for row in given.mapInArrow(count, schema).repartition(blocks, "block").mapInArrow(total, schema).collect():  # 2 * HASHES * buckets numbers of two kinds, whatever the input
        out[:, row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(row["counts"], np.int64).reshape(2, width)
    return out


def log_ratios(found: np.ndarray, shrink: float = SHRINK, dead_zone: float = DEAD_ZONE, deviations: float = DEVIATIONS) -> np.ndarray:
    """Log ratio of the target's to the raw share of each bucket of :func:`counts`, zero where it is small or within chance."""
    buckets = found.shape[1] // (2 * HASHES)
    out = np.zeros(2 * HASHES * buckets)
    for half in (slice(k * buckets, (k + 1) * buckets) for k in range(2 * HASHES)):
        raw, target = (x[half].astype(float) for x in found)
        if target.sum():
            expected = raw * (target.sum() / raw.sum())
            r = np.log((target + shrink) / (expected + shrink))
            out[half] = np.where((np.abs(r) > dead_zone) & (np.abs(expected - target) > deviations * np.sqrt(expected + 1)), r, 0)
    return out


def weights(h: np.ndarray, doc: np.ndarray, n: int, ratio: np.ndarray) -> np.ndarray:
    """Log importance weight of each of ``n`` texts, given their words."""
    found, doc = features(h, doc, len(ratio) // (2 * HASHES))
    r = ratio[found]
    return np.bincount(doc, r[np.abs(r).argmin(0), np.arange(r.shape[1])], minlength=n)


def with_log_weight(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", only_id: bool = False, names: tuple[str, str] = ("__log_weight", "__key")) -> DataFrame:
    """``docs`` with its log weight and key under ``names``; with ``only_id`` just (id, __log_weight, __key)."""
    model = docs.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))
    rest = [] if only_id else docs.columns
    cols = [F.col(id_col).cast("long").alias("id"), text_column(docs, text_col).cast("binary").alias("__bytes"), *(F.col(c).alias(f"__c{i}") for i, c in enumerate(rest))]
    given = docs.select(*cols)

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, offsets = binary_parts(b.column(1))
            weight = np.zeros(b.num_rows)
            for s, e in slices(np.diff(offsets)):
                weight[s:e] = weights(*words(data, offsets[s : e + 1]), e - s, model.value)
            keep = [i for i in range(b.num_columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(weight)], [*(b.schema.names[i] for i in keep), "__w"])

    out = T.StructType([f for f in given.schema.fields if f.name != "__bytes"] + [T.StructField("__w", T.DoubleType())])
    scored = given.mapInArrow(run, out)
    u = (F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    key = F.col("__w") - F.log(-F.log(u)) / SHARPNESS
    back = [F.col("id")] if only_id else [F.col(f"__c{i}").alias(c) for i, c in enumerate(rest)]
    return scored.select(*back, F.col("__w").alias(names[0]), key.alias(names[1]))


def kth_largest(df: DataFrame, col: str, k: int) -> float:
    """The exact k-th largest value of a finite double column, by counting passes over ever narrower ranges; ``df`` should be written already."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    above, bins = 0, 1024
    for _ in range(12):
        if low == high:
            return low
        width = (high - low) / bins
        if not width or low + width == low:
            break
        inside = df.where((F.col(col) >= low) & (F.col(col) <= high))
        slot = F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1)).cast("int")
        counts = inside.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()  # bins rows at most
        for row in sorted(counts, key=lambda r: -r["slot"]):
            if above + row["n"] >= k:
                low, high = row["lo"], row["hi"]
                break
            above += row["n"]
        if row["n"] == 1:
            return low
    return low


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut (kept: at or above) with the best mean of the good documents kept and the others rejected."""
    order = np.argsort(-scores, kind="stable")
    s, g = scores[order], good[order]
    gain = np.cumsum(g) / max(1, g.sum()) - np.cumsum(~g) / max(1, (~g).sum())
    last = np.append(s[1:] != s[:-1], True)
    at = np.flatnonzero(last)[np.argmax(gain[last])]
    return float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else float(s[at])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, buckets: int = BUCKETS, k: int | None = None) -> tuple[np.ndarray, float, DataFrame]:
    """(ratios, key of the last kept, written scores (id, __log_weight, __key)); ``k`` overrides the number kept."""
    good, bad = _labelled(labels, max_labelled, id_col)
    ratio = log_ratios(counts(docs, good, id_col, text_col, buckets))
    scores = staged(with_log_weight(docs, ratio, id_col, text_col, only_id=True), "scores")
    if k is None:
        if not len(good) or not len(bad):
            return ratio, float("-inf"), scores
        chosen = docs.sparkSession.sparkContext.broadcast((good, bad))

        @tidy
        def pick(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                ids = _ids(b.column(0))
                is_good = _is_in(ids, chosen.value[0])
                known = is_good | _is_in(ids, chosen.value[1])
                yield pa.RecordBatch.from_arrays([pa.array(b.column(1).to_numpy(zero_copy_only=False)[known]), pa.array(is_good[known]), pa.array(ids[known])], ["w", "good", "id"])

        seen = scores.select("id", "__log_weight").mapInArrow(pick, "w double, good boolean, id long").groupBy("id").agg(F.min("w").alias("w"), F.first("good").alias("good")).toArrow()  # a row for each of the sample's ids
        if not seen.num_rows:
            return ratio, float("-inf"), scores
        cut = best_cut(seen["w"].to_numpy(), seen["good"].to_numpy())
        k = scores.where(F.col("__log_weight") >= cut).count()
    return ratio, kth_largest(scores, "__key", k) if k else float("inf"), scores


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The sampled documents with all their columns: weights are computed again on the rows instead of joining texts."""
    ratio, least, _ = fit(docs, labels, id_col, text_col, **kw)
    weight, key = fresh_names(docs, 2)
    return with_log_weight(docs, ratio, id_col, text_col, names=(weight, key)).where(F.col(key) >= least).select(*(F.col(f"`{c}`") for c in docs.columns))
