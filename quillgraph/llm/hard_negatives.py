"""Hard negatives by branch and bound over ball trees, one tree per partition of the rows.

Components are made integers, ``floor(256 * x)``, and a row's score for an anchor is the integer inner product of the two. An anchor's positives are its ``positives`` best other rows of the same label; the negatives of an
anchor and a positive are the ``negatives`` best rows of other labels whose scores lie in a window given by the positive's.

Rows are dealt to partitions by a hash, whatever their labels, so that no label, however common, makes a large one. Every task builds a tree over its partition: labels with many rows have a subtree each, the others share
one, and nodes are halved across their longest diameter. A node's centre and radius bound the inner products of its rows with an anchor from above and below. Anchors come to a task in blocks, in an order
that needs none of them in memory beyond its block; leaves are visited from the highest upper bound down, and a leaf is skipped for the anchors for which it lies outside the window on either side, or strictly beneath the last of the best
rows found so far (ties may still win by their ids). Only leaves that some anchor needs are scored, exactly. What the partitions found for an anchor, a few rows each, is ranked after a shuffle.

Every anchor meets every partition, so the work before pruning is anchors times rows; anchors are a stated share of the rows. An anchor's row is copied once a partition; a partition has up to ``PARTITION_BYTES`` of components.

Rows: those with a null id or label, a null vector, or a null or non-finite component take no part, nor do those with a component of 2**23 / 256 or more in size, of whose scores a long might not hold the hundredths (vectors of up to 1024 components;
beyond that the bound shrinks with the length). Vectors of different lengths have no score and never meet. Repeated rows are rows of their own, but anchors that repeat an id, label and vector are one, and rows with an anchor's own id are never its positives or
negatives. Ties go to the smaller id. Extra columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, tasks_of, tidy

ANCHORS_EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: A negative's score, as hundredths of its positive's.
WINDOW = (50, 95)
SCALE = 256
#: Bytes of components (eight each) in a partition, and fewest partitions.
PARTITION_BYTES, LEAST_PARTITIONS = 32 << 20, 12
LEAF, ANCHOR_BLOCK = 128, 256
#: Magnitude of integer components for vectors of up to 1024; a hundred times their scores stays below 2**63.
MOST = 1 << 23


class BallTree:
    """Leaves of up to ``LEAF`` rows, each of one label if its label has enough rows, and their bounds."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        order = np.lexsort((ids, labels))
        own, counts = np.unique(labels, return_counts=True)
        alone = own[counts >= LEAF]
        mine = np.isin(labels[order], alone)
        groups = [order[mine & (labels[order] == x)] for x in alone] + ([order[~mine]] if not mine.all() else [])
        leaves: list[np.ndarray] = []
        todo = groups[::-1]
        while todo:
            part = todo.pop()
            if len(part) <= LEAF:
                leaves.append(part)
                continue
            # across the line from the row farthest from the centre to the row farthest from that one
            x = rows[part]
            far = x[np.argmax(((x - x.mean(0)) ** 2).sum(1))]
            other = x[np.argmax(((x - far) ** 2).sum(1))]
            by = np.argsort(x @ (other - far), kind="stable")
            half = len(part) // 2
            todo += [part[by[half:]], part[by[:half]]]
        at = np.concatenate(leaves)
        self.ids, self.labels, self.rows = ids[at], labels[at], rows[at]
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
        self.centres = np.add.reduceat(self.rows, self.starts[:-1]) / np.diff(self.starts)[:, None]
        away = np.sqrt(((self.rows - np.repeat(self.centres, np.diff(self.starts), axis=0)) ** 2).sum(1))
        self.radius = np.maximum.reduceat(away, self.starts[:-1])
        first, last = np.minimum.reduceat(self.labels, self.starts[:-1]), np.maximum.reduceat(self.labels, self.starts[:-1])
        self.only, self.label = first == last, first
        #: Pairs of inner products are whole in double precision up to here.
        self.exact = bool(np.abs(self.rows).max(initial=0.0) ** 2 * max(1, rows.shape[1]) < 2**53)

    def scores(self, leaf: int, anchors: np.ndarray) -> np.ndarray:
        rows = self.rows[self.starts[leaf] : self.starts[leaf + 1]]
        if self.exact and np.abs(anchors).max(initial=0.0) ** 2 * max(1, rows.shape[1]) < 2**53:
            return (anchors @ rows.T).astype(np.int64)
        return anchors.astype(np.int64) @ rows.astype(np.int64).T

    def best(self, anchor: np.ndarray, own: np.ndarray, label: np.ndarray, which: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query, of the anchor at ``which`` with scores from ``low`` to ``high``: (query, id, score) of the best rows of its label or of others."""
        n = len(which)
        norm = np.sqrt((anchor**2).sum(1))
        middle = anchor @ self.centres.T
        slack = norm[:, None] * (self.radius * (1 + 1e-9) + 1e-9 * np.sqrt((self.centres**2).sum(1)))[None, :] + 1e-6
        above, below = (middle + slack)[which], (middle - slack)[which]
        open_ = (above >= low[:, None]) & (below <= high[:, None])
        fits = self.label[None, :] == label[which][:, None]
        open_ &= fits | ~self.only[None, :] if same else ~(fits & self.only[None, :])
        kth = np.full(n, np.iinfo(np.int64).min)
        found: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
        pending = 0
        reach = np.where(open_, above, -np.inf)
        for leaf in np.argsort(-reach.max(0), kind="stable").tolist():
            need = np.flatnonzero(open_[:, leaf] & (above[:, leaf] >= kth))
            if not len(need):
                continue
            a, at = np.unique(which[need], return_inverse=True)
            score = self.scores(leaf, anchor[a])[at]
            here = slice(self.starts[leaf], self.starts[leaf + 1])
            ok = (score >= np.maximum(low, kth)[need][:, None]) & (score <= high[need][:, None]) & (self.ids[here][None, :] != own[which[need]][:, None])
            if not self.only[leaf]:
                ok &= (self.labels[here][None, :] == label[which[need]][:, None]) == same
            i, j = np.nonzero(ok)
            if len(i):
                found.append(np.stack([need[i], self.ids[here][j], score[i, j]]))
                pending += len(i)
                if pending >= n * most:
                    found, kth = [self._first(np.concatenate(found, axis=1), most)], kth.copy()
                    full, count = np.unique(found[0][0], return_counts=True)
                    ends = np.cumsum(count) - 1
                    kth[full[count == most]] = found[0][2][ends[count == most]]
                    pending = 0
        return tuple(self._first(np.concatenate(found, axis=1), most))

    @staticmethod
    def _first(found: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` best of each query: by score, then by id."""
        found = found[:, np.lexsort((found[1], -found[2], found[0]))]
        start = np.flatnonzero(np.diff(found[0], prepend=-1))
        rank = np.arange(found.shape[1]) - np.repeat(start, np.diff(np.append(start, found.shape[1])))
        return found[:, rank < most]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


SEARCH_SCHEMA = "anchor long, own long, query int, found long, score long"


def _search(rows: DataFrame, anchors: DataFrame, same: bool, most: int, parts: int) -> DataFrame:
    """``rows(id, label, v)``; ``anchors(anchor, id, label, v, low array<long>, high array<long>)`` -> the best of every partition for each anchor and window."""
    nothing = F.array().cast("array<long>")
    dealt = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("anchor"), "id", "label", "v", nothing.alias("low"), nothing.alias("high"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "anchor", "id", "label", "v", "low", "high")
    both = dealt.unionAll(asked).withColumn("dim", F.size("v"))

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, gathered, tree = None, [], None
        for batch in it:
            keys = np.stack([batch.column(c).to_numpy() for c in ("part", "dim", "kind")])
            cuts = np.flatnonzero((np.diff(keys) != 0).any(0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if s == e:
                    continue
                part, dim, kind = keys[:, s].tolist()
                if (part, dim) != key:
                    key, gathered, tree = (part, dim), [], None
                piece = batch.slice(s, e - s)
                if kind == 0:
                    gathered.append((piece.column("id").to_numpy(), piece.column("label").to_numpy(), _matrix(piece.column("v"), dim)))
                    continue
                if tree is None and gathered:
                    tree = BallTree(*(np.concatenate(x) for x in zip(*gathered, strict=True)))
                    gathered = []
                for at in range(0, piece.num_rows if tree else 0, ANCHOR_BLOCK):
                    block = piece.slice(at, ANCHOR_BLOCK)
                    low = block.column("low")
                    each = low.value_lengths().to_numpy()
                    which = np.repeat(np.arange(block.num_rows), each)
                    own, name = block.column("id").to_numpy(), block.column("anchor").to_numpy()
                    query, found, score = tree.best(_matrix(block.column("v"), dim), own, block.column("label").to_numpy(), which, low.flatten().to_numpy(), block.column("high").flatten().to_numpy(), same, most)
                    number = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
                    yield pa.RecordBatch.from_arrays([pa.array(name[which[query]]), pa.array(own[which[query]]), pa.array(number[query].astype(np.int32)), pa.array(found), pa.array(score)], ["anchor", "own", "query", "found", "score"])

    return both.repartition(parts, "part").sortWithinPartitions("part", "dim", "kind").mapInArrow(run, SEARCH_SCHEMA)


def _ranked(found: DataFrame, most: int) -> DataFrame:
    by = Window.partitionBy("anchor", "query").orderBy(F.col("score").desc(), "found")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v array<int>) of the rows that take part."""
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * SCALE))
    x = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    most = F.lit(MOST / SCALE) / F.sqrt(F.greatest(F.lit(1.0), F.size(vector_col) / F.lit(1024.0)))
    fine = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < most))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.cast("array<int>").alias("v"))


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchors_every: int = ANCHORS_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """(anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long); anchors are the rows whose id ``anchors_every`` divides."""
    rows = quantised(vectors, id_col, vector_col, label_col)
    size = rows.agg(F.sum(F.size("v").cast("long")).alias("n")).first()["n"] or 0
    parts = tasks_of(8 * size, PARTITION_BYTES, LEAST_PARTITIONS)
    named = rows.where(F.col("id") % anchors_every == 0).distinct().withColumn("anchor", F.xxhash64("id", "label", "v"))
    bound = lambda x: F.array(F.lit(x).cast("long"))
    best = _search(rows, named.select("*", bound(-(1 << 62)).alias("low"), bound(1 << 62).alias("high")), True, positives, parts)
    positive = staged(_ranked(best, positives).select("anchor", "rank", F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    def limit(percent: int, up: bool) -> Column:
        """The scores from, or up to, so many hundredths of the positive's."""
        hundredths = F.col("positive_score") * percent + (99 if up else 0)
        return F.call_function("div", hundredths - F.pmod(hundredths, F.lit(100)), F.lit(100).cast("long"))

    windows = positive.select("anchor", F.struct("rank", limit(window[0], True).alias("low"), limit(window[1], False).alias("high"), "positive_id", "positive_score").alias("w"))
    windows = windows.groupBy("anchor").agg(F.sort_array(F.collect_list("w")).alias("w"))  # ``positives`` at most
    asked = staged(named.join(windows, "anchor"), "windows")
    worst = _search(rows, asked.select("anchor", "id", "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high")), False, negatives, parts)
    ranked = _ranked(worst, negatives).select("anchor", "query", "rank", F.col("own").alias("anchor_id"), F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    given = positive.select("anchor", (F.col("rank") - 1).alias("query"), "positive_id", "positive_score")
    return ranked.join(given, ["anchor", "query"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
