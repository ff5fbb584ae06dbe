"""Audit of how document filters interact, by inclusion-exclusion over joint failures.

Each document gets one flag per filter. For every one of the 2**n sets of filters the documents that fail all of its filters are counted, as sums of flag products; these joint-failure counts are
all that is kept of the documents. What a set of filters removes is their alternating sum over its subsets (Moebius inversion), and from it follow survivors and removals in any order of application, failures
of one filter alone, redundancy, and Shapley values: the joint failure of a set is, up to its sign, the set's Harsanyi dividend, which its filters share equally.

The filters of ``FILTERS``, over whole texts, null as empty, words being maximal runs without ASCII white space, case-sensitive: A too few words, B too many repeated words, C too many capitals, D symbols, E the same text
(by 256 bits of hash) as a document with a smaller id, anywhere in the table. Documents of a text are counted before they meet, so a text that a third of the table repeats costs what others do.

Rows: a null text is empty; a null id is never a later copy, makes none and has no label; rows that repeat an id are documents of their own, copies only of smaller ids; a null language is the part ``''``. Of several labels of an id, one that says so
is enough. Extra columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_column, tidy

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 100, 80, 10
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes that do not begin a code point.
CONTINUATION = bytes(range(0x80, 0xC0))
#: Bytes of text whose words are held at once.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: What is counted of the documents: all, those labelled good, those labelled toxic.
COUNTED = ("n", "good", "toxic")


def _word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words, a piece of the text at a time, cut at white space."""
    n, distinct, at = 0, set(), 0
    while at < len(text):
        stop = at + PIECE
        if stop < len(text) and (space := _SPACE.search(text, stop)):
            stop = space.start()
        elif stop < len(text):
            stop = len(text)
        words = text[at:stop].split()  # of bytes: at the six ASCII spaces only
        n += len(words)
        distinct.update(words)
        at = stop
    return n, len(distinct)


def failed_alone(text: bytes) -> int:
    """Bits of the filters that need the document alone."""
    n, distinct = _word_counts(text)
    chars = len(text.translate(None, CONTINUATION))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    fails = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT_PERCENT * n, 100 * capitals > MOST_CAPITALS_PERCENT * chars, len(text.translate(None, SYMBOLS)) < len(text))
    return sum(1 << k for k, f in enumerate(fails) if f)


def document_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, text_key, failed): ``failed`` has the bits of the filters that need the document alone."""

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [t.as_buffer().to_pybytes() for t in b.column(2)]
            keys = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), keys, pa.array([failed_alone(t) for t in texts], pa.int32())], ["id", "part", "text_key", "failed"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_column(docs, text_col).alias("t"))
    return rows.mapInArrow(run, "id long, part string, text_key binary, failed int")


def label_flags(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, good long, toxic long), one row per id."""
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))


def failures(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents of each part by the exact set of filters they fail, copies included."""
    counted = flags.join(label_flags(labels), "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    add = [F.sum(c).alias(c) for c in COUNTED]
    each = counted.withColumn("n", F.lit(1)).groupBy("id", "text_key", "part", "failed").agg(*add)
    # a text's documents in a part: all, and those with the smallest id
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", *COUNTED))).alias("first")
    nameless = [F.sum(F.when(F.col("id").isNull(), F.col(c)).otherwise(0)).alias(f"no_{c}") for c in COUNTED]
    texts = each.groupBy("text_key", "part", "failed").agg(*add, first, *nameless)
    least = F.min("first.id").over(Window.partitionBy("text_key"))  # over a text's parts, not its documents
    kept = [(F.col(f"no_{c}") + F.when(F.col("first.id") == F.col("least"), F.col(f"first.{c}")).otherwise(0)).alias(c) for c in COUNTED]
    split = texts.withColumn("least", least).select("part", "failed", *COUNTED, F.struct(*kept).alias("kept"))
    copy = F.lit(1 << FILTERS.index("E"))
    both = F.array(F.struct("failed", *(F.col(f"kept.{c}").alias(c) for c in COUNTED)), F.struct((F.col("failed") + copy).alias("failed"), *((F.col(c) - F.col(f"kept.{c}")).alias(c) for c in COUNTED)))
    return split.select("part", F.explode(both).alias("x")).select("part", "x.*").groupBy("part", "failed").agg(*add)


def joint_failures(counts: DataFrame) -> DataFrame:
    """(part, n, good, toxic), each an array with, for every set of filters in the order of its bits, the documents that fail all of them."""
    flag = [F.col("failed").bitwiseAND(1 << k).cast("boolean").cast("long") for k in range(len(FILTERS))]

    def product(s: int, c: str) -> Column:
        out = F.col(c)
        for k, f in enumerate(flag):
            if s >> k & 1:
                out = out * f
        return F.sum(out)

    return counts.groupBy("part").agg(*(F.array(*(product(s, c) for s in range(1 << len(FILTERS)))).alias(c) for c in COUNTED))


def audit(joint: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    subsets = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))
    sign = lambda s: F.when(F.bit_count(s) % 2 == 1, 1).otherwise(-1)
    total = lambda js, weight: F.aggregate(F.transform(subsets, lambda s: js[s] * weight(s)), F.lit(0).cast("long"), lambda a, b: a + b)
    # Harsanyi dividends of "removed by a set": the joint failures with alternating signs, none for the empty set
    removed_by = lambda js, of: total(js, lambda s: F.when((s > 0) & (s.bitwiseAND(of) == s), sign(s)).otherwise(0))
    n_orders = 1
    for k in range(2, len(FILTERS) + 1):
        n_orders *= k
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    bit = lambda letter: F.pow(F.lit(2), F.ascii(letter) - F.lit(ord(FILTERS[0]))).cast("int")
    steps = joint.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    mine = bit(F.substring("filter_order", F.col("step"), F.lit(1)))
    before = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda a, k: a + F.when(k < F.col("step"), bit(F.substring(F.col("filter_order"), k, F.lit(1)))).otherwise(0))
    steps = steps.withColumns({"mine": mine, "before": before}).withColumn("after", F.col("mine") + F.col("before"))
    removed = {c: removed_by(F.col(c), F.col("after")) - removed_by(F.col(c), F.col("before")) for c in COUNTED}
    holds = lambda s: s.bitwiseAND(F.col("mine")) > 0
    unique = total(F.col("n"), lambda s: F.when(holds(s), sign(s)).otherwise(0))
    shapley = total(F.col("n"), lambda s: F.when(holds(s), sign(s) * (F.lit(n_orders) / F.bit_count(s)).cast("long")).otherwise(0))
    return steps.select(
        "part", "filter_order", "step",
        (F.col("n")[0] - removed_by(F.col("n"), F.col("after"))).alias("kept"),
        removed["n"].alias("removed"),
        (F.col("n")[F.col("mine")] - removed["n"]).alias("redundant"),
        unique.alias("unique_fails"), removed["good"].alias("good_lost"), removed["toxic"].alias("toxic_lost"), shapley.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return audit(joint_failures(failures(document_flags(docs, id_col, text_col, part_col), labels)))
