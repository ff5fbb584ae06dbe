"""Access to ``triples(s, p, o, o_kind, p_local)``: extents, literal maps, neighbours, priorities."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import dealt, shared_folder


def scan(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    for col, value in (("s", s), ("p_local", p), ("o", o)):
        triples = triples if value is None else triples.where(F.col(col) == value)
    return triples


def class_extent(triples: DataFrame, cls: str) -> DataFrame:
    """Named nodes of a class; blank nodes do not count."""
    return triples.where((F.col("p_local") == "type") & F.col("o").endswith(cls) & (F.regexp_extract("o", r"([^#/:]*)$", 1) == cls) & ~F.col("s").startswith("_:")).select(F.col("s").alias("node")).distinct()


def types(triples: DataFrame) -> DataFrame:
    """(node, cls): a row for each class of each named node, by local name."""
    return triples.where((F.col("p_local") == "type") & ~F.col("s").startswith("_:")).select(F.col("s").alias("node"), F.regexp_extract("o", r"([^#/:]*)$", 1).alias("cls")).distinct()


def of_type(nodes: DataFrame, triples: DataFrame, *classes: str) -> DataFrame:
    """The rows of ``nodes(node, ..)`` whose node has one of the classes."""
    return nodes.join(types(triples).where(F.col("cls").isin(*classes)).select("node"), "node", "left_semi")


def aliases(triples: DataFrame, keys: list[str], style: str | None = None) -> DataFrame:
    """(s, alias): all distinct names; with ``style`` also those of that key (courtesy names, which some analyses count)."""
    return distinct_literals(triples, [*keys, *([style] if style else [])]).withColumnRenamed("value", "alias")


def literals(triples: DataFrame) -> DataFrame:
    bare = F.trim("o")
    return triples.where((F.col("o_kind") == "lit") & (bare != "")).select("s", "p_local", bare.alias("o"))


def literal_map(triples: DataFrame) -> DataFrame:
    """(s, props map<string, array<string>>), values sorted."""
    each = literals(triples).groupBy("s", "p_local").agg(F.array_sort(F.collect_set("o")).alias("vals"))
    return each.groupBy("s").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("p_local", "vals")))).alias("props"))


def _priority(keys: list[str]) -> Column:
    out = F.lit(None).cast("int")
    for k, key in reversed(list(enumerate(keys))):
        out = F.when(F.col("p_local") == key, k).otherwise(out)
    return out


def first_literal(triples: DataFrame, keys: list[str], fallback: bool = False) -> DataFrame:
    """(s, value): of the first key with a literal, the least one; with ``fallback`` of any predicate where no key has one."""
    found = literals(triples).withColumn("prio", _priority(keys))
    if fallback:
        found = found.withColumn("prio", F.coalesce("prio", F.lit(len(keys))))
    return found.where("prio is not null").groupBy("s").agg(F.min(F.struct("prio", "o"))["o"].alias("value"))


def distinct_literals(triples: DataFrame, keys: list[str]) -> DataFrame:
    return literals(triples).where(F.col("p_local").isin(keys)).select("s", F.col("o").alias("value")).distinct()


def neighbours(triples: DataFrame) -> DataFrame:
    """(node, other): named objects and subjects one hop away, in either direction."""
    edges = triples.where("o_kind = 'iri'").select("s", "o")
    return edges.select(F.col("s").alias("node"), F.col("o").alias("other")).union(edges.select("o", "s")).distinct()


def display_name(nodes: DataFrame, triples: DataFrame, keys: list[str]) -> DataFrame:
    """(node, name): the first name literal, else the local name."""
    names = first_literal(triples, keys).withColumnRenamed("s", "node")
    return nodes.join(names, "node", "left").select("node", F.coalesce("value", F.regexp_extract("node", r"([^#/:]*)$", 1)).alias("name"))


def attribute_row(triples: DataFrame, keys: list[str], fallbacks: dict[str, str] | None = None) -> DataFrame:
    """One row per subject, one column per key (its least literal); ``fallbacks`` names the column that stands in.

    The literals are dealt by subject before they are grouped: grouped where they are read, a task would sort all that its part of a file holds."""
    fallbacks = fallbacks or {}
    every = [*dict.fromkeys([*keys, *fallbacks.values()])]
    wide = dealt(literals(triples).where(F.col("p_local").isin(every)), "s").groupBy("s").pivot("p_local", every).agg(F.min("o"))
    return wide.select("s", *(F.coalesce(k, fallbacks[k]).alias(k) if k in fallbacks else F.col(k) for k in keys))


# What is shown of a position, in this order; codes are hidden unless asked for. What names a position.
POSITION_KEYS = ["核心职称", "层级", "机构", "职系", "修饰_方位", "修饰_副", "地名", "对齐码_core", "对齐码_inst", "对齐码_tier", "对齐码_loc_core", "对齐码_loc_inst", "对齐码_loc_full", "原始称谓", "官职名称"]
CODE_PREFIX = "对齐码_"
POSITION_NAMES = ["官职名称", "原始称谓", "label"]
# The dimensions by which positions are counted.
POSITION_DIMENSIONS = ["职系", "机构", "核心职称", "层级", "官阶", "地名", "对齐码_core", "对齐码_inst", "对齐码_tier", "对齐码_loc_core", "对齐码_loc_inst", "对齐码_loc_full"]


def position_details(triples: DataFrame, codes: bool = False) -> DataFrame:
    """(s, ord, key, value) rows of positions."""
    return key_values(triples, POSITION_KEYS, None if codes else CODE_PREFIX)


def position_names(positions: DataFrame, triples: DataFrame) -> DataFrame:
    """``positions(node)`` -> (node, name): the first that there is of the official name, the original title and the label, else a dash."""
    names = first_literal(triples, POSITION_NAMES).withColumnRenamed("s", "node")
    return positions.join(names, "node", "left").select("node", F.coalesce("value", F.lit("—")).alias("name"))


def position_rows(triples: DataFrame) -> DataFrame:
    """One row per position with a column for each dimension and name; the level falls back to the general level, the original title to the official name."""
    keys = [*POSITION_DIMENSIONS, "原始称谓", "官职名称", "修饰_方位", "修饰_副", "通用层级"]
    return attribute_row(triples, keys, {"层级": "通用层级", "原始称谓": "官职名称"})


def key_values(triples: DataFrame, keys: list[str], hide_prefix: str | None = None) -> DataFrame:
    """(s, ord, key, value) rows in the keys' order. Rows are dealt before repeated ones are dropped, so that a task holds a bounded number."""
    keys = [k for k in keys if not hide_prefix or not k.startswith(hide_prefix)]
    rows = literals(triples).withColumn("ord", _priority(keys)).where("ord is not null").select("s", "ord", F.col("p_local").alias("key"), F.col("o").alias("value"))
    return dealt(rows, "s", "ord", "value").distinct()


class Layout:
    """Triples written by predicate, within a predicate bucketed and sorted by subject, so that a pattern reads its predicate's files only and patterns that share a subject join without a shuffle.

    ``where`` is a folder that driver and executors share; without it, one under ``spark.checkpoint.dir``. The bucketed tables are external ones of the session's catalog, one for each predicate that is asked for."""

    def __init__(self, triples: DataFrame, where: str | None = None, buckets: int = 8):
        self.spark, self.buckets = triples.sparkSession, buckets
        self.where = where or f"{shared_folder(self.spark)}/quillgraph/triples-{uuid.uuid4().hex[:12]}"
        triples.select("p_local", "s", "o", "o_kind").write.partitionBy("p_local").parquet(f"{self.where}/by-predicate")
        self.all = self.spark.read.parquet(f"{self.where}/by-predicate")
        self.sizes = {r["p_local"]: r["n"] for r in self.all.groupBy("p_local").agg(F.count(F.lit(1)).alias("n")).collect()}  # a vocabulary of predicates
        self._tables: dict[str, str] = {}

    def predicate(self, p: str) -> DataFrame:
        """(s, o) of a predicate, bucketed and sorted by subject."""
        if p not in self._tables:
            name = f"triples_{uuid.uuid4().hex[:16]}"
            rows = self.all.where(F.col("p_local") == p).select("s", "o")
            rows.write.bucketBy(self.buckets, "s").sortBy("s").option("path", f"{self.where}/{name}").saveAsTable(name)
            self._tables[p] = name
        return self.spark.table(self._tables[p])

    def match(self, patterns: list[tuple[str, str, str]]) -> DataFrame:
        """A row for each way to fill the variables (words that begin with ``?``) of all patterns (subject, predicate, object).

        The smallest predicate comes first; then, of the patterns that share a variable with those before, one that shares its subject, then the smallest. Patterns without any common variable are refused."""
        left = sorted(patterns, key=lambda x: (self.sizes.get(x[1], 0), x))
        out, bound = None, set()
        while left:
            shared = [x for x in left if out is None or bound & {v for v in (x[0], x[2]) if v.startswith("?")}]
            if not shared:
                raise ValueError(f"no variable of {left[0]} stands in the patterns before it")
            mine = shared[0] if out is None else min(shared, key=lambda x: (x[0] not in bound, self.sizes.get(x[1], 0), x))
            left.remove(mine)
            s, p, o = mine
            rows = self.predicate(p)
            for column, word in (("s", s), ("o", o)):
                if not word.startswith("?"):
                    rows = rows.where(F.col(column) == word)
            if s == o and s.startswith("?"):
                rows = rows.where("s = o")
            names = {word[1:]: F.col(column) for column, word in (("o", o), ("s", s)) if word.startswith("?")}
            rows = rows.select(*(c.alias(n) for n, c in names.items()))
            out = rows if out is None else out.join(rows, [n for n in names if "?" + n in bound])
            bound |= {"?" + n for n in names}
        return out
