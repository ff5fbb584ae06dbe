"""Provenance, person search, spans of extracted entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def provenance_paths(contains: DataFrame, about: DataFrame, derived: DataFrame) -> DataFrame:
    """(node, tp): text provenance that contains a node, or from which an assertion about it is derived."""
    by_assertion = about.join(derived, "pa").select("node", "tp")
    return contains.select("node", "tp").union(by_assertion).distinct()


def provenance_items(rows: DataFrame, src: Column, body: Column, *items: Column | str) -> DataFrame:
    """(g_src, g_body, items): a row for each distinct item of a group, whether label, examination or property and value."""
    return rows.select(src.alias("g_src"), body.alias("g_body"), *items).distinct()


def provenance_groups(rows: DataFrame, src: Column, body: Column, conf: str, item: Column | str) -> DataFrame:
    """One row per source and body (given as they are, or in normal form): the numerically largest confidence (non-numbers lose) and the number of distinct items.

    The items themselves are :func:`provenance_items`: a group may have any number of them."""
    keyed = rows.select(src.alias("g_src"), body.alias("g_body"), F.col(conf).alias("conf"), (F.col(item) if isinstance(item, str) else item).alias("item"))
    number = F.coalesce(F.col("conf").try_cast("double"), F.lit(float("-inf")))
    return keyed.groupBy("g_src", "g_body").agg(F.max(F.when(F.col("conf").isNotNull(), F.struct(number.alias("n"), "conf")))["conf"].alias("conf"), F.countDistinct("item").alias("items"))


def groups_with(groups: DataFrame, items: DataFrame, **wanted: str) -> DataFrame:
    """The groups that have an item with the given values, as chosen by a user."""
    hits = items
    for column, value in wanted.items():
        hits = hits.where(F.col(column) == value)
    keys = ["g_src", "g_body"]
    return groups.join(hits.select(*keys).distinct(), keys, "left_semi")


def with_fallback(rows: DataFrame, key: str, strict: Column, loose: Column) -> DataFrame:
    """Rows that pass ``strict``; for keys without any, those that pass ``loose``, flagged. Only keys are shuffled to tell them, aggregated first."""
    marked = rows.where(loose).withColumn("__strict", strict)
    have = marked.where("__strict").select(F.col(key).alias("__key")).distinct()
    hits = marked.where("__strict").withColumn("fallback", F.lit(False))
    rest = marked.where(~F.coalesce("__strict", F.lit(False))).join(have, F.col(key) == F.col("__key"), "left_anti").withColumn("fallback", F.lit(True))
    return hits.unionAll(rest).drop("__strict")


def search(names: DataFrame, query: str, name: str, node: str, most: int | None = 30, normal: bool = True) -> DataFrame:
    """(node, name, reason) of a typed query: names that equal it, and names that contain it, in normal form (which converts no script); one row a node, the first spelling of the better reason, sorted by name, the first ``most``.

    ``names`` has a row for each alias."""
    form = text.norm if normal else (lambda c: c)
    q, n = form(F.lit(query)), form(F.col(name))
    hits = names.withColumn("__r", F.when(n == q, 0).when(F.instr(n, q) > 0, 1)).where("__r is not null")
    best = hits.groupBy(F.col(node).alias("node")).agg(F.min(F.struct("__r", F.col(name).alias("name"))).alias("b"))
    out = best.select("node", "b.name", F.when(F.col("b.__r") == 0, "等值").otherwise("包含").alias("reason"))
    return out.orderBy("name", "node").limit(most) if most else out


def decoded_spans(head: DataFrame, tail: DataFrame, first: float = 0.4, later: float = 0.7) -> DataFrame:
    """``head(line_id, type_idx, pos, delta, p)``, ``tail(line_id, pos, p)`` -> (line_id, type_idx, start, length): both ends over the threshold, which is lower at delta 0."""
    cut = F.when(F.col("delta") == 0, first).otherwise(later)
    t = tail.select("line_id", F.col("pos").alias("end_pos"), F.col("p").alias("tail_p"))
    h = head.withColumn("end_pos", F.col("pos") + F.col("delta")).withColumn("cut", cut).where("p > cut")
    return h.join(t, ["line_id", "end_pos"]).where("tail_p > cut").select("line_id", "type_idx", F.col("pos").alias("start"), (F.col("delta") + 1).alias("length"))


def cleaned_entities(entities: Column) -> Column:
    """If any entity lies in another element (an equal one included), only those that do, by first index; else all, distinct, in order."""
    inner = F.filter(entities, lambda e, i: F.exists(F.transform(entities, lambda x, j: x.contains(e) & (i != j)), lambda b: b))
    return F.when(F.size(inner) > 0, F.array_distinct(inner)).otherwise(F.array_distinct(entities))


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds ``step``: each row's place, from 1, among its key's in the given order (a sort that spills; no group is held in memory)."""
    return rows.withColumn("step", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def grouped_entities(spans: DataFrame, vocabulary: DataFrame, labels: dict[str, str]) -> DataFrame:
    """``spans(line_id, type_idx, start, text)``, ``vocabulary(idx, label)`` -> (line_id, label, entities), cleaned, in order of place.

    A type without a reading in ``labels`` (code -> name) is dropped. Vocabularies have some tens of rows."""
    readings = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    named = vocabulary.select(F.col("idx").alias("type_idx"), F.try_element_at(readings, F.col("label")).alias("name")).where("name is not null")
    each = spans.join(named, "type_idx").groupBy("line_id", "name").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("xs"))
    return each.select("line_id", F.col("name").alias("label"), cleaned_entities(F.col("xs.text")).alias("entities"))
