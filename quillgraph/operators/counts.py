"""People counted by place, rank, position, year and era. Rules that look alike but differ have functions of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import ROWS, dealt, settled


def people_per(df: DataFrame, *by: str, person: str = "person_id") -> DataFrame:
    """Distinct people of each bucket; blank buckets do not count."""
    for c in by:
        df = df.where(F.col(c).isNotNull())
    return df.groupBy(*by).agg(F.countDistinct(person).alias("people"))


def rows_per(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def ranked_shares(counts: DataFrame, label: str, n: str = "people") -> DataFrame:
    """Adds rank, share of the total (half-even, four places) and the running sum of those rounded shares, largest first.

    One row per bucket of a report: its total order needs one task, after aggregation."""
    order = Window.orderBy(F.col(n).desc(), F.col(label))
    share = F.bround(F.col(n) / F.sum(n).over(Window.partitionBy()), 4)
    out = counts.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("share", share)
    return out.withColumn("cumulative", F.bround(F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0)), 4))


def shares_in_parts(counts: DataFrame, label: str, n: str = "people") -> DataFrame:
    """As :func:`ranked_shares`, for any number of buckets: rows are dealt to partitions by range, each partition's rows are numbered on their own, and offsets come from the partitions' totals.

    What reaches the driver is a row for each partition; no window spans them."""
    order = [F.col(n).desc(), F.col(label)]
    dealt = settled(counts.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    total = dealt.agg(F.sum(n)).first()[0]
    shared = dealt.withColumn("share", F.bround(F.col(n) / F.lit(total), 4))
    offsets, rows, share = [], 0, 0.0
    for r in shared.groupBy("__part").agg(F.count(F.lit(1)).alias("rows"), F.sum("share").alias("share")).orderBy("__part").collect():
        offsets.append((r["__part"], rows, share))
        rows, share = rows + r["rows"], share + (r["share"] or 0.0)
    before = F.broadcast(counts.sparkSession.createDataFrame(offsets, "__part int, __rows long, __share double"))
    w = Window.partitionBy("__part").orderBy(*order)
    rank = (F.row_number().over(w) + F.col("__rows")).cast("long")
    cumulative = F.bround(F.sum("share").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__share"), 4)
    return shared.join(before, "__part").withColumns({"rank": rank, "cumulative": cumulative}).select(*counts.columns, "rank", "share", "cumulative")


def numbered_in_parts(df: DataFrame, *order: Column | str) -> DataFrame:
    """All rows in the given total order with their ``place`` from 1, numbered in range partitions: :func:`ordered` without its one task. Ties beyond the order may fall either way."""
    dealt = settled(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    offsets, rows = [], 0
    for r in dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("rows")).orderBy("__part").collect():
        offsets.append((r["__part"], rows))
        rows += r["rows"]
    before = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part int, __rows long"))
    place = (F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__rows")).cast("long")
    return dealt.join(before, "__part").withColumn("place", place).drop("__part", "__rows")


def banded(counts: DataFrame, parent: str, n: str = "people") -> DataFrame:
    """Adds the parent's total, by which bands are ordered."""
    return counts.withColumn("parent_total", F.sum(n).over(Window.partitionBy(parent)))


def split_by_conflict(pairs: DataFrame, population: DataFrame, person: str, value: str) -> DataFrame:
    """(person, state): ``conflict`` with two distinct values or more, ``ok`` with one, ``neither`` without."""
    n = pairs.groupBy(person).agg(F.countDistinct(value).alias("n"))
    state = F.when(F.coalesce("n", F.lit(0)) == 0, "neither").when(F.col("n") == 1, "ok").otherwise("conflict")
    return population.join(n, person, "left").select(person, state.alias("state"))


def without_conflicts(df: DataFrame, keys: list[str], value: str, least: int = 2) -> DataFrame:
    """Rows whose key does not hold ``least`` distinct values or more."""
    bad = df.groupBy(*keys).agg(F.countDistinct(value).alias("n")).where(F.col("n") >= least).select(*keys)
    return df.join(bad, keys, "left_anti")


def distinct_and_first(rows: DataFrame, key: str, value: str, n: str = "n", first: str = "first") -> DataFrame:
    """(key, n, first): of each key how many distinct values it has, and the least of them. Null values do not count."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias(n), F.min(value).alias(first))


def conflicted(rows: DataFrame, key: str, value: str, least: int = 2, n: str = "n") -> DataFrame:
    """(key, n): the keys that hold ``least`` distinct values or more."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias(n)).where(F.col(n) >= least)


def options(rows: DataFrame, value: str, option: str = "option") -> DataFrame:
    """(option): the distinct values to choose from, sorted; blank ones are no option."""
    return rows.select(F.col(value).alias(option)).where(F.trim(option) != "").distinct().orderBy(option)


def by_family(rows: DataFrame, families: Column, unknown: str, n: str = "n") -> DataFrame:
    """(family, n): rows of each family that they have, those without any under ``unknown``."""
    return rows.select(F.explode_outer(families).alias("f")).groupBy(F.coalesce("f", F.lit(unknown)).alias("family")).agg(F.count(F.lit(1)).alias(n))


def zero_filled(axis: DataFrame, counts: DataFrame, on: list[str], n: str) -> DataFrame:
    return axis.join(counts, on, "left").fillna({n: 0})


def first_per(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def yearly_share(people: DataFrame, hits: DataFrame) -> DataFrame:
    """``people(year, person_id)``, ``hits(person_id)`` -> (year, den, num, ratio): distinct people, and those among the hits."""
    marked = people.distinct().join(hits.select("person_id", F.lit(True).alias("hit")).distinct(), "person_id", "left")
    out = marked.groupBy("year").agg(F.countDistinct("person_id").alias("den"), F.countDistinct(F.when(F.col("hit"), F.col("person_id"))).alias("num"))
    return out.withColumn("ratio", F.when(F.col("den") > 0, F.col("num") / F.col("den")))


def marked_names(people: DataFrame, by: str, name: str, hit: Column) -> DataFrame:
    """(by, name, hit): a row for each distinct name, hits and others apart, so that no group is held as one value."""
    return people.select(by, F.col(name).alias("name"), F.coalesce(hit, F.lit(False)).alias("hit")).distinct()


def on_axis(axis: DataFrame, domains: list[str], domain: str, counts: DataFrame, on: str, n: str) -> DataFrame:
    """Each domain with every label of the axis, zero where nothing was counted."""
    every = axis.select(F.explode(F.array(*(F.lit(d) for d in domains))).alias(domain), on)
    return every.join(counts, [domain, on], "left").fillna({n: 0}).select(domain, on, n)


def per_dimension(holders: DataFrame, positions: DataFrame, dimensions: list[str], key: str = "position_id", n: int | None = None) -> DataFrame:
    """(dimension, label, people): distinct holders of the positions that share a label, for every dimension; blank labels do not count.

    ``positions`` has the key and a column for each dimension; all are counted in one pass. ``n`` is the number of holders or a bound of it; without it they are counted first.
    Holders meet their positions' labels by the position and are then dealt by the person, so that each task tells its own people apart, a bounded number of labels of them, and only counts are added up."""
    n = holders.count() if n is None else n
    named = F.array(*(F.struct(F.lit(k).alias("dimension"), F.trim(F.col(d)).alias("label")) for k, d in enumerate(dimensions)))
    labels = positions.select(key, F.filter(named, lambda x: x["label"] != "").alias("labels"))
    rows = -(-3 * ROWS // len(dimensions))
    held = dealt(holders.select(key, "person_id"), key, rows=rows, n=n).join(labels.hint("merge"), key).select("person_id", "labels")  # no broadcast: labels are many times their table's size
    each = dealt(held, "person_id", rows=rows, n=n).select("person_id", F.explode("labels").alias("x")).select("person_id", "x.*")
    return people_per(each, "dimension", "label").select(F.get(F.array(*map(F.lit, dimensions)), "dimension").alias("dimension"), "label", "people")


def ordered(df: DataFrame, *order: Column | str, most: int | None = None) -> DataFrame:
    """The first ``most`` rows in the given total order, with their ``place`` from 1.

    A bounded report takes the top of every partition and then numbers ``most`` rows; without a bound the order needs one task, which suits reports after aggregation only."""
    if most is not None:
        df = df.orderBy(*order).limit(most)
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def largest(counts: DataFrame, label: str, n: str, most: int) -> DataFrame:
    """The largest counts, equal ones by label."""
    return ordered(counts, F.col(n).desc(), F.col(label), most=most)
