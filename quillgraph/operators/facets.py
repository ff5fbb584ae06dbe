"""Filters of people by attributes, assertions, regions, eras and years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Local names of properties that state a school type; the household types that one analysis admits.
SCHOOL_TYPE_KEYS = ["学籍类型", "學籍類型", "学籍_类型", "學籍_類型", "类型", "類型"]
HOUSEHOLDS = ["官籍", "军籍", "民籍"]


def match_facets(people: DataFrame, attributes: DataFrame, chosen: dict[str, list[str]], exact: tuple[str, ...] = (), skip: str | None = None) -> DataFrame:
    """``people(person_id)`` that have, of each chosen facet, a value that equals one of the chosen: ``attributes(person_id, facet, value)``.

    Values are compared in normal form, those of ``exact`` facets as they are. The facet ``skip``, the one being charted, does not restrict; nor does one without chosen values."""
    for facet, values in chosen.items():
        if not values or facet == skip:
            continue
        mine = attributes.where(F.col("facet") == facet)
        spark = people.sparkSession
        wanted = spark.createDataFrame([(v,) for v in values], "wanted string")
        form = (lambda c: c) if facet in exact else text.norm_token
        wanted = F.broadcast(wanted.select(form(F.col("wanted")).alias("wanted")).distinct())  # what a user chose
        spelt = mine.select("value").distinct().withColumn("wanted", form(F.col("value"))).join(wanted, "wanted", "left_semi")  # distinct spellings are put in normal form, not facts
        people = people.join(mine.join(spelt, "value", "left_semi"), "person_id", "left_semi")
    return people


def admitted(attributes: DataFrame, facet: str = "户籍类型", values: tuple[str, ...] = tuple(HOUSEHOLDS)) -> DataFrame:
    """``attributes(person_id, facet, value)`` without the values of a facet that the analysis does not admit; of household types three count, in simplified script and without spaces around."""
    mine = F.col("facet") == facet
    form = F.trim(text.to_simplified(F.col("value")))
    return attributes.where(~mine | form.isin(*values)).withColumn("value", F.when(mine, form).otherwise(F.col("value")))


def bucket_hits(attributes: DataFrame, target: str, key: str = "person_id", value: str = "value") -> DataFrame:
    """Distinct keys with a value that equals the target when both are normalised without white space."""
    spelt = attributes.select(value).distinct()
    spelt = spelt.where(text.strip_ws(text.nfkc(F.col(value))) == text.strip_ws(text.nfkc(F.lit(target))))
    return attributes.join(spelt, value, "left_semi").select(key).distinct()


def school_types(assertions: DataFrame, by_local_name: bool = True, form: str = "place") -> DataFrame:
    """``assertions(about, prop, value, value_norm)`` -> (about, value) of those that state a school type, one spelling (the least) of each.

    ``by_local_name``: the property's local name is looked up, else its whole text. ``form`` tells equal spellings: ``place`` without white space and simplified, ``people`` also NFKC, ``trend`` NFKC but not simplified."""
    prop = text.local_name_a(F.col("prop")) if by_local_name else F.col("prop")
    named = prop.isin(SCHOOL_TYPE_KEYS) | (F.col("prop").rlike("学籍|學籍") & F.col("prop").rlike("类型|類型"))
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    found = assertions.where(named).select("about", F.coalesce(blank("value_norm"), blank("value")).alias("value")).where("value is not null")
    v = F.col("value")
    spelt = {"place": text.to_simplified(text.strip_ws(v)), "people": text.norm_token(v), "trend": text.strip_ws(text.nfkc(v))}[form]
    return found.withColumn("k", spelt).where("k <> ''").groupBy("about", "k").agg(F.min("value").alias("value")).select("about", "value")


def school_types_nearby(assertions: DataFrame, neighbours: DataFrame, **kw) -> DataFrame:
    """School types of nodes by assertions about them or about a node one hop away; ``neighbours(node, other)``."""
    near = neighbours.join(assertions.withColumnRenamed("about", "other"), "other").drop("other").withColumnRenamed("node", "about")
    return school_types(assertions.select("about", "prop", "value", "value_norm").union(near.select("about", "prop", "value", "value_norm")), **kw)


def eras_between(eras: DataFrame, first: str | None, last: str | None) -> DataFrame | None:
    """The eras from one to the other, both included, in either order; None, that is no restriction, unless both are given."""
    if not first or not last:
        return None
    ends = eras.where(F.col("era").isin(first, last)).agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    return eras.join(F.broadcast(ends), F.col("ord").between(F.col("lo"), F.col("hi"))).select(*eras.columns)


def years_of_eras(eras: DataFrame, first: str | None, last: str | None) -> DataFrame | None:
    """(low, high): least start and largest end of the chosen eras; of one if one is given, None without."""
    chosen = [e for e in (first, last) if e]
    return eras.where(F.col("era").isin(chosen)).agg(F.min("y0").alias("low"), F.max("y1").alias("high")) if chosen else None


def shown(era: Column, years: Column, query: str) -> Column:
    """Whether a bucket is shown for a typed query: part of the era's name, or the beginning of one of its years (array)."""
    return era.contains(query) | F.exists(years, lambda y: y.cast("string").startswith(query))
