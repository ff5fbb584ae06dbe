"""Events, their places and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domain

# Predicates from an event to its place.
PLACE_PREDICATES = ["hasPlace", "tookPlaceAt", "happenedIn"]


def clean_events(types: DataFrame, wanted: tuple[str, ...] = ("OfficeAtPlaceEvent", "TaskEvent"), unwanted: str = "BirthEvent") -> DataFrame:
    """``types(node, cls)`` -> (node): nodes typed as one of ``wanted`` and not as ``unwanted`` too."""
    return types.where(F.col("cls").isin(*wanted)).select("node").distinct().join(types.where(F.col("cls") == unwanted), "node", "left_anti")


def strict_place(links: DataFrame, places: DataFrame) -> DataFrame:
    """``links(s, p_local, o)``, ``places(node)`` -> (event, place): the least object of a place predicate that is a place."""
    objects = links.where(F.col("p_local").isin(PLACE_PREDICATES)).join(places.select(F.col("node").alias("o")), "o", "left_semi")
    return objects.groupBy(F.col("s").alias("event")).agg(F.min("o").alias("place"))


def loose_place(links: DataFrame, places: DataFrame) -> DataFrame:
    """(event, place): the least place that is the object of ``hasPlace``, else of any predicate."""
    objects = links.join(places.select(F.col("node").alias("o")), "o", "left_semi")
    prio = F.when(F.col("p_local") == "hasPlace", 0).otherwise(1)
    return objects.groupBy(F.col("s").alias("event")).agg(F.min(F.struct(prio.alias("p"), "o"))["o"].alias("place"))


def linked_either_way(triples: DataFrame, events: DataFrame, people: DataFrame) -> DataFrame:
    """(event, person) for every triple between an event and a person, whatever its predicate and direction. ``events(node)``, ``people(node)``."""
    pairs = triples.where("o_kind = 'iri'").select("s", "o")
    pairs = pairs.select(F.col("s").alias("event"), F.col("o").alias("person")).union(pairs.select("o", "s"))
    return pairs.join(events.select(F.col("node").alias("event")), "event", "left_semi").join(people.select(F.col("node").alias("person")), "person", "left_semi").distinct()


def people_at_places(event_person: DataFrame, event_place: DataFrame, on: str = "event") -> DataFrame:
    """Both linked to one event: distinct rows of the other columns."""
    return event_person.join(event_place, on).drop(on).distinct()


def single(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """The least value of each key, for maps that hold one."""
    return pairs.groupBy(key).agg(F.min(value).alias(value))


def candidates(*parts: tuple[DataFrame, str], person: str = "person_id") -> DataFrame:
    """(person): everyone whom any of the given (rows, column) names, once."""
    out = None
    for rows, column in parts:
        mine = rows.where(F.col(column).isNotNull()).select(F.col(column).alias(person))
        out = mine if out is None else out.unionAll(mine)
    return out.distinct()


def rank_records(participations: DataFrame, honours: Column, said: Column, keys: list[str], classes: tuple[str, ...] = ("二甲", "三甲")) -> DataFrame:
    """(keys, jiadi, rank): a row for each rank that a participation's text ``said`` names, of those whose class of honours, as ``honours`` tells it, is one of ``classes``."""
    each = participations.withColumns({"jiadi": domain.honours_class(honours), "__ranks": domain.ranks(said)}).where(F.col("jiadi").isin(*classes))
    return each.select(*keys, "jiadi", F.explode("__ranks").alias("rank")).where("rank is not null")
