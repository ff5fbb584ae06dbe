"""Places: names, levels, coordinates; what counts at a viewing level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domain, text
from . import triples as t

# Literal keys of a place.
MODERN, HISTORICAL, LEVEL_KEYS = "现代名称", "历史名称", ["现代区划层级", "区划层级"]


def metadata(places: DataFrame, triples: DataFrame, infer: bool = True, timeline: bool = False, literal_fallback: bool = False) -> DataFrame:
    """``places(node)`` -> (node, modern, level): the modern name, else the historical one, else the local name; the declared level, else (``infer``) the name's last suffix, in canonical form.

    ``literal_fallback`` takes any literal where a key has none, as some analyses happen to do."""
    name = t.first_literal(triples, [MODERN, HISTORICAL], literal_fallback).select(F.col("s").alias("node"), F.col("value").alias("modern"))
    level = t.first_literal(triples, LEVEL_KEYS, literal_fallback).select(F.col("s").alias("node"), F.col("value").alias("declared"))
    both = places.select("node").distinct().join(name, "node", "left").join(level, "node", "left")
    both = both.withColumn("modern", F.coalesce("modern", text.local_name_a(F.col("node"))))
    level = F.coalesce("declared", domain.last_suffix(F.col("modern"), timeline)) if infer else F.col("declared")
    return both.select("node", "modern", domain.canonical_suffix(level, timeline).alias("level"))


def counts_at(view: str) -> Column:
    """Whether a row of :func:`metadata` counts at a viewing level: its level is of that group, or it is a municipality seen as a province."""
    return F.coalesce(domain.is_view_level(F.col("level"), F.col("modern"), view), F.lit(False))


def descendants_at_view(closed: DataFrame, meta: DataFrame, view: str) -> DataFrame:
    """(root, node): every root's descendants, itself included, that count at the viewing level."""
    at = meta.where(counts_at(view)).select("node")
    return closed.join(at, "node").select(F.col("ancestor").alias("root"), "node")


def coordinates(props: DataFrame, route: bool = False) -> DataFrame:
    """``props(s, props)`` -> (s, lat, lon), by the reading of maps or of routes."""
    lat, lon = (domain.coordinates_of_route if route else domain.coordinates_of_map)(F.col("props"))
    return props.select("s", lat.alias("lat"), lon.alias("lon"))


def centre(points: DataFrame) -> DataFrame:
    """The mean of ``points(lat, lon)`` within the map's bounds; one row."""
    clip = lambda c: F.greatest(F.least(F.avg(c), F.lit(domain.BOUNDS[c][1])), F.lit(domain.BOUNDS[c][0])).alias(c)
    return points.agg(clip("lat"), clip("lon"))


def heat_layer(counts: DataFrame, points: DataFrame, on: str, n: str = "people", boost: float = 1.0) -> DataFrame:
    """(lat, lon, weight) of the buckets that have coordinates."""
    return counts.join(points, on).where("lat is not null and lon is not null").select(on, "lat", "lon", (F.col(n) * boost).alias("weight"))


def path_layer(steps: DataFrame, points: DataFrame, person: str = "person_id", place: str = "place_id") -> DataFrame:
    """A line for each two steps in a row of a person's ``steps(person, step, place)`` that have coordinates: (person, leg, from and to coordinates)."""
    from pyspark.sql import Window

    known = steps.join(points, place).where("lat is not null and lon is not null")
    w = Window.partitionBy(person).orderBy("step")
    legs = known.select(person, F.row_number().over(w).cast("long").alias("leg"), "lat", "lon", F.lead("lat").over(w).alias("to_lat"), F.lead("lon").over(w).alias("to_lon"))
    return legs.where("to_lat is not null")
