"""Reference files: GeoJSON, label vocabularies, numbered step scripts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FEATURE = "struct<type string, properties map<string,string>, geometry struct<type string, coordinates string>>"


@F.pandas_udf(StringType())
def _gb18030(content: pd.Series) -> pd.Series:
    """Bytes that are not UTF-8; null where they are not GB18030 either."""

    def one(data):
        try:
            return None if data is None else bytes(data).decode("gb18030")
        except UnicodeDecodeError:
            return None

    return content.map(one)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(path, feature_no, geometry_type, coordinates, properties): the features of GeoJSON files, coordinates as JSON text.

    Files are UTF-8, with or without a byte-order mark, else GB18030. TopoJSON and anything that is not a feature collection give
    no rows. A file is read whole by one task: these are boundary files of some megabytes.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    as_utf8 = F.expr("try_validate_utf8(cast(content as string))")
    other = _gb18030(F.when(as_utf8.isNull(), F.col("content")))
    body = F.regexp_replace(F.coalesce(as_utf8, other), "^﻿", "")
    parsed = files.select("path", F.from_json(body, f"type string, features array<{FEATURE}>").alias("j")).where("j.type = 'FeatureCollection'")
    each = parsed.select("path", F.posexplode("j.features").alias("feature_no", "f"))
    return each.select("path", "feature_no", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def label_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(idx, label) of a file with a label a line, numbered from 0 without blank lines."""
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "").alias("labels"))
    return lines.select(F.posexplode("labels").alias("idx", "label"))


def numbered_scripts(spark: SparkSession, folder: str, last: int = 20, glob: str = "*.py") -> DataFrame:
    """(step, path) for each number up to ``last``: the first file, by path, whose name starts with it; null where there is none. Empty files do not count."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path")
    number = F.regexp_extract("path", r"/(\d+)[^/]*$", 1).try_cast("int")
    found = files.select(number.alias("step"), "path").where("step is not null").groupBy("step").agg(F.min("path").alias("path"))
    return spark.range(1, last + 1).select(F.col("id").cast("int").alias("step")).join(found, "step", "left")
