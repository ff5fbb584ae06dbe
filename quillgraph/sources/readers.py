"""Readers of triples, lines and model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import recovery

TRIPLE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'
#: What an escape of one letter stands for.
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescaped(x: Column) -> Column:
    """A literal's or IRI's escapes undone in one pass, so that an escaped backslash starts no other escape."""
    pieces = F.regexp_extract_all(x, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), F.lit(1))
    table = F.create_map(*(F.lit(y) for pair in ESCAPES.items() for y in pair))

    def one(p: Column) -> Column:
        code = F.conv(F.substring(p, 3, 8), 16, 10).cast("long")
        utf32 = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(p.rlike(r"^\\[uU][0-9A-Fa-f]{4}"), utf32).when(p.startswith("\\"), F.coalesce(F.try_element_at(table, F.substring(p, 2, 1)), p)).otherwise(p)

    return F.when(x.contains("\\"), F.array_join(F.transform(pieces, one), "")).otherwise(x)


def _triple_lines(lines: DataFrame, value: str) -> DataFrame:
    return lines.where(F.trim(F.col(value)) != "").where(~F.ltrim(F.col(value)).startswith("#"))


def parse_triples(lines: DataFrame, value: str = "value") -> DataFrame:
    """N-Triples lines -> distinct triples. Malformed lines are left out; see :func:`malformed`."""
    line = F.col(value)
    s, p, o = (F.regexp_extract(line, TRIPLE, k) for k in (1, 2, 3))
    bare = lambda x: unescaped(F.regexp_replace(x, r"^<|>$", ""))
    body = unescaped(F.regexp_extract(o, r'(?s)^"((?:[^"\\]|\\.)*)"', 1))
    kind = F.when(o.startswith('"'), "lit").when(o.startswith("_:"), "bnode").otherwise("iri")
    out = _triple_lines(lines, value).where(line.rlike(TRIPLE)).select(
        bare(s).alias("s"), bare(p).alias("p"), F.when(o.startswith('"'), body).otherwise(bare(o)).alias("o"), kind.alias("o_kind"),
        F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1).alias("o_lang"), F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1).alias("o_dtype"),
        F.when(s.startswith("_:"), "bnode").otherwise("iri").alias("s_kind"), F.regexp_extract(bare(p), r"([^#/:]*)$", 1).alias("p_local"),
    )
    return out.distinct()


def malformed(lines: DataFrame, value: str = "value") -> DataFrame:
    """The lines that are neither triples, comments nor blank."""
    return _triple_lines(lines, value).where(~F.col(value).rlike(TRIPLE))


def read_triples(spark: SparkSession, path: str, unknown: str = "nt") -> DataFrame:
    """Triples of a file or folder, its syntax told by the suffix: N-Triples by the line, Turtle by the statement, RDF/XML by the file.

    A suffix that says nothing means ``unknown``: ``nt``, ``turtle``, ``xml``, or ``try``, which gives each file the first syntax in this order that reads all of it."""
    from . import rdf, turtle

    kind = rdf.SUFFIXES.get(path.rstrip("/").rsplit(".", 1)[-1].lower(), unknown)
    if kind == "nt":
        return parse_triples(spark.read.text(path))
    return turtle.read(spark, path) if kind == "turtle" else rdf.read_files(spark, path, kind)


def line_documents(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, line_no, line): trimmed lines that are not blank, numbered from 1 among all."""
    each = df.select(key, F.posexplode(F.split(text, "\r?\n")).alias("pos", "line"))
    return each.select(key, (F.col("pos") + 1).cast("long").alias("line_no"), F.trim("line").alias("line")).where("line <> ''")


def recovered_records(df: DataFrame, raw: str) -> DataFrame:
    """Adds ``records``: an array of the records of a model's raw output, empty if it holds none. :func:`recovery.record_rows` gives a row for each instead, for outputs of any size."""
    records = F.from_json(recovery.all_records(F.col(raw)), f"array<struct<{recovery.RECORD}>>")
    return df.withColumn("records", F.filter(records, lambda r: r["type"].isNotNull()))


def newest_file(spark: SparkSession, folder: str, glob: str = "*.nt") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def write_table(df: DataFrame, path: str, drop: tuple[str, ...] = ("place_id",)) -> None:
    """A report as CSV with a header, without its id columns; each file begins with a byte-order mark, as spreadsheets want it."""
    kept = df.drop(*drop)
    first = kept.columns[0]
    kept.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").option("header", True).csv(path)
