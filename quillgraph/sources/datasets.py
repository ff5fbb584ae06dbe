"""One handle on a dataset that several analyses share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import read_triples


class Datasets:
    """Reads and caches the dataset of a path once; another path, or files that changed since, take its place. Views derived from it are kept by name until then."""

    def __init__(self, spark: SparkSession, read: Callable[[SparkSession, str], DataFrame] = read_triples):
        self.spark, self.read = spark, read
        self.state: tuple | None = None
        self.views: dict[str, DataFrame] = {}

    def _stamp(self, path: str) -> tuple:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content")
        return path, *files.agg(F.count(F.lit(1)), F.max("modificationTime"), F.sum("length")).first()

    def get(self, path: str) -> DataFrame:
        stamp = self._stamp(path)
        if stamp != self.state:
            self.clear()
            self.views[""] = self.read(self.spark, path).cache()
            self.state = stamp
        return self.views[""]

    def view(self, path: str, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A derived table, made and cached at its first use."""
        source = self.get(path)
        if name not in self.views:
            self.views[name] = make(source).cache()
        return self.views[name]

    def clear(self) -> None:
        for df in self.views.values():
            df.unpersist()
        self.views, self.state = {}, None


class PageFailed(RuntimeError):
    """Names the page; the cause is chained."""


class Pages:
    """Named analyses over one shared dataset: ``table`` has, by name, a function of the dataset and of options that gives a result.

    A page's result is made at its first use with the same options and kept until the dataset changes; a page that fails takes no other with it, and is tried anew next time."""

    def __init__(self, datasets: Datasets, table: dict[str, Callable[..., DataFrame]]):
        faults = [repr(n) for n, f in table.items() if not n.strip() or not callable(f)]
        if faults:
            raise ValueError(f"no pages: {', '.join(faults)}")
        self.datasets, self.table = datasets, dict(table)

    def names(self) -> list[str]:
        return list(self.table)

    def open(self, name: str, path: str, **options: str | int | float | bool | None) -> DataFrame:
        if name not in self.table:
            raise KeyError(f"no page {name!r}; there are {', '.join(self.table)}")
        key = f"page {name} {sorted(options.items())!r}"
        try:
            return self.datasets.view(path, key, lambda df: self.table[name](df, **options))
        except Exception as e:
            raise PageFailed(f"page {name!r}") from e
