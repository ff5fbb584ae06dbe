"""The graph of a stream of lines, composed as they come.

A batch adds a delta: of each node and property the batch's last value, and its edges, each with their place in the stream. The graph is what the deltas give together: properties are merged key by key, of a key the
last occurrence holds, and every edge stays. A delta's folder is named by its batch, so a batch that runs again replaces its own; ``compact`` folds whole deltas into one base. In replace mode only the last batch's graph is kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

NODES = "id string, key string, value string, batch long, ord string"
EDGES = "src string, dst string, label string, props map<string,string>, batch long, ord string"


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, replace: bool = False):
        self.spark, self.path, self.replace = spark, path.rstrip("/"), replace

    def _folders(self, kind: str) -> dict[int, str]:
        """Whole deltas by the last batch in them; of a base and the deltas that it holds, the base."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(conf)
        out: dict[int, str] = {}
        base = -1
        for status in fs.listStatus(top) if fs.exists(top) else []:
            name = status.getPath().getName()
            m = re.fullmatch(rf"{kind}-(batch|base)-(\d+)", name)
            if m and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                number = int(m[2])
                if m[1] == "base":
                    base = max(base, number)
                out[number] = f"{self.path}/{name}" if m[1] == "base" or number not in out else out[number]
        return {n: p for n, p in out.items() if n >= base and (n > base or p.endswith(f"base-{n}"))}

    def _drop(self, folders: list[str]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for f in folders:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(conf).delete(path, True)

    def write(self, nodes: DataFrame, edges: DataFrame, number: int) -> None:
        """Adds a batch: ``nodes(id, ord, props)`` and ``edges(src, dst, label, props, ord)``, ``ord`` being a string that sorts as the batch does."""
        earlier = [p for kind in ("nodes", "edges") for n, p in self._folders(kind).items() if n < number] if self.replace else []
        each = nodes.select("id", F.col("ord").cast("string").alias("ord"), F.explode_outer("props").alias("key", "value"))
        last = each.groupBy("id", "key").agg(F.max(F.struct("ord", "value")).alias("x")).select("id", "key", "x.value", F.lit(number).cast("long").alias("batch"), "x.ord")
        last.write.mode("overwrite").parquet(f"{self.path}/nodes-batch-{number}")
        edges.select("src", "dst", "label", "props", F.lit(number).cast("long").alias("batch"), F.col("ord").cast("string").alias("ord")).write.mode("overwrite").parquet(f"{self.path}/edges-batch-{number}")
        self._drop(earlier)

    def _rows(self, kind: str, schema: str) -> DataFrame:
        folders = list(self._folders(kind).values())
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _merged(self) -> DataFrame:
        last = F.max(F.struct("batch", "ord", "value")).alias("x")
        return self._rows("nodes", NODES).groupBy("id", "key").agg(last).select("id", "key", "x.value", "x.batch", "x.ord")

    def nodes(self) -> DataFrame:
        """(id, props) of the composed graph."""
        entries = F.sort_array(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value"))))
        return self._merged().groupBy("id").agg(F.map_from_entries(entries).alias("props"))

    def edges(self) -> DataFrame:
        """(src, dst, label, props): every edge."""
        return self._rows("edges", EDGES).select("src", "dst", "label", "props")

    def compact(self) -> None:
        """Folds the whole deltas of nodes into one base and drops them."""
        folders = self._folders("nodes")
        if len(folders) > 1:
            self._merged().write.mode("overwrite").parquet(f"{self.path}/nodes-base-{max(folders)}")
            self._drop(list(folders.values()))

    def run(self, lines: DataFrame, step: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str) -> StreamingQuery:
        """Feeds ``step`` of each batch of lines, its (nodes, edges), to the graph."""
        return lines.writeStream.foreachBatch(lambda batch, number: self.write(*step(batch), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
