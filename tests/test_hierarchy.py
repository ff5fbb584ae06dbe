import pytest
from pyspark.sql import functions as F

from quillgraph.operators import hierarchy


def test_closure_is_whole_or_an_error(spark):
    edges = spark.createDataFrame([(f"p{k}", f"p{k + 1}") for k in range(4)] + [("p4", "p3")], "child string, parent string")
    nodes = spark.createDataFrame([(f"p{k}",) for k in range(5)], "node string")
    want = {(f"p{i}", f"p{j}", j - i) for i in range(5) for j in range(i, 5)} | {("p4", "p3", 1)}
    assert {tuple(r) for r in hierarchy.closure(edges, nodes, 4).collect()} == want
    for use in (lambda c: c, lambda c: c.select("node"), lambda c: c.where(F.col("ancestor") == "p4")):
        with pytest.raises(Exception, match="deeper than max_depth"):
            use(hierarchy.closure(edges, nodes, 3)).collect()
