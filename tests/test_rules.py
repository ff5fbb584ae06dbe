"""Rules over hand-made rows: repeats, ties, cycles, scripts, plans."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import domain, text
from quillgraph.operators import names as name_ops
from quillgraph.operators import evidence, events, facets, graph, hierarchy, places, triples
from quillgraph.plans import queries, scheduler
from quillgraph.sources import readers
from quillgraph.streaming import lines


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_full_closure_of_any_depth(spark):
    n = 13
    chain = [(f"p{k:02d}", f"p{k + 1:02d}") for k in range(n - 1)] + [("x", "y"), ("y", "x"), ("p00", "p02"), (None, "x")]
    nodes = [(f"p{k:02d}",) for k in range(n)] + [("x",), ("y",)]
    got = {(r.node, r.ancestor): r.depth for r in hierarchy.full_closure(spark.createDataFrame(chain, "child string, parent string"), spark.createDataFrame(nodes, "node string")).collect()}
    assert len(got) == n * (n + 1) // 2 + 4
    assert got["p00", "p12"] == 11 and got["x", "y"] == 1 and got["x", "x"] == 0


def test_with_era_keeps_repeated_rows_and_shuffles_none(spark):
    rows = spark.createDataFrame([(1620, "a"), (1620, "a"), (1300, "b"), (None, "c")], "year int, x string")
    out = domain.with_era(rows, "year", domain.era_table(spark, "timeline"))
    assert sorted((r.x, r.era) for r in out.collect() if r.era) == [("a", "泰昌"), ("a", "泰昌")] and out.count() == 4
    assert "SortMergeJoin" not in plan(out)
    assert len(domain.hosted_years(spark).collect()) == 87 and domain.hosted_years(spark).where("era is null").count() == 0


def test_list_numbers_are_removed(spark):
    raw = '0: {"type":"node","label":"a"}\n1: {"type":"node","label":"b"}\n2) {"type":"node","label":"c"},'
    got = readers.recovered_records(spark.createDataFrame([(raw,)], "raw string"), "raw").first()["records"]
    assert [r["label"] for r in got] == ["a", "b", "c"]


def test_mentions_in_all_scripts(spark):
    texts = spark.createDataFrame([(1, "蘇州进士"), (2, "苏州進士"), (3, "苏"), (4, None)], "id long, t string")
    names = spark.createDataFrame([("蘇州",), ("进士",), ("苏",)], "n string")
    one = {(r.id, r.n) for r in name_ops.mentions(texts, "id", "t", names, "n").collect()}
    every = {(r.id, r.n) for r in name_ops.mentions(texts, "id", "t", names, "n", scripts=True).collect()}
    assert one == {(1, "蘇州"), (1, "进士"), (2, "苏"), (3, "苏")}
    assert every == {(1, "蘇州"), (1, "进士"), (1, "苏"), (2, "蘇州"), (2, "进士"), (2, "苏"), (3, "苏")}
    spaced = name_ops.mentions(texts, "id", "t", spark.createDataFrame([("苏 州",)], "n string"), "n", normal=True).collect()
    assert [(r.id, r.n) for r in spaced] == [(2, "苏 州")]
    assert "NestedLoop" not in plan(name_ops.mentions(texts, "id", "t", names, "n", scripts=True))


def test_search_by_alias(spark):
    names = spark.createDataFrame([(1, "王 安石"), (1, "介甫"), (2, "王安石公"), (3, "李"), (4, "王安石")], "p long, n string")
    got = [tuple(r) for r in evidence.search(names, "王安石", "n", "p").collect()]
    assert got == [(1, "王 安石", "等值"), (4, "王安石", "等值"), (2, "王安石公", "包含")]


def test_hierarchy_direction(spark):
    flat = [(f"c{k}", "p") for k in range(5)]
    df = spark.createDataFrame(flat, "child string, parent string")
    assert sorted(map(tuple, graph.oriented(df).collect())) == sorted(flat)
    assert graph.oriented(df, least=9).where("parent like 'c%'").count() == 5


def test_khop_needs_no_pairs(spark):
    big = [(1, k) for k in range(200)] + [(2, 5), (2, 900), (3, 900), (3, 901)]
    members = spark.createDataFrame(big, "event_id long, person_id long")
    start = spark.createDataFrame([(0,)], "node long")
    got = {r.node: r.level for r in graph.khop(members, start, 2).collect()}
    assert got == {0: 0} | {k: 1 for k in range(1, 200)} | {900: 2}
    assert [tuple(r) for r in graph.khop(members, start, 3, most=3).collect()] == [(0, 0), (1, 1), (2, 1)]
    assert {r.a: r.meetings for r in graph.meetings(members).collect()}[5] == 200


def test_event_rules(spark):
    types = spark.createDataFrame([("a", "TaskEvent"), ("b", "TaskEvent"), ("b", "BirthEvent"), ("c", "Person")], "node string, cls string")
    assert [r.node for r in events.clean_events(types).collect()] == ["a"]
    links = spark.createDataFrame([("a", "near", "p1"), ("a", "hasPlace", "p2"), ("a", "hasPlace", "x"), ("b", "near", "p3")], "s string, p_local string, o string")
    known = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "node string")
    assert {tuple(r) for r in events.strict_place(links, known).collect()} == {("a", "p2")}
    assert {tuple(r) for r in events.loose_place(links, known).collect()} == {("a", "p2"), ("b", "p3")}


def test_era_bounds(spark):
    eras = domain.era_table(spark)
    assert facets.eras_between(eras, "永乐", None) is None and facets.years_of_eras(eras, None, None) is None
    assert [r.era for r in facets.eras_between(eras, "永乐", "洪武").orderBy("ord").collect()] == ["洪武", "建文", "永乐"]
    assert tuple(facets.years_of_eras(eras, None, "建文").first()) == (1399, 1402)


def test_municipalities_count_as_provinces(spark):
    rows = spark.createDataFrame([("贵阳市", "市"), ("广州市", "市"), ("云南省", "省"), ("无", None)], "modern string, level string")
    assert {r.modern for r in rows.where(places.counts_at("省")).collect()} == {"贵阳市", "云南省"}
    assert {r.modern for r in rows.where(places.counts_at("市")).collect()} == {"贵阳市", "广州市"}


def test_coordinates(spark):
    cases = [("24.81°N, 113.59°E", 24.81, 113.59), ("113.5,24.5", 24.5, 113.5), ("24.5S,113.5W", -24.5, 113.5), ("-30, 20", 20.0, -30.0), ("none", None, None)]
    lat, lon = domain.coordinates_pair(F.col("raw"))
    got = spark.createDataFrame(cases, "raw string, a double, b double").select("raw", lat, lon).collect()
    assert [tuple(r) for r in got] == cases


def test_highlight_in_all_scripts(spark):
    df = spark.createDataFrame([("國会與国會",)], "x string")
    assert df.select(text.highlight(F.col("x"), ["國會"], scripts=True)).first()[0] == "國会與国會"
    assert df.select(text.highlight(F.col("x"), ["國"], scripts=True)).first()[0] == "<mark>國</mark>会與<mark>国</mark>會"


def test_record_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\n\n two \n")
    step = lambda df: df.select(F.upper("text").alias("text"))
    for mode in ("accumulate", "replace"):
        lines.run(lines.line_stream(spark, str(tmp_path / "in")), step, str(tmp_path / mode), str(tmp_path / f"c-{mode}"), mode).awaitTermination(120)
    (tmp_path / "in" / "b.txt").write_text("three\n")
    for mode, want in (("accumulate", ["ONE", "THREE", "TWO"]), ("replace", ["THREE"])):
        lines.run(lines.line_stream(spark, str(tmp_path / "in")), step, str(tmp_path / mode), str(tmp_path / f"c-{mode}"), mode).awaitTermination(120)
        assert sorted(r.text for r in spark.read.parquet(str(tmp_path / mode)).collect()) == want


def test_resume_only_of_the_same_work(spark, tmp_path):
    ran = []

    def add(n):
        def step(df):
            ran.append(n)
            return df.select((F.col("x") + n).alias("x"))

        return step

    src = str(tmp_path / "src")
    spark.range(3).toDF("x").write.parquet(src)
    folder = str(tmp_path / "run")
    scheduler.run_stages(spark.read.parquet(src), [("a", add(1))], folder)
    scheduler.run_stages(spark.read.parquet(src), [("a", add(1))], folder)
    assert ran == [1]
    scheduler.run_stages(spark.read.parquet(src), [("a", add(2))], folder)  # other code
    spark.range(5).toDF("x").write.mode("overwrite").parquet(src)
    out, _ = scheduler.run_stages(spark.read.parquet(src), [("a", add(1))], folder)  # other source
    assert ran == [1, 2, 1] and out.count() == 5
    assert scheduler.corrected_inputs({"a": " x.jso ", "b": "y.json"}) == {"a": "x.json", "b": "y.json"}
    with pytest.raises(ValueError, match="no path for a, c"):
        scheduler.corrected_inputs({"a": "", "b": "y", "c": None})


def test_type_test_and_position_codes(spark):
    t = spark.createDataFrame([("a", "type", "http://e#Person", "iri"), ("_:b", "type", "http://e#Person", "iri"), ("a", "对齐码_core", "CORE/x", "lit"), ("a", "机构", "m", "lit")], "s string, p_local string, o string, o_kind string")
    assert [r.node for r in triples.types(t).collect()] == ["a"]
    assert triples.position_details(t).count() == 1 and triples.position_details(t, codes=True).count() == 2


@pytest.mark.parametrize("name", ["text_contains_alias", "khop_people_graph", "people_meetings", "endpoint_resolution", "year_to_era_range", "person_search"])
def test_no_nested_loops(spark, sf, name):
    assert "NestedLoop" not in plan(queries.QUERIES[name](spark, sf))
