"""Readers, the model client and the stage scheduler."""

import json

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import names as name_ops
from quillgraph.operators import evidence
from quillgraph.plans import scheduler
from quillgraph.sources import extraction, files, readers


def test_geojson_encodings_and_topojson(spark, tmp_path):
    features = [{"type": "Feature", "properties": {"name": "贵州"}, "geometry": {"type": "Point", "coordinates": [106.7, 26.6]}}]
    doc = json.dumps({"type": "FeatureCollection", "features": features}, ensure_ascii=False)
    (tmp_path / "a.json").write_bytes(doc.encode())
    (tmp_path / "b.json").write_bytes(doc.encode("utf-8-sig"))
    (tmp_path / "c.json").write_bytes(doc.encode("gb18030"))
    (tmp_path / "d.json").write_text('{"type": "Topology", "objects": {}}')
    (tmp_path / "e.json").write_text("")
    got = files.read_geojson(spark, str(tmp_path)).collect()
    assert sorted(r["path"][-6] for r in got) == ["a", "b", "c"]
    assert {r["properties"]["name"] for r in got} == {"贵州"}
    assert {r["coordinates"] for r in got} == {"[106.7,26.6]"}


def test_vocabulary_and_scripts(spark, tmp_path):
    (tmp_path / "labels.txt").write_text("PER\n\n LOC \n")
    assert [tuple(r) for r in files.label_vocabulary(spark, str(tmp_path / "labels.txt")).collect()] == [(0, "PER"), (1, "LOC")]
    steps = tmp_path / "steps"
    (steps / "more").mkdir(parents=True)
    for name in ("1_first.py", "more/1_again.py", "more/3-third.py", "notes.py"):
        (steps / name).write_text("pass\n")
    got = {r["step"]: r["path"] for r in files.numbered_scripts(spark, str(steps), 3).collect()}
    assert got[1].endswith("1_first.py") and got[2] is None and got[3].endswith("3-third.py")


def test_literals_are_recovered(spark):
    rows = [("{'type': 'node', 'label': 'a',}",), ("{'type': 'node'}\n{'type': 'relationship'}",), ("(" * 500,), (None,), ("",)]
    got = readers.recovered_records(spark.createDataFrame(rows, "raw string"), "raw").select(F.size("records")).collect()
    assert [r[0] for r in got] == [1, 2, 0, 0, 0]


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("# x\nmodel:\n  name: 'a # b'\n  url: http://h:1/x # y\nllm:\n  retry: 3\n")
    assert extraction.read_config(str(tmp_path / "c.yaml")) == {"model": {"name": "a # b", "url": "http://h:1/x"}, "llm": {"retry": "3"}}
    (tmp_path / "d.yaml").write_text("a:\n  - x: 1\n")
    with pytest.raises(ValueError, match="d.yaml:2"):
        extraction.read_config(str(tmp_path / "d.yaml"))


def test_instruction(spark):
    df = spark.createDataFrame([("t", ["x", "y"]), (None, None)], "t string, e array<string>")
    first, second = (r[0] for r in df.select(extraction.instruction(F.col("t"), F.col("e"))).collect())
    assert first.endswith("Text: t\nEntities: x、y") and second.endswith("Text: \nEntities: ")


def test_mentions_lose_no_name_between_pieces(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "abcd"), (2, "bc"), (3, None), (4, "")], "id long, t string")
    names = spark.createDataFrame([(n,) for n in ["a", "b", "c", "d", "bc", "bc", "", None, "zz"]], "n string")
    want = {(i, n) for i, t in ((1, "abcd"), (2, "bc")) for n in ["a", "b", "c", "d", "bc"] if n in t}
    for piece in (1, 2, 1000):
        monkeypatch.setattr(name_ops, "PIECE", piece)
        got = [(r["id"], r["n"]) for r in name_ops.mentions(texts, "id", "t", names, "n").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert name_ops.mentions(texts, "id", "t", names.limit(0), "n").count() == 0


def test_grouped_entities(spark):
    spans = spark.createDataFrame([(1, 0, 5, "B"), (1, 0, 0, "A"), (1, 1, 2, "C"), (1, 2, 9, "D")], "line_id long, type_idx int, start int, text string")
    vocabulary = spark.createDataFrame([(0, "PER"), (1, "LOC"), (2, "ODD")], "idx int, label string")
    got = {(r["label"], tuple(r["entities"])) for r in evidence.grouped_entities(spans, vocabulary, {"PER": "人", "LOC": "地"}).collect()}
    assert got == {("人", ("A", "B")), ("地", ("C",))}


def test_inference_of_lines(spark):
    def model():
        return lambda texts: [[(0, k, 2) for k in range(len(t) - 1) if t[k : k + 2] == "王安"] for t in texts]

    lines = spark.createDataFrame([(1, "見王安石王安"), (2, None), (3, "")], "i long, t string")
    found = extraction.span_rows(extraction.spans(lines, "t", model), "i", "t").collect()
    assert sorted(map(tuple, found)) == [(1, 0, 1, "王安"), (1, 0, 4, "王安")]
    with pytest.raises(Exception, match="outside its text"):
        extraction.spans(lines, "t", lambda: lambda texts: [[(0, 5, 9)] for _ in texts]).collect()


def test_scheduler_stops_and_resumes(spark, tmp_path):
    ran = []

    def add(n, fail=False):
        def step(df):
            ran.append(n)
            if fail:
                raise RuntimeError("broken")
            return df.select((F.col("x") + n).alias("x"))

        return step

    source = spark.range(3).toDF("x")
    with pytest.raises(scheduler.StageFailed, match=r"stage 2 \(b\)"):
        scheduler.run_stages(source, [("a", add(1)), ("b", add(2, True)), ("c", add(4))], str(tmp_path))
    out, log = scheduler.run_stages(source, [("a", add(1)), ("b", add(2)), ("c", add(4))], str(tmp_path))
    assert ran == [1, 2, 2, 4] and [o.resumed for o in log] == [True, False, False]
    assert sorted(r["x"] for r in out.collect()) == [7, 8, 9]
    for bad in ([], [("a", add(1)), ("a", add(1))], [("a/b", add(1))]):
        with pytest.raises(ValueError):
            scheduler.preflight(bad)
