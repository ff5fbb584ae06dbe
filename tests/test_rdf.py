"""N-Triples, Turtle and RDF/XML; the shared handle; reports and newest files."""

import os

import pytest

from quillgraph.sources import datasets, rdf, readers

NT = r'''# a comment
<http://e/a> <http://e/p#name> "café \U0001F600 a\\nb \"q\"\n"@zh .
<http://e/a> <http://e/p#name> "café \U0001F600 a\\nb \"q\"\n"@zh .
_:b1 <http://e/p#is> <http://e/a> .
<http://e/a> <http://e/p#n> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .
this line is no triple
'''
TTL = """@prefix e: <http://e/> .
@prefix p: <http://e/p#> .
@base <http://e/> .
e:a a p:Thing ; p:name "caf\\u00e9"@zh , '''long
"text"''' ; p:n 5 ; p:x true, 1.5 ; p:in [ p:name "inner" ] .
<b> p:list ( e:a "z" ) .
"""
XML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:p="http://e/p#">
<p:Thing rdf:about="http://e/a" p:short="s"><p:name xml:lang="zh">café</p:name><p:n rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">5</p:n><p:in rdf:resource="http://e/b"/>
<p:has><rdf:Description rdf:about="http://e/c"><p:name>inner</p:name></rdf:Description></p:has></p:Thing></rdf:RDF>
"""


def test_n_triples(spark):
    lines = spark.createDataFrame([(x,) for x in NT.split("\n")], "value string")
    rows = readers.parse_triples(lines).collect()
    assert sorted((r.s, r.p_local, r.o, r.o_kind, r.o_lang, r.s_kind) for r in rows) == [
        ("_:b1", "is", "http://e/a", "iri", "", "bnode"),
        ("http://e/a", "n", "5", "lit", "", "iri"),
        ("http://e/a", "name", 'café \U0001f600 a\\nb "q"\n', "lit", "zh", "iri"),
    ]
    assert [r.value for r in readers.malformed(lines).collect()] == ["this line is no triple"]


def test_turtle():
    got = set(rdf.turtle(TTL))
    a, p = "http://e/a", "http://e/p#"
    assert (a, "iri", rdf.RDF + "type", p + "Thing", "iri", "", "") in got
    assert (a, "iri", p + "name", "café", "lit", "zh", "") in got and (a, "iri", p + "name", 'long\n"text"', "lit", "", "") in got
    assert (a, "iri", p + "n", "5", "lit", "", rdf.XSD + "integer") in got and (a, "iri", p + "x", "1.5", "lit", "", rdf.XSD + "decimal") in got
    (inner,) = [o for s, _, q, o, *_ in got if q == p + "in"]
    assert (inner, "bnode", p + "name", "inner", "lit", "", "") in got
    (head,) = [o for s, _, q, o, *_ in got if q == p + "list" and s == "http://e/b"]
    assert (head, "bnode", rdf.RDF + "first", a, "iri", "", "") in got and sum(q == rdf.RDF + "rest" for _, _, q, *_ in got) == 2
    for bad in ("e:a p:b p:c .", "<a> <b>", "<a> <b> <c> <d> .", "{"):
        with pytest.raises(ValueError):
            rdf.turtle(bad)


def test_rdf_xml():
    a, p = "http://e/a", "http://e/p#"
    want = [
        (a, "iri", rdf.RDF + "type", p + "Thing", "iri", "", ""), (a, "iri", p + "short", "s", "lit", "", ""), (a, "iri", p + "name", "café", "lit", "zh", ""),
        (a, "iri", p + "n", "5", "lit", "", rdf.XSD + "integer"), (a, "iri", p + "in", "http://e/b", "iri", "", ""), (a, "iri", p + "has", "http://e/c", "iri", "", ""), ("http://e/c", "iri", p + "name", "inner", "lit", "", ""),
    ]
    assert sorted(rdf.rdf_xml(XML)) == sorted(want)
    with pytest.raises(ValueError):
        rdf.rdf_xml("no xml")


def test_syntax_by_suffix_or_trial(spark, tmp_path):
    for name, text in (("a.nt", NT), ("b.ttl", TTL), ("c.rdf", XML)):
        (tmp_path / name).write_text(text)
    assert readers.read_triples(spark, str(tmp_path / "a.nt")).count() == 3
    assert readers.read_triples(spark, str(tmp_path / "b.ttl")).count() == len(set(rdf.turtle(TTL)))
    assert readers.read_triples(spark, str(tmp_path / "c.rdf")).count() == 7
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    for name, text in (("x", NT.replace("this line is no triple\n", "")), ("y", TTL), ("z", XML)):
        (mixed / name).write_text(text)
    assert readers.read_triples(spark, str(mixed), "try").count() > 12
    with pytest.raises(Exception, match="nt: .*turtle: .*xml: "):
        (mixed / "w").write_text("{ nothing")
        readers.read_triples(spark, str(mixed), "try").count()


def test_shared_handle(spark, tmp_path):
    path = tmp_path / "a.nt"
    path.write_text(NT)
    reads = []
    shared = datasets.Datasets(spark, lambda s, p: (reads.append(p), readers.read_triples(s, p))[1])
    assert shared.get(str(path)) is shared.get(str(path)) and len(reads) == 1
    names = lambda: shared.view(str(path), "names", lambda t: t.where("p_local = 'name'"))
    assert names() is names() and names().count() == 1
    path.write_text(NT + '<http://e/c> <http://e/p#name> "c" .\n')
    assert names().count() == 2 and len(reads) == 2
    shared.clear()


def test_report_and_newest_file(spark, tmp_path):
    readers.write_table(spark.createDataFrame([("a,b", 1, "x")], "place string, people int, place_id string").coalesce(1), str(tmp_path / "out"))
    (part,) = [x for x in os.listdir(tmp_path / "out") if x.endswith(".csv")]
    assert (tmp_path / "out" / part).read_text(encoding="utf-8-sig") == 'place,people\n"a,b",1\n'
    for k, name in enumerate(("old.nt", "new.nt", "newer.txt")):
        (tmp_path / name).write_text("")
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (1000 + k, 1000 + k))
    assert readers.newest_file(spark, str(tmp_path)).first()[0].endswith("new.nt")


MANY = (
    "﻿@prefix a: <http://e/a#> .\n# no end. here\nPREFIX b: <http://e/b#>\n@base <http://e/base/> .\n"
    + "".join(f'a:s{k} a b:T ; b:n {k} , {k}.25 ; b:said "x . y" , \'\'\'long\n. # {k} "\n""" end\'\'\'@en ; b:of [ b:in <rel{k}> ] .\n' for k in range(40))
    + '@prefix a: <http://e/other#> .\na:last b:p """one\n""two\\" ." \n.""".a:again b:p ( 1 2 ).\n'
    + "_:x b:p _:x .\na:end b:p a:x.y ."
)


@pytest.mark.parametrize("size", [64, 300, 2000, 1 << 20])
def test_turtle_files_are_cut(spark, tmp_path, size):
    """Blocks of any size give the triples of the whole document, but for the names of blank nodes."""
    for name in ("a.ttl", "b.ttl"):
        (tmp_path / name).write_text(MANY if name == "a.ttl" else MANY.replace("http://e/", "http://f/"), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for name, host in (("a.ttl", "http://e/"), ("b.ttl", "http://f/")):
            got = readers.read_triples(spark, str(tmp_path / name))
            plain = lambda rows: sorted(tuple("_" if str(x).startswith("_:") else x for x in r) for r in rows)
            want = rdf.turtle(MANY.removeprefix("﻿").replace("http://e/", host))
            assert plain((r.s, r.s_kind, r.p, r.o, r.o_kind, r.o_lang, r.o_dtype) for r in got.collect()) == plain(want)
            labels = {r.s for r in got.where("s = o").collect()}
            assert len(labels) == 1 and got.where("s_kind = 'bnode'").select("s").distinct().count() == 43
        if size < 1000:
            from quillgraph.sources import turtle

            assert spark.read.text(str(tmp_path / "a.ttl")).rdd.getNumPartitions() > 5
            assert turtle.statements(spark, f"{tmp_path}/*.ttl").groupBy("file").count().count() == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_turtle_faults_name_their_statement(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix a: <http://e/> .\na:x a:y a:z .\na:x a:y .\n")
    with pytest.raises(Exception, match=r"a\.ttl, statement 3"):
        readers.read_triples(spark, str(tmp_path / "a.ttl")).collect()
    (tmp_path / "b.ttl").write_text("")
    assert readers.read_triples(spark, str(tmp_path / "b.ttl")).count() == 0
    with pytest.raises(ValueError, match="too deeply"):
        rdf.turtle("<http://a> <http://b> " + "[ <http://c> " * 5000)
