"""What is built for large inputs, over hand-made rows and against plain versions: plans, restarts, hot groups, time."""

import functools
import random
import time

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import script
from quillgraph.operators import counts, evidence, graph, hierarchy, names, spans, triples
from quillgraph.operators.staging import dealt
from quillgraph.plans import graph_queries, scheduler
from quillgraph.sources import recovery
from quillgraph.streaming import graph_store, lines


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def grouped_where_read(df):
    """Whether rows are grouped by the tasks that read them, whatever these hold."""
    return "Aggregate" in plan(df).rpartition("Exchange")[2]


# --- tasks of bounded size -------------------------------------------------------------------------------------------


def test_tasks_grow_with_the_rows(spark):
    df = spark.range(0, 50_000, 1, 1)
    for out in (dealt(df, "id", rows=1000), dealt(df, "id", rows=1000, n=50_000)):
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 50 and max(sizes) < 1500 and sum(sizes) == 50_000
    assert dealt(df.limit(0), "id").count() == 0


def test_literals_are_dealt_before_they_become_rows(spark):
    """Many subjects in one task, one with many values, one without a subject."""
    facts = [(f"s{k}", p, f"{p}{k}", "lit") for k in range(300) for p in ("机构", "通用层级", "x")] + [("s1", "机构", f"z{k}", "lit") for k in range(500)] + [(None, "机构", "n", "lit"), ("s2", "层级", " ", "lit"), ("s3", "层级", "t", "lit")]
    got = triples.position_rows(spark.createDataFrame(facts, "s string, p_local string, o string, o_kind string").coalesce(1))
    assert not grouped_where_read(got)
    want = {(f"s{k}", "z0" if k == 1 else f"机构{k}", "t" if k == 3 else f"通用层级{k}") for k in range(300)} | {(None, "n", None)}
    rows = got.select("s", "机构", "层级").collect()
    assert len(rows) == 301 and set(map(tuple, rows)) == want


def test_details_are_dealt_before_repeats_are_dropped(spark):
    """Many values of one subject, each twice, one without a subject, a code that is hidden."""
    facts = 2 * ([("s1", "机构", f"z{k}", "lit") for k in range(400)] + [("s2", "官职名称", " y ", "lit"), (None, "机构", "n", "lit"), ("s2", "对齐码_core", "c", "lit"), ("s2", "x", "c", "lit")])
    got = triples.position_details(spark.createDataFrame(facts, "s string, p_local string, o string, o_kind string").coalesce(1))
    assert not grouped_where_read(got)
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    want = {("s1", 2, "机构", f"z{k}") for k in range(400)} | {("s2", 8, "官职名称", "y"), (None, 2, "机构", "n")}
    assert len(rows) == 402 and {tuple(r)[:4] for r in rows} == want and len({r.task for r in rows}) == 12


@pytest.mark.parametrize("n", [None, 9_000_000])
def test_people_are_told_apart_where_they_are_dealt(spark, n):
    """One position that all hold, one that nobody holds, holders twice, without a position and without a person; blank and missing labels. Labels travel once a holder, and a task's part of them is bounded."""
    rng = random.Random(4)
    held = [(p, rng.randrange(40)) for p in range(300) for _ in range(5)] + [(p, 50) for p in range(300)] + [(7, 50), (8, None), (None, 51)]
    names = {k: (f" a{k % 7} ", None if k % 3 else "b", " " if k % 2 else "a1") for k in (*range(41), 50, 51, 60)}
    holders = spark.createDataFrame(held, "person_id long, position_id long")
    found = counts.per_dimension(holders, spark.createDataFrame([(k, *v) for k, v in names.items()], "position_id long, x string, y string, z string"), ["x", "y", "z"], n=n)
    above, _, below = plan(found).rpartition("hashpartitioning(person_id")
    assert "Broadcast" not in plan(found) and "hashpartitioning(dimension" in above and "Generate explode(labels" in above and "Aggregate" not in below
    want = {}
    for p, k in held:
        for d, label in zip("xyz", names.get(k, ())):
            if (label or "").strip():
                want.setdefault((d, label.strip()), set()).add(p)
    assert sorted(map(tuple, found.collect())) == sorted((*k, len(v - {None})) for k, v in want.items())


# --- recovery --------------------------------------------------------------------------------------------------------

A, B = {"type": "node", "label": "a"}, {"type": "node", "label": 'b{"}'}
RAW_A, RAW_B = '{"type":"node","label":"a"}', '{"type":"node","label":"b{\\"}"}'


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (f"{RAW_A}\nnot json\n{RAW_B}", [A, B]),
        (f"{RAW_A}\n{{oops", [A]),
        (f"{{oops don't\n{RAW_A}", [A]),
        (f"Here: {RAW_A}, and {RAW_B}.", [A, B]),
        (f"[{RAW_A},{RAW_B}]", [A, B]),
        (f"[{RAW_A}\n{RAW_B}]", [A, B]),
        (f"1: {RAW_A}\n2: {RAW_B}", [A, B]),
        (f"```json\n[{RAW_A},]\n```", [A]),
        (f"<think>{RAW_B}</think>{RAW_A}", [A]),
        ('{"type":"node"\n"label":"a",}', [A]),
        ("{'type': 'node', 'label': 'a',}", [A]),
        ("[{'type': 'node', 'label': None}]", [{"type": "node", "label": None}]),
        ('{"type" "x"} ' + RAW_A, [A]),
        ("it's nothing", []),
        ("", []),
        (None, []),
        ("5", []),
    ],
)
def test_records_in(raw, want):
    assert list(recovery.records_in(raw)) == want


@pytest.mark.parametrize("text", ["{", "{'a': ", '{"a":', "'{\"", "{'", '{"\\', "}\n\n", "[1: {"])
def test_recovery_takes_time_that_grows_with_the_text(text):
    began = time.process_time()
    list(recovery.records_in(text * (600_000 // len(text))))
    assert time.process_time() - began < 6


def test_record_rows(spark):
    rows = [(1, f"{RAW_A}\nbad\n{RAW_B}"), (2, None), (3, "none"), (4, '{"x": 1}')]
    got = recovery.record_rows(spark.createDataFrame(rows, "k int, raw string"), "raw").orderBy("k", "ord").collect()
    assert [(r.k, r.ord, r.record.label) for r in got] == [(1, 0, "a"), (1, 1, 'b{"}')]


def test_outputs_of_one_file_are_read_by_many_tasks(spark):
    """Outputs that are equal too; a record with a field of another kind costs no other record."""
    odd = '{"type":"node","label":"c","properties":"none"}'
    df = spark.range(0, 600, 1, 1).select("id", F.create_map(F.lit("k"), "id").alias("m"), F.lit(f"{RAW_A}\n{odd}\n{RAW_B}").alias("raw"))
    found = recovery.record_rows(df, "raw")
    assert found.columns == ["id", "m", "raw", "ord", "record"] and dict(found.dtypes)["ord"] == "int"
    got = found.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.id, r.m["k"], r.ord, r.record.label) for r in got if r.ord != 1) == [(k, k, o, x) for k in range(600) for o, x in ((0, "a"), (2, 'b{"}'))]
    assert len({r.task for r in got}) == 12


# --- names -----------------------------------------------------------------------------------------------------------


def test_mentions_of_many_names(spark):
    """100,000 names, many with one beginning, some in nearly every text; against substring search."""
    rng = random.Random(3)
    called = [f"Customer#{k:09d}" for k in range(99_000)] + ["".join(rng.choices("abcd", k=rng.randint(2, 9))) for _ in range(1000)]
    texts = [(k, " ".join(rng.choice(called) if rng.random() < 0.2 else "".join(rng.choices("abcde", k=5)) for _ in range(30))) for k in range(60)]
    df, n = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(x,) for x in called], "n string")
    found = names.mentions(df, "id", "t", n, "n")
    assert {(r.id, r.n) for r in found.collect()} == {(i, x) for i, t in texts for x in set(called) if x in t}
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


@pytest.mark.parametrize("normal", [True, False])
def test_search_many_against_plain_search(spark, normal):
    rng = random.Random(5)
    called = [(k, "".join(rng.choices("ab c", k=rng.randint(1, 8)))) for k in range(400)] + [(k, "abab") for k in range(5)] + [(900, None), (901, "")]
    df = spark.createDataFrame(called, "node long, name string")
    terms = [(t,) for t in ["a", "ab", "abc", "abca", "b a", "zz", "zzz", "abab", "", None, "c", "a"]]
    index = names.name_index(df, "name", "node", normal)
    for most in (5, None):
        got = names.search_many(index, spark.createDataFrame(terms, "t string"), "t", most, normal).collect()
        for term in {t for (t,) in terms if t}:
            want = evidence.search(df, term, "name", "node", most, normal).collect()
            assert sorted((r.node, r.name, r.reason) for r in got if r.term == term) == sorted((r.node, r.name, r.reason) for r in want)


def test_common_terms_make_rows_for_hits_only(spark, monkeypatch):
    """Terms whose grams stand in every name: rows are made for what contains the term, not for what contains its grams."""
    made = []
    met = names._met
    monkeypatch.setattr(names, "_met", lambda *a, **k: made.append(met(*a, **k)) or made[-1])
    df = spark.range(3000).select(F.format_string("Customer#%09d", "id").alias("name"), F.col("id").alias("node"))
    terms = spark.range(3000).select(F.format_string("Customer#%09d", "id").alias("t"))
    got = names.search_many(names.name_index(df, "name", "node"), terms, "t")
    assert got.where("reason = '等值'").count() == got.count() == 3000 and made[0].count() == 3000


@pytest.mark.parametrize("piece", [7, 40, 1 << 20])
def test_mentions_and_their_counts_over_pieces(spark, monkeypatch, piece):
    """Texts longer and shorter than what is hashed at once, repeated texts, names in two scripts, hashes that all collide."""
    monkeypatch.setattr(names, "PIECE", piece)
    rng = random.Random(8)
    called = sorted({"".join(rng.choices("ab國", k=rng.randint(1, 6))) for _ in range(60)})
    texts = [(k, "".join(rng.choices("abc國国", k=rng.choice([0, 3, 20, 90])))) for k in range(40)] + [(90, None)]
    df, n = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(x,) for x in [*called, "", None]], "n string")
    want = {(i, x) for i, t in texts for x in called if x in (t or "")}
    assert {(r.id, r.n) for r in names.mentions(df, "id", "t", n, "n").collect()} == want
    counts_ = {r.n: r.texts for r in names.mention_counts(df, "id", "t", n, "n").collect()}
    assert counts_ == {x: sum(y == x for _, y in want) for x in {y for _, y in want}}
    simple = lambda x: x.replace("國", "国")
    both = names.mentions(df, "id", "t", n, "n", scripts=True).collect()
    assert {(r.id, r.n) for r in both} == {(i, x) for i, t in texts for x in called if simple(x) in simple(t or "")}


def test_texts_are_counted_by_dealt_tasks_in_one_pass(spark, monkeypatch):
    """Names without a space, with one at any place and with several, line breaks, spaces in a row, words over and over, texts that are cut; texts of one file are dealt and looked through once."""
    monkeypatch.setattr(names, "PIECE", 300)
    rng = random.Random(11)
    made = lambda n: "".join(rng.choices("aab \n國", k=n))
    called = sorted({made(rng.randint(1, 7)) for _ in range(400)} | {" ", "  ", " a", "a ", "a b", "a  b", "a b a", "國" * 40, "a" * 33 + " b"})
    texts = [(k, made(rng.choice([1, 5, 60, 290, 310, 900]))) for k in range(80)] + [(k, t) for k, t in enumerate(["", None, " ", "國" * 90, "a" * 299 + " b", "a  b a b"], 90)]
    df, n = spark.createDataFrame(texts, "id long, t string").coalesce(1), spark.createDataFrame([(x,) for x in called], "n string")
    found = names.mention_counts(df, "id", "t", n, "n")
    below = plan(found).partition("MapInArrow")[2]
    assert plan(found).count("MapInArrow") == 1 and "hashpartitioning(key" in below
    want = {x: sum(x in (t or "") for _, t in texts) for x in called}
    assert sorted(map(tuple, found.collect())) == sorted((x, k) for x, k in want.items() if k)


@pytest.mark.parametrize("held, spread", [(1 << 20, 1 << 22), (40, 3)])
def test_what_is_counted_is_given_up_in_time(monkeypatch, held, spread):
    """What a task holds and expands at once is bounded, and the sums are the same."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(names, "MOST_HELD", held)
    monkeypatch.setattr(names, "SPREAD", spread)
    rng = random.Random(12)
    texts = ["".join(rng.choices("abc ", k=30)) for _ in range(60)]
    counter, got, most = names._Counter({0: [1, 2, 3], 1: [1, 2, 3], 2: [0, 1, 2], 3: [4, 5]}, np.full(2, 0xFFFFFFFF, np.uint64), 64), {}, 0  # all windows pass
    for k in range(0, 60, 5):
        counter.add(pa.array(texts[k : k + 5]))
        most = max(most, len(counter.number))
        if counter.full() or k == 55:
            for b in counter.rows(pa.nulls(1, pa.int64())):
                for w, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    got[w] = got.get(w, 0) + x
    windows = {t[s : s + n] for t in texts for n in range(1, 6) for s in range(31 - n)}
    want = {w for w in windows if (w.count(" ") == 0 and len(w) < 4) or (w.count(" ") == 1 and w.find(" ") < 3 and len(w) - w.find(" ") < 4) or (w.count(" ") > 1 and len(w) > 3)}
    assert got == {w: sum(w in t for t in texts) for w in want} and not counter.number and (held > 40) == (most > 500)


def test_windows_of_one_hash_are_told_apart():
    import numpy as np

    points, at = names._points("abcabdabcabd"), np.array([0, 3, 6, 9])
    order, first = names._firsts(points, at, np.zeros(4, np.int64), np.zeros(4, np.int64), 3)
    assert sorted(at[order[first]].tolist()) == [0, 3]


def test_script_conversion_is_leftmost_longest(spark):
    entries = spark.createDataFrame([("ab", "1"), ("abc", "2"), ("bcd", "3"), ("a", "4"), ("a", "5"), ("", "x"), (None, "y"), ("d", None)], "s string, t string")
    convert = script.converter(entries, "s", "t")
    rows = spark.createDataFrame([("abcd",), ("xbcda",), ("abx",), ("",), (None,), ("q",)], "x string")
    assert [r[0] for r in rows.select(convert("x")).collect()] == ["2d", "x34", "1x", "", None, "q"]
    assert [len(r[0]) for r in rows.where("x is not null").select(script.forms(F.col("x"), convert)).collect()] == [2, 2, 2, 1, 1]
    with pytest.raises(ValueError, match="more than 2"):
        script.converter(entries, "s", "t", most=2)


# --- hierarchies and graphs ------------------------------------------------------------------------------------------


def test_closure_by_squaring_gives_least_depths(spark):
    rng = random.Random(7)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(5, 5), (None, 3), (3, None), (0, 1)]
    up = {}
    for c, p in edges:
        if c is not None and p is not None:
            up.setdefault(c, set()).add(p)
    want = set()
    for node in range(60):
        depth, level, ring = {node: 0}, 0, [node]
        while ring:
            level += 1
            ring = [p for p in {p for c in ring for p in up.get(c, ())} if p not in depth]
            depth |= dict.fromkeys(ring, level)
        want |= {(node, a, d) for a, d in depth.items()}
    nodes = spark.range(60).select(F.col("id").alias("node"))
    got = hierarchy.full_closure(spark.createDataFrame(edges, "child long, parent long"), nodes)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    few = hierarchy.full_closure(spark.createDataFrame(edges, "child long, parent long"), nodes.where("node in (0, 59)"))
    assert sorted(map(tuple, few.collect())) == sorted(x for x in want if x[0] in (0, 59))


@pytest.mark.parametrize("forks", [0, 12])
def test_ancestor_totals(spark, monkeypatch, forks):
    """Chains, trees, cycles with tails and self-loops, without and with nodes of several parents; pairs are made only above the latter."""
    rng = random.Random(11)
    edges = [(k, k + 1) for k in range(30)] + [(29 + k, 30) for k in range(3, 8)] + [(k, k + 1) for k in range(40, 53)] + [(53, 45), (54, 41), (60, 61), (61, 60), (62, 62), (62, 61), (70, 71), (None, 3), (3, None), (0, 1)]
    edges += [(rng.randrange(80, 100), rng.choice([rng.randrange(80, 110), 5, 50])) for _ in range(forks)]
    up = {}
    for c, p in edges:
        if None not in (c, p) and c != p:
            up.setdefault(c, set()).add(p)
    want = []
    for node in range(120):
        met, ring = set(), {node}
        while ring:
            ring = {p for c in ring for p in up.get(c, ())} - met
            met |= ring
        if met - {node}:
            want.append((node, len(met - {node}), sum(met - {node})))
    if not forks:
        monkeypatch.delattr(hierarchy, "full_closure")
    got = hierarchy.ancestor_totals(spark.createDataFrame(edges, "child long, parent long"), spark.range(120).select(F.col("id").alias("node")))
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_member_pairs_once_each(spark, block):
    rng = random.Random(2)
    members = [(e, p) for e, n in ((1, 40), (2, 1), (3, 7), (4, 0)) for p in rng.sample(range(100), n)] + [(1, None), (None, 5)]
    members += members[:5]
    df = spark.createDataFrame(members, "event_id long, person_id long")
    real = {m for m in members if None not in m}
    want = sorted((e, a, b) for e, a in real for f, b in real if e == f and a < b)
    assert sorted(map(tuple, graph.member_pairs(df, block).collect())) == want
    assert sorted((r.event_id, r.a, r.b) for r in graph.comembers(df, block).collect()) == sorted([*want, *((e, b, a) for e, a, b in want)])


def test_groups_are_dealt_by_their_pairs(spark):
    """3,000 events of 60 members make 5 million pairs, in one small task's files; one of 1,500 members makes 1 million more, in its blocks."""
    m = spark.range(0, 180_000, 1, 1).select((F.col("id") / 60).cast("long").alias("event_id"), (F.col("id") % 60).alias("person_id"))
    m = m.union(spark.range(1_500).select(F.lit(-1).cast("long"), "id"))
    sizes = [r["count"] for r in graph.member_pairs(m, 100).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3_000 * 60 * 59 // 2 + 1_500 * 1_499 // 2 and len(sizes) == 12 and max(sizes) < 1_000_000


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_partners_are_the_distinct_comembers(spark, block):
    """Large events that overlap, people in several of them, small events within, across and beside them."""
    rng = random.Random(6)
    members = [(e, p) for e, n in ((1, 40), (2, 30), (3, 7), (4, 1), (5, 12), *((k, rng.randint(1, 4)) for k in range(10, 90))) for p in rng.sample(range(150), n)] + [(1, None), (None, 5)]
    members += members[:5]
    real = {x for x in members if None not in x}
    met = {}
    for e, a in real:
        met.setdefault(a, set()).update(b for f, b in real if e == f and a != b)
    got = graph.partners(spark.createDataFrame(members, "event_id long, person_id long"), block).collect()
    assert sorted(map(tuple, got)) == sorted((a, len(b)) for a, b in met.items() if b)


def test_a_large_event_makes_no_pairs(spark):
    """200,000 members of one event are 20 billion pairs."""
    m = spark.range(200_000).select(F.lit(1).alias("event_id"), F.col("id").alias("person_id"))
    got = graph.partners(m.union(spark.createDataFrame([(2, 7), (2, 200_000)], "event_id int, person_id long")))
    assert {(r.partners, r["count"]) for r in got.groupBy("partners").count().collect()} == {(199_999, 199_999), (200_000, 1), (1, 1)}


def test_compose_merges_key_by_key(spark):
    rows = [("x", 1, {"a": "1", "b": "2"}), ("x", 2, {"b": "3"}), ("y", 1, {}), ("y", 2, None), ("x", 3, {"c": None})]
    got = {r.id: r.props for r in graph.compose(spark.createDataFrame(rows, "id string, ord int, props map<string,string>")).collect()}
    assert got == {"x": {"a": "1", "b": "3", "c": None}, "y": {}}


def test_ranks_in_parts(spark):
    rng = random.Random(9)
    rows = [(f"k{k}", rng.randint(1, 50)) for k in range(500)]
    df = spark.createDataFrame(rows, "label string, people long").repartition(7)
    far = counts.shares_in_parts(df, "label")
    near = counts.ranked_shares(df, "label")
    assert sorted(map(tuple, far.collect())) == sorted(map(tuple, near.collect()))
    assert "Window" in plan(far) and "SinglePartition" not in plan(far)
    numbered = counts.numbered_in_parts(df, F.col("people").desc(), "label")
    assert [r.label for r in numbered.orderBy("place").collect()] == [k for k, n in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert "SinglePartition" not in plan(numbered)
    assert counts.shares_in_parts(df.limit(0), "label").count() == 0 and counts.numbered_in_parts(df.limit(0), "label").count() == 0


def test_layout_prunes_and_shuffles_nothing(spark):
    rows = [(f"p{k}", "bornIn", f"n{k % 3}", "iri") for k in range(20)] + [(f"p{k}", "name", f"N{k}", "lit") for k in range(20)] + [(f"p{k}", "field", "x" if k % 2 else "y", "lit") for k in range(10)] + [(f"n{k}", "modern", f"M{k}", "lit") for k in range(3)]
    laid = triples.Layout(spark.createDataFrame(rows, "s string, p_local string, o string, o_kind string"), buckets=4)
    star = [("?p", "bornIn", "?n"), ("?p", "name", "?name"), ("?p", "field", "x")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = laid.match(star)
        assert sorted((r.p, r.n, r.name) for r in found.collect()) == sorted((f"p{k}", f"n{k % 3}", f"N{k}") for k in range(1, 10, 2))
        assert "Exchange hashpartitioning" not in plan(found)
        chain = laid.match([("?p", "bornIn", "?n"), ("?n", "modern", "M1")])
        assert {r.p for r in chain.collect()} == {f"p{k}" for k in range(20) if k % 3 == 1}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "PartitionFilters: [isnotnull(p_local" in plan(laid.all.where("p_local = 'modern'"))
    with pytest.raises(ValueError, match="no variable"):
        laid.match([("?p", "bornIn", "?n"), ("?x", "modern", "?y")])


# --- spans -----------------------------------------------------------------------------------------------------------


def test_offsets_of_tokens(spark):
    rows = [(1, ["ab", "", "中文x", "d"]), (2, []), (3, None), (4, ["a", None, "b"])]
    df = spark.createDataFrame(rows, "k int, w array<string>")
    got = {r.k: (r.starts, r.stops) for r in spans.offsets(df, "k", "w", gap=1).collect()}
    assert got == {1: ([0, 3, 4, 8], [2, 3, 7, 9]), 2: ([], []), 3: (None, None), 4: ([0, 2, 3], [1, 2, 4])}
    wanted = spark.createDataFrame([(1, 0, 2), (1, 3, 3), (1, 3, 4), (4, 2, 1), (2, 0, 0)], "k int, first int, last int")
    placed = spans.characters(wanted, spans.offsets(df, "k", "w", gap=1), "k").collect()
    assert sorted((r.k, r.start, r.stop) for r in placed) == [(1, 0, 7), (1, 8, 9)]


def test_spans_by_place_equal_spans_by_join(spark):
    rng = random.Random(1)
    heads = [[[rng.random() for _ in range(8)] for _ in range(12)] for _ in range(6)]
    tails = [[rng.random() for _ in range(12)] for _ in range(6)]
    arrays = spark.createDataFrame([(k, 0, heads[k], tails[k]) for k in range(6)] + [(9, 0, [], []), (10, 0, None, None)], "line_id int, type_idx int, heads array<array<double>>, tails array<double>")
    head = spark.createDataFrame([(k, 0, p, d, heads[k][p][d]) for k in range(6) for p in range(12) for d in range(8)], "line_id int, type_idx int, pos int, delta int, p double")
    tail = spark.createDataFrame([(k, p, tails[k][p]) for k in range(6) for p in range(12)], "line_id int, pos int, p double")
    assert sorted(map(tuple, spans.decoded(arrays).collect())) == sorted(map(tuple, evidence.decoded_spans(head, tail).collect()))


# --- streams and stages ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("replace", [False, True])
def test_graph_of_a_stream_with_a_restart(spark, sf, tmp_path, replace):
    """Orders in four files, fed by three runs, equal the batch result; a batch that runs again adds nothing."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey < 2000")
    folder, store = str(tmp_path / "lines"), graph_store.GraphStore(spark, f"file://{tmp_path}/graph", replace)
    line = F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"))

    def step(batch):
        part = lambda k: F.split_part("text", F.lit("|"), F.lit(k))
        return graph_queries.order_graphs(batch.select(part(1).cast("long").alias("o_orderkey"), part(2).cast("long").alias("o_custkey"), part(3).alias("o_orderstatus"), part(4).alias("o_orderpriority"), part(5).cast("date").alias("o_orderdate")))

    last = None
    for run, parts in enumerate(((0, 1), (2,), (3,))):
        for k in parts:
            orders.where(f"o_orderkey div 500 = {k}").select(line.alias("value")).coalesce(1).write.mode("append").text(folder)
        store.run(lines.line_stream(spark, folder), step, f"{tmp_path}/check").awaitTermination()
        last = parts
        if run == 1 and not replace:
            store.compact()
    number = max(store._folders("edges"))
    fed = orders if not replace else orders.where(f"o_orderkey div 500 = {last[0]}")
    nodes, edges = graph_queries.order_graphs(fed)
    key = lambda rows: sorted((r.id, sorted(r.props.items())) for r in rows)
    assert key(store.nodes().collect()) == key(graph.compose(nodes).collect())
    every = lambda df: sorted((r.src, r.dst, r.label, sorted(r.props.items())) for r in df.collect())
    assert every(store.edges()) == every(edges)
    again = orders.where("o_orderkey div 500 = 3")
    store.write(*graph_queries.order_graphs(again), number)
    assert key(store.nodes().collect()) == key(graph.compose(nodes).collect()) and every(store.edges()) == every(edges)


def _plus(n):
    return F.lit(n)


HELD = {"n": 1}


def test_stages_know_their_code():
    code = scheduler._code
    nested = [lambda df, n=None: df.select((lambda: F.lit(1))()), lambda df, n=None: df.select((lambda: F.lit(2))())]
    assert code(nested[0]) != code(nested[1])
    stage = lambda df: df.select(_plus(HELD["n"]))
    first = code(stage)
    assert first == code(stage)
    global _plus
    kept = _plus
    try:
        exec("def _plus(n):\n    return F.lit(n + 1)", globals())
        assert code(stage) != first
        globals()["_plus"] = kept
        assert code(stage) == first
        HELD["n"] = 2
        assert code(stage) != first
    finally:
        globals()["_plus"], HELD["n"] = kept, 1

    def made(n):
        inner = lambda df: df.limit(n)
        return lambda df: inner(df)

    assert code(made(1)) != code(made(2)) and code(made(1)) == code(made(1))
    assert code(functools.partial(made, 1)) != code(functools.partial(made, 2))


def test_changed_stages_run_again(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    source, folder = spark.read.parquet(f"{tmp_path}/in"), f"{tmp_path}/out"

    def stages(k):
        return [("one", lambda df: df.withColumn("x", F.col("id") + 1)), ("two", lambda df: (lambda d: d.withColumn("y", F.lit(k)))(df))]

    runs = [scheduler.run_stages(source, stages(k), folder) for k in (1, 1, 2)]
    assert [[o.resumed for o in log] for _, log in runs] == [[False, False], [True, True], [True, False]]
    assert {r.y for r in runs[2][0].collect()} == {2}


def test_pages_by_name(spark, tmp_path):
    from quillgraph.sources import datasets

    spark.range(4).write.parquet(f"{tmp_path}/d")
    made = []

    def page(df, n=0):
        made.append(n)
        if n > 8:
            raise RuntimeError("broken")
        return df.where(F.col("id") >= n)

    pages = datasets.Pages(datasets.Datasets(spark, lambda s, p: s.read.parquet(p)), {"a": page, "b": page})
    path = f"{tmp_path}/d"
    assert pages.names() == ["a", "b"] and [pages.open("a", path).count(), pages.open("a", path).count(), pages.open("a", path, n=3).count()] == [4, 4, 1]
    assert made == [0, 3]
    with pytest.raises(datasets.PageFailed, match="'b'"):
        pages.open("b", path, n=9)
    assert pages.open("b", path).count() == 4 and made == [0, 3, 9, 0]
    spark.range(6).write.mode("append").parquet(path)
    assert pages.open("a", path).count() == 10
    with pytest.raises(KeyError, match="no page 'c'; there are a, b"):
        pages.open("c", path)
    with pytest.raises(ValueError, match="no pages"):
        datasets.Pages(pages.datasets, {" ": page})
