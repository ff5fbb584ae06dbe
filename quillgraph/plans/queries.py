"""One query per operator over the driver tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import domain, exams, text
from ..operators import counts, evidence, events, facets, graph, hierarchy, names, places, triples
from ..sources import extraction, readers
from .registry import ORACLE_SQL, QUERIES, query
from .views import ERA_SQL, YEARS, Views, sql

def long(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# --- triples: scans, projections, literals ---------------------------------------------------------------------------


@query(sql("SELECT s AS node FROM triple WHERE p = 'type' AND o = 'http://ex/o#Person'", "triple"))
def triples_class_extent(v):
    return triples.class_extent(v.triples(), "Person")


@query(sql("SELECT p AS p_local, count(*) AS n, count(DISTINCT s) AS subjects FROM triple GROUP BY 1", "triple"))
def triples_by_predicate(v):
    return v.triples().groupBy("p_local").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("subjects"))


@query(sql("SELECT s, string_agg(p || '=' || o, ';' ORDER BY p) AS props FROM triple WHERE k = 'lit' GROUP BY 1", "triple"))
def triples_literal_map(v):
    props = triples.literal_map(v.triples())
    return props.select("s", F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";").alias("props"))


@query(
    """SELECT page_id, regexp_extract(url, '([^#/:]*)$', 1) AS name_a, CASE WHEN contains(url, '#') THEN split_part(url, '#', -1) ELSE split_part(url, '/', -1) END AS name_b
    FROM pages"""
)
def local_names(v):
    return v.table("pages").select("page_id", text.local_name_a(F.col("url")).alias("name_a"), text.local_name_b(F.col("url")).alias("name_b"))


@query(
    sql("""SELECT s, coalesce(min(CASE WHEN p = 'field' THEN o END), min(CASE WHEN p = 'modern' THEN o END), min(o)) AS value
    FROM triple
    WHERE k = 'lit'
    GROUP BY 1""", "triple")
)
def first_literal_with_fallback(v):
    return triples.first_literal(v.triples(), ["field", "modern"], fallback=True)


@query(
    sql("""SELECT s, coalesce(min(CASE WHEN p = 'field' THEN o END), min(CASE WHEN p = 'modern' THEN o END)) AS value
    FROM triple
    WHERE k = 'lit' AND p IN ('field', 'modern')
    GROUP BY 1""", "triple")
)
def first_literal_priority(v):
    return triples.first_literal(v.triples(), ["field", "modern"])


@query(sql("SELECT DISTINCT s, o AS value FROM triple WHERE p IN ('name', 'modern')", "triple"))
def literals_distinct(v):
    return triples.distinct_literals(v.triples(), ["name", "modern"])


@query(sql("SELECT s AS node, count(*) AS n FROM (SELECT s, o FROM triple WHERE k = 'iri' UNION SELECT o, s FROM triple WHERE k = 'iri') GROUP BY 1", "triple"))
def one_hop_neighbors(v):
    return triples.neighbours(v.triples()).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query(
    sql("""SELECT t.s AS node, coalesce(min(n.o), regexp_extract(t.s, '([^#/:]*)$', 1)) AS name
    FROM (SELECT DISTINCT s
    FROM triple
    WHERE p = 'type') t
    LEFT
    JOIN triple n ON n.s = t.s AND n.p = 'name'
    GROUP BY t.s""", "triple")
)
def person_display_name(v):
    t = v.triples()
    return triples.display_name(triples.scan(t, p="type").select(F.col("s").alias("node")).distinct(), t, ["name"])


@query(
    sql("""SELECT s, min(CASE WHEN p = 'name' THEN o END) AS name, coalesce(min(CASE WHEN p = 'field' THEN o END), min(CASE WHEN p = 'name' THEN o END)) AS field
    FROM triple
    WHERE p IN ('name', 'field')
    GROUP BY 1""", "triple")
)
def attributes_pivot(v):
    return triples.attribute_row(v.triples(), ["name", "field"], {"field": "name"})


@query(sql("SELECT s, CAST(CASE p WHEN 'field' THEN 0 ELSE 1 END AS INT) AS ord, p AS key, o AS value FROM triple WHERE p IN ('name', 'field')", "triple"))
def profile_key_values(v):
    return triples.key_values(v.triples(), ["field", "name", "code_x"], hide_prefix="code_")


@query(
    """SELECT conv_id, turn, i AS line_no, trim(l) AS line
    FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
    FROM conversations)
    WHERE trim(l) <> ''"""
)
def line_documents(v):
    c = v.table("conversations").withColumn("key", F.struct("conv_id", "turn"))
    return readers.line_documents(c, "text", "key").select("key.conv_id", "key.turn", "line_no", "line")


# --- filters and populations -----------------------------------------------------------------------------------------


@query(
    sql("""SELECT DISTINCT e AS node
    FROM ev_type t
    WHERE cls IN ('OfficeAtPlaceEvent', 'TaskEvent') AND NOT EXISTS (SELECT 1
    FROM ev_type b
    WHERE b.e = t.e AND b.cls = 'BirthEvent')""", "ev_type")
)
def clean_events(v):
    return events.clean_events(v.event_types())

@query(
    sql("""SELECT e AS event, min(o) AS place
    FROM ev_link
    WHERE p IN ('hasPlace', 'tookPlaceAt', 'happenedIn') AND o IN (SELECT 'N' || n_nationkey
    FROM nation)
    GROUP BY 1""", "ev_link")
)
def strict_event_place(v):
    return events.strict_place(v.event_links(), v.nations())


@query(
    sql("""SELECT e AS event, coalesce(min(CASE WHEN p = 'hasPlace' THEN o END), min(o)) AS place
    FROM ev_link
    WHERE o IN (SELECT 'N' || n_nationkey
    FROM nation)
    GROUP BY 1""", "ev_link")
)
def loose_event_place(v):
    return events.loose_place(v.event_links(), v.nations())

LEVEL_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN '殿试' WHEN '2-HIGH' THEN ' 殿 試 ' WHEN '3-MEDIUM' THEN 'Palace exam' WHEN '4-NOT SPECIFIED' THEN '御试' ELSE '会试' END"
NAME_SQL = "CASE WHEN o_orderkey % 10 = 0 THEN 'Palace' ELSE 'x' END || o_orderkey"


@query(
    f"""SELECT o_orderkey, contains(l, '殿试') OR contains(n, 'Palace') AS any_literal, contains(l, '殿试') OR contains(l, 'Palace') OR coalesce(p, '') = '殿试' AS either_level, l IN ('殿试', ' 殿 試 ') AS equal_level, regexp_matches(l, '殿|Palace|御试') OR contains(n, 'Palace') AS level_keys, regexp_matches(l, '殿|Palace|御试') OR contains(n, 'Palace') AS level_or_name
    FROM (SELECT o_orderkey, {LEVEL_SQL} AS l, {NAME_SQL} AS n, CASE WHEN o_orderstatus = 'F' THEN '殿试' END AS p
    FROM orders)"""
)
def palace_test_variants(v):
    o = v.table("orders").select("o_orderkey", F.expr(LEVEL_SQL).alias("l"), F.expr(NAME_SQL).alias("n"), F.expr("CASE WHEN o_orderstatus = 'F' THEN '殿试' END").alias("p"))
    each, name = F.array("l"), F.col("n")
    props = F.create_map(F.lit("科举等级"), each)
    return o.select("o_orderkey", exams.palace_by_any_literal(each, name).alias("any_literal"), exams.palace_by_either_level(each, F.array("p")).alias("either_level"), exams.palace_by_equal_level(F.col("l")).alias("equal_level"), exams.palace_by_level_keys(props, name).alias("level_keys"), exams.palace_by_level_or_name(F.col("l"), name).alias("level_or_name"))

@query(
    sql("""SELECT c_custkey AS person_id
    FROM customer
    WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AND c_nationkey IN (3, 5, 7) AND c_custkey IN (SELECT person_id
    FROM part_in
    WHERE palace)""", "part_in")
)
def facet_any_match(v):
    people = v.facet().select("person_id").join(v.palace().select("person_id"), "person_id", "left_semi")
    return facets.match_facets(people, v.attributes(), {"segment": ["BUILDING", "ＡＵＴＯ MOBILE"], "nation": ["3", "5", "7"], "none": []}, exact=("nation",))


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_nationkey IN (3, 5, 7) GROUP BY 1")
def facet_self_exclusion(v):
    people = facets.match_facets(v.facet().select("person_id"), v.attributes(), {"segment": ["BUILDING"], "nation": ["3", "5", "7"]}, exact=("nation",), skip="segment")
    return counts.rows_per(v.table("customer").join(people, F.col("c_custkey") == F.col("person_id"), "left_semi").select(F.col("c_mktsegment").alias("segment")), "segment")


@query("SELECT c_custkey AS person_id FROM customer WHERE c_mktsegment = 'BUILDING'")
def bucket_hit_people(v):
    return facets.bucket_hits(v.attributes().where("facet = 'segment'"), " ＢＵＩＬＤＩＮＧ")


SCHOOL_SQL = "SELECT c_custkey AS about, CASE c_custkey % 4 WHEN 0 THEN 'http://ex/o#学籍类型' WHEN 1 THEN '學籍之類型' WHEN 2 THEN '官职' ELSE 'http://ex/o#类型' END AS prop, ' 府 學' AS value, CASE WHEN c_custkey % 3 = 0 THEN '府学' ELSE ' ' END AS value_norm FROM customer"


@query(f"SELECT about, CASE WHEN about % 3 = 0 THEN '府学' ELSE '府 學' END AS value FROM ({SCHOOL_SQL}) WHERE about % 4 <> 2")
def school_type_people(v):
    v.table("customer").createOrReplaceTempView("__customer")
    return facets.school_types(v.spark.sql(SCHOOL_SQL.replace("FROM customer", "FROM __customer")), form="people")


@query(
    f"""SELECT node AS about, min(value) AS value
    FROM (SELECT about AS node, about
    FROM ({SCHOOL_SQL})
    UNION ALL SELECT c_custkey, c_custkey + 1
    FROM customer)
    JOIN (SELECT about, CASE WHEN about % 3 = 0 THEN '府学' ELSE '府 學' END AS value
    FROM ({SCHOOL_SQL})
    WHERE about % 4 IN (0, 1)) USING (about)
    GROUP BY node, replace(value, ' ', '')"""
)
def school_type_people_nearby(v):
    v.table("customer").createOrReplaceTempView("__customer")
    given = v.spark.sql(SCHOOL_SQL.replace("FROM customer", "FROM __customer"))
    next_ = v.table("customer").select(F.col("c_custkey").alias("node"), (F.col("c_custkey") + 1).alias("other"))
    return facets.school_types_nearby(given, next_, by_local_name=False, form="trend")

@query(sql("SELECT DISTINCT person_id FROM birth JOIN up ON node = place_id WHERE ancestor = 'R1'", "birth", "up"))
def region_subtree_people(v):
    return v.birth().join(hierarchy.subtree(v.closure(), "R1"), F.col("place_id") == F.col("node"), "left_semi").select("person_id").distinct()


@query(
    sql(f"""SELECT DISTINCT person_id
    FROM part_in
    JOIN year_era USING (year)
    JOIN {ERA_SQL} ON era.era = year_era.era
    WHERE palace AND ord BETWEEN 1 AND 2""", "part_in", "year_era")
)
def era_window_people(v):
    window = v.year_era().join(F.broadcast(facets.eras_between(v.eras(), "丙元", "乙元")), "era", "left_semi")
    return v.palace().join(F.broadcast(window), "year", "left_semi").select("person_id").distinct()


@query(sql("SELECT DISTINCT person_id FROM part_in WHERE palace AND year BETWEEN 1995 AND 1999", "part_in"))
def year_range_people(v):
    span = facets.years_of_eras(v.eras(), "丙元", "乙元")
    return v.palace().join(F.broadcast(span), F.col("year").between(F.col("low"), F.col("high"))).select("person_id").distinct()


@query(
    sql("""SELECT DISTINCT person_id
    FROM part_in
    JOIN (SELECT DISTINCT person_id
    FROM (SELECT person_id, min(place_id) AS place_id
    FROM birth
    GROUP BY 1)
    JOIN up ON node = place_id
    WHERE ancestor = 'R1') USING (person_id)
    WHERE palace""", "part_in", "birth", "up")
)
def region_people_by_single_birthplace(v):
    born = events.single(v.birth(), "person_id", "place_id").join(hierarchy.subtree(v.closure(), "R1"), F.col("place_id") == F.col("node"), "left_semi")
    return v.palace().join(born, "person_id", "left_semi").select("person_id").distinct()

@query(
    """SELECT c_custkey AS node, c_name AS name, CASE WHEN c_name = 'Customer#000000001' THEN '等值' ELSE '包含' END AS reason
    FROM customer
    WHERE contains(c_name, 'Customer#000000001')
    UNION ALL SELECT c_custkey, c_name, '包含'
    FROM customer
    WHERE false
    ORDER BY name, node LIMIT 30"""
)
def person_search(v):
    return evidence.search(v.table("customer"), " Customer＃000000001", "c_name", "c_custkey")


@query(
    """SELECT node, name, reason
    FROM (SELECT node, arg_min(name, r || name) AS name, CASE min(r) WHEN 0 THEN '等值' ELSE '包含' END AS reason
    FROM (SELECT c_custkey AS node, a AS name, CASE WHEN replace(a, ' ', '') = 'BUILDING1' THEN 0 ELSE 1 END AS r
    FROM (SELECT c_custkey, unnest([c_name, c_mktsegment || ' ' || c_custkey]) AS a
    FROM customer)
    WHERE contains(replace(a, ' ', ''), 'BUILDING1'))
    GROUP BY 1)
    ORDER BY name, node LIMIT 50"""
)
def person_search_by_alias(v):
    names = v.table("customer").select("c_custkey", F.explode(F.array("c_name", F.concat_ws(" ", "c_mktsegment", "c_custkey"))).alias("a"))
    return evidence.search(names, "BUILDING 1", "a", "c_custkey", most=50)

@query(
    """SELECT name, count(*) AS docs
    FROM (SELECT DISTINCT split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) AS name
    FROM benchmark)
    JOIN documents ON contains(documents.text, name)
    GROUP BY 1"""
)
def text_contains_alias(v):
    b = v.table("benchmark").select(F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(2)), F.split_part("text", F.lit(" "), F.lit(3))).alias("name"))
    return names.mentions(v.table("documents"), "doc_id", "text", b, "name", scripts=True).groupBy("name").agg(F.count(F.lit(1)).alias("docs"))

# --- joins -----------------------------------------------------------------------------------------------------------


@query(sql("SELECT kind, person_id, count(DISTINCT place_id) AS places FROM event GROUP BY 1, 2", "event"))
def person_event_place(v):
    e = v.event()
    both = events.people_at_places(e.select("event_id", "person_id"), e.select("event_id", "place_id", "kind"), "event_id")
    return both.groupBy("kind", "person_id").agg(F.count(F.lit(1)).alias("places"))

@query(sql("SELECT person_id, count(DISTINCT exam) AS exams, min(exam) AS first_exam FROM part_in GROUP BY 1", "part_in"))
def person_exam(v):
    return counts.distinct_and_first(v.participation(), "person_id", "exam", "exams", "first_exam")


@query(sql("SELECT person_id, count(*) AS positions FROM appoint GROUP BY 1", "appoint"))
def person_position(v):
    return counts.distinct_and_first(v.appointment(), "person_id", "position_id", "positions").drop("first")


@query(sql("SELECT person_id, min(place_id) AS place_id FROM birth GROUP BY 1", "birth"))
def person_birth_place(v):
    return events.single(v.birth(), "person_id", "place_id")


@query(
    """SELECT event, person
    FROM (SELECT 'e' || o_orderkey AS event, 'p' || o_custkey AS person
    FROM orders
    WHERE o_orderkey % 2 = 0
    UNION SELECT 'e' || o_orderkey, 'p' || o_custkey
    FROM orders
    WHERE o_orderkey % 3 = 0)
    WHERE CAST(substr(event, 2) AS BIGINT) % 7 <> 0"""
)
def event_person_bidirectional(v):
    o = v.table("orders").select(F.concat(F.lit("e"), "o_orderkey").alias("e"), F.concat(F.lit("p"), "o_custkey").alias("p"), "o_orderkey")
    to, back = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0")
    links = to.select(F.col("e").alias("s"), F.col("p").alias("o")).union(back.select(F.col("p").alias("s"), F.col("e").alias("o"))).withColumn("o_kind", F.lit("iri"))
    people = v.table("customer").select(F.concat(F.lit("p"), "c_custkey").alias("node"))
    return events.linked_either_way(links, o.where("o_orderkey % 7 <> 0").select(F.col("e").alias("node")), people)

@query(
    """SELECT node, count(*) AS sources
    FROM (SELECT doc_id AS node, source AS tp
    FROM documents
    UNION SELECT l.doc_id, lang
    FROM labels l
    JOIN documents d ON d.doc_id = l.doc_id)
    GROUP BY 1"""
)
def provenance_paths(v):
    d = v.table("documents")
    contains = d.select(F.col("doc_id").alias("node"), F.col("source").alias("tp"))
    about = v.table("labels").select(F.col("doc_id").alias("node"), F.col("doc_id").alias("pa"))
    derived = d.select(F.col("doc_id").alias("pa"), F.col("lang").alias("tp"))
    return evidence.provenance_paths(contains, about, derived).groupBy("node").agg(F.count(F.lit(1)).alias("sources"))


@query(sql("SELECT person_id FROM facet WHERE person_id IN (SELECT person_id FROM part_in WHERE palace)", "facet", "part_in"))
def palace_semi(v):
    return v.facet().join(v.palace(), "person_id", "left_semi").select("person_id")


@query(
    sql("""SELECT person_id, exam
    FROM part_in
    WHERE palace AND person_id NOT IN (SELECT person_id
    FROM part_in
    WHERE palace
    GROUP BY 1
    HAVING count(DISTINCT exam) >= 2)
    GROUP BY 1, 2""", "part_in")
)
def conflict_anti(v):
    return counts.without_conflicts(v.palace().select("person_id", "exam").distinct(), ["person_id"], "exam")


@query(
    sql(f"""SELECT y.year, count(DISTINCT person_id) AS people
    FROM (SELECT CAST(unnest(range({YEARS[0]}, {YEARS[1] + 1})) AS INT) AS year) y
    LEFT
    JOIN part_in p ON p.year = y.year AND palace
    GROUP BY 1""", "part_in")
)
def hosted_axis_zero_fill(v):
    return counts.zero_filled(v.years(), counts.people_per(v.palace(), "year"), ["year"], "people")


@query(sql("SELECT p.pe, era FROM part_in p LEFT JOIN year_era e ON e.year = p.year", "part_in", "year_era"))
def year_to_era_range(v):
    return domain.with_era(v.participation().select("pe", "year"), "year", v.eras()).select("pe", "era")


@query(
    sql("""SELECT a.person_id AS a, count(DISTINCT b.person_id) AS partners
    FROM member a
    JOIN member b ON a.event_id = b.event_id AND a.person_id <> b.person_id
    GROUP BY 1""", "member")
)
def comembers(v):
    return graph.comembers(v.member()).groupBy("a").agg(F.countDistinct("b").alias("partners"))


@query(
    """SELECT person_id AS a, CAST(sum(n - 1) AS BIGINT) AS meetings
    FROM (SELECT person_id, count(*) OVER (PARTITION BY event_id) AS n
    FROM (SELECT DISTINCT l_orderkey AS event_id, l_suppkey AS person_id
    FROM lineitem))
    WHERE n > 1
    GROUP BY 1"""
)
def people_meetings(v):
    return graph.meetings(v.member(urgent=False))

@query(
    """SELECT o_orderkey AS edge, n.node
    FROM orders
    JOIN customer m ON m.c_custkey = o_custkey
    JOIN (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS node
    FROM customer
    GROUP BY 1, 2) n ON n.c_nationkey = m.c_nationkey AND n.c_mktsegment = m.c_mktsegment"""
)
def endpoint_resolution(v):
    c = v.table("customer")
    props = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.concat(F.lit(" "), "c_mktsegment"), F.lit("blank"), F.lit(" "))
    label = F.when(F.col("c_custkey") >= 0, "Person").alias("label")
    nodes = c.select(F.col("c_custkey").alias("node"), F.col("c_custkey").alias("ord"), label, props.alias("props"))
    refs = v.table("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("edge"), label, props.alias("ref"))
    return graph.resolve_endpoints(refs, nodes)


PG_NODES = "SELECT 'node' AS type, 'Person' AS label, c_custkey AS ord, 'P' || (c_custkey % 700) AS a, NULL AS b FROM customer UNION ALL SELECT 'node', 'Place', 10000000 + n_nationkey, n_name, NULL FROM nation UNION ALL SELECT 'node', 'Region', 20000000 + r_regionkey, r_name, NULL FROM region UNION ALL SELECT 'relationship', CASE WHEN c_custkey % 9 = 0 THEN '甲' ELSE '生' END, 30000000 + c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'nobody' ELSE 'P' || (c_custkey % 700) END, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey"
PG_NAMED = f"SELECT ord, label, a, a || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS node FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY ord) AS k FROM ({PG_NODES}) WHERE type = 'node' AND label <> 'Region')"


def _records(v: Views) -> DataFrame:
    for t in ("customer", "nation", "region"):
        v.table(t).createOrReplaceTempView(f"__{t}")
    r = v.spark.sql(re.sub(r"\b(FROM|JOIN) (customer|nation|region)\b", r"\1 __\2", PG_NODES))
    one = lambda k, c: F.create_map(F.lit(k), F.col(c), F.lit("x"), F.lit(" "))
    props = F.when(F.col("type") == "node", F.when(F.col("label") == "Place", one("现代名称", "a")).otherwise(one("姓名", "a")))
    edge = F.col("type") == "relationship"
    return r.select("type", "label", "ord", props.alias("properties"), F.when(edge, one("姓名", "a")).alias("start"), F.when(edge, one("现代名称", "b")).alias("end"))


@query(f"SELECT node, label FROM ({PG_NAMED})")
def pg_build_nodes(v):
    return graph.build_nodes(_records(v), "ord", list(extraction.NODES)).select("node", "label")


@query(
    f"""SELECT s.node AS src, e.b AS dst, e.label
    FROM ({PG_NODES}) e
    JOIN (SELECT a, arg_min(node, ord) AS node
    FROM ({PG_NAMED})
    WHERE label = 'Person'
    GROUP BY 1) s ON s.a = e.a
    WHERE e.type = 'relationship' AND e.label = '生'"""
)
def pg_build_edges(v):
    r = _records(v)
    return graph.build_edges(r, graph.build_nodes(r, "ord", list(extraction.NODES)), "ord", extraction.RELATIONS).select("src", "dst", "label")

# --- hierarchy and graphs --------------------------------------------------------------------------------------------


@query(sql("SELECT node, ancestor, CAST(min(depth) AS INT) AS depth FROM up GROUP BY 1, 2", "up"))
def place_closure(v):
    return v.closure()


@query(sql("SELECT node, ancestor AS lifted FROM up JOIN place ON place_id = ancestor WHERE level = 'region'", "up"))
def lift_to_level(v):
    return hierarchy.lift(v.closure(), v.place(), "region")


@query(sql("SELECT ancestor AS root, count(*) AS nations FROM up JOIN place ON place_id = node WHERE level = 'nation' GROUP BY 1", "up"))
def descendants_at_level(v):
    return hierarchy.descendants_at(v.closure(), v.place(), "nation").groupBy("root").agg(F.count(F.lit(1)).alias("nations"))


META_SQL = "SELECT s_suppkey AS k, 'S' || s_suppkey AS node, CASE s_suppkey % 4 WHEN 0 THEN s_name || '市' WHEN 1 THEN s_name || '自治县' WHEN 2 THEN s_name || '省' ELSE 'S' || s_suppkey END AS modern, CASE WHEN s_suppkey % 5 = 0 THEN '府' ELSE CASE s_suppkey % 4 WHEN 0 THEN '市' WHEN 1 THEN '县' WHEN 2 THEN '省' END END AS level FROM supplier"


def _place_meta(v: Views, infer: bool = True) -> DataFrame:
    return places.metadata(v.table("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node")), v.place_facts(), infer)


@query(f"SELECT node, modern, level FROM ({META_SQL})")
def place_metadata(v):
    return _place_meta(v)


@query(f"SELECT node, modern, CASE WHEN k % 5 = 0 THEN '府' END AS level FROM ({META_SQL})")
def place_metadata_declared(v):
    return _place_meta(v, infer=False)


@query(
    sql(f"""SELECT 'N' || s_nationkey AS root, count(*) FILTER (WHERE level = '省' OR k % 4 = 0) AS provinces, count(*) FILTER (WHERE level = '市') AS cities
    FROM ({META_SQL})
    JOIN supplier ON s_suppkey = k
    GROUP BY 1
    HAVING count(*) FILTER (WHERE level IN ('省', '市') OR k % 4 = 0) > 0""")
)
def descendants_at_view(v):
    closed, meta = v.closure().where(F.col("ancestor").startswith("N")), _place_meta(v)
    n = lambda view, name: places.descendants_at_view(closed, meta, view).select("root", F.lit(name).alias("name"))
    both = n("省", "provinces").union(n("市", "cities"))
    return both.groupBy("root").pivot("name", ["provinces", "cities"]).count().fillna(0)


COORDINATE_SQL = "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey + 20.5 WHEN n_nationkey % 4 < 3 THEN n_nationkey + 20 END AS lat, CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey + 100.25 WHEN n_nationkey % 4 < 3 THEN n_nationkey + 100 END AS lon FROM nation"


@query(f"SELECT 'N' || k AS s, CAST(lat AS DOUBLE) AS lat, CAST(CASE WHEN k % 4 = 1 THEN -lon ELSE lon END AS DOUBLE) AS lon FROM ({COORDINATE_SQL})")
def place_coordinates_on_map(v):
    return places.coordinates(triples.literal_map(v.coordinate_facts()))


@query(
    f"""SELECT 'N' || k AS s, CAST(CASE WHEN k % 4 = 2 THEN lon ELSE lat END AS DOUBLE) AS lat, CAST(CASE WHEN k % 4 = 2 THEN lat ELSE lon END AS DOUBLE) AS lon
    FROM ({COORDINATE_SQL})"""
)
def place_coordinates_on_route(v):
    return places.coordinates(triples.literal_map(v.coordinate_facts()), route=True)

@query(
    sql("""SELECT n.ancestor AS nation, count(DISTINCT person_id) AS people
    FROM event e
    JOIN up r ON r.node = e.place_id AND r.ancestor = 'R2'
    JOIN up n ON n.node = e.place_id
    JOIN place p ON p.place_id = n.ancestor AND p.level = 'nation'
    GROUP BY 1""", "up", "event")
)
def drilldown_child_level(v):
    closed, place = v.closure(), v.place()
    inside = v.event().join(hierarchy.subtree(closed, "R2"), F.col("place_id") == F.col("node"), "left_semi").select("place_id", "person_id").distinct()
    lifted = hierarchy.lift(closed, place, "nation")
    return inside.join(lifted, F.col("place_id") == F.col("node")).groupBy(F.col("lifted").alias("nation")).agg(F.countDistinct("person_id").alias("people"))


@query(
    sql("""SELECT l.place_id, u.ancestor AS parent
    FROM place l
    JOIN up u ON u.node = l.place_id
    JOIN place p ON p.place_id = u.ancestor AND p.level = 'region'
    WHERE l.level = 'nation'""", "up")
)
def parent_at_level(v):
    lifted = hierarchy.lift(v.closure(), v.place(), "region")
    return v.place().where("level = 'nation'").join(lifted, F.col("place_id") == F.col("node")).select("place_id", F.col("lifted").alias("parent"))


@query(
    sql("""SELECT node, CAST(min(level) AS INT) AS level
    FROM (SELECT CAST(1 AS BIGINT) AS node, 0 AS level
    UNION ALL SELECT b.person_id, 1
    FROM member a
    JOIN member b ON a.event_id = b.event_id AND a.person_id <> b.person_id
    WHERE a.person_id = 1
    UNION ALL SELECT d.person_id, 2
    FROM member a
    JOIN member b ON a.event_id = b.event_id AND a.person_id <> b.person_id
    JOIN member c ON c.person_id = b.person_id
    JOIN member d ON d.event_id = c.event_id AND d.person_id <> c.person_id
    WHERE a.person_id = 1)
    GROUP BY 1""", "member")
)
def khop_people_graph(v):
    return graph.khop(v.member(), v.spark.range(1, 2).select(F.col("id").alias("node")), 2)


NEAR = "SELECT node, level FROM (SELECT CAST(1 AS BIGINT) AS node, 0 AS level UNION ALL SELECT DISTINCT b.person_id, 1 FROM every a JOIN every b ON a.event_id = b.event_id AND a.person_id <> b.person_id WHERE a.person_id = 1) ORDER BY level, node LIMIT 20"


@query(
    f"""WITH every AS (SELECT DISTINCT l_orderkey AS event_id, l_suppkey AS person_id
    FROM lineitem), near AS ({NEAR}) SELECT a.person_id AS a, b.person_id AS b, count(*) AS events
    FROM every a
    JOIN every b ON a.event_id = b.event_id AND a.person_id < b.person_id
    WHERE a.person_id IN (SELECT node
    FROM near) AND b.person_id IN (SELECT node
    FROM near)
    GROUP BY 1, 2"""
)
def capped_people_graph(v):
    members = v.member(urgent=False)
    near = graph.khop(members, v.spark.range(1, 2).select(F.col("id").alias("node")), 1, most=20)
    return graph.links_between(members, near.select("node")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("events"))

@query(
    sql("""SELECT a.person_id AS src, b.person_id AS dst, string_agg(DISTINCT o_orderstatus, '、'
    ORDER BY o_orderstatus) AS label
    FROM member a
    JOIN member b ON a.event_id = b.event_id AND a.person_id < b.person_id
    JOIN orders ON o_orderkey = a.event_id
    GROUP BY 1, 2""", "member")
)
def merged_edges(v):
    kinds = v.table("orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("rel"))
    people = v.member().select(F.col("person_id").alias("node")).distinct()
    return graph.merged_edges(graph.links_between(v.member(), people).join(kinds, "event_id"))

@query(
    """SELECT p_partkey, CASE WHEN k > 1 THEN p_name || '#' || k ELSE p_name END AS node
    FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name
    ORDER BY p_partkey) AS k
    FROM part)"""
)
def pg_nodes_unique(v):
    return graph.unique_names(v.table("part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "node")


# --- aggregates ------------------------------------------------------------------------------------------------------

PER_REGION = "SELECT a.ancestor AS place_id, count(DISTINCT person_id) AS people FROM event e JOIN up a ON a.node = e.place_id JOIN place p ON p.place_id = a.ancestor AND p.level = '{}' WHERE kind = 'office' GROUP BY 1"


def _people_at(v: Views, level: str) -> DataFrame:
    offices = v.event().where("kind = 'office'").select("place_id", "person_id").distinct()
    lifted = hierarchy.lift(v.closure(), v.place(), level).withColumnRenamed("node", "place_id")
    return counts.people_per(offices.join(lifted, "place_id").select(F.col("lifted").alias("place_id"), "person_id"), "place_id")


@query(sql(PER_REGION.format("region"), "up", "event"))
def people_per_place(v):
    return _people_at(v, "region")


@query(
    sql("""SELECT state, count(*) AS people
    FROM (SELECT c_custkey, CASE count(DISTINCT u.ancestor) WHEN 0 THEN 'neither' WHEN 1 THEN 'ok' ELSE 'conflict' END AS state
    FROM customer
    LEFT
    JOIN birth b ON b.person_id = c_custkey
    LEFT
    JOIN (SELECT node, ancestor
    FROM up
    JOIN place ON place_id = ancestor
    WHERE level = 'region') u ON u.node = b.place_id
    GROUP BY 1)
    GROUP BY 1""", "up", "birth")
)
def birth_conflict_split(v):
    lifted = hierarchy.lift(v.closure(), v.place(), "region").withColumnRenamed("node", "place_id")
    pairs = v.birth().join(lifted, "place_id").select("person_id", "lifted")
    people = v.table("customer").select(F.col("c_custkey").alias("person_id"))
    return counts.split_by_conflict(pairs, people, "person_id", "lifted").groupBy("state").agg(F.count(F.lit(1)).alias("people"))


@query(
    sql("""SELECT place_id, people, rank, share, round_even(sum(share) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING), 4) AS cumulative
    FROM (SELECT *, row_number() OVER (ORDER BY people DESC, place_id) AS rank, round_even(people / sum(people) OVER (), 4) AS share
    FROM (""" + PER_REGION.format("nation") + "))", "up", "event")
)
def place_share_cumulative(v):
    return counts.ranked_shares(_people_at(v, "nation"), "place_id")

@query(
    sql("""SELECT *, row_number() OVER (ORDER BY parent_total DESC, people DESC, place_id) AS place
    FROM (SELECT t.place_id, parent, people, CAST(sum(people) OVER (PARTITION BY parent) AS BIGINT) AS parent_total
    FROM (""" + PER_REGION.format("nation") + ") t JOIN edge ON child = t.place_id)", "up", "event")
)
def parent_banded_order(v):
    up = v.edge().select(F.col("child").alias("place_id"), "parent")
    banded = counts.banded(_people_at(v, "nation").join(up, "place_id"), "parent").select("place_id", "parent", "people", "parent_total")
    return counts.ordered(banded, F.col("parent_total").desc(), F.col("people").desc(), "place_id")

@query(
    sql("""SELECT ancestor AS node, coalesce(max(CASE WHEN id = ancestor THEN lat END), avg(lat)) AS lat, coalesce(max(CASE WHEN id = ancestor THEN 6 * lat END), avg(6 * lat)) AS lon
    FROM up
    JOIN (SELECT 'N' || n_nationkey AS id, CAST(n_nationkey AS DOUBLE) AS lat
    FROM nation
    WHERE n_nationkey <> 3) ON id = node
    GROUP BY 1""", "up")
)
def bucket_centroid(v):
    return hierarchy.centroids(v.closure(), v.points().where("place_id <> 'N3'"))

@query("SELECT greatest(least(avg(n_nationkey), 54.5), 18.0) AS lat, greatest(least(avg(n_nationkey * 6), 135.5), 73.0) AS lon FROM nation")
def map_center(v):
    return places.centre(v.points())


@query(
    sql("""SELECT place_id, CAST(substr(place_id, 2) AS DOUBLE) AS lat, CAST(substr(place_id, 2) AS DOUBLE) * 6 AS lon, people * 1.5 AS weight
    FROM (""" + PER_REGION.format("nation") + ")", "up", "event").replace("people * 1.5", "CAST(people AS DOUBLE) * 1.5")
)
def map_heat_layer(v):
    return places.heat_layer(_people_at(v, "nation"), v.points(), "place_id", boost=1.5)


@query(
    """SELECT person_id, leg, lat, lat * 6 AS lon, to_lat, to_lat * 6 AS to_lon
    FROM (SELECT o_custkey AS person_id, row_number() OVER w AS leg, CAST(s_nationkey AS DOUBLE) AS lat, CAST(lead(s_nationkey) OVER w AS DOUBLE) AS to_lat
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN supplier ON s_suppkey = l_suppkey WINDOW w AS (PARTITION BY o_custkey
    ORDER BY l_orderkey * 1000 + l_linenumber * 25 + s_nationkey))
    WHERE to_lat IS NOT NULL"""
)
def map_path_layer(v):
    lines = v.table("lineitem").join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(v.table("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    steps = lines.select(F.col("o_custkey").alias("person_id"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 25 + F.col("s_nationkey")).alias("step"), F.concat(F.lit("N"), "s_nationkey").alias("place_id"))
    return places.path_layer(steps, v.points())

@query(sql("SELECT facet, count(*) AS n FROM facet WHERE facet IS NOT NULL GROUP BY 1", "facet"))
def facet_histogram(v):
    return counts.rows_per(v.facet().where("facet is not null").select(text.norm_token(F.col("facet")).alias("facet")), "facet")


@query(sql("SELECT count(*) AS missing FROM facet WHERE facet IS NULL", "facet"))
def facet_missing(v):
    f = v.facet()
    return f.select("person_id").distinct().join(f.where("facet is not null"), "person_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))


RANKS = "SELECT person_id, rank, jiadi, ((greatest(rank, 1) - 1) // 50 * 50) || '-' || ((greatest(rank, 1) - 1) // 50 * 50 + 50) AS bucket FROM part_in WHERE palace AND jiadi IN ('二甲', '三甲')"


def _ranks(v: Views) -> DataFrame:
    return v.palace().where(F.col("jiadi").isin("二甲", "三甲")).select("person_id", "rank", "jiadi", domain.rank_bucket(F.col("rank"), 50).alias("bucket"))


@query(
    sql(f"""SELECT jiadi, bucket, count(DISTINCT person_id) AS people
    FROM ({RANKS})
    WHERE (person_id, jiadi) NOT IN (SELECT person_id, jiadi
    FROM ({RANKS})
    GROUP BY 1, 2
    HAVING count(DISTINCT rank) >= 2)
    GROUP BY 1, 2""", "part_in")
)
def rank_buckets_distinct(v):
    return counts.people_per(counts.without_conflicts(_ranks(v), ["person_id", "jiadi"], "rank"), "jiadi", "bucket")


@query(sql(f"SELECT jiadi, bucket, count(*) AS n FROM ({RANKS}) GROUP BY 1, 2", "part_in"))
def rank_buckets_rows(v):
    return counts.rows_per(_ranks(v), "jiadi", "bucket")


RANK_AXIS = f"SELECT jiadi, bucket, coalesce(n, 0) AS n FROM (SELECT unnest(['二甲', '三甲']) AS jiadi) CROSS JOIN (SELECT a || '-' || (a + 50) AS bucket FROM (SELECT unnest(range(0, 500, 50)) AS a)) LEFT JOIN (SELECT jiadi, bucket, {{}} AS n FROM ({RANKS}) {{}} GROUP BY 1, 2) USING (jiadi, bucket)"


def _on_axis(v: Views, counted: DataFrame, n: str) -> DataFrame:
    return counts.on_axis(domain.bucket_axis(v.spark, 500, 50), ["二甲", "三甲"], "jiadi", counted.withColumnRenamed(n, "n"), "bucket", "n")


@query(sql(RANK_AXIS.format("count(*)", ""), "part_in"))
def rank_axis_rows(v):
    return _on_axis(v, counts.rows_per(_ranks(v), "jiadi", "bucket"), "n")


@query(sql(RANK_AXIS.format("count(DISTINCT person_id)", f"WHERE (person_id, jiadi) NOT IN (SELECT person_id, jiadi FROM ({RANKS}) GROUP BY 1, 2 HAVING count(DISTINCT rank) >= 2)"), "part_in"))
def rank_axis_distinct(v):
    clean = counts.without_conflicts(_ranks(v), ["person_id", "jiadi"], "rank")
    return _on_axis(v, counts.people_per(clean, "jiadi", "bucket"), "people")


@query(sql(f"SELECT bucket, person_id, min(rank) AS rank FROM ({RANKS}) GROUP BY 1, 2", "part_in"))
def rank_bucket_roster(v):
    return counts.first_per(_ranks(v), ["bucket", "person_id"], "rank", "jiadi").select("bucket", "person_id", "rank")


@query(
    sql("""SELECT person_id, pe, exam, jiadi, rank
    FROM (SELECT person_id, pe, exam, jiadi, rank
    FROM part_in
    WHERE palace
    UNION ALL SELECT person_id, pe, exam, jiadi, rank + 1
    FROM part_in
    WHERE palace)
    WHERE jiadi IN ('二甲', '三甲')""", "part_in")
)
def participation_records(v):
    said = F.concat(F.lit("第"), F.col("rank").cast("string"), F.lit("名，又"), (F.col("rank") + 1).cast("string"), F.lit("名；第"), F.col("rank").cast("string"), F.lit("名"))
    return events.rank_records(v.palace(), F.concat(F.lit("殿试"), "jiadi"), said, ["person_id", "pe", "exam"])

def _positions(v: Views, label) -> DataFrame:
    labelled = v.position().select("position_id", label.alias("label"))
    return counts.people_per(v.appointment().join(labelled, "position_id"), "label")


def _label_sql(label: str) -> str:
    return sql(f"SELECT label, count(DISTINCT person_id) AS people FROM appoint JOIN (SELECT position_id, {label} AS label FROM pos) USING (position_id) GROUP BY 1", "pos", "appoint")


@query(_label_sql("core"))
def position_label_1d(v):
    return _positions(v, domain.alignment_label(F.concat(F.lit("CORE/"), "core")))


@query(_label_sql("inst || ' / ' || core"))
def position_label_2d(v):
    return _positions(v, domain.alignment_label(F.concat_ws("/", F.lit("INST"), "inst", "core")))


@query(_label_sql("inst || ' / ' || core || ' / ' || tier"))
def position_label_3d(v):
    return _positions(v, domain.alignment_label(F.concat_ws("/", F.lit("TIER"), "inst", "core", "tier")))


@query(_label_sql("'京 / ' || inst || ' / ' || core || ' / ' || tier"))
def position_label_4d(v):
    return _positions(v, domain.alignment_label(F.concat_ws("/", F.lit("LOC_FULL/Place#京"), "inst", "core"), F.col("tier")))


@query(sql("SELECT position_id, count(*) AS people, min(person_id) AS first FROM appoint GROUP BY 1", "appoint"))
def position_incumbents(v):
    return counts.distinct_and_first(v.appointment(), "position_id", "person_id", "people")


@query(sql("SELECT CASE WHEN core = 'ECONOMY' THEN '(未识别职系)' ELSE core END AS family, count(*) AS positions FROM pos GROUP BY 1", "pos"))
def positions_by_family(v):
    family = F.when(F.col("core") != "ECONOMY", F.array("core"))
    return counts.by_family(v.position(), family, "(未识别职系)", "positions")


@query(sql("SELECT position_id, inst, core, CAST(CASE tier WHEN '执行' THEN 0 WHEN '分管' THEN 1 WHEN '决策' THEN 2 ELSE 3 END AS INT) AS tier_rank FROM pos", "pos"))
def positions_by_tier(v):
    return v.position().select("position_id", "inst", "core", domain.tier_rank(F.col("tier")).alias("tier_rank"))


@query(sql("SELECT year, count(DISTINCT person_id) AS people FROM part_in WHERE palace GROUP BY 1", "part_in"))
def exam_people_by_year(v):
    return counts.people_per(v.palace(), "year")


@query(sql("SELECT era, count(DISTINCT person_id) AS people FROM part_in JOIN year_era USING (year) WHERE palace GROUP BY 1", "part_in", "year_era"))
def exam_people_by_era(v):
    return counts.people_per(v.palace().join(F.broadcast(v.year_era()), "year"), "era")


HOSTED = "(VALUES " + ", ".join(f"({y})" for y in domain.HOSTED_YEARS) + ") AS hosted(year)"


@query(sql(f"SELECT count(DISTINCT person_id) AS people FROM ming WHERE person_id NOT IN (SELECT person_id FROM ming JOIN {HOSTED} USING (year))", "ming"))
def exam_unknown_year(v):
    dated = v.ming().join(F.broadcast(domain.hosted_years(v.spark)), "year", "left_semi")
    return v.ming().join(dated, "person_id", "left_anti").agg(F.countDistinct("person_id").alias("people"))


@query(sql(f"SELECT hosted.year, count(DISTINCT person_id) AS people FROM {HOSTED} LEFT JOIN ming ON ming.year = hosted.year GROUP BY 1", "ming"))
def hosted_people_by_year(v):
    axis = domain.hosted_years(v.spark).select("year")
    return counts.zero_filled(axis, counts.people_per(v.ming().join(F.broadcast(axis), "year", "left_semi"), "year"), ["year"], "people")


@query(sql("SELECT person_id, count(DISTINCT exam) AS exams FROM part_in WHERE palace GROUP BY 1 HAVING count(DISTINCT exam) >= 2", "part_in"))
def exam_conflicts(v):
    return counts.conflicted(v.palace(), "person_id", "exam", n="exams")


SHARE = "SELECT year, count(DISTINCT p.person_id) AS den, count(DISTINCT CASE WHEN facet = 'BUILDING' THEN p.person_id END) AS num FROM part_in p JOIN facet f ON f.person_id = p.person_id WHERE palace GROUP BY 1"


def _share(v: Views) -> DataFrame:
    return counts.yearly_share(v.palace().select("year", "person_id"), v.facet().where("facet = 'BUILDING'"))


@query(sql(f"SELECT *, CAST(num AS DOUBLE) / den AS ratio FROM ({SHARE})", "part_in", "facet"))
def yearly_share(v):
    return _share(v)


@query(
    sql(f"""SELECT era, CAST(sum(den) AS BIGINT) AS den, CAST(sum(num) AS BIGINT) AS num
    FROM ({SHARE})
    JOIN year_era USING (year)
    GROUP BY 1""", "part_in", "facet", "year_era")
)
def era_sum_totals(v):
    return _share(v).join(F.broadcast(v.year_era()), "year").groupBy("era").agg(F.sum("den").alias("den"), F.sum("num").alias("num"))


@query(sql("SELECT era, CAST(min(year) AS INT) AS first, CAST(max(year) AS INT) AS last FROM year_era GROUP BY 1", "year_era"))
def era_brackets(v):
    return domain.era_brackets(v.year_era(), "year")


@query(
    sql("""SELECT n_name AS nation, c_name AS name, facet IS NOT DISTINCT
    FROM 'BUILDING' AS hit
    FROM customer
    JOIN nation ON n_nationkey = c_nationkey
    JOIN facet ON person_id = c_custkey""", "facet")
)
def hit_miss_lists(v):
    f = v.facet().join(v.table("customer"), F.col("person_id") == F.col("c_custkey")).join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return counts.marked_names(f.withColumnRenamed("n_name", "nation"), "nation", "c_name", F.col("facet") == "BUILDING")

@query(
    """SELECT level, name, row_number() OVER (PARTITION BY level
    ORDER BY name) AS step
    FROM (SELECT 'nation' AS level, n_name AS name
    FROM nation
    UNION ALL SELECT 'region', r_name
    FROM region
    UNION ALL SELECT 'site', s_name
    FROM supplier
    UNION ALL SELECT 'root', 'WORLD')"""
)
def places_by_level(v):
    return evidence.numbered(v.place().select("level", "name"), "level", "name")

@query("SELECT DISTINCT c_mktsegment AS option FROM customer")
def option_lists(v):
    return counts.options(v.table("customer"), "c_mktsegment")


@query("SELECT o_orderstatus AS rel, count(*) AS n FROM orders GROUP BY 1")
def relations_by_type(v):
    return counts.rows_per(v.table("orders").select(F.col("o_orderstatus").alias("rel")), "rel").orderBy(F.col("rel").isNull(), "rel")


# --- provenance, text, spans -----------------------------------------------------------------------------------------


@query("SELECT source AS g_src, lang AS g_body, CAST(max(n_chars) AS VARCHAR) AS conf, count(*) AS items FROM documents GROUP BY 1, 2")
def provenance_groups(v):
    d = v.table("documents").select("source", "lang", F.col("n_chars").cast("string").alias("conf"), "doc_id")
    return evidence.provenance_groups(d, F.col("source"), F.col("lang"), "conf", "doc_id")


@query("SELECT source AS g_src, lang AS g_body, CAST(max(n_chars) AS VARCHAR) AS conf, count(*) AS items FROM documents GROUP BY 1, 2")
def provenance_groups_normalised(v):
    d = v.table("documents").select(F.concat(F.lit(" "), "source").alias("source"), F.concat("lang", F.lit("\u200b ")).alias("lang"), F.col("n_chars").cast("string").alias("conf"), "doc_id")
    return evidence.provenance_groups(d, text.norm(F.col("source")), text.norm(F.col("lang")), "conf", "doc_id")


@query("SELECT source AS g_src, lang AS g_body, CAST(n_chars % 10 AS VARCHAR) AS value FROM documents GROUP BY 1, 2, 3")
def provenance_item_rows(v):
    return evidence.provenance_items(v.table("documents"), F.col("source"), F.col("lang"), (F.col("n_chars") % 10).cast("string").alias("value"))


@query("SELECT source AS g_src, lang AS g_body, count(*) AS items FROM documents GROUP BY 1, 2 HAVING bool_or(n_chars % 100 = 7 AND doc_id % 2 = 1)")
def provenance_drilldown(v):
    d = v.table("documents").withColumn("conf", F.lit("1"))
    groups = evidence.provenance_groups(d, F.col("source"), F.col("lang"), "conf", "doc_id").drop("conf")
    items = evidence.provenance_items(d, F.col("source"), F.col("lang"), (F.col("doc_id") % 2).cast("string").alias("prop"), (F.col("n_chars") % 100).cast("string").alias("value"))
    return evidence.groups_with(groups, items, prop="1", value="7")

@query(
    """SELECT doc_id, NOT s AS fallback
    FROM (SELECT doc_id, contains(text, 'idiot') AS strict, bool_or(contains(text, 'idiot')) OVER (PARTITION BY source) AS s
    FROM documents
    WHERE contains(text, 'the'))
    WHERE strict OR NOT s"""
)
def provenance_fallback(v):
    d = v.table("documents").select("doc_id", "source", "text")
    return evidence.with_fallback(d, "source", F.instr("text", "idiot") > 0, F.instr("text", "the") > 0).select("doc_id", "fallback")


@query("SELECT p_partkey, regexp_replace(p_name, '(' || 'blue|red' || ')', '<mark>\\1</mark>', 'g') AS marked FROM part")
def fn_highlight(v):
    return v.table("part").select("p_partkey", text.highlight(F.col("p_name"), ["red", "blue"]).alias("marked"))


@query("SELECT doc_id, regexp_replace(text, '[\\s\\x0b\\x85\\p{Z}]+', '', 'g') AS bare FROM documents")
def fn_strip_ws(v):
    return v.table("documents").select("doc_id", text.strip_ws(F.col("text")).alias("bare"))


@query(
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) < 2000 THEN CAST(year(o_orderdate) AS INT) ELSE 1595 END AS first, CAST(year(o_orderdate) AS INT) AS modern, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) || ',1601' ELSE '1601' END AS bounded, CAST(1400 + o_orderkey % 200 AS INT) AS by_name
    FROM orders"""
)
def fn_year_variants(v):
    y = F.date_format("o_orderdate", "yyyy")
    stamp = F.concat_ws(" ", F.lit("x"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("於1595年 1601"))
    bounded = domain.years_of_exam(F.array(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("x "), y, F.lit("-1"))).otherwise(F.lit("於1595年"))), F.array(F.lit("1601")))
    # order dates are after 1601, so sorting puts that first where both are bounded
    listed = F.array_join(F.transform(F.reverse(bounded), lambda x: x.cast("string")), ",")
    name = F.concat(F.lit("exam"), (1400 + F.col("o_orderkey") % 200).cast("string"))
    return v.table("orders").select("o_orderkey", domain.year_first(stamp).alias("first"), domain.year_first(stamp, modern=True).alias("modern"), listed.alias("bounded"), domain.year_of_literals(F.array(F.lit("no year")), name, True).alias("by_name"))

@query("SELECT o_orderkey, CAST(o_orderkey % 400 + 1 AS INT) AS rank FROM orders")
def fn_rank_extract(v):
    said = F.concat(F.lit("第"), (F.col("o_orderkey") % 400 + 1).cast("string"), F.lit("名，共99人"))
    return v.table("orders").select("o_orderkey", F.element_at(domain.ranks(said), 1).alias("rank"))




SPAN_P = "least(abs(CAST(x AS DOUBLE)) * 5, 1.0)"
SPAN_SQL = f"SELECT vec_id, {SPAN_P} AS p, pos FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings)"


@query(
    f"""WITH s AS ({SPAN_SQL}) SELECT a.vec_id AS line_id, a.pos AS type_idx, a.pos AS start, CAST(b.pos - a.pos + 1 AS INT) AS length
    FROM s a
    JOIN s b ON a.vec_id = b.vec_id AND b.pos BETWEEN a.pos AND a.pos + 7
    WHERE a.p > CASE WHEN a.pos = b.pos THEN 0.4 ELSE 0.7 END AND b.p > CASE WHEN a.pos = b.pos THEN 0.4 ELSE 0.7 END"""
)
def spans_decode(v):
    each = v.table("embeddings").select(F.col("vec_id").alias("line_id"), F.posexplode("embedding").alias("pos", "x")).select("line_id", long("pos").alias("pos"), F.least(F.abs(F.col("x").cast("double")) * 5, F.lit(1.0)).alias("p"))
    head = each.withColumn("type_idx", F.col("pos")).withColumn("delta", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return evidence.decoded_spans(head, each).select("line_id", "type_idx", "start", F.col("length").cast("int").alias("length"))

@query("SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN '[]' WHEN l_linenumber = 2 THEN NULL ELSE 'a' || l_linenumber END AS raw FROM lineitem")
def model_answers(v):
    def client():
        def ask(prompt):
            if prompt == "1":
                raise RuntimeError("no answer")
            return ["a", " ", "\n", prompt]

        return ask

    lines = v.table("lineitem").select("l_orderkey", F.when(F.col("l_linenumber") != 2, F.col("l_linenumber").cast("string")).alias("prompt"))
    return extraction.answers(lines, "prompt", client).select("l_orderkey", "raw")


# --- events of a person ----------------------------------------------------------------------------------------------

RELATION_SQL = "SELECT person_id, place_id, '0' AS event_id, '生' AS label, 0 AS ord FROM birth UNION ALL SELECT person_id, place_id, event_id, CASE WHEN kind = 'office' THEN '职任' ELSE '任务执行' END, CASE WHEN kind = 'office' THEN 1 ELSE 2 END FROM event"


def _related(v: Views) -> DataFrame:
    office = F.col("kind") == "office"
    events = v.event().select("person_id", "place_id", "event_id", F.when(office, "职任").otherwise("任务执行").alias("label"), F.when(office, 1).otherwise(2).alias("ord"))
    return v.birth().select("person_id", "place_id", F.lit("0").alias("event_id"), F.lit("生").alias("label"), F.lit(0).alias("ord")).unionAll(events)


@query(sql(f"SELECT label, count(*) AS n FROM ({RELATION_SQL}) GROUP BY 1", "birth", "event"))
def events_by_relation(v):
    return counts.rows_per(_related(v), "label")


@query(
    sql(f"""SELECT person_id, row_number() OVER (PARTITION BY person_id
    ORDER BY ord, event_id, place_id) AS step, place_id, label
    FROM ({RELATION_SQL})""", "birth", "event")
)
def migration_path(v):
    return evidence.numbered(_related(v), "person_id", "ord", "event_id", "place_id").select("person_id", "step", "place_id", "label")


@query("SELECT s_suppkey AS person_id FROM supplier UNION SELECT c_custkey FROM customer UNION SELECT l_suppkey FROM lineitem")
def candidate_people(v):
    return events.candidates((v.table("supplier"), "s_suppkey"), (v.table("customer"), "c_custkey"), (v.table("lineitem"), "l_suppkey"))


# --- lists and orders of reports -------------------------------------------------------------------------------------


@query(
    """SELECT segment, n, row_number() OVER (ORDER BY n DESC, segment) AS place
    FROM (SELECT c_mktsegment AS segment, count(*) AS n
    FROM customer
    GROUP BY 1)
    QUALIFY place <= 3"""
)
def top_facets(v):
    n = counts.rows_per(v.table("customer").select(F.col("c_mktsegment").alias("segment")), "segment")
    return counts.largest(n, "segment", "n", 3)


@query(
    sql("""SELECT label, people, row_number() OVER (ORDER BY people DESC, label) AS place, CASE WHEN length(label) > 6 THEN substr(label, 1, 5) || '…' ELSE label END AS short
    FROM (SELECT core || inst AS label, count(DISTINCT person_id) AS people
    FROM appoint
    JOIN pos USING (position_id)
    GROUP BY 1)
    QUALIFY place <= 30""", "pos", "appoint")
)
def top_positions(v):
    top = counts.largest(_positions(v, F.concat("core", "inst")), "label", "people", 30)
    return top.withColumn("short", text.truncated(F.col("label"), 6))


@query(
    sql("""SELECT place_id, people, row_number() OVER (ORDER BY people DESC, place_id) AS place
    FROM (""" + PER_REGION.format("site") + ") QUALIFY place <= 120", "up", "event")
)
def top_places(v):
    return counts.largest(_people_at(v, "site"), "place_id", "people", 120)


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name, c_custkey) AS place FROM customer QUALIFY place <= 600")
def people_by_name(v):
    return counts.ordered(v.table("customer").select("c_custkey", "c_name"), "c_name", "c_custkey", most=600)


@query(
    """SELECT source, lang, n, row_number() OVER (ORDER BY source, lang) AS place
    FROM (SELECT source, lang, count(*) AS n
    FROM documents
    GROUP BY 1, 2)
    QUALIFY place <= 60"""
)
def provenance_by_source(v):
    return counts.ordered(counts.rows_per(v.table("documents"), "source", "lang"), "source", "lang", most=60)


@query(
    sql("""SELECT position_id, row_number() OVER (ORDER BY CASE tier WHEN '执行' THEN 0 WHEN '分管' THEN 1 WHEN '决策' THEN 2 ELSE 3 END, inst, core, position_id) AS place
    FROM pos
    QUALIFY place <= 400""", "pos")
)
def positions_in_order(v):
    return counts.ordered(v.position(), domain.tier_rank(F.col("tier")), "inst", "core", "position_id", most=400).select("position_id", "place")


@query(
    sql("""SELECT family, positions, row_number() OVER (ORDER BY family = '(未识别职系)', family) AS place
    FROM (SELECT CASE WHEN core = 'ECONOMY' THEN '(未识别职系)' ELSE core END AS family, count(*) AS positions
    FROM pos
    GROUP BY 1)""", "pos")
)
def families_in_order(v):
    unknown = "(未识别职系)"
    n = v.position().groupBy(F.when(F.col("core") == "ECONOMY", unknown).otherwise(F.col("core")).alias("family")).agg(F.count(F.lit(1)).alias("positions"))
    return counts.ordered(n, F.col("family") == unknown, "family")


# --- positions -------------------------------------------------------------------------------------------------------

DIMENSION_SQL = {"职系": "p_type", "机构": "p_brand", "核心职称": "p_type || p_brand", "层级": "CASE WHEN p_size % 2 = 0 THEN '执行' ELSE '分管' END", "官阶": "CAST(p_size AS VARCHAR)", "对齐码_core": "'CORE/' || p_type", "对齐码_inst": "'INST/HUBU/' || p_type"}


@query(
    sql("""SELECT dimension, label, count(DISTINCT person_id) AS people
    FROM appoint
    JOIN (""" + " UNION ALL ".join(f"SELECT p_partkey AS position_id, '{d}' AS dimension, {x} AS label FROM part" for d, x in DIMENSION_SQL.items()) + ") USING (position_id) GROUP BY 1, 2", "appoint")
)
def position_dimensions(v):
    rows = triples.position_rows(v.position_facts()).withColumn("position_id", F.col("s").cast("long"))
    return counts.per_dimension(v.appointment(), rows, triples.POSITION_DIMENSIONS, n=v.most_appointments())


@query(sql("SELECT DISTINCT inst AS label, person_id FROM appoint JOIN pos USING (position_id)", "pos", "appoint"))
def position_members(v):
    return v.appointment().join(v.position().select("position_id", F.col("inst").alias("label")), "position_id").select("label", "person_id").distinct()


@query("SELECT CAST(p_partkey AS VARCHAR) AS node, CASE p_partkey % 3 WHEN 0 THEN p_name || '官' WHEN 1 THEN p_name ELSE '—' END AS name FROM part")
def position_names(v):
    return triples.position_names(v.table("part").select(F.col("p_partkey").cast("string").alias("node")), v.position_facts())


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS s, ord, key, value
    FROM (SELECT p_partkey, unnest([0, 1, 2, 3, 7, 8]::INT[]) AS ord, unnest(['核心职称', '层级', '机构', '职系', '原始称谓', '官职名称']) AS key, unnest([p_type || p_brand, CASE WHEN p_size % 2 = 0 THEN '执行' END, p_brand, p_type, CASE WHEN p_partkey % 3 < 2 THEN p_name END, CASE WHEN p_partkey % 3 = 0 THEN p_name || '官' END]) AS value
    FROM part)
    WHERE value IS NOT NULL"""
)
def position_details(v):
    return triples.position_details(v.position_facts())


# --- triples again ---------------------------------------------------------------------------------------------------


@query(sql("SELECT s FROM triple WHERE p = 'bornIn' AND o = 'http://ex/n#3'", "triple"))
def triples_pattern(v):
    return triples.scan(v.triples(), p="bornIn", o="http://ex/n#3").select("s")


@query("SELECT 'http://ex/n#' || n_nationkey AS node FROM nation")
def nodes_of_type(v):
    t = v.triples()
    return triples.of_type(t.select(F.col("s").alias("node")).distinct(), t, "Place")


@query(sql("SELECT DISTINCT s, o AS alias FROM triple WHERE p IN ('name', 'field')", "triple"))
def person_aliases(v):
    return triples.aliases(v.triples(), ["name"], "field")


# --- scalar functions over whole columns -----------------------------------------------------------------------------


@query("SELECT p_partkey, '國会' || p_name || '劉' AS raw, '国会' || p_name || '刘' AS simple, '國會' || p_name || '劉' AS old FROM part")
def fn_script(v):
    raw = F.concat(F.lit("國会"), "p_name", F.lit("劉"))
    return v.table("part").select("p_partkey", raw.alias("raw"), text.to_simplified(raw).alias("simple"), text.to_traditional(raw).alias("old"))


@query(
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '区' WHEN 1 THEN '县' WHEN 2 THEN '嘎查村' ELSE '旗' END AS suffix, CASE p_size % 4 WHEN 2 THEN '村' WHEN 0 THEN '区' WHEN 1 THEN '县' ELSE '旗' END AS timeline, CASE p_size % 4 WHEN 0 THEN '区' WHEN 1 THEN '县' WHEN 2 THEN '村' ELSE '旗' END AS last
    FROM part"""
)
def fn_suffix(v):
    s = F.expr("CASE p_size % 4 WHEN 0 THEN '市辖区' WHEN 1 THEN '自治县' WHEN 2 THEN '嘎查村' ELSE '自治旗' END")
    return v.table("part").select("p_partkey", domain.canonical_suffix(s).alias("suffix"), domain.canonical_suffix(s, timeline=True).alias("timeline"), domain.last_suffix(F.concat(F.lit("甲"), s), timeline=True).alias("last"))


@query("SELECT n_nationkey, ln(tan(pi() / 4 + radians(least(85.05112878, greatest(-85.05112878, n_nationkey * 8.0 - 90))) / 2)) AS y FROM nation")
def fn_mercator(v):
    return v.table("nation").select("n_nationkey", domain.mercator_y(F.col("n_nationkey") * 8.0 - 90).alias("y"))


@query(
    """SELECT o_orderkey, '第' || r || '名|' || r || '名|第 ' || r || ' 名' AS tokens, CASE WHEN o_orderstatus = 'F' THEN '二甲' WHEN o_orderstatus = 'O' THEN '一甲' ELSE '未明' END AS jiadi
    FROM (SELECT *, o_orderkey % 400 + 1 AS r
    FROM orders)"""
)
def fn_rank_tokens(v):
    r = (F.col("o_orderkey") % 400 + 1).cast("int")
    said = F.when(F.col("o_orderstatus") == "F", "第二甲，非一甲").when(F.col("o_orderstatus") == "O", "一甲第三").otherwise("不详")
    return v.table("orders").select("o_orderkey", F.array_join(domain.rank_variants(r), "|").alias("tokens"), domain.honours_class(said).alias("jiadi"))


@query("SELECT p_partkey, '<b>Person</b><br>a&amp;b: &lt;' || replace(p_name, '\'\'', '&#x27;') || '&gt;' AS tip FROM part")
def fn_tooltip(v):
    props = F.create_map(F.lit("a&b"), F.concat(F.lit("<"), "p_name", F.lit(">")), F.lit("z"), F.lit(" "))
    return v.table("part").select("p_partkey", text.tooltip(F.lit("Person"), props).alias("tip"))


@query(
    """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN '未知官职' WHEN 2 THEN p_brand WHEN 3 THEN substr(p_name || p_type || p_brand, 1, 20) ELSE '科举' END AS name
    FROM part"""
)
def fn_display_name(v):
    label = F.expr("CASE p_size % 5 WHEN 0 THEN 'Person' WHEN 1 THEN 'Official Position' WHEN 2 THEN 'Place' WHEN 3 THEN 'Text' ELSE 'ImperialExam' END")
    props = F.create_map(F.lit("姓名"), F.concat(F.lit(" "), "p_name"), F.lit("现代名称"), F.col("p_brand"), F.lit("历史名称"), F.lit(" "), F.lit("content"), F.concat("p_name", "p_type", "p_brand"))
    return v.table("part").select("p_partkey", text.display_name(label, props).alias("name"))


# The other modules of queries enter theirs on import.
from . import graph_queries, text_queries  # noqa: E402, F401
