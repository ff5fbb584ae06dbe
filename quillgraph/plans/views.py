"""The engine's views over the driver tables, in Spark and as SQL common table expressions.

person: customers. place: suppliers in nations in regions under one root. birth: a customer's nation, and the nation of the least supplier of its low-priority orders.
office and task events: order lines at the supplier's place, by order status. participation: orders as examinations, urgent ones as palace
examinations. position: parts; appointment: a customer's parts. social events: urgent orders, members are suppliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import closure
from ..operators.staging import dealt, settled

ERAS = [("甲元", 1993, 1995), ("乙元", 1995, 1997), ("丙元", 1998, 1999), ("丁元", 2000, 2001), ("戊元", 2001, 2003)]
YEARS = (1993, 2003)
ERA_SQL = "(VALUES " + ", ".join(f"('{e}', {a}, {b}, {k})" for k, (e, a, b) in enumerate(ERAS)) + ") AS era(era, y0, y1, ord)"

CTE = {
    "place": "SELECT 'WORLD' place_id, 'WORLD' AS name, 'root' AS level UNION ALL SELECT 'R' || r_regionkey, r_name, 'region' FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, 'nation' FROM nation UNION ALL SELECT 'S' || s_suppkey, s_name, 'site' FROM supplier",
    "edge": "SELECT 'S' || s_suppkey AS child, 'N' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'R' || r_regionkey, 'WORLD' FROM region",
    "up": "SELECT place_id AS node, place_id AS ancestor, 0 AS depth FROM place UNION ALL SELECT child, parent, 1 FROM edge UNION ALL SELECT a.child, b.parent, 2 FROM edge a JOIN edge b ON a.parent = b.child UNION ALL SELECT a.child, c.parent, 3 FROM edge a JOIN edge b ON a.parent = b.child JOIN edge c ON b.parent = c.child",
    "event": "SELECT l_orderkey || '-' || l_linenumber AS event_id, o_custkey AS person_id, 'S' || l_suppkey AS place_id, CASE WHEN o_orderstatus = 'F' THEN 'office' ELSE 'task' END AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "birth": "SELECT c_custkey AS person_id, 'N' || c_nationkey AS place_id FROM customer UNION SELECT person_id, 'N' || s_nationkey FROM (SELECT o_custkey AS person_id, min(l_suppkey) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '5-LOW' GROUP BY 1) JOIN supplier ON s_suppkey = k",
    "part_in": "SELECT o_custkey AS person_id, o_orderkey AS pe, o_orderpriority AS level, CAST(year(o_orderdate) AS INT) AS year, o_orderpriority || '@' || year(o_orderdate) AS exam, o_orderpriority = '1-URGENT' AS palace, CAST(o_orderkey % 400 + 1 AS INT) AS rank, CASE o_orderstatus WHEN 'F' THEN '二甲' WHEN 'O' THEN '三甲' ELSE '一甲' END AS jiadi FROM orders",
    "facet": "SELECT c_custkey AS person_id, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS facet FROM customer",
    "pos": "SELECT p_partkey AS position_id, p_brand AS inst, p_type AS core, CASE WHEN p_size <= 15 THEN '执行' WHEN p_size <= 35 THEN '分管' ELSE '决策' END AS tier FROM part",
    "appoint": "SELECT DISTINCT o_custkey AS person_id, l_partkey AS position_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    "member": "SELECT DISTINCT l_orderkey AS event_id, l_suppkey AS person_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'",
    "ming": "SELECT o_custkey AS person_id, o_orderkey AS pe, CAST(1368 + o_orderkey % 277 AS INT) AS year FROM orders",
    "ev_type": "SELECT 'e' || o_orderkey AS e, CASE WHEN o_orderstatus = 'F' THEN 'OfficeAtPlaceEvent' ELSE 'TaskEvent' END AS cls FROM orders UNION ALL SELECT 'e' || o_orderkey, 'BirthEvent' FROM orders WHERE o_orderkey % 7 = 0",
    "ev_link": "SELECT 'e' || o_orderkey AS e, 'hasPlace' AS p, 'N' || (o_orderkey % 25) AS o FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'e' || o_orderkey, 'tookPlaceAt', 'N' || (o_orderkey % 24) FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'e' || o_orderkey, 'near', 'N' || (o_orderkey % 23) FROM orders UNION ALL SELECT 'e' || o_orderkey, 'hasPlace', 'X1' FROM orders WHERE o_orderkey % 5 = 0",
    "year_era": f"SELECT y.year, arg_min(era, ord) AS era FROM (SELECT unnest(range({YEARS[0]}, {YEARS[1] + 1})) AS year) y JOIN {ERA_SQL} ON y.year BETWEEN y0 AND y1 GROUP BY 1",
}
NEEDS = {"up": ["place", "edge"]}


def sql(query: str, *names: str) -> str:
    """``query`` after the common table expressions it names."""
    if not names:
        return query
    every = list(dict.fromkeys(x for n in names for x in [*NEEDS.get(n, []), n]))
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in every) + " " + query


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._closure: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def place(self) -> DataFrame:
        one = lambda t, k, n, mark, level: self.table(t).select(F.concat(F.lit(mark), F.col(k)).alias("place_id"), F.col(n).alias("name"), F.lit(level).alias("level"))
        root = self.spark.range(1).select(F.lit("WORLD").alias("place_id"), F.lit("WORLD").alias("name"), F.lit("root").alias("level"))
        return root.union(one("region", "r_regionkey", "r_name", "R", "region")).union(one("nation", "n_nationkey", "n_name", "N", "nation")).union(one("supplier", "s_suppkey", "s_name", "S", "site"))

    def edge(self) -> DataFrame:
        pair = lambda t, a, m, b, n: self.table(t).select(F.concat(F.lit(m), F.col(a)).alias("child"), (F.concat(F.lit(n), F.col(b)) if b else F.lit("WORLD")).alias("parent"))
        return pair("supplier", "s_suppkey", "S", "s_nationkey", "N").union(pair("nation", "n_nationkey", "N", "n_regionkey", "R")).union(pair("region", "r_regionkey", "R", None, ""))

    def closure(self) -> DataFrame:
        """All places with their ancestors, derived once for all uses of a query."""
        if self._closure is None:
            self._closure = settled(closure(self.edge(), self.place().select(F.col("place_id").alias("node")), 3))
        return self._closure

    def event(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"), F.col("o_custkey").alias("person_id"), F.concat(F.lit("S"), "l_suppkey").alias("place_id"), F.when(F.col("o_orderstatus") == "F", "office").otherwise("task").alias("kind"))

    def birth(self) -> DataFrame:
        own = self.table("customer").select(F.col("c_custkey").alias("person_id"), F.concat(F.lit("N"), "c_nationkey").alias("place_id"))
        orders = self.table("orders").where("o_orderpriority = '5-LOW'").select("o_orderkey", F.col("o_custkey").alias("person_id"))
        least = orders.join(self.table("lineitem").select("l_orderkey", "l_suppkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("person_id").agg(F.min("l_suppkey").alias("s_suppkey"))
        return own.union(least.join(self.table("supplier"), "s_suppkey").select("person_id", F.concat(F.lit("N"), "s_nationkey"))).distinct()

    def participation(self) -> DataFrame:
        o, y = self.table("orders"), F.year("o_orderdate")
        return o.select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("pe"), F.col("o_orderpriority").alias("level"), y.alias("year"), F.concat_ws("@", "o_orderpriority", y.cast("string")).alias("exam"), (F.col("o_orderpriority") == "1-URGENT").alias("palace"), (F.col("o_orderkey") % 400 + 1).cast("int").alias("rank"), F.when(F.col("o_orderstatus") == "F", "二甲").when(F.col("o_orderstatus") == "O", "三甲").otherwise("一甲").alias("jiadi"))

    def palace(self) -> DataFrame:
        return self.participation().where("palace")

    def facet(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("person_id"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("facet"))

    def position(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("position_id"), F.col("p_brand").alias("inst"), F.col("p_type").alias("core"), F.when(F.col("p_size") <= 15, "执行").when(F.col("p_size") <= 35, "分管").otherwise("决策").alias("tier"))

    def lines(self, *columns: str) -> DataFrame:
        """Order lines, dealt by order."""
        return dealt(self.table("lineitem").select("l_orderkey", *columns), "l_orderkey")

    def appointment(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("person_id"))
        held = self.lines("l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("person_id", F.col("l_partkey").alias("position_id"))
        return dealt(held, "person_id", "position_id", n=self.most_appointments()).distinct()

    def most_appointments(self) -> int:
        return self.table("lineitem").count()

    def member(self, urgent: bool = True) -> DataFrame:
        """Suppliers of an order; of urgent ones where a result has a row for each pair of them."""
        lines = self.lines("l_suppkey")
        if urgent:
            lines = lines.join(self.table("orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))  # a semi join would move below the dealing
        return lines.select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("person_id")).distinct()

    def ming(self) -> DataFrame:
        """Orders as examinations of the years 1368 to 1644."""
        return self.table("orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("pe"), (F.lit(1368) + F.col("o_orderkey") % 277).cast("int").alias("year"))

    def attributes(self) -> DataFrame:
        c = self.table("customer")
        spelt = F.concat(F.substring("c_mktsegment", 1, 2), F.lit(" "), F.expr("substring(c_mktsegment, 3)"))
        return c.select(F.col("c_custkey").alias("person_id"), F.lit("segment").alias("facet"), spelt.alias("value")).union(c.select("c_custkey", F.lit("nation"), F.col("c_nationkey").cast("string")))

    def nations(self) -> DataFrame:
        return self.table("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("node"))

    def points(self) -> DataFrame:
        return self.table("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("place_id"), F.col("n_nationkey").cast("double").alias("lat"), (F.col("n_nationkey") * 6).cast("double").alias("lon"))

    def event_types(self) -> DataFrame:
        k = self.table("orders").select("o_orderkey", F.concat(F.lit("e"), "o_orderkey").alias("node"), F.when(F.col("o_orderstatus") == "F", "OfficeAtPlaceEvent").otherwise("TaskEvent").alias("cls"))
        return k.select("node", "cls").union(k.where("o_orderkey % 7 = 0").select("node", F.lit("BirthEvent")))

    def event_links(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", F.concat(F.lit("e"), "o_orderkey").alias("s"))
        one = lambda cond, p, place: o.where(cond).select("s", F.lit(p).alias("p_local"), F.expr(place).alias("o"))
        return one("o_orderkey % 2 = 0", "hasPlace", "concat('N', o_orderkey % 25)").union(one("o_orderkey % 3 = 0", "tookPlaceAt", "concat('N', o_orderkey % 24)")).union(one("true", "near", "concat('N', o_orderkey % 23)")).union(one("o_orderkey % 5 = 0", "hasPlace", "'X1'"))

    def facts(self, table: str, subject: str, facts: dict[str, str]) -> DataFrame:
        """Literal triples of a table's rows: SQL expressions by predicate, null where a row has none."""
        each = F.explode(F.array(*(F.struct(F.lit(p).alias("p_local"), F.expr(x).cast("string").alias("o")) for p, x in facts.items())))
        return self.table(table).select(F.expr(subject).cast("string").alias("s"), each.alias("f")).select("s", "f.*", F.lit("lit").alias("o_kind")).where("o is not null")

    def place_facts(self) -> DataFrame:
        return self.facts("supplier", "concat('S', s_suppkey)", {"现代名称": "CASE s_suppkey % 4 WHEN 0 THEN concat(s_name, '市') WHEN 2 THEN concat(s_name, '省') END", "历史名称": "CASE s_suppkey % 4 WHEN 1 THEN concat(s_name, '自治县') WHEN 2 THEN '旧名' END", "区划层级": "CASE WHEN s_suppkey % 5 = 0 THEN ' 府' END"})

    def coordinate_facts(self) -> DataFrame:
        n = "n_nationkey"
        return self.facts("nation", f"concat('N', {n})", {"name": "n_name", "经纬坐标": f"CASE WHEN {n} % 4 = 0 THEN concat({n} + 20, '.5°N，', {n} + 100, '.25°E') END", "坐标": f"CASE WHEN {n} % 4 = 2 THEN concat({n} + 100, ',', {n} + 20) END", "lat": f"CASE WHEN {n} % 4 = 1 THEN concat({n} + 20, ' N') END", "lon": f"CASE WHEN {n} % 4 = 1 THEN concat({n} + 100, 'W') END"})

    def position_facts(self) -> DataFrame:
        tier = "CASE WHEN p_size % 2 = {} THEN '{}' END"
        return self.facts("part", "p_partkey", {"职系": "p_type", "机构": "p_brand", "核心职称": "concat(p_type, p_brand)", "层级": tier.format(0, "执行"), "通用层级": tier.format(1, "分管"), "官阶": "p_size", "地名": "' '", "对齐码_core": "concat('CORE/', p_type)", "对齐码_inst": "concat('INST/HUBU/', p_type)", "原始称谓": "CASE WHEN p_partkey % 3 < 2 THEN p_name END", "官职名称": "CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, '官') END"})

    def eras(self) -> DataFrame:
        return self.spark.createDataFrame([(e, a, b, k) for k, (e, a, b) in enumerate(ERAS)], "era string, y0 int, y1 int, ord int")

    def years(self) -> DataFrame:
        return self.spark.range(YEARS[0], YEARS[1] + 1).select(F.col("id").cast("int").alias("year"))

    def year_era(self) -> DataFrame:
        return self.years().join(F.broadcast(self.eras()), F.col("year").between(F.col("y0"), F.col("y1"))).groupBy("year").agg(F.min_by("era", "ord").alias("era"))

    def triples(self) -> DataFrame:
        """Customers, nations and births as N-Triples lines, read back by the triple reader."""
        from ..sources.readers import parse_triples

        iri = lambda kind, key: F.concat(F.lit(f"<http://ex/{kind}#"), key.cast("string"), F.lit(">"))
        line = lambda s, p, o: F.concat_ws(" ", s, F.lit(f"<http://ex/o#{p}>"), o, F.lit("."))
        quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        c, n = self.table("customer"), self.table("nation")
        person, place = iri("p", F.col("c_custkey")), iri("n", F.col("c_nationkey"))
        parts = [
            c.select(line(person, "type", F.lit("<http://ex/o#Person>"))),
            c.select(line(person, "name", quoted(F.col("c_name")))),
            c.where("c_mktsegment <> 'MACHINERY'").select(line(person, "field", quoted(F.col("c_mktsegment")))),
            c.select(line(person, "bornIn", place)),
            n.select(line(iri("n", F.col("n_nationkey")), "type", F.lit("<http://ex/o#Place>"))),
            n.select(line(iri("n", F.col("n_nationkey")), "modern", quoted(F.col("n_name")))),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return parse_triples(out.toDF("value"))


CTE["triple"] = "SELECT 'http://ex/p#' || c_custkey AS s, 'type' AS p, 'http://ex/o#Person' AS o, 'iri' AS k FROM customer UNION ALL SELECT 'http://ex/p#' || c_custkey, 'name', c_name, 'lit' FROM customer UNION ALL SELECT 'http://ex/p#' || c_custkey, 'field', c_mktsegment, 'lit' FROM customer WHERE c_mktsegment <> 'MACHINERY' UNION ALL SELECT 'http://ex/p#' || c_custkey, 'bornIn', 'http://ex/n#' || c_nationkey, 'iri' FROM customer UNION ALL SELECT 'http://ex/n#' || n_nationkey, 'type', 'http://ex/o#Place', 'iri' FROM nation UNION ALL SELECT 'http://ex/n#' || n_nationkey, 'modern', n_name, 'lit' FROM nation"
