"""Queries of record recovery, script conversion, names in texts, places' levels and other text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import domain, script, text
from ..operators import evidence, facets, names, places, triples
from ..sources import datasets, recovery
from .registry import query

# --- records out of raw output ---------------------------------------------------------------------------------------

_ONE = '{"type":"node","label":"Person","properties":{"name":"«N»"}}'
_TWO = '{"type":"node","label":"Place","properties":{"name":"{«S»\\"}"}}'
#: Raw outputs by the key's remainder: an array, lines with a bad one between, an object that never closes, prose, indices, missing commas, reasoning, literals, commas too many, nothing.
_RAW = [
    f"[{_ONE},{_TWO}]",
    f"{_ONE}\nnot json\n{_TWO}",
    f"{_ONE}\n{{oops\n{_TWO}",
    f"It's done: {_ONE} and {{more}} then {_TWO}. Fine?",
    f"[1: {_ONE}, 2: {_TWO}]",
    f"```json\n[{_ONE}\n{_TWO},]\n```",
    f"<think>{{{_ONE}</think>{_TWO}",
    f"{{'type': 'node', 'label': 'Person', 'properties': {{'name': '«N»', 'x': None}},}}\n{_TWO}",
    '{"type":"node"\n"label":"Person",,"properties":{"name":"«N»",},}',
    "nothing found",
]
_P, _Q = "(0, 'Person', c_name)", "({}, 'Place', '{{' || c_mktsegment || '\"}}')"
_FOUND = {**{k: f"[{_P}, {_Q.format(1)}]" for k in (0, 1, 2, 3, 4, 5, 7)}, 6: f"[{_Q.format(0)}]", 8: f"[{_P}]", 9: "[]"}


@query(
    "SELECT c_custkey, CAST(r[1] AS INTEGER) AS ord, r[2] AS label, r[3] AS name FROM (SELECT c_custkey, unnest(CASE c_custkey % 10 "
    + " ".join(f"WHEN {k} THEN {x}" for k, x in sorted(_FOUND.items()) if x != "[]")
    + " ELSE [] END) AS r FROM customer)"
)
def json_recover(v):
    form = F.get(F.array(*map(F.lit, _RAW)), (F.col("c_custkey") % 10).cast("int"))
    raw = F.replace(F.replace(form, F.lit("«N»"), F.col("c_name")), F.lit("«S»"), F.col("c_mktsegment"))
    rows = recovery.record_rows(v.table("customer").select("c_custkey", raw.alias("raw")), "raw")
    return rows.select("c_custkey", "ord", "record.label", F.col("record.properties")["name"].alias("name"))


@query(r"SELECT conv_id, turn, regexp_replace(text, '^[^{]*', '') AS shown FROM conversations WHERE contains(text, '{') UNION ALL SELECT conv_id, turn, text FROM conversations WHERE NOT contains(text, '{')")
def reasoning_removed(v):
    said = F.concat(F.lit("<think>{a} "), F.col("role"), F.lit("\n</think>"), F.col("text"))
    return v.table("conversations").select("conv_id", "turn", text.without_reasoning(said).alias("shown"))


# --- scripts, names and texts ----------------------------------------------------------------------------------------

_ENTRIES = """SELECT DISTINCT p_name AS s, upper(p_name) AS t
    FROM part
    WHERE p_partkey % 3 = 0
    UNION SELECT DISTINCT split_part(p_name, ' ', 1), '<' || split_part(p_name, ' ', 1) || '>'
    FROM part
    UNION SELECT DISTINCT split_part(p_name, ' ', 2) || '/' || split_part(p_name, ' ', 1), '='
    FROM part
    WHERE p_partkey % 2 = 0"""
_TEXTS = "SELECT a.p_partkey, a.p_name || '/' || b.p_name AS body FROM part a JOIN part b ON b.p_partkey = (a.p_partkey * 7 + 1) % (SELECT count(*) FROM part)"


@query(
    f"""WITH RECURSIVE entry AS ({_ENTRIES}), body AS ({_TEXTS}),
    scan AS (
        SELECT p_partkey, body, 1 AS pos, '' AS out FROM body
        UNION ALL
        SELECT p_partkey, body, pos + coalesce(hit.n, 1), out || coalesce(hit.t, body[pos]) FROM scan LEFT JOIN LATERAL (SELECT length(s) AS n, t FROM entry WHERE starts_with(substring(scan.body, scan.pos), s) ORDER BY length(s) DESC LIMIT 1) AS hit ON true
        WHERE pos <= length(body)
    )
    SELECT p_partkey, out AS converted, CASE WHEN out = body THEN 1 ELSE 2 END AS forms FROM scan WHERE pos > length(body)"""
)
def script_phrases(v):
    p = v.table("part")
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    entries = p.where("p_partkey % 3 = 0").select(F.col("p_name").alias("s"), F.upper("p_name").alias("t")).union(p.select(first, F.concat(F.lit("<"), first, F.lit(">")))).union(p.where("p_partkey % 2 = 0").select(F.concat_ws("/", second, first), F.lit("=")))
    convert = script.converter(entries.distinct(), "s", "t")
    other = p.select(F.col("p_partkey").alias("other"), F.col("p_name").alias("other_name"))
    bodies = p.join(other, (F.col("p_partkey") * 7 + 1) % p.count() == F.col("other")).select("p_partkey", F.concat_ws("/", "p_name", "other_name").alias("body"))
    return bodies.select("p_partkey", convert(F.col("body")).alias("converted"), F.size(script.forms(F.col("body"), convert)).alias("forms"))


_TYPED = """SELECT DISTINCT right(s_name, 5) AS term
    FROM supplier
    UNION SELECT DISTINCT c_mktsegment
    FROM customer
    UNION SELECT 'Customer#' || right(s_name, 9)
    FROM supplier
    UNION SELECT right(s_name, 2)
    FROM supplier
    UNION SELECT right(s_name, 1)
    FROM supplier"""


@query(
    f"""WITH typed AS ({_TYPED}), hit AS (SELECT term, c_custkey AS node, c_name AS name, CASE WHEN c_name = term THEN '等值' ELSE '包含' END AS reason FROM typed JOIN customer ON contains(c_name, term))
    SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY term ORDER BY name, node) <= 30"""
)
def person_search_many(v):
    """All terms at once, by the windows of the names."""
    s, tail = v.table("supplier"), lambda n: F.expr(f"right(s_name, {n})").alias("term")
    typed = s.select(tail(5)).union(v.table("customer").select("c_mktsegment")).union(s.select(F.concat(F.lit("Customer#"), tail(9)))).union(s.select(tail(2))).union(s.select(tail(1)))
    return names.search_many(names.name_index(v.table("customer"), "c_name", "c_custkey"), typed.distinct(), "term")


_CALLED = """SELECT DISTINCT p_name AS name
    FROM part
    UNION SELECT DISTINCT c_mktsegment
    FROM customer
    UNION SELECT c_name
    FROM customer
    UNION SELECT DISTINCT split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4)
    FROM documents
    UNION SELECT split_part(text, ' ', 2)
    FROM documents"""


@query(f"WITH called AS ({_CALLED}) SELECT name, count(*) AS docs FROM called JOIN documents ON name <> '' AND contains(text, name) GROUP BY 1")
def text_contains_names(v):
    """Names of parts, segments, customers, and two words of every document, in all documents."""
    d, word = v.table("documents"), lambda n: F.split_part(F.substring_index("text", " ", 4), F.lit(" "), F.lit(n))  # the first words, not the whole text, are split
    called = v.table("part").select(F.col("p_name").alias("name")).union(v.table("customer").select("c_mktsegment")).union(v.table("customer").select("c_name")).union(d.select(F.explode(F.array(word(2), F.concat_ws(" ", word(3), word(4))))))
    return names.mention_counts(d, "doc_id", "text", called.distinct(), "name").withColumnRenamed("texts", "docs")


# --- places ----------------------------------------------------------------------------------------------------------

_SUFFIXES = [*domain.SUFFIXES, domain.TIMELINE_SUFFIX, ""]


def _suffixed(name: str, key: str) -> str:
    return f"{name} || CASE {key} % {len(_SUFFIXES)} " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(_SUFFIXES)) + " END"


def _by_case(levels: list[str | None]) -> str:
    return f"CASE s_suppkey % {len(_SUFFIXES)} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(levels) if x) + " END"


#: Worked out by hand, in the order of the suffixes: the suffix of the last token in the fixed order, and for the timeline.
_PLACE_LEVELS = ["特别行政区", "自治区", "州", "县", "区", "区", "省", "市", "州", "盟", "县", "区", "旗", "乡", "镇", "街道", "乡", "苏木", "区", "村", "嘎查", "村", "居委会", None, "旗", None]
_TIMELINE_LEVELS = ["特别行政区", "自治区", "州", "县", "地区", "区", "省", "市", "州", "盟", "县", "区", "旗", "乡", "镇", "街道", "民族乡", "苏木", "社区", "村", "嘎查", "村", "居委会", None, "旗", None]


@query(f"SELECT s_suppkey, {_by_case(_PLACE_LEVELS)} AS place, {_by_case(_TIMELINE_LEVELS)} AS timeline FROM supplier")
def place_level_suffixes(v):
    """Every suffix, in both forms."""
    name = F.expr(_suffixed("concat('P', s_suppkey)", "s_suppkey"))
    return v.table("supplier").select("s_suppkey", name.alias("name")).select("s_suppkey", domain.last_suffix(F.col("name")).alias("place"), domain.last_suffix(F.col("name"), True).alias("timeline"))


_DECLARED = ["市辖区", "自治县", "自治州", "自治旗", "省", "嘎查村"]


@query("SELECT 'S' || s_suppkey AS node, CASE s_suppkey % 7 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(["区", "县", "州", "旗", "省", "嘎查村"])) + " ELSE '市' END AS level FROM supplier")
def place_levels_canonical(v):
    """Declared levels, and inferred ones, in canonical form."""
    declared = "CASE s_suppkey % 7 " + " ".join(f"WHEN {k} THEN ' {x} '" for k, x in enumerate(_DECLARED)) + " END"
    facts = v.facts("supplier", "concat('S', s_suppkey)", {places.MODERN: "concat(s_name, '市')", places.LEVEL_KEYS[0]: declared})
    return places.metadata(v.table("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node")), facts).select("node", "level")


@query(
    """SELECT s_suppkey, replace(n_name, ' ', '') || '省|' || s_name || CASE s_suppkey % 4 WHEN 0 THEN '市' WHEN 1 THEN '县' WHEN 2 THEN '市|市|辖区' ELSE '' END AS tokens, CASE s_suppkey % 4 WHEN 0 THEN '市' WHEN 1 THEN '县/区/旗' WHEN 2 THEN '县/区/旗' END AS level
    FROM supplier
    JOIN nation ON n_nationkey = s_nationkey"""
)
def fn_admin_tokens(v):
    both = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.concat("n_name", F.lit("省、"), "s_name", F.expr("CASE s_suppkey % 4 WHEN 0 THEN '市' WHEN 1 THEN '县' WHEN 2 THEN '市市辖区' ELSE '' END"))
    return both.select("s_suppkey", F.array_join(domain.admin_tokens(name), "|").alias("tokens"), domain.level_of(name).alias("level"))


_SOUTH, _WEST = "CASE WHEN s_suppkey % 3 = 1 THEN -1 ELSE 1 END", "CASE WHEN s_suppkey % 2 = 1 THEN -1 ELSE 1 END"


@query(
    f"""SELECT s_suppkey, CAST({_SOUTH} * (s_suppkey % 30 + 20.5) AS DOUBLE) AS lat_a, CAST(s_suppkey % 60 + 75.25 AS DOUBLE) AS lon_a, CAST({_SOUTH} * (s_suppkey % 30 + 20.5) AS DOUBLE) AS lat_b, CAST({_WEST} * (s_suppkey % 60 + 75.25) AS DOUBLE) AS lon_b
    FROM supplier"""
)
def fn_coords(v):
    raw = F.expr("concat(s_suppkey % 30 + 20, '.5', if(s_suppkey % 3 = 1, 'S', '°N'), ', ', s_suppkey % 60 + 75, '.25', if(s_suppkey % 2 = 1, 'W', '°E'))")
    a, b = domain.coordinates_pair(raw), domain.coordinates_merged(raw)
    return v.table("supplier").select("s_suppkey", a[0].alias("lat_a"), a[1].alias("lon_a"), b[0].alias("lat_b"), b[1].alias("lon_b"))


_CODES = ["'CORE/' || {t}", "'INST/HUBU/' || {t}", "'INST/' || {t}", "'TIER/HUBU/' || {t} || '/' || {t}", "'TIER/HUBU/' || {t} || '/' || {b}", "'LOC_INST/Place#' || {b} || '/LIBU/' || {t}"]
_LABELS = ["{t}", "'户部 / ' || {t}", "'INST/' || {t}", "'户部 / ' || {t}", "'户部 / ' || {t} || ' / ' || {b}", "{b} || ' / 吏部 / ' || {t}"]


def _sixth(forms: list[str]) -> str:
    return "CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN " + x.format(t="p_type", b="p_brand") for k, x in enumerate(forms)) + " END"


@query(f"SELECT p_partkey, {_sixth(_LABELS)} AS label FROM part")
def fn_align_label(v):
    return v.table("part").select("p_partkey", domain.alignment_label(F.expr(_sixth(_CODES))).alias("label"))


@query("SELECT c_custkey, 'AB' || c_name || '國會' AS normal, 'ABc​d' || c_name || '国会' AS token FROM customer")
def fn_norm(v):
    name = F.col("c_name")
    return v.table("customer").select("c_custkey", text.norm(F.concat(F.lit("ＡＢ ​"), name, F.lit("　國\t會"))).alias("normal"), text.norm_token(F.concat(F.lit("Ａ Ｂc​d "), name, F.lit("國 會"))).alias("token"))


# --- numerals, eras, entities ----------------------------------------------------------------------------------------

_CHINESE = "一二三四五六七八九"


def _numeral_text(n: str) -> str:
    """SQL of the Chinese numeral of ``n`` from 1 to 9999."""
    place = lambda unit, word: f"CASE WHEN {n} DIV {unit} % 10 > 0 THEN concat(substring('{_CHINESE}', {n} DIV {unit} % 10, 1), '{word}') ELSE '' END"
    return "concat(" + ", ".join(place(10**k, w) for k, w in ((3, "千"), (2, "百"), (1, "十"), (0, ""))) + ")"


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN NULL WHEN 4 THEN CAST(o_orderkey % 9999 + 1 AS INTEGER) ELSE CAST(o_orderkey % 9999 + 1 AS INTEGER) END AS value
    FROM orders"""
)
def fn_cn_numeral(v):
    """Ranks in Chinese numerals, alone, as ranks, with a letter between, and in digits."""
    written = _numeral_text("CAST(o_orderkey % 9999 + 1 AS INT)")
    raw = F.expr(f"CASE o_orderkey % 5 WHEN 1 THEN concat('第', {written}, '名') WHEN 3 THEN concat('x', {written}) WHEN 4 THEN concat('第', o_orderkey % 9999 + 1, '位') ELSE {written} END")
    return v.table("orders").select("o_orderkey", domain.numeral(raw).alias("value"))


def _era_rows(variant: str) -> list[tuple[str, int, int]]:
    """The eras of a variant in the order of precedence, as the tables state them."""
    rows = [*domain.MING, *(domain.QING if variant in ("place", "people") else [])]
    if variant == "place":
        rows = [(e, 1398 if e == "建文" else 1735 if e == "雍正" else a, b) for e, a, b in rows]
    return sorted(rows, key=lambda r: r[0] != "泰昌") if variant == "timeline" else rows


_VARIANTS = ("place", "people", "timeline", "trend")
_YEAR = "CAST(1360 + o_orderkey % 560 AS INTEGER)"
_ERA_VALUES = {x: ", ".join(f"('{e}', {a}, {b}, {k})" for k, (e, a, b) in enumerate(_era_rows(x))) for x in _VARIANTS}
_ERA_SQL = " UNION ALL ".join(f"SELECT '{x}' AS variant, o_orderkey, arg_min(era, ord) AS era FROM (SELECT o_orderkey, {_YEAR} AS year FROM orders) JOIN (VALUES {_ERA_VALUES[x]}) AS t(era, y0, y1, ord) ON year BETWEEN y0 AND y1 GROUP BY o_orderkey" for x in _VARIANTS)


@query(f"SELECT variant, era, count(*) AS orders FROM ({_ERA_SQL}) GROUP BY ALL")
def era_variants(v):
    """Orders as examinations of the years 1360 to 1919, by the eras of all four tables."""
    years = v.table("orders").select(F.expr("CAST(1360 + o_orderkey % 560 AS INT)").alias("year"))
    one = lambda x: domain.with_era(years, "year", domain.era_table(v.spark, x)).where("era is not null").groupBy("era").agg(F.count(F.lit(1)).alias("orders")).select(F.lit(x).alias("variant"), "era", "orders")
    return one("place").union(one("people")).union(one("timeline")).union(one("trend"))


_HOSTED = "(VALUES " + ", ".join(f"({y}, '{next(e for e, a, b in _era_rows('timeline') if a <= y <= b)}')" for y in domain.HOSTED_YEARS) + ") AS hosted(year, era)"
_MING_YEAR = "CAST(1368 + o_orderkey % 277 AS INTEGER)"


@query(
    f"""SELECT era, count(DISTINCT year) AS years, count(DISTINCT o_custkey) AS people
    FROM (SELECT o_custkey, {_MING_YEAR} AS year
    FROM orders)
    JOIN {_HOSTED} USING (year)
    GROUP BY 1
    HAVING contains(era, '正') OR bool_or(starts_with(CAST(year AS VARCHAR), '142'))"""
)
def eras_shown(v):
    """The eras that a typed query shows, with the hosted years that have people in the data, and the people."""
    held = v.ming().join(F.broadcast(domain.hosted_years(v.spark)), "year")
    eras = held.groupBy("era").agg(F.collect_set("year").alias("ys"), F.countDistinct("person_id").alias("people"))  # years of a table of some tens of rows
    shown = facets.shown(F.col("era"), F.col("ys"), "正") | facets.shown(F.col("era"), F.col("ys"), "142")
    return eras.where(shown).select("era", F.size("ys").cast("long").alias("years"), "people")


@query(f"SELECT era, CAST(min(year) AS INTEGER) AS first, CAST(max(year) AS INTEGER) AS last FROM {_HOSTED} GROUP BY 1")
def era_brackets_hosted(v):
    """The span of each era's hosted years; the years of the data are joined in for the people who stand above it."""
    return domain.era_brackets(domain.hosted_years(v.spark), "year")


_CLIPPED = f"SELECT min(year) AS lo, max(year) AS hi FROM (SELECT {_YEAR} AS year FROM orders WHERE o_orderkey % 560 BETWEEN 100 AND 200)"


@query(
    f"""SELECT era, CAST(greatest(y0, lo) AS INTEGER) AS first, CAST(least(y1, hi) AS INTEGER) AS last
    FROM (VALUES {_ERA_VALUES['trend']}) AS t(era, y0, y1, ord)
    JOIN ({_CLIPPED}) ON greatest(y0, lo) <= least(y1, hi)"""
)
def era_bands_clipped(v):
    """The eras clipped to the range of the data's years."""
    years = v.table("orders").where("o_orderkey % 560 BETWEEN 100 AND 200").select(F.expr("CAST(1360 + o_orderkey % 560 AS INT)").alias("year"))
    return domain.era_bands(domain.era_table(v.spark), years, "year")


@query(
    """WITH list AS (SELECT l_orderkey, list(CAST(l_partkey % 30 AS VARCHAR) ORDER BY l_linenumber, CAST(l_partkey % 30 AS VARCHAR)) AS e FROM lineitem GROUP BY 1),
    inner_ AS (SELECT l_orderkey, e, list_transform(list_filter(list_zip(e, range(len(e))), lambda x: len(list_filter(list_zip(e, range(len(e))), lambda y: y[2] <> x[2] AND contains(y[1], x[1]))) > 0), lambda z: z[1]) AS i FROM list),
    chosen AS (SELECT l_orderkey, CASE WHEN len(i) > 0 THEN i ELSE e END AS c FROM inner_)
    SELECT l_orderkey, array_to_string(list_filter(list_transform(range(1, len(c) + 1), lambda k: CASE WHEN list_position(c, c[k]) = k THEN c[k] END), lambda x: x IS NOT NULL), ',') AS kept FROM chosen"""
)
def entities_clean(v):
    """The lines of an order as entities: of those that lie in others only these."""
    lines = v.table("lineitem").select("l_orderkey", F.struct("l_linenumber", (F.col("l_partkey") % 30).cast("string").alias("e")).alias("x"))
    lists = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x"))["e"].alias("es"))  # an order has some lines
    return lists.select("l_orderkey", F.array_join(evidence.cleaned_entities(F.col("es")), ",").alias("kept"))


_HOUSE = "CASE c_custkey % 5 WHEN 0 THEN '官籍' WHEN 1 THEN '军籍' WHEN 2 THEN ' 民籍 ' WHEN 3 THEN '匠籍' END"


@query(f"SELECT c_custkey AS person_id FROM customer WHERE c_custkey % 5 IN (0, 2) AND c_mktsegment = 'BUILDING'")
def households_admitted(v):
    """People of chosen household types, of which only three are admitted: the fourth that was chosen restricts nothing in."""
    c = v.table("customer")
    attributes = c.select(F.col("c_custkey").alias("person_id"), F.lit("户籍类型").alias("facet"), F.expr(_HOUSE).alias("value")).union(c.select("c_custkey", F.lit("segment"), "c_mktsegment"))
    return facets.match_facets(c.select(F.col("c_custkey").alias("person_id")), facets.admitted(attributes), {"户籍类型": ["官籍", "民籍", "匠籍"], "segment": ["BUILDING"]})


#: The fields of a position's row, in order, and what each is in the made-up facts.
_FIELDS = ["职系", "机构", "核心职称", "层级", "官阶", "地名", "对齐码_core", "对齐码_inst", "对齐码_tier", "对齐码_loc_core", "对齐码_loc_inst", "对齐码_loc_full", "原始称谓", "官职名称", "修饰_方位", "修饰_副", "通用层级"]
_GIVEN = {x: f"CASE WHEN (p_partkey + {k}) % 4 > 0 THEN p_type || '{k}' END" for k, x in enumerate(_FIELDS)}


@query("SELECT CAST(p_partkey AS VARCHAR) AS s, " + ", ".join((f"coalesce({_GIVEN[x]}, {_GIVEN['通用层级']})" if x == "层级" else f"coalesce({_GIVEN[x]}, {_GIVEN['官职名称']})" if x == "原始称谓" else _GIVEN[x]) + f' AS "{x}"' for x in _FIELDS) + " FROM part")
def position_fields(v):
    """All seventeen fields of a position."""
    return triples.position_rows(v.facts("part", "p_partkey", {k: x for k, x in _GIVEN.items()}))


@query(
    """SELECT 'people' AS page, c_mktsegment AS bucket, count(*) AS n
    FROM customer
    GROUP BY ALL
    UNION ALL SELECT 'rich', c_mktsegment, count(*)
    FROM customer
    WHERE c_acctbal >= 5000
    GROUP BY ALL
    UNION ALL SELECT 'rich', c_mktsegment, count(*)
    FROM customer
    WHERE c_acctbal >= 0
    GROUP BY ALL"""
)
def pages_by_name(v):
    """Pages opened by name over one dataset: one as it is, one with two options."""

    def buckets(df, least=None):
        kept = df if least is None else df.where(F.col("c_acctbal") >= least)
        return kept.groupBy(F.col("c_mktsegment").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))

    pages = datasets.Pages(datasets.Datasets(v.spark, lambda spark, path: spark.read.parquet(path).select("c_mktsegment", "c_acctbal")), {"people": buckets, "rich": buckets})
    opened = lambda name, **options: pages.open(name, f"{v.dir}/customer.parquet", **options).select(F.lit(name).alias("page"), "bucket", "n")
    return opened("people").union(opened("rich", least=5000)).union(opened("rich", least=0))
