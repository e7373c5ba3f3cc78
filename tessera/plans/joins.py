"""Resolution, rule and neighbour joins as queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph, lookups, resolve, rules
from tessera.plans.registry import Registry, read

query = Registry()


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 3"
)
def bounded_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return graph.top_per_key(rows, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")], 3).drop("l_extendedprice")


@query(
    "SELECT 'c' || c_custkey AS node_id, 'n' || c_nationkey AS other_id, 'outgoing' AS direction FROM customer UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'incoming' FROM customer"
)
def both_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("target_id"))
    return graph.both_directions(edges)


def _points_and_intervals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_custkey").alias("point_id"), (F.col("c_custkey") % 97).alias("at"))
    o = read(spark, sf_dir, "orders")
    start = F.col("o_orderkey") % 97
    return points, o.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("owner"), start.alias("start"), (start + 1 + F.col("o_orderkey") % 13).alias("end"))


def _interval_sql(order: str) -> str:
    return f"""WITH p AS (SELECT c_custkey, c_custkey % 97 AS place FROM customer), i AS (SELECT o_custkey, o_orderkey AS owner, o_orderkey % 97 AS s, o_orderkey % 97 + 1 + o_orderkey % 13 AS e FROM orders)
SELECT c_custkey AS point_id, owner FROM (SELECT c_custkey, owner, row_number() OVER (PARTITION BY c_custkey ORDER BY {order}) AS r FROM p LEFT JOIN i ON o_custkey = c_custkey AND s <= place AND place <= e) WHERE r = 1"""


@query(_interval_sql("e - s, owner"))
def innermost_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, intervals = _points_and_intervals(spark, sf_dir)
    return resolve.innermost_interval(points, intervals, "custkey", "point_id", "at", "start", "end", "owner").select("point_id", "owner")


@query(_interval_sql("owner"))
def first_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, intervals = _points_and_intervals(spark, sf_dir)
    return resolve.first_interval(points, intervals, "custkey", "point_id", "at", "start", "end", "owner").select("point_id", "owner")


def _owners(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Paths without the scheme, and their hosts and hosts with one segment as owners."""
    paths = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"^[a-z]+://", "").alias("path")).where("path is not null")
    host = F.split_part("path", F.lit("/"), F.lit(1))
    two = F.regexp_extract("path", "^[^/]*/[^/]+", 0)
    owners = paths.select(F.explode(F.array(host, two)).alias("prefix")).where("prefix <> ''").distinct().withColumn("owner", F.concat(F.lit("m:"), F.col("prefix")))
    return paths, owners


OWNERS_SQL = r"""paths AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages WHERE url IS NOT NULL),
owners AS (SELECT DISTINCT prefix FROM (SELECT split_part(path, '/', 1) AS prefix FROM paths UNION ALL SELECT regexp_extract(path, '^[^/]*/[^/]+', 0) FROM paths) WHERE prefix <> '')"""


@query(
    f"WITH {OWNERS_SQL} SELECT page_id, path, CASE WHEN max(length(prefix)) IS NULL THEN NULL ELSE 'm:' || arg_max(prefix, length(prefix)) END AS owner "
    "FROM paths LEFT JOIN owners ON path = prefix OR starts_with(path, prefix || '/') GROUP BY page_id, path"
)
def longest_prefix_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, owners = _owners(spark, sf_dir)
    return resolve.longest_prefix_owner(paths, owners, "path", "prefix", "owner")


@query(
    f"WITH {OWNERS_SQL} SELECT 'm:' || a.prefix AS id, a.prefix AS path, CASE WHEN max(length(b.prefix)) IS NULL THEN NULL ELSE 'm:' || arg_max(b.prefix, length(b.prefix)) END AS parent_id "
    "FROM owners a LEFT JOIN owners b ON starts_with(a.prefix, b.prefix || '/') GROUP BY a.prefix"
)
def parent_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, owners = _owners(spark, sf_dir)
    return resolve.parent_owner(owners.select(F.col("owner").alias("id"), F.col("prefix").alias("path")))


#: stand-ins for the rules of a catalogue, in order
PART_RULES = [rules.Rule("copper", {"p_type": "*COPPER"}), rules.Rule("brand-one", {"p_brand": "Brand#1*"}), rules.Rule("promo", {"p_type": "PROMO*", "p_brand": "*"}), rules.Rule("steel", {"p_type": "*STEEL"})]
_TESTS = {"copper": "ends_with(p_type, 'COPPER')", "brand-one": "starts_with(p_brand, 'Brand#1')", "promo": "starts_with(p_type, 'PROMO') AND p_brand IS NOT NULL", "steel": "ends_with(p_type, 'STEEL')"}
_FIRST = "CASE " + " ".join(f"WHEN {t} THEN '{n}'" for n, t in _TESTS.items()) + " END"


@query(f"SELECT p_partkey, {_FIRST} AS rule_id FROM part WHERE {_FIRST} IS NOT NULL")
def first_match_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.first_match(read(spark, sf_dir, "part"), PART_RULES).where("rule_id is not null").select("p_partkey", "rule_id")


@query(f"SELECT p_partkey FROM part WHERE {_FIRST} IS NULL")
def unmatched_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unmatched(read(spark, sf_dir, "part"), PART_RULES).select("p_partkey")


@query(" UNION ALL ".join(f"SELECT p_partkey, '{n}' AS rule_id FROM part WHERE {t}" for n, t in _TESTS.items()))
def all_match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.all_matches(read(spark, sf_dir, "part"), PART_RULES).select("p_partkey", "rule_id")


def _codes() -> list[rules.Rule]:
    """50,000 rules: whole codes, beginnings and ends in turn."""
    kinds = ("c{}", "c{}*", "*{}")
    return [rules.Rule(f"r{i}", {"code": kinds[i % 3].format(i)}, {"minimum_21": str(i % 7), "recommended_21": "9"}) for i in range(50_000)]


@query("""WITH p AS (SELECT p_partkey, CAST(p_partkey * 17 % 90000 AS varchar) AS digits, p_size % 9 AS v FROM part), hits AS (
  SELECT p_partkey, v, CAST(digits AS bigint) AS i FROM p WHERE CAST(digits AS bigint) % 3 = 0
  UNION ALL SELECT p_partkey, v, CAST(substr(digits, 1, n) AS bigint) FROM (SELECT *, unnest(generate_series(1, length(digits))) AS n FROM p) WHERE CAST(substr(digits, 1, n) AS bigint) % 3 = 1
  UNION ALL SELECT p_partkey, v, CAST(right(digits, n) AS bigint) FROM (SELECT *, unnest(generate_series(1, length(digits))) AS n FROM p) WHERE CAST(right(digits, n) AS bigint) % 3 = 2 AND CAST(CAST(right(digits, n) AS bigint) AS varchar) = right(digits, n)
), first AS (SELECT p_partkey, v, min(i) AS i FROM hits WHERE i < 50000 GROUP BY p_partkey, v)
SELECT p_partkey, 'r' || i AS rule_id, CAST(i % 7 AS varchar) AS minimum, '9' AS recommended FROM first WHERE v < i % 7""")
def recommendations_of_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").selectExpr("p_partkey", "concat('c', p_partkey * 17 % 90000) AS code", "cast(p_size % 9 AS string) AS version")
    return rules.recommendations(parts, _codes(), 21).select("p_partkey", "rule_id", "minimum", "recommended")


@query("""SELECT o_orderkey, 'below' || k AS rule_id, 'com.k' || k AS term FROM (SELECT o_orderkey, o_orderkey % 70000 AS k FROM orders) WHERE k < 50000 AND k % 10 <> 0
UNION ALL SELECT o_orderkey, 'gap' || k, 'Call' || k || '*()' FROM (SELECT o_orderkey, o_orderkey % 900 AS k FROM orders) WHERE k < 600 AND k >= 100""")
def api_findings_of_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "array(concat('com.k', o_orderkey % 70000, '.C'), concat('x.Call', o_orderkey % 900, 'z()')) AS symbols")
    listed = [rules.ApiRule(f"below{i}", symbols=(f"com.k{i}",), excluded_prefixes=() if i % 10 else (f"com.k{i}.C",)) for i in range(50_000)]
    listed += [rules.ApiRule(f"gap{i}", patterns=(f"Call{i}*()",)) for i in range(100, 600)]
    return rules.api_findings(found, listed, 21).select("o_orderkey", "rule_id", F.explode("terms").alias("term"))


TERMS = ["the", "license", "http", "on"]


@query(" UNION ALL ".join(f"SELECT doc_id, '{t}' AS term FROM documents WHERE contains(text, '{t}')" for t in TERMS))
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array("text").alias("symbols"))
    found = rules.api_findings(docs, [rules.ApiRule(t, patterns=(t,)) for t in TERMS], 25)
    return found.select("doc_id", F.explode("terms").alias("term"))


BRANDS = ["Brand#1", "Brand#22", "Brand#22-long", "Brand"]


@query(f"SELECT p_partkey, prefix FROM part, (VALUES {', '.join(f"('{b}')" for b in BRANDS)}) t(prefix) WHERE starts_with(p_brand, prefix) OR starts_with(prefix, p_brand)")
def mutual_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.mutual_prefix(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", BRANDS).drop("p_brand")


@query(
    "SELECT prefix AS replacement_id, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS symbols FROM part, (VALUES ('Brand#1'), ('Brand#3x')) t(prefix) WHERE starts_with(p_brand, prefix) OR starts_with(prefix, p_brand) GROUP BY prefix"
)
def replacement_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.replacements(read(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")), {"Brand#1": ["Brand#1"], "Brand#3x": ["Brand#3x"]})
    return found.select("replacement_id", F.array_join("symbols", ",").alias("symbols"))


HINTS = {"ends-in-seven": "7$", "low": "#0000000[0-9]+"}


@query(" UNION ALL ".join(f"SELECT s_suppkey, '{n}' AS hint FROM supplier WHERE regexp_matches(s_name, '{p}')" for n, p in HINTS.items()))
def hint_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.hint_links(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), HINTS, ["s_name"]).drop("s_name")


@query("SELECT o_orderkey, coalesce(c_name, 'unresolved') AS owner FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = o_custkey")
def lookup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    found = lookups.with_names(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey", "c_name", "unresolved")
    return found.select("o_orderkey", F.col("c_name").alias("owner"))


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 10) ON p_partkey = l_partkey")
def left_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges keep a null name where their other end is not known."""
    parts = read(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return lookups.with_names(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parts, "l_partkey", "p_name").drop("l_partkey")


@query("SELECT c_custkey, max(c.c_name) AS name, max(n_name) AS nation FROM customer c JOIN nation ON n_nationkey = c_nationkey GROUP BY c_custkey")
def owner_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return lookups.with_names(read(spark, sf_dir, "customer"), nation, "c_nationkey", "nation").where("nation is not null").select("c_custkey", F.col("c_name").alias("name"), "nation")


@query(
    "SELECT o_orderkey, l_linenumber, s_name FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = l_linenumber"
)
def composite_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("l_linenumber"), "s_name")
    return o.join(lines, "l_orderkey", "left").join(s, ["l_suppkey", "l_linenumber"], "left").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "s_name")


@query(
    """WITH d AS (SELECT 't' || c_custkey % 40 AS t, 'call' || c_custkey % 3 AS name, 'f' || c_custkey % 6 AS file, CAST(c_custkey % 120 AS bigint) AS line FROM customer),
m AS (SELECT 'm' || s_suppkey AS id, 'f' || s_suppkey % 4 AS file, s_suppkey % 50 AS s, s_suppkey % 50 + s_suppkey % 9 AS e FROM supplier),
k AS (SELECT 'c' || n_nationkey AS id, 'f' || n_nationkey % 5 AS file, n_nationkey AS s, n_nationkey + 60 AS e FROM nation),
p AS (SELECT DISTINCT file, line FROM d),
r AS (SELECT p.file, p.line, (SELECT arg_min(m.id, row(e - s, m.id)) FROM m WHERE m.file = p.file AND s <= p.line AND p.line <= e) AS mid, (SELECT arg_min(k.id, row(e - s, k.id)) FROM k WHERE k.file = p.file AND s <= p.line AND p.line <= e) AS kid FROM p)
SELECT t AS test_case_id, CASE WHEN mid IS NOT NULL THEN 'method' ELSE 'class' END AS target_kind, coalesce(mid, kid) AS target_id, CASE WHEN mid IS NOT NULL THEN 'exercises' ELSE 'mentions' END AS relationship, 0.95::double AS confidence,
       arg_min('jdtls_definition:' || name || '@' || d.file || ':' || d.line, row(d.file, d.line, name)) AS source
FROM d JOIN r ON r.file = d.file AND r.line = d.line WHERE coalesce(mid, kid) IS NOT NULL GROUP BY 1, 2, 3, 4"""
)
def linked_test_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of what test cases call, to the methods and classes around them, each link once."""
    definitions = read(spark, sf_dir, "customer").selectExpr("concat('t', c_custkey % 40) AS test_case_id", "concat('call', c_custkey % 3) AS name", "concat('f', c_custkey % 6) AS file", "c_custkey % 120 AS line")
    methods = read(spark, sf_dir, "supplier").selectExpr("concat('m', s_suppkey) AS id", "concat('f', s_suppkey % 4) AS file", "s_suppkey % 50 AS start_line", "s_suppkey % 50 + s_suppkey % 9 AS end_line")
    classes = read(spark, sf_dir, "nation").selectExpr("concat('c', n_nationkey) AS id", "concat('f', n_nationkey % 5) AS file", "n_nationkey AS start_line", "n_nationkey + 60 AS end_line")
    return resolve.test_targets(definitions, methods, classes)


@query(
    """WITH f AS (SELECT c_custkey AS k, 'conf/c' || c_custkey || '.yml' AS path FROM customer), hits AS (
  SELECT path, CAST(k % 300 AS bigint) AS i, 'filename' AS sign FROM f WHERE k % 300 % 4 = 0
  UNION ALL SELECT path, k % 500, 'property_prefix' FROM f WHERE k % 500 % 4 = 1
  UNION ALL SELECT path, k % 70, 'xml_namespace' FROM f WHERE k % 70 % 4 = 2
  UNION ALL SELECT path, k % 90, 'xml_root' FROM f WHERE k % 90 % 4 = 3)
SELECT path, string_agg(DISTINCT 'r' || i, ',' ORDER BY 'r' || i) AS rules, (SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT DISTINCT unnest([sign, 'r' || i]) AS e FROM hits h WHERE h.path = hits.path)) AS evidence FROM hits GROUP BY path"""
)
def config_files_of_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4,000 rules, each by one sign: a file name, a key's beginning, a namespace or a root element."""
    files = read(spark, sf_dir, "customer").selectExpr(
        "concat('conf/c', c_custkey, '.yml') AS path", "concat('c', c_custkey % 300, '.yml') AS file_name", """concat("<b xmlns='urn:n", c_custkey % 70, "'/>") AS contents""",
        "concat('root', c_custkey % 90) AS xml_root", "array(concat('p', c_custkey % 500, '.x.y'), 'other') AS keys",
    )
    signs = [{"names": ("c{}.yml",)}, {"prefixes": ("p{}",)}, {"namespaces": ("urn:n{}'",)}, {"xml_roots": ("root{}",)}]
    listed = [rules.ConfigRule(f"r{i}", **{k: tuple(t.format(i) for t in v) for k, v in signs[i % 4].items()}) for i in range(4000)]
    found = rules.config_files(files, listed)
    return found.select("path", F.array_join(F.array_sort("rule_ids"), ",").alias("rules"), F.array_join("evidence", ",").alias("evidence"))
