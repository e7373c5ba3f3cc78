"""The operators over extracted tables as queries: the driver's tables stand in for methods, classes, scores, tests and the graph."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dealing import dealt
from tessera.operators import coverage, graph, lookups, resolve, score, upsert
from tessera.plans.registry import Registry, read

query = Registry()

#: rows that a task sorts for their first ones
SORTED = 200_000

#: each stand-in: its table, its columns for both engines (expressions that Spark and DuckDB read alike)
STAND_INS = {
    "methods": (
        "documents",
        {
            "id": "concat('m', doc_id)", "class_id": "concat('c', doc_id % 25)", "name": "source", "signature": "concat(lang, '(', doc_id, ')')", "file": "concat('src/', source, '.java')",
            "start_line": "doc_id % 100 + 1", "end_line": "doc_id % 100 + 1 + n_chars % 50", "body_text": "text",
        },
    ),
    "classes": (
        "nation",
        {
            "id": "concat('c', n_nationkey)", "name": "n_name", "qualified_name": "concat('geo.', n_name)", "kind": "CASE WHEN n_regionkey = 0 THEN 'interface' ELSE 'class' END",
            "file": "concat('src/s', n_nationkey % 5, '.java')", "start_line": "CAST(n_nationkey + 1 AS bigint)", "end_line": "CAST(n_nationkey * 3 + 40 AS bigint)",
        },
    ),
    "relationships": (
        "orders",
        {"id": "o_orderkey", "source_id": "concat('m', o_custkey % 50)", "target_id": "concat('m', o_orderkey * 7 % 70)", "kind": "o_orderstatus", "source": "o_orderpriority", "confidence": "o_totalprice"},
    ),
    "candidate_scores": ("documents", {"method_id": "concat('m', doc_id)", "score": "doc_id % 30", "priority": "CASE WHEN doc_id % 30 >= 18 THEN 'high' WHEN doc_id % 30 >= 8 THEN 'medium' ELSE 'low' END"}),
    "candidate_signals": ("conversations", {"method_id": "concat('m', conv_id % 40)", "name": "concat(role, conv_id, '-', turn)", "count": "length(text)", "weight": "turn % 3 + 1"}),
    "business_nodes": ("part", {"id": "concat('business-node:', p_partkey)", "kind": "split_part(p_type, ' ', 1)", "name": "p_name", "statement": "p_type", "created_at": "concat('2024-01-', p_size)", "confidence": "p_retailprice / 10000"}),
    "business_edges": ("orders", {"id": "o_orderkey", "source_id": "concat('business-node:', o_custkey % 150)", "target_id": "concat('business-node:', o_orderkey % 120)", "kind": "o_orderstatus"}),
    "business_evidence": ("orders", {"node_id": "CASE WHEN o_orderkey % 9 > 0 THEN concat('business-node:', o_custkey % 60) END", "method_id": "concat('m', o_orderkey % 90)"}),
    "test_suites": ("region", {"id": "concat('s', r_regionkey)", "qualified_name": "concat('tests.', r_name)", "test_kind": "lower(r_name)", "file": "concat(r_name, 'IT.java')"}),
    "test_cases": ("customer", {"id": "concat('t', c_custkey)", "suite_id": "CASE WHEN c_custkey % 11 > 0 THEN concat('s', c_custkey % 7) END", "name": "c_name", "file": "concat(c_mktsegment, 'IT.java')", "start_line": "c_custkey % 50", "body_text": "repeat(c_name, 300)"}),
    "test_targets": ("orders", {"test_case_id": "concat('t', o_custkey)", "target_kind": "CASE WHEN o_orderkey % 5 = 0 THEN 'class' ELSE 'method' END", "target_id": "concat('m', o_orderkey % 80)", "relationship": "o_orderstatus", "confidence": "o_totalprice"}),
    "test_assertions": ("orders", {"id": "o_orderkey", "test_case_id": "concat('t', o_custkey % 60)", "line": "o_orderkey % 30", "expression": "repeat(concat(o_orderstatus, o_orderkey), o_orderkey % 400)"}),
    "test_entry_points": ("events", {"id": "event_id", "test_case_id": "concat('t', user_id % 60)", "kind": "event_type", "route": "props", "http_method": "upper(event_type)"}),
    "test_fixtures": (
        "events",
        {"id": "event_id", "test_case_id": "CASE WHEN event_id % 3 > 0 THEN concat('t', user_id % 60) END", "suite_id": "CASE WHEN event_id % 3 = 0 THEN concat('s', event_id % 7) END", "fixture_kind": "event_type", "name": "props", "line": "event_id % 40"},
    ),
    "entry_points": ("events", {"id": "event_id", "method_id": "concat('m', user_id % 80)", "kind": "event_type", "framework": "'web'", "route": "props", "http_method": "upper(event_type)"}),
}


def stand_ins(spark: SparkSession, sf_dir: str, *names: str, keys: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The stand-ins; those of the tables in `keys` (table: its key) dealt by it over tasks of SORTED rows, before columns are made of them."""
    tables = {t: read(spark, sf_dir, t) for t in {STAND_INS[n][0] for n in names}}
    tables |= {t: dealt(tables[t], k, per_task=SORTED) for t, k in (keys or {}).items()}
    return {n: tables[STAND_INS[n][0]].selectExpr(*(f"{e} AS {c}" for c, e in STAND_INS[n][1].items())) for n in names}


def w(*names: str) -> str:
    """The stand-ins as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in STAND_INS[n][1].items())} FROM {STAND_INS[n][0]})" for n in names) + " "


# --- signals, scores and candidates ---

LOW = "translate(coalesce(body_text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _counted(text: str, terms: list[str]) -> str:
    return " + ".join(f"CAST((length({text}) - length(replace({text}, '{t}', ''))) / {len(t)} AS bigint)" for t in terms)


_MARKED = "CASE WHEN " + " OR ".join(f"contains(lower(mark), '{t}')" for t in score.ANNOTATION_TERMS[0]) + " THEN 1 ELSE 0 END"
SIGNALS_SQL = (
    w("methods")
    + ", marked AS (SELECT *, CASE CAST(substr(id, 2) AS bigint) % 4 WHEN 0 THEN '@org.x.Transactional' WHEN 1 THEN '@GetMapping(\"/a\")' WHEN 2 THEN '@Plain' END AS mark FROM methods), signals AS ("
    + " UNION ALL ".join(
        [f"SELECT id AS method_id, '{n}' AS name, {_counted('coalesce(body_text, chr(32))', t)} AS count, {k} AS weight FROM marked" for n, (t, k) in score.BODY_TERMS.items()]
        + [f"SELECT id, '{n}', {_counted(LOW, t)}, {k} FROM marked" for n, (t, k) in score.LOWER_TERMS.items()]
        + [f"SELECT id, 'framework_annotations', {_MARKED}, {score.ANNOTATION_TERMS[1]} FROM marked"]
    )
    + "), scores AS (SELECT id AS method_id, CAST(coalesce(sum(count * weight), 0) AS bigint) AS score FROM methods LEFT JOIN signals ON method_id = id GROUP BY id), "
    f"ranked AS (SELECT *, CASE WHEN score >= {score.HIGH} THEN 'high' WHEN score >= {score.MEDIUM} THEN 'medium' ELSE 'low' END AS priority FROM scores) "
)


def marked_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("id", 2, 20).cast("long") % 4
    mark = F.when(k == 0, "@org.x.Transactional").when(k == 1, '@GetMapping("/a")').when(k == 2, "@Plain")
    return stand_ins(spark, sf_dir, "methods")["methods"].withColumn("annotations", F.array_compact(F.array(mark)))


@query(SIGNALS_SQL + "SELECT method_id, name, CAST(count AS bigint) AS count, CAST(weight AS bigint) AS weight FROM signals WHERE count > 0")
def method_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.method_signals(marked_methods(spark, sf_dir))


@query(SIGNALS_SQL + "SELECT * FROM ranked")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.candidate_scores(marked_methods(spark, sf_dir))


@query(SIGNALS_SQL + "SELECT count_if(priority = 'low')::bigint AS low, count_if(priority = 'medium')::bigint AS medium, count_if(priority = 'high')::bigint AS high, count(*)::bigint AS total FROM ranked")
def priority_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.priority_counts(score.candidate_scores(marked_methods(spark, sf_dir)))


@query(
    SIGNALS_SQL + f", {w('classes')[5:]} SELECT method_id, class_id, m.name, signature, m.file, m.start_line, m.end_line, qualified_name, score, priority FROM methods m JOIN classes c ON c.id = class_id JOIN ranked ON method_id = m.id "
    "WHERE priority IN ('medium', 'high') ORDER BY score DESC, method_id LIMIT 20"
)
def select_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best methods of the medium tier and above."""
    methods = marked_methods(spark, sf_dir)
    return score.select_candidates(methods, stand_ins(spark, sf_dir, "classes")["classes"], score.candidate_scores(methods), "medium", 20)


@query(SIGNALS_SQL + "SELECT method_id, file || ':' || start_line || '-' || end_line || ' score=' || score || ' priority=' || priority AS summary FROM ranked JOIN methods ON id = method_id WHERE file IS NOT NULL")
def context_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = marked_methods(spark, sf_dir)
    return score.context_packets(methods.where("file is not null"), score.candidate_scores(methods))


@query(w("methods") + "SELECT id AS method_id, file, start_line, end_line, 'scanner' AS source FROM methods")
def evidence_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.evidence_ranges(stand_ins(spark, sf_dir, "methods")["methods"])


# --- lookups ---


@query(w("methods", "classes") + "SELECT m.*, qualified_name, c.kind AS class_kind FROM methods m JOIN classes c ON c.id = class_id WHERE m.id = 'm7'")
def lookup_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.get_method(stand_ins(spark, sf_dir, "methods", "classes"), "m7")


_ASKED = ["m1", "m2", "m3", "m50", "m69"]
_ASKED_SQL = "(" + ", ".join(f"'{m}'" for m in _ASKED) + ")"
_BOTH = "SELECT source_id AS node_id, target_id AS other_id, 'outgoing' AS direction, * EXCLUDE (source_id, target_id) FROM {0} UNION ALL SELECT target_id, source_id, 'incoming', * EXCLUDE (source_id, target_id) FROM {0}"


@query(
    w("methods", "relationships") + f", seen AS ({_BOTH.format('relationships')}) SELECT s.* EXCLUDE r, name AS other_name FROM (SELECT *, row_number() OVER (PARTITION BY node_id, direction ORDER BY confidence DESC, id) AS r FROM seen WHERE node_id IN {_ASKED_SQL}) s "
    "LEFT JOIN methods m ON m.id = other_id WHERE r <= 20"
)
def lookup_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.get_method_relationships(stand_ins(spark, sf_dir, "methods", "relationships"), _ASKED)


@query(
    w("candidate_scores", "candidate_signals") + "SELECT s.method_id, score, priority, string_agg(name || '=' || count, ',' ORDER BY r) AS signals FROM candidate_scores s LEFT JOIN (SELECT *, row_number() OVER (ORDER BY weight DESC, name) AS r "
    "FROM candidate_signals WHERE method_id = 'm5') g ON g.method_id = s.method_id AND r <= 20 WHERE s.method_id = 'm5' GROUP BY ALL"
)
def lookup_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookups.get_method_analysis(stand_ins(spark, sf_dir, "candidate_scores", "candidate_signals"), "m5")
    return found.withColumn("signals", F.array_join(F.transform("signals", lambda x: F.concat_ws("=", x["name"], x["count"].cast("string"))), ","))


_LINES = r"lines AS (SELECT path, unnest(l) AS line, CAST(generate_subscripts(l, 1) AS bigint) AS line_number FROM (SELECT path, string_split_regex(regexp_replace(text, '\r?\n$', ''), '\r?\n') AS l FROM files WHERE text IS NOT NULL))"
_FILES = "WITH files AS (SELECT 'd/' || doc_id AS path, text FROM documents), "


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), "text")


@query(_FILES + _LINES + " SELECT * FROM lines WHERE path = 'd/3' AND line_number BETWEEN 1 AND 5")
def lookup_source_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.read_source_range(_files(spark, sf_dir), "d/3", 1, 9, 5)


@query(_FILES + _LINES + ", m AS (SELECT doc_id % 3 AS s FROM documents WHERE doc_id = 8) SELECT l.* FROM lines l, m WHERE path = 'd/8' AND line_number BETWEEN s AND s + 80")
def lookup_method_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = read(spark, sf_dir, "documents").selectExpr("concat('m', doc_id) AS id", "concat('d/', doc_id) AS file", "doc_id % 3 AS start_line", "doc_id % 3 + 500 AS end_line")
    return lookups.read_method_source({"methods": methods}, _files(spark, sf_dir), "m8")


@query(w("methods", "classes", "relationships") + "SELECT m.*, qualified_name, c.kind AS class_kind FROM methods m JOIN classes c ON c.id = class_id WHERE m.id = 'm14' AND m.id IN (SELECT target_id FROM relationships)")
def lookup_related_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stand_ins(spark, sf_dir, "methods", "classes", "relationships")
    return lookups.get_related_method(t, t["relationships"].select(F.col("target_id").alias("id")), "m14")


@query(w("methods") + "SELECT * FROM methods WHERE name ILIKE '%e%' OR signature ILIKE '%e%' ORDER BY name NULLS FIRST, id LIMIT 20")
def lookup_search_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.search_methods(stand_ins(spark, sf_dir, "methods"), "E")


@query(w("classes") + "SELECT * FROM classes WHERE name ILIKE '%n!_1%' ESCAPE '!' OR qualified_name ILIKE '%n!_1%' ESCAPE '!' ORDER BY qualified_name, id LIMIT 5")
def lookup_search_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.search_classes(stand_ins(spark, sf_dir, "classes"), "n_1", 5)


@query(w("business_nodes") + "SELECT * FROM business_nodes WHERE (name ILIKE '%old%' OR statement ILIKE '%old%') AND kind = 'PROMO' ORDER BY created_at DESC, id LIMIT 20")
def lookup_find_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.find_business_nodes(stand_ins(spark, sf_dir, "business_nodes"), "OLD", "PROMO")


@query(w("business_nodes") + "SELECT * FROM business_nodes WHERE id = 'business-node:9'")
def lookup_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.get_business_node(stand_ins(spark, sf_dir, "business_nodes"), "business-node:9")


@query(w("business_nodes") + "SELECT * FROM business_nodes ORDER BY created_at DESC, id LIMIT 20")
def lookup_recent_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.recent_nodes(stand_ins(spark, sf_dir, "business_nodes"))


@query(
    w("business_nodes", "business_edges") + f", seen AS ({_BOTH.format('business_edges')}) SELECT * EXCLUDE r FROM (SELECT s.*, n.name AS other_name, n.kind AS other_kind, row_number() OVER (PARTITION BY node_id, direction ORDER BY s.id) AS r "
    "FROM seen s JOIN business_nodes n ON n.id = other_id WHERE node_id IN ('business-node:1', 'business-node:4')) WHERE r <= 7"
)
def lookup_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.get_business_neighbors(stand_ins(spark, sf_dir, "business_nodes", "business_edges"), ["business-node:1", "business-node:4"], 7)


@query(
    w("test_targets", "test_cases") + f"SELECT * EXCLUDE r FROM (SELECT target_id, confidence, relationship, c.*, row_number() OVER (PARTITION BY target_id ORDER BY confidence DESC, file, start_line, c.id) AS r FROM test_targets JOIN test_cases c ON c.id = test_case_id "
    f"WHERE target_kind = 'method' AND target_id IN {_ASKED_SQL}) WHERE r <= 20"
)
def lookup_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.get_tests_for_method(stand_ins(spark, sf_dir, "test_targets", "test_cases"), _ASKED)


@query(w("test_cases", "test_suites") + f"SELECT c.* REPLACE (left(body_text, {lookups.BODY}) || '…' AS body_text), s.qualified_name AS suite_name FROM test_cases c LEFT JOIN test_suites s ON s.id = suite_id WHERE c.id = 't3'")
def lookup_test_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.get_test_case(stand_ins(spark, sf_dir, "test_cases", "test_suites"), "t3")


@query(w("test_assertions") + f"SELECT * REPLACE (CASE WHEN length(expression) > {lookups.EXPRESSION} THEN left(expression, {lookups.EXPRESSION}) || '…' ELSE expression END AS expression) FROM test_assertions WHERE test_case_id = 't7' ORDER BY line, id LIMIT 20")
def lookup_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.get_test_assertions(stand_ins(spark, sf_dir, "test_assertions"), "t7")


@query(w("test_entry_points") + "SELECT * FROM test_entry_points WHERE test_case_id = 't5' ORDER BY id LIMIT 20")
def lookup_test_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.get_test_entry_points(stand_ins(spark, sf_dir, "test_entry_points"), "t5")


@query(
    w("test_cases", "test_fixtures") + "SELECT * FROM (SELECT *, 'case' AS scope FROM test_fixtures WHERE test_case_id = 't5' UNION ALL SELECT *, 'suite' FROM test_fixtures WHERE test_case_id IS NULL AND suite_id IN (SELECT suite_id FROM test_cases WHERE id = 't5')) "
    "ORDER BY line, id LIMIT 20"
)
def lookup_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.get_test_fixtures(stand_ins(spark, sf_dir, "test_cases", "test_fixtures"), "t5")


@query(w("entry_points") + f"SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY method_id ORDER BY id) AS r FROM entry_points WHERE method_id IN {_ASKED_SQL}) WHERE r <= 5")
def lookup_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.entry_points_of(stand_ins(spark, sf_dir, "entry_points"), _ASKED)


@query(w("business_nodes") + "SELECT id, kind, name FROM business_nodes WHERE kind IN ('PROMO', 'SMALL') ORDER BY kind, name, id LIMIT 30")
def behaviours_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.behaviours_in_order(stand_ins(spark, sf_dir, "business_nodes")["business_nodes"], ["PROMO", "SMALL"], 30).select("id", "kind", "name")


_ORDERS = {"entry_points": "kind, route, http_method, id", "signals": "weight DESC, count DESC, name", "tests": "file, start_line, id", "assertions": "line, id", "fixtures": "line, id", "test_entry_points": "kind, route, http_method, id"}
_PART_TABLES = {"entry_points": "entry_points", "signals": "candidate_signals", "assertions": "test_assertions", "fixtures": "test_fixtures", "test_entry_points": "test_entry_points"}


def _bounded(part: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _PART_TABLES[part]
    key = lookups.CONTEXT[part][0]
    return lookups.bounded_context(stand_ins(spark, sf_dir, table)[table].where(F.col(key).isNotNull()), part)


for _part, _table in _PART_TABLES.items():
    _key, _, _most = lookups.CONTEXT[_part]
    _run = functools.partial(_bounded, _part)
    _run.__name__ = f"context_{_part}"  # type: ignore[attr-defined]
    query(w(_table) + f"SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY {_key} ORDER BY {_ORDERS[_part]}) AS r FROM {_table} WHERE {_key} IS NOT NULL) WHERE r <= {_most}")(_run)


@query(
    w("methods", "test_cases", "test_targets") + "SELECT file FROM test_cases UNION SELECT file FROM methods WHERE id IN (SELECT target_id FROM test_targets WHERE target_kind = 'method') AND file IS NOT NULL"
)
def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.java_files(stand_ins(spark, sf_dir, "methods", "test_cases", "test_targets"))


@query(w("methods", "classes", "candidate_scores") + "SELECT s.method_id, m.class_id, m.name AS method_name, m.file, qualified_name FROM candidate_scores s LEFT JOIN methods m ON m.id = s.method_id LEFT JOIN classes c ON c.id = m.class_id")
def related_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stand_ins(spark, sf_dir, "methods", "classes", "candidate_scores")
    return lookups.related_ids(t["candidate_scores"].select("method_id"), t).select("method_id", "class_id", "method_name", "file", "qualified_name")


_COUNTED = ["methods", "classes", "relationships", "business_nodes"]


@query(w(*_COUNTED) + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*)::bigint AS n FROM {n}" for n in _COUNTED))
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.row_counts(stand_ins(spark, sf_dir, *_COUNTED))


# --- coverage ---


@query(w("business_nodes", "business_evidence") + "SELECT n.id, kind, name, string_agg(DISTINCT method_id, ',' ORDER BY method_id) AS method_ids FROM business_nodes n JOIN business_evidence e ON n.id = node_id GROUP BY n.id, kind, name")
def behaviours(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stand_ins(spark, sf_dir, "business_nodes", "business_evidence")
    return coverage.behaviours(t["business_nodes"].select("id", "kind", "name"), t["business_evidence"]).withColumn("method_ids", F.array_join("method_ids", ","))


@query(
    w("methods", "business_evidence") + "SELECT node_id AS id, arg_min(method_id, pos) AS first_known FROM (SELECT node_id, method_id, row_number() OVER (PARTITION BY node_id ORDER BY method_id) AS pos FROM (SELECT DISTINCT node_id, method_id FROM business_evidence WHERE node_id IS NOT NULL)) "
    "WHERE method_id IN (SELECT id FROM methods WHERE CAST(substr(id, 2) AS bigint) % 3 = 0) GROUP BY node_id"
)
def candidates_with_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stand_ins(spark, sf_dir, "methods", "business_evidence")
    listed = t["business_evidence"].where("node_id is not null").groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_set("method_id")).alias("ids"))
    known = t["methods"].where("CAST(substr(id, 2) AS bigint) % 3 = 0").select(F.col("id").alias("method_id"))
    return coverage.with_any(listed, "ids", known, "method_id").select("id", "first_known")


_INPUTS = "inputs AS (SELECT o_custkey AS scenario_id, o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN '{\"method\": \"m' || o_orderkey % 6 || '\"}' ELSE '{}' END AS input_json FROM orders)"
_SEEN = "observations AS (SELECT o_custkey AS scenario_id, l_orderkey AS input_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 45)"
_OBSERVED = f"{_INPUTS}, {_SEEN}, covered AS (SELECT i.scenario_id, json_extract_string(input_json, '$.method') AS method FROM inputs i JOIN (SELECT DISTINCT * FROM observations) o ON o.scenario_id = i.scenario_id AND o.input_id = i.id)"


def _observed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders")
    json = F.expr("CASE WHEN o_orderkey % 4 > 0 THEN concat('{\"method\": \"m', o_orderkey % 6, '\"}') ELSE '{}' END")
    inputs = orders.select(F.col("o_custkey").alias("scenario_id"), F.col("o_orderkey").alias("id"), json.alias("input_json"))
    seen = read(spark, sf_dir, "lineitem").where("l_quantity > 45").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return inputs, seen.select(F.col("o_custkey").alias("scenario_id"), F.col("l_orderkey").alias("input_id"))


@query(f"WITH {_OBSERVED} SELECT scenario_id, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM covered WHERE method IS NOT NULL GROUP BY scenario_id")
def observed_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.observed_methods(*_observed(spark, sf_dir)).withColumn("methods", F.array_join("methods", ","))


@query(f"WITH {_INPUTS}, {_SEEN} SELECT i.scenario_id, i.id, count(o.input_id)::bigint AS n_observations FROM inputs i LEFT JOIN observations o ON o.scenario_id = i.scenario_id AND o.input_id = i.id GROUP BY ALL")
def observations_of_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.observations_of_inputs(*_observed(spark, sf_dir)).select("scenario_id", "id", "n_observations")


_STATUS = "CASE c_custkey % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'skipped' WHEN 2 THEN 'failed' ELSE 'pending' END"
_SCENARIOS = f"scenarios AS (SELECT c_custkey AS id, {_STATUS} AS status FROM customer)"
_COMPLETE = (
    f"WITH {_OBSERVED}, {_SCENARIOS}, expected AS (SELECT DISTINCT scenario_id, json_extract_string(input_json, '$.method') AS method FROM inputs), lacking AS (SELECT DISTINCT scenario_id FROM (SELECT * FROM expected WHERE method IS NOT NULL EXCEPT SELECT * FROM covered)) "
    ", done AS (SELECT id, status, status = 'skipped' OR (status = 'accepted' AND id NOT IN (SELECT scenario_id FROM lacking) AND id IN (SELECT scenario_id FROM inputs) AND id IN (SELECT scenario_id FROM observations)) AS complete FROM scenarios) "
)


def _complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, seen = _observed(spark, sf_dir)
    method = F.get_json_object("input_json", "$.method")
    expected = inputs.where(method.isNotNull()).groupBy("scenario_id").agg(F.collect_set(method).alias("methods"))  # six methods at most
    gaps = coverage.coverage_gaps(expected, coverage.observed_methods(inputs, seen))
    scenarios = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(_STATUS).alias("status"))
    return coverage.complete(coverage.scenario_counts(scenarios, inputs, seen), gaps)


@query(_COMPLETE + "SELECT * FROM done")
def scenarios_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _complete(spark, sf_dir).select("id", "status", "complete")


@query(_COMPLETE + "SELECT count(*)::bigint AS n FROM done WHERE NOT complete")
def scenarios_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.incomplete_count(_complete(spark, sf_dir))


@query(f"WITH {_SCENARIOS} SELECT * FROM scenarios WHERE status NOT IN ('accepted', 'committed', 'skipped') ORDER BY id LIMIT 1")
def next_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.next_pending(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(_STATUS).alias("status")))


@query("SELECT c_custkey AS id, min(o_orderpriority || o_orderkey) AS path FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "orders").selectExpr("o_custkey AS scenario_id", "concat(o_orderpriority, o_orderkey) AS path")
    return coverage.first_files(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), files)


@query(w("methods", "business_evidence") + "SELECT id FROM methods WHERE id NOT IN (SELECT method_id FROM business_evidence)")
def methods_without_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stand_ins(spark, sf_dir, "methods", "business_evidence")
    return upsert.pending(t["methods"].select("id"), t["business_evidence"].select(F.col("method_id").alias("id")), "id")


# --- places ---


@query(
    w("methods", "classes") + ", points AS (SELECT o_orderkey AS point_id, 'src/s' || o_custkey % 6 || '.java' AS file, o_orderkey % 130 AS line FROM orders), spans AS (SELECT 'src/s' || CAST(substr(id, 2) AS bigint) % 4 || '.java' AS file, start_line, end_line, id FROM methods), "
    "m AS (SELECT point_id, arg_min(id, row(end_line - start_line, id)) AS id FROM points p JOIN spans s ON s.file = p.file AND line BETWEEN start_line AND end_line GROUP BY point_id), "
    "c AS (SELECT point_id, arg_min(id, row(end_line - start_line, id)) AS id FROM points p JOIN classes s ON s.file = p.file AND line BETWEEN start_line AND end_line GROUP BY point_id) "
    "SELECT p.point_id, p.file, line, CASE WHEN m.id IS NOT NULL THEN 'method' WHEN c.id IS NOT NULL THEN 'class' END AS target_kind, coalesce(m.id, c.id) AS target_id FROM points p LEFT JOIN m USING (point_id) LEFT JOIN c USING (point_id)"
)
def innermost_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS point_id", "concat('src/s', o_custkey % 6, '.java') AS file", "o_orderkey % 130 AS line")
    t = stand_ins(spark, sf_dir, "methods", "classes")
    spans = t["methods"].withColumn("file", F.expr("concat('src/s', CAST(substr(id, 2) AS bigint) % 4, '.java')"))
    return resolve.innermost_target(points, spans, t["classes"]).select("point_id", "file", "line", "target_kind", "target_id")


@query(
    "WITH f AS (SELECT page_id AS finding_id, regexp_replace(url, '^[a-z]+://', '') AS file FROM pages), s AS (SELECT DISTINCT split_part(file, '/', 1) AS path FROM f WHERE file IS NOT NULL UNION SELECT '.'), "
    "o AS (SELECT path, length(path) % 7 AS ordinal, 's:' || path AS scope_id FROM s) SELECT finding_id, arg_min(scope_id, row(ordinal, scope_id)) AS scope_id FROM f LEFT JOIN o ON path = '.' AND file IS NOT NULL OR file = path OR starts_with(file, path || '/') GROUP BY finding_id"
)
def first_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = read(spark, sf_dir, "pages").select(F.col("page_id").alias("finding_id"), F.regexp_replace("url", "^[a-z]+://", "").alias("file"))
    hosts = findings.where("file is not null").select(F.split_part("file", F.lit("/"), F.lit(1)).alias("path")).union(spark.range(1).select(F.lit("."))).distinct()
    scopes = hosts.select("path", F.expr("length(path) % 7").alias("ordinal"), F.concat(F.lit("s:"), "path").alias("scope_id"))
    return resolve.first_scope(findings, scopes).select("finding_id", "scope_id")


@query(
    w("relationships", "classes") + f", seen AS ({_BOTH.format('relationships')}) SELECT * EXCLUDE r, CAST(NULL AS varchar) AS other_name FROM (SELECT *, row_number() OVER (PARTITION BY node_id, direction ORDER BY confidence DESC, id) AS r FROM seen) WHERE r <= 20"
)
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stand_ins(spark, sf_dir, "relationships", "classes")
    return graph.neighbours(t["relationships"], t["classes"])


@query(
    w("classes") + ", found AS (SELECT o_orderkey AS id, 'c' || o_custkey % 25 AS target_id, min(c.id) AS source_id FROM orders LEFT JOIN classes c ON c.file = 'src/s' || o_custkey % 6 || '.java' AND o_orderkey % 130 BETWEEN start_line AND end_line GROUP BY ALL) "
    "SELECT DISTINCT source_id, target_id, 'REFERENCES' AS kind, 'language_server' AS source, 0.9::double AS confidence FROM found WHERE source_id IS NOT NULL AND source_id <> target_id"
)
def location_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS location_id", "concat('src/s', o_custkey % 6, '.java') AS file", "o_orderkey % 130 AS line", "concat('c', o_custkey % 25) AS target_id")
    return graph.location_edges(at, stand_ins(spark, sf_dir, "classes")["classes"], "REFERENCES", 0.9)


# --- writes ---


@query(w("candidate_scores") + "SELECT method_id, CASE WHEN method_id = 'm9' THEN 99 ELSE score END AS score, CASE WHEN method_id = 'm9' THEN NULL ELSE priority END AS priority FROM candidate_scores")
def updated_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.updated(stand_ins(spark, sf_dir, "candidate_scores")["candidate_scores"], "method_id", "m9", {"score": 99, "priority": None})


@query("SELECT * FROM region UNION ALL SELECT 77, NULL")
def inserted_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.inserted(read(spark, sf_dir, "region"), {"r_regionkey": 77})
