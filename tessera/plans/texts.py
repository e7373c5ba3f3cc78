"""Expressions over text columns as queries: signals, ids, lines, searches, kinds of values, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import lookups
from tessera.operators.graph import first_per_key
from tessera.plans import scoring
from tessera.plans.registry import Registry, read

query = Registry()
#: fixed value: what stands in for long texts that are cut
MARKER = "..."
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NORMAL_SQL = r"lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))"
NODE_SQL = f"'business-node:' || sha256(lower(coalesce(lang, '')) || chr(0) || {NORMAL_SQL})"


@query(scoring.SIGNALS_SQL)
def term_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.wide(read(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, score, priority FROM ({scoring.SCORED_SQL})")
def priority_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(spark, sf_dir).select("doc_id", "score", "priority")


@query(f"SELECT priority, CAST(count(*) AS bigint) AS n, CAST(sum(score) AS bigint) AS total FROM ({scoring.SCORED_SQL}) GROUP BY priority")
def priority_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(spark, sf_dir).groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


@query(
    "SELECT doc_id, name, n, CASE name "
    + " ".join(f"WHEN '{n}' THEN {w}" for n, _, w in scoring.SIGNALS)
    + f" END AS weight FROM (SELECT * FROM ({scoring.SIGNALS_SQL}) x UNPIVOT (n FOR name IN ({', '.join(n for n, _, _ in scoring.SIGNALS)}))) WHERE n > 0"
)
def signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each signal that occurs."""
    each = scoring.signals(read(spark, sf_dir, "documents")).select("doc_id", F.explode("signals").alias("s"))
    return each.select("doc_id", "s.name", F.col("s.count").alias("n"), F.col("s.weight").cast("int").alias("weight")).where("n > 0")


def identified(docs: DataFrame) -> DataFrame:
    text, lang = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))
    return docs.select("doc_id", X.content_id("business-node:", lang, text).alias("node_id"))


@query(f"SELECT doc_id, {NODE_SQL} AS node_id FROM documents")
def stable_node_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(read(spark, sf_dir, "documents"))


@query(f"SELECT node_id, min(doc_id) AS doc_id FROM (SELECT doc_id, {NODE_SQL} AS node_id FROM documents) GROUP BY node_id")
def node_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each content id."""
    return first_per_key(identified(read(spark, sf_dir, "documents")), ["node_id"], [F.col("doc_id")])


@query(
    "SELECT doc_id, CAST(line_number AS bigint) AS line_number, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_number FROM "
    r"(SELECT doc_id, string_split_regex(regexp_replace(text, '\r?\n$', ''), '\r?\n') AS l FROM documents WHERE text IS NOT NULL)) WHERE line_number BETWEEN 2 AND 4"
)
def source_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("path"), "text")
    return lookups.numbered_lines(docs).where(F.col("line_number").between(2, 4)).withColumnRenamed("path", "doc_id")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%an%' OR p_type ILIKE '%an%' ORDER BY p_name, p_partkey LIMIT 20")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookups.contains_text("p_name", "an") | lookups.contains_text("p_type", "an")
    return read(spark, sf_dir, "part").where(found).select("p_partkey", "p_name", "p_type").orderBy("p_name", "p_partkey").limit(lookups.clamped(None))


@query(r"SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%\_1%' ESCAPE '\' OR p_brand ILIKE '%1%'")
def escaped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wildcard in the text searched for is a plain character."""
    return read(spark, sf_dir, "part").where(lookups.contains_text("p_name", "_1") | lookups.contains_text("p_brand", "1")).select("p_partkey", "p_name")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", X.json_field(F.col("props"), "k").alias("k"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/]*/([^/?#]*)', 1) AS segment FROM pages")
def route_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda pattern: F.regexp_extract("url", pattern, 1)
    return read(spark, sf_dir, "pages").select("page_id", part("^([a-z]+)://").alias("scheme"), part("://([^/?#]*)").alias("host"), part("://[^/]*/([^/?#]*)").alias("segment"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages""")
def reference_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


VERSION_SQL = "'v' || p_size || '.' || (p_partkey % 20) || '-M1'"
MANUAL = "p_size % 11 = 0"


@query(
    f"SELECT p_partkey, version, CASE WHEN {MANUAL} THEN true ELSE list_transform(regexp_extract_all(version, '([0-9]+)', 1), lambda x: CAST(x AS bigint)) < [25, 10, 0] END AS due "
    f"FROM (SELECT *, {VERSION_SQL} AS version FROM part)"
)
def version_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a version lies below 25.10.0, or its minimum is to be settled by hand."""
    from tessera.operators.rules import upgrade_due

    parts = read(spark, sf_dir, "part").withColumn("version", F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 20).cast("string"), F.lit("-M1")))
    return parts.select("p_partkey", "version", upgrade_due(F.col("version"), F.lit("25.10.0"), F.lit(True), F.expr(MANUAL)).alias("due"))


_DOLLAR = "chr(36) || '{"
VALUE_SQL = f"""CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN {_DOLLAR}DB_HOST:local}}' WHEN 2 THEN {_DOLLAR}app.name}}' WHEN 3 THEN 'java:comp/env' WHEN 4 THEN 'jdbc/main' WHEN 5 THEN 'jms/q' WHEN 6 THEN 'r2dbc:h2:mem' WHEN 7 THEN {_DOLLAR}HOST}}' ELSE CASE WHEN page_id % 2 = 0 THEN 'plain' ELSE 'a/b' END END"""


@query(
    f"""SELECT page_id, value, CASE WHEN starts_with(value, {_DOLLAR}') AND (contains(value, '_') OR contains(value, 'HOST')) THEN 'ENVIRONMENT_REFERENCE' WHEN starts_with(value, {_DOLLAR}') THEN 'PROPERTY_REFERENCE'
WHEN starts_with(value, 'java:') OR starts_with(value, 'jdbc/') OR starts_with(value, 'jms/') THEN 'JNDI_REFERENCE' WHEN starts_with(value, 'http://') OR starts_with(value, 'https://') OR starts_with(value, 'r2dbc:') THEN 'URL' WHEN contains(value, '/') OR contains(value, '\\') THEN 'FILE_PATH' ELSE 'LITERAL' END AS kind
FROM (SELECT page_id, {VALUE_SQL} AS value FROM pages)"""
)
def value_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.expr(VALUE_SQL).alias("value")).withColumn("kind", X.value_kind(F.col("value")))


SECRETS = ["password", "secret", "token", "key"]


@query(f"SELECT doc_id, CASE WHEN {' OR '.join(f"contains({LOWERED}, '{s}')" for s in SECRETS)} THEN 'secret' ELSE 'normal' END AS sensitivity FROM documents")
def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.sensitivity(F.coalesce("text", F.lit("")), SECRETS).alias("sensitivity"))


@query(f"SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 40) || '{MARKER}' ELSE text END AS short FROM documents")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.truncated(F.col("text"), 40, MARKER).alias("short"))


@query(f"SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 30) || '{MARKER}' || right(text, 30) ELSE text END AS middle, left(split_part(text, chr(10), 1), 240) AS first_line, left(sha256(text), 12) AS short_hash FROM documents WHERE text IS NOT NULL")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.excerpt(text, 60, MARKER).alias("middle"), X.first_line(text).alias("first_line"), X.short_hash(text).alias("short_hash"))


@query(
    "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_filter(list(CAST(l_quantity AS bigint)), lambda x: x BETWEEN 10 AND 40))), ',') AS lines FROM lineitem GROUP BY l_orderkey"
)
def evidence_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line lists cut to a range, sorted, each number once; each number meets its order once, so a list is at most the range."""
    q = F.col("l_quantity").cast("long")
    lists = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(q.between(10, 40), q)).alias("q"))
    return lists.select("l_orderkey", F.array_join(X.clipped_lines(F.col("q"), F.lit(10), F.lit(40)).cast("array<string>"), ",").alias("lines"))


SEGMENTS = ["en", "fr", "news", "test"]


@query(
    f"SELECT page_id, len(list_filter(string_split(lower(url), '/'), lambda x: x IN ({', '.join(f"'{s}'" for s in SEGMENTS)}))) > 0 AS excluded, regexp_matches(lower(url), '(test|spec)[^/]*$') AS by_name FROM pages"
)
def path_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a path has a listed segment, and whether its last segment has a listed ending."""
    path = F.lower("url")
    return read(spark, sf_dir, "pages").select("page_id", F.exists(F.split(path, "/"), lambda x: x.isin(SEGMENTS)).alias("excluded"), F.regexp_like(path, F.lit("(test|spec)[^/]*$")).alias("by_name"))
