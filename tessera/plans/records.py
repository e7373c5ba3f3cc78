"""Expressions, path tests, rules and classification as queries over the driver's tables, beside SQL that works the rows out its own way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import builds, classify, rules
from tessera.plans.registry import Registry, read
from tessera.sources import catalogues, files, formats

query = Registry()

# --- expressions: each case is a text that a row's key picks, the same in both engines ---


def picked(key: str, cases: list[str | None]) -> str:
    """A CASE over key % n; doubled quotes stand for one, {k} for the key."""
    texts = ["NULL" if c is None else " || ".join(part for i, p in enumerate(c.split("{k}")) for part in ([f"CAST({key} AS string)"] if i else []) + [f"'{p}'"]) for c in cases]
    return f"CASE {key} % {len(cases)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"


VERSIONS = picked("p_partkey", ["1.{k}", "{k}.0.2", "17", "none", None, "1", "jdk-21.0.{k}"])


@query(
    "SELECT p_partkey, CASE WHEN v IS NULL OR regexp_extract(v, '([0-9]+)', 1) = '' THEN NULL WHEN regexp_matches(v, '^[^0-9]*1\\.[0-9]') THEN CAST(regexp_extract(v, '1\\.([0-9]+)', 1) AS bigint) ELSE CAST(regexp_extract(v, '([0-9]+)', 1) AS bigint) END AS major "
    f"FROM (SELECT p_partkey, {VERSIONS} AS v FROM part)"
)
def java_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.expr(VERSIONS).alias("v")).select("p_partkey", X.java_major(F.col("v")).alias("major"))


ANNOTATIONS = picked("event_id", ['@org.x.GetMapping("/a/{k}")', "@Plain", '@Table(name = "t_{k}", schema = "s")', '@x.Column( "c{k}" )', "@Path(VALUE)", '@RequestMapping(value="/v", name="n")'])


@query(
    "SELECT event_id, regexp_extract(split_part(ltrim(a, '@'), '(', 1), '([^.]+)$', 1) AS name, nullif(split_part(a || '\"', '\"', 2), '') AS quoted, "
    "nullif(regexp_extract(a, '\\bname\\s*=\\s*\"([^\"]*)\"', 1), '') AS named, coalesce(nullif(regexp_extract(a, 'name\\s*=\\s*\"([^\"]+)\"', 1), ''), nullif(regexp_extract(a, '\\(\\s*\"([^\"]+)\"', 1), '')) AS value "
    f"FROM (SELECT event_id, {ANNOTATIONS} AS a FROM events)"
)
def annotation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    rows = read(spark, sf_dir, "events").select("event_id", F.expr(ANNOTATIONS).alias("a"))
    return rows.select("event_id", X.annotation_name(a).alias("name"), X.first_quoted(a).alias("quoted"), X.named_value(a, "name").alias("named"), X.annotation_value(a).alias("value"))


TYPES = picked("o_orderkey", ["ResponseEntity<Order{k}>", "void", "List<Item, Other>", "HttpEntity<Map<A, B>>", "OrderResponse", "Void", None, "Order{k}"])


@query(
    "SELECT o_orderkey, g AS argument, coalesce(g, t) AS unwrapped, CASE WHEN t IN ('void', 'Void') THEN NULL WHEN contains(t, 'ResponseEntity') OR contains(t, 'HttpEntity') THEN g ELSE t END AS response "
    f"FROM (SELECT o_orderkey, t, CASE WHEN contains(t, '<') THEN trim(split_part(split_part(substr(t, instr(t, '<') + 1), '>', 1), ',', 1)) END AS g FROM (SELECT o_orderkey, {TYPES} AS t FROM orders))"
)
def generic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.expr(TYPES).alias("t")).select("o_orderkey", X.generic_argument(t).alias("argument"), X.unwrapped(t).alias("unwrapped"), classify.response_type(t).alias("response"))


@query("SELECT o_orderkey, replace(replace(o_orderpriority || '-${host}:${port}-${missing}-${host}', '${port}', '80'), '${host}', o_orderpriority) AS value FROM orders")
def substituted_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    properties = F.create_map(F.lit("host"), F.col("o_orderpriority"), F.lit("port"), F.lit("80"))
    return rows.select("o_orderkey", X.substituted(F.concat("o_orderpriority", F.lit("-${host}:${port}-${missing}-${host}")), properties).alias("value"))


NAMES = picked("page_id", ["application-prod.yml", "bootstrap-{k}.properties", "application.yaml", "app-x.yml", "application-a.b.yaml"])
CONTENTS = picked("page_id", [None, "a=1", "x: 1~ spring.profiles.active: dev-{k}", "spring.config.activate.on-profile=it", "none"])
PLACES = picked("page_id", ["src/test/r/a.yml", "m/src/test/b", "src/main/c", "test/src/d"])


@query(
    "SELECT page_id, coalesce(nullif(regexp_extract(n, '^(?:application|bootstrap)-([A-Za-z0-9_.-]+)\\.(?:properties|ya?ml)$', 1), ''), nullif(regexp_extract(replace(c, '~', chr(10)), '(?m)^\\s*(?:spring\\.profiles\\.active|spring\\.profiles\\.default|spring\\.config\\.activate\\.on-profile)\\s*[:=]\\s*([A-Za-z0-9_.-]+)', 1), '')) AS profile, "
    f"CASE WHEN contains('/' || p, '/src/test/') THEN 'test' ELSE 'main' END AS scope FROM (SELECT page_id, {NAMES} AS n, {CONTENTS} AS c, {PLACES} AS p FROM pages)"
)
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", F.expr(NAMES).alias("n"), F.translate(F.expr(CONTENTS), "~", "\n").alias("c"), F.expr(PLACES).alias("p"))
    return rows.select("page_id", X.profile(F.col("n"), F.col("c")).alias("profile"), X.source_scope(F.col("p")).alias("scope"))


EXPRESSIONS = picked("c_custkey", [" a.b.Call{k} ( x , y )", "java.util.Date", "  ", 'Class.forName( "org.K{k}" )', "new  Thing{k}"])


@query(
    "SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter(CASE c_custkey % 5 WHEN 0 THEN ['a.b.Call' || c_custkey || ' ( x , y )', 'a.b.Call' || c_custkey || '(x,y)', 'Call' || c_custkey || '(x,y)'] WHEN 1 THEN ['java.util.Date'] WHEN 2 THEN [] "
    "WHEN 3 THEN ['Class.forName( \"org.K' || c_custkey || '\" )', 'Class.forName(\"org.K' || c_custkey || '\")', 'forName(\"org.K' || c_custkey || '\")', 'org.K' || c_custkey, 'Class.forName(\"org.K' || c_custkey] "
    "ELSE ['new  Thing' || c_custkey, 'newThing' || c_custkey] END, lambda x: x IS NOT NULL))), '|') AS names FROM customer"
)
def expression_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(X.expression_values(F.expr(EXPRESSIONS)), "|").alias("names"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '-', 'g') AS segment, replace(html, '*/', '* /') AS comment, '\"' || replace(replace(replace(replace(url, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r') || '\"' AS literal FROM pages")
def escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", X.path_segment(url).alias("segment"), X.comment_text(F.col("html")).alias("comment"), X.string_literal(url).alias("literal"))


PACKAGES = picked("p_partkey", ["org.shop", None, "", "a.b.c"])
SOURCES = picked("p_partkey", ["m/src/main/java/A.java", "src/main/java/B.java", "lib/C.java"])
TITLES = picked("p_partkey", ["approve order-{k}", "!!", "x y_z"])
_PACKAGE = "CASE WHEN coalesce(package, '') = '' THEN 'checks' ELSE package || '.checks' END"
_CLASS = "CASE p_partkey % 3 WHEN 0 THEN 'ApproveOrder' || p_partkey WHEN 1 THEN 'Behavior' ELSE 'XYZ' END || left(sha256(p_name), 12) || 'CharacterizationTest'"


@query(
    f"SELECT p_partkey, {_PACKAGE} AS package, {_CLASS} AS class_name, CASE WHEN p_partkey % 3 = 0 THEN 'm/' ELSE '' END || 'src/test/java/' || replace({_PACKAGE}, '.', '/') || '/' || {_CLASS} || '.java' AS path FROM (SELECT p_partkey, p_name, {PACKAGES} AS package FROM part)"
)
def generated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.expr(PACKAGES).alias("source"), F.expr(SOURCES).alias("file"), F.expr(TITLES).alias("title"))
    named = rows.select("p_partkey", "file", X.generated_package(F.col("source"), "checks").alias("package"), X.generated_class(F.col("title"), F.col("p_name")).alias("class_name"))
    return named.select("p_partkey", "package", "class_name", X.generated_path(F.col("file"), F.col("package"), F.col("class_name")).alias("path"))


ANSWERS = [
    ('{"status": "completed", "changed_files": ["a"], "verification": [{"command": "c", "status": "s"}], "blockers": []}', None),
    ("not json", "agent response must be valid JSON"),
    ("[1]", "agent response must be a JSON object"),
    ('{"status": "completed"}', "agent response fields do not match schema"),
    ('{"status": "done", "changed_files": [], "verification": [], "blockers": []}', "agent response status must be completed or blocked"),
    ('{"status": "completed", "changed_files": [1], "verification": [], "blockers": []}', "agent response changed_files must be string array"),
    ('{"status": "completed", "changed_files": [], "verification": [], "blockers": "x"}', "agent response blockers must be string array"),
    ('{"status": "completed", "changed_files": [], "verification": [{"command": "c"}], "blockers": []}', "agent response verification item must match schema"),
    ('{"status": "blocked", "changed_files": [], "verification": [], "blockers": []}', "blocked agent response must include blocker"),
    ("``` {} ```", "agent response must be JSON only"),
]


@query("SELECT page_id, " + picked("page_id", [e for _, e in ANSWERS]) + " AS error FROM pages")
def answer_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", X.answer_error(F.expr(picked("page_id", [t for t, _ in ANSWERS]))).alias("error"))


CUT = [('{"a": [1, {"b": "x', '{"a": [1, {"b": "x"}]}'), ('text {"a": 1} more', '{"a": 1}'), ('{"a": [1}', None), ("none", None), ('{"k": {k}', '{"k": {k}}'), ('{"a": "]}", "b": [', '{"a": "]}", "b": []}')]


@query("SELECT event_id, " + picked("event_id", [e for _, e in CUT]) + " AS json FROM events")
def recovered_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", formats.recovered_json(F.expr(picked("event_id", [t for t, _ in CUT]))).alias("json"))


@query("SELECT o_orderkey, CAST(CAST(epoch(o_orderdate) AS bigint) AS varchar) AS seconds, coalesce(nullif(o_orderstatus, 'F'), 'direct_method_scaffold') AS kind FROM orders")
def epoch_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.nullif("o_orderstatus", F.lit("F"))
    return read(spark, sf_dir, "orders").select("o_orderkey", X.epoch_text(F.col("o_orderdate").cast("timestamp")).alias("seconds"), X.invocation_kind(kind).alias("kind"))


NEEDS = picked("p_partkey", ["org.springframework.boot:spring-boot-starter-web", "hibernate-core, junit", "jakarta.persistence-api", None, "spring-security-core", "jakarta.ws.rs-api mockito"])
KINDS = picked("p_partkey", ["models", "entities", "request_bodies", "dtos"])


@query(
    "SELECT p_partkey, array_to_string(list_filter(['version-rewrite-modernization', 'java-best-practices', 'java-lombok-modernization', CASE WHEN contains(t, 'spring-boot') THEN 'spring-boot-best-practices' END, "
    "CASE WHEN contains(t, 'starter-web') OR contains(t, 'spring-web') OR k = 'request_bodies' THEN 'spring-mvc-best-practices' END, CASE WHEN contains(t, 'spring-security') THEN 'spring-security-best-practices' END, "
    "CASE WHEN contains(t, 'hibernate') OR contains(t, 'jakarta.persistence') OR k = 'entities' THEN 'database-orm-best-practices' END, CASE WHEN contains(t, 'junit') OR contains(t, 'mockito') THEN 'junit-mockito-testing-best-practices' END, "
    f"CASE WHEN contains(t, 'jakarta') AND NOT contains(t, 'spring-boot') THEN 'jakarta-ee-best-practices' END], lambda x: x IS NOT NULL), ',') AS skills FROM (SELECT p_partkey, {NEEDS} AS t, {KINDS} AS k FROM part)"
)
def task_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(classify.task_skills(F.expr(NEEDS), F.expr(KINDS)), ",").alias("skills"))


# --- files ---

PATHS = picked(
    "doc_id",
    [
        "a/src/Main{k}.java", "target/classes/B.class", "a/test/C.java", "x/Generated/D.java", "m/e2e/Flow{k}.java", "m/integration-test/E.java", "pom.xml", "svc/build.gradle", "conf/app.YML", ".env", "b/build/classes/java/main/F.class", "q/OrderIT.java", "z/GTests.java", "build/pom.xml", "w/target/test-classes/H.class",
    ],
)
_DIRS = "list_slice(string_split(lower(path), '/'), 1, -2)"


def _has(names: list[str]) -> str:
    return f"list_has_any({_DIRS}, [{', '.join(f"'{n}'" for n in names)}])"


def _ends(names: list[str]) -> str:
    return "(" + " OR ".join(f"ends_with(path, '{n}')" for n in names) + ")"


_SIGNED = "(" + " OR ".join(f"contains(left(coalesce(text, ''), {files.HEAD}), '{x}')" for x in files.GENERATED_SIGNS) + ")"
TREE = f"WITH tree AS (SELECT doc_id, {PATHS} AS path, CASE WHEN doc_id % 4 = 1 THEN '// Generated by hand ' || text ELSE text END AS text FROM documents) "
_KIND = f"CASE WHEN {_has(files.SKIPPED)} THEN 'ignored' WHEN {_has(files.GENERATED_FOLDERS)} THEN 'generated_path' WHEN {_has(files.TEST_FOLDERS)} OR {_ends(files.TEST_NAMES)} THEN 'test' WHEN {_SIGNED} THEN 'generated_text' ELSE 'production' END"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("// Generated by hand "), "text")).otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.expr(PATHS).alias("path"), text.alias("text"))


@query(TREE + f"SELECT doc_id, {_KIND} AS kind FROM tree")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.classified(tree(spark, sf_dir)).select("doc_id", "kind")


@query(TREE + f", kinds AS (SELECT {_KIND} AS kind FROM tree) SELECT " + ", ".join(f"count_if(kind = '{k}')::bigint AS {k}" for k in ("production", "ignored", "generated_path", "generated_text", "test")) + " FROM kinds")
def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.scan_counters(tree(spark, sf_dir))


@query(TREE + f"SELECT doc_id FROM tree WHERE ({_has(files.INTEGRATION_FOLDERS + files.END_TO_END_FOLDERS)} OR {_ends(files.INTEGRATION_NAMES + files.END_TO_END_NAMES)}) AND NOT {_has(files.SKIPPED + files.GENERATED_FOLDERS)} AND NOT {_SIGNED}")
def integration_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.integration_tests(tree(spark, sf_dir)).select("doc_id")


@query(TREE + f"SELECT doc_id FROM tree WHERE list_contains([{', '.join(f"'{b}'" for b in files.BUILD_FILES)}], list_last(string_split(path, '/'))) AND NOT {_has(files.SKIPPED)}")
def build_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.build_files(tree(spark, sf_dir)).select("doc_id")


@query(TREE + f"SELECT doc_id, CASE WHEN path = '.env' THEN 'env' WHEN ends_with(lower(path), '.yml') THEN 'yaml' WHEN ends_with(path, '.xml') THEN 'xml' END AS format FROM tree WHERE format IS NOT NULL AND NOT {_has(files.SKIPPED)}")
def config_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.config_files(tree(spark, sf_dir)).select("doc_id", "format")


@query(TREE + "SELECT DISTINCT regexp_extract(path, '^(target/classes|.*/target/test-classes|.*/build/classes/java/main)/', 1) AS path FROM tree WHERE ends_with(path, '.class')")
def compiled_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.compiled_folders(tree(spark, sf_dir))


@query(
    "WITH lines AS (SELECT page_id, trim(line) AS line, pos FROM (SELECT page_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, string_split_regex(html, '\\r?\\n') AS l FROM pages WHERE html IS NOT NULL))), "
    "parted AS (SELECT page_id, pos, line, CASE WHEN instr(line, '=') > 0 THEN instr(line, '=') ELSE instr(line, ':') END AS place FROM lines WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '!')), "
    "entries AS (SELECT page_id, pos, trim(left(line, place - 1)) AS key, trim(substr(line, place + 1)) AS value FROM parted WHERE place > 1) SELECT page_id, key, arg_min(value, pos) AS value FROM entries GROUP BY page_id, key"
)
def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").where("html is not null").select(F.col("page_id").alias("path"), F.col("html").alias("text"))
    return formats.key_values(pages).withColumnRenamed("path", "page_id")


@query("SELECT page_id, nullif(regexp_extract(regexp_replace(html, '(?s)<!--.*?-->|<\\?.*?\\?>|<![^>]*>', '', 'g'), '<(?:[A-Za-z0-9_.-]+:)?([A-Za-z0-9_.-]+)', 1), '') AS root FROM pages")
def xml_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", formats.xml_root(F.col("html")).alias("root"))


BUILDS = picked("p_partkey", ["pom.xml", "svc/build.gradle", "gradle/libs.versions.toml", "a/b/pom.xml", "x/gradle/wrapper/w.properties", None])


@query(
    "SELECT p_partkey, m AS module_path, CASE WHEN m = '.' THEN 'parent' ELSE list_last(string_split(m, '/')) END AS module_name FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN 'svc' WHEN 3 THEN 'a/b' WHEN 4 THEN 'x' ELSE '.' END AS m FROM part)"
)
def build_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogues.regrouped(read(spark, sf_dir, "part").select("p_partkey", F.expr(BUILDS).alias("file"))).drop("file")


# --- rules ---

UPGRADES = [
    rules.Rule("web", {"p_name": "*widget"}, {"minimum_21": "12.0", "recommended_21": "30"}),
    rules.Rule("hand", {"p_type": "PROMO"}, {"minimum_21": "manual", "recommended_21": "9"}),
    rules.Rule("none", {"p_type": "SMALL"}, {"minimum_17": "1"}),
    rules.Rule("open", {"p_name": "*"}, {"recommended_21": "5"}),
]


@query(
    "SELECT p_partkey, rule_id, minimum, recommended FROM (SELECT p_partkey, p_size, CASE WHEN p_name LIKE '%widget' THEN 'web' WHEN p_type = 'PROMO' THEN 'hand' WHEN p_type = 'SMALL' THEN 'none' ELSE 'open' END AS rule_id FROM part), "
    "(VALUES ('web', '12.0', '30'), ('hand', 'manual', '9'), ('open', NULL, '5')) r(id, minimum, recommended) WHERE id = rule_id AND (rule_id <> 'web' OR p_size < 12 OR p_partkey % 5 = 0)"
)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit(".1")))
    return rules.recommendations(read(spark, sf_dir, "part").withColumn("version", version), UPGRADES, 21).select("p_partkey", "rule_id", "minimum", "recommended")


MANY = [rules.Rule(f"r{i}", {"p_name": "*r" if i % 3 == 0 else "cold*" if i % 3 == 1 else "*", "p_brand": f"Brand#{i % 60}"}) for i in range(300)]
_MANY_SQL = "(SELECT 'r' || i AS rule_id, i, i % 3 AS kind, 'Brand#' || i % 60 AS brand FROM range(300) t(i))"
_MANY_HIT = f"FROM part JOIN {_MANY_SQL} ON p_brand = brand AND (kind = 2 OR kind = 0 AND p_name LIKE '%r' OR kind = 1 AND p_name LIKE 'cold%')"


@query(f"SELECT p_partkey, arg_min(rule_id, i) AS rule_id {_MANY_HIT} GROUP BY p_partkey")
def first_of_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.first_match(read(spark, sf_dir, "part"), MANY).where("rule_id is not null").select("p_partkey", "rule_id")


@query(f"SELECT p_partkey, rule_id {_MANY_HIT}")
def all_of_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.all_matches(read(spark, sf_dir, "part"), MANY).select("p_partkey", "rule_id")


SYMBOLS = picked("o_orderkey", ["java.util.Date", "java.util.Date.parse", "java.util.Dates", "sun.misc.Unsafe", "sun.misc.ok.X", "javax.xml.bind.JAXB", "org.Foo.finalize()"])
APIS = [
    rules.ApiRule("date", "warning", symbols=("java.util.Date",)),
    rules.ApiRule("internal", "error", prefixes=("sun.",), excluded_prefixes=("sun.misc.ok",)),
    rules.ApiRule("late", "error", prefixes=("javax.",), applies_from=25),
    rules.ApiRule("pattern", "info", patterns=("Foo*()", "Date.")),
]


@query(
    "SELECT o_orderkey, rule_id, severity, term FROM (SELECT o_orderkey, o_orderkey % 7 AS k FROM orders) JOIN (VALUES (0, 'date', 'warning', 'java.util.Date'), (1, 'date', 'warning', 'java.util.Date'), (1, 'pattern', 'info', 'Date.'), (3, 'internal', 'error', 'sun.'), (6, 'pattern', 'info', 'Foo*()')) v(n, rule_id, severity, term) ON n = k"
)
def api_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.array(F.expr(SYMBOLS)).alias("symbols"))
    return rules.api_findings(rows, APIS, 21).select("o_orderkey", "rule_id", "severity", F.explode("terms").alias("term"))


CONFIGS = [
    rules.ConfigRule("boot", "SPRING", "spring-boot", ("application", "web"), names=("application.yml",), prefixes=("spring", "server.")),
    rules.ConfigRule("orm", "ORM", None, ("database",), xml_roots=("persistence",), namespaces=("http://orm",), path_patterns=("META-INF/", "(bad")),
    rules.ConfigRule("log", "LOGGING", "logback", ("logging",), file_patterns=("^logback.*[.]xml$",)),
]
_CONFIG = [
    ("META-INF/application.yml", None, "SPRING|spring-boot|application,database,web|boot,orm|boot,filename,orm,path_pattern"),
    ("a/logback-x.xml", "configuration", "LOGGING|logback|logging|log|filename_pattern,log"),
    ("a/persistence.xml", "persistence", "ORM||database|orm|orm,xml_root"),
    ("a/x.properties", None, "SPRING|spring-boot|application,web|boot|boot,property_prefix"),
    ("a/plain.txt", None, None),
]


@query(f"SELECT s_suppkey, found FROM (SELECT s_suppkey, {picked('s_suppkey', [f for *_, f in _CONFIG])} AS found FROM supplier) WHERE found IS NOT NULL")
def config_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr(picked("s_suppkey", [p for p, *_ in _CONFIG]))
    keys = F.when(F.col("s_suppkey") % 5 == 3, F.array(F.lit("server.port"), F.lit("springy"))).otherwise(F.array(F.lit("springs.x")))
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", path.alias("path"), files.file_name(path).alias("file_name"), F.lit("").alias("contents"), F.expr(picked("s_suppkey", [r for _, r, _ in _CONFIG])).alias("xml_root"), keys.alias("keys"))
    found = rules.config_files(rows, CONFIGS)
    lists = [F.array_join(c, ",") for c in ("categories", "rule_ids", "evidence")]
    return found.select("s_suppkey", F.concat_ws("|", "type", F.coalesce("framework", F.lit("")), *lists).alias("found"))


@query("SELECT p_partkey, CAST(coalesce(v, p_size) AS varchar) AS version FROM part LEFT JOIN (SELECT l_partkey, arg_min(l_suppkey, row(l_orderkey, l_linenumber, l_suppkey)) AS v FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey")
def updated_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").cast("string").alias("version"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("ordinal"))
    return rules.updated_versions(read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("version")), resolved, ["p_partkey"]).select("p_partkey", "version")


# --- classification: suppliers stand in for classes; their keys decide what each is ---

_SYMBOL = "named_struct('raw', {raw}, 'simple', '{simple}', 'values', array({values}), 'line', 5L)"


def _symbol(simple: str, values: str = "", raw: str | None = None) -> str:
    return _SYMBOL.format(raw=f"'@{simple}'" if raw is None else raw, simple=simple, values=values or f"'{simple}'")


_ENTITY = _symbol("Entity", "'jakarta.persistence.Entity', 'Entity'")
_TABLE = _symbol("Table", "'jakarta.persistence.Table'", "concat('@Table(name = \"tab_', k, '\")')")
_NONE = "CAST(array() AS " + classify.SYMBOLS + ")"
REGISTRY = {"jakarta_persistence": classify.Group(symbol_prefixes=("jakarta.persistence.",)), "spring_mvc": classify.Group(symbols=("org.springframework.web.RequestBody",))}
CLASSES = {
    "module_id": "CASE WHEN k % 2 = 0 THEN 'module:svc' ELSE 'module:.' END", "name": "concat('S', k, CASE WHEN k % 5 = 0 THEN 'Repository' ELSE '' END)", "qualified_name": "concat('org.S', k)", "kind": "'class'", "file": "concat('f', k % 3)", "start_line": "k", "end_line": "k + 9",
    "annotations": f"flatten(array(CASE WHEN k % 3 = 0 THEN array({_ENTITY}) ELSE {_NONE} END, CASE WHEN k % 6 = 0 THEN array({_TABLE}) ELSE {_NONE} END, CASE WHEN k % 4 = 0 THEN array({_symbol('RestController')}) ELSE {_NONE} END))",
    "superclass": "CAST(NULL AS string)", "interfaces": "CASE WHEN k % 5 = 0 THEN array(concat('JpaRepository<S', k, ', Long>')) ELSE CAST(array() AS array<string>) END",
    "fields": f"array(named_struct('name', 'id', 'type_name', 'long', 'line', k, 'annotations', array({_symbol('Id', chr(39) + 'jakarta.persistence.Id' + chr(39))})), named_struct('name', 'val', 'type_name', 'String', 'line', k, 'annotations', CASE WHEN k % 2 = 0 THEN array({_symbol('Column', chr(39) + 'x' + chr(39), 'concat(' + chr(39) + '@Column(' + chr(34) + 'c_' + chr(39) + ', k, ' + chr(39) + chr(34) + ')' + chr(39) + ')')}) ELSE {_NONE} END))",
    "methods": f"array(named_struct('name', concat('find', k % 3), 'return_type', concat('ResponseEntity<S', k + 1, '>'), 'line', k, 'annotations', array({_symbol('GetMapping')}), 'parameters', array("
    f"named_struct('type_name', concat('R', k % 7), 'line', k, 'annotations', array({_symbol('RequestBody', chr(39) + 'org.springframework.web.RequestBody' + chr(39))})), named_struct('type_name', 'HttpServletRequest', 'line', k, 'annotations', {_NONE}), named_struct('type_name', 'Plain', 'line', k, 'annotations', {_NONE}))), "
    f"named_struct('name', 'other', 'return_type', 'void', 'line', k, 'annotations', {_NONE}, 'parameters', CAST(array() AS array<struct<type_name:string,line:bigint,annotations:{classify.SYMBOLS}>>)))",
}
K = "WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'module:svc' ELSE 'module:.' END AS module_id FROM supplier) "


def signed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k").selectExpr(*(f"{e} AS {c}" for c, e in CLASSES.items()))
    dependencies = spark.createDataFrame(
        [("module:.", 0, "org.springframework.data", "spring-data-jpa", "3"), ("module:.", 1, "jakarta.persistence", "jakarta.persistence-api", "3.1"), ("module:svc", 0, "jakarta.persistence", "jakarta.persistence-api", "2"), ("module:svc", 1, "x", "spring-boot-starter-web", None)],
        "module_id string, ordinal int, group_id string, artifact_id string, version string",
    )
    return classify.signed(classes, dependencies, REGISTRY)


@query(K + "SELECT 'org.S' || k AS qualified_name, module_id, CASE WHEN k % 6 = 0 THEN 'tab_' || k END AS table_name, CASE WHEN k % 6 = 0 THEN 2 ELSE 1 END AS n_evidence, CASE WHEN k % 2 = 0 THEN '2' ELSE '3.1' END AS version FROM s WHERE k % 3 = 0")
def class_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify.entities(signed_classes(spark, sf_dir))
    return found.select("qualified_name", "module_id", "table_name", F.size("evidence").alias("n_evidence"), F.col("evidence")[0]["dependency"]["version"].alias("version"))


@query(K + "SELECT 'org.S' || k AS entity, CASE WHEN k % 6 = 0 THEN 'tab_' || k WHEN k % 5 = 0 THEN 'S' || k || 'Repository' ELSE 'S' || k END AS name, CASE WHEN k % 6 = 0 THEN 'annotation' ELSE 'class_name' END AS source FROM s WHERE k % 3 = 0")
def class_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.tables(signed_classes(spark, sf_dir)).select("entity", "name", "source")


@query(K + "SELECT 'org.S' || k AS entity, 'id' AS field_name, 'id' AS column_name, 1 AS n_evidence FROM s WHERE k % 3 = 0 UNION ALL SELECT 'org.S' || k, 'val', 'c_' || k, 0 FROM s WHERE k % 6 = 0")
def class_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.columns(signed_classes(spark, sf_dir), REGISTRY).select("entity", "field_name", "column_name", F.size("evidence").alias("n_evidence"))


@query(K + "SELECT 'org.S' || k AS qualified_name, 'S' || k AS entity_type, 'find' || k % 3 AS query_methods, 'JpaRepository<S' || k || ', Long>' AS symbol, 'spring-data-jpa' AS artifact_id FROM s WHERE k % 5 = 0")
def class_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("evidence")[0]
    return classify.repositories(signed_classes(spark, sf_dir)).select("qualified_name", "entity_type", F.array_join("query_methods", ",").alias("query_methods"), e["symbol"].alias("symbol"), e["dependency"]["artifact_id"].alias("artifact_id"))


_BODIES = (
    K + ", b AS (SELECT k, module_id, 'request_body' AS body, 'R' || k % 7 AS type_name, 0 AS step, 1 AS marked FROM s UNION ALL SELECT k, module_id, 'request_body', 'Plain', 1, 0 FROM s WHERE k % 4 = 0 UNION ALL SELECT k, module_id, 'response_body', 'S' || (k + 1), 2, 0 FROM s WHERE k % 4 = 0) "
)


@query(_BODIES + "SELECT body, 'org.S' || k AS owner, 'find' || k % 3 AS method, type_name, marked AS n_evidence FROM b")
def class_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.body_rows(signed_classes(spark, sf_dir), REGISTRY).select("body", "owner", "method", "type_name", F.size("evidence").alias("n_evidence"))


_DTOS = (
    _BODIES + ", known AS (SELECT CASE WHEN k % 5 = 0 THEN 'S' || k || 'Repository' ELSE 'S' || k END AS name, 'org.S' || k AS qualified_name, module_id FROM s), d AS (SELECT coalesce(n.qualified_name, type_name) AS qualified_name, coalesce(n.module_id, b.module_id) AS module_id, body, k, step "
    "FROM b LEFT JOIN known n ON n.name = type_name), dtos AS (SELECT module_id, qualified_name, arg_min(body, row(k % 3, k, step)) AS classification, min(row(k % 3, k, step)) AS seq FROM d GROUP BY ALL) "
)


@query(_DTOS + "SELECT module_id, qualified_name, classification FROM dtos")
def class_transfer_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.transfer_objects(signed_classes(spark, sf_dir), REGISTRY).select("module_id", "qualified_name", "classification")


_MODELS = _DTOS + ", models AS (SELECT qualified_name, arg_min(classification, seq) AS classification FROM (SELECT qualified_name, classification, seq FROM dtos UNION ALL SELECT 'org.S' || k, CASE WHEN k % 3 = 0 THEN 'entity' ELSE 'repository' END, row(k % 3, k, 9) FROM s WHERE k % 3 = 0 OR k % 5 = 0) GROUP BY qualified_name) "


@query(_MODELS + "SELECT * FROM models")
def class_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.models(signed_classes(spark, sf_dir), REGISTRY).select("qualified_name", "classification")


def _tables_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    found = signed_classes(spark, sf_dir)
    body = classify.body_rows(found, REGISTRY)
    return {"models": classify.models(found, REGISTRY), "repositories": classify.repositories(found), "entities": classify.entities(found), "request_bodies": body.where("body = 'request_body'")}


@query("SELECT * FROM (VALUES ('module:.', 'jakarta.persistence', 'jakarta.persistence-api', '3.1'), ('module:svc', 'jakarta.persistence', 'jakarta.persistence-api', '2'), ('module:.', 'org.springframework.data', 'spring-data-jpa', '3'), ('module:svc', 'org.springframework.data', 'spring-data-jpa', '3'), ('module:svc', 'x', 'spring-boot-starter-web', NULL)) v(module_id, group_id, artifact_id, version)")
def used_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.used_dependencies(_tables_of(spark, sf_dir))


@query(_MODELS + "SELECT 2::bigint AS modules, (SELECT count(*) FROM models)::bigint AS models, (SELECT count(*) FROM s WHERE k % 5 = 0)::bigint AS repositories, (SELECT count(*) FROM s WHERE k % 3 = 0)::bigint AS entities, (SELECT count(*) FROM b WHERE body = 'request_body')::bigint AS request_bodies")
def classification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.summary(spark.range(2), _tables_of(spark, sf_dir))


@query(
    K + "SELECT module_id || ':entities:org.S' || k || ':f' || k % 3 || ':' || k AS task_id, 'entities' AS row_type, 'org.S' || k AS name, substr(module_id, 8) AS module_path, 'f' || k % 3 AS source_file, k AS start_line FROM s WHERE k % 3 = 0 "
    "UNION ALL SELECT module_id || ':request_bodies:R' || k % 7 || ':f' || k % 3 || ':' || k, 'request_bodies', 'R' || k % 7, substr(module_id, 8), 'f' || k % 3, k FROM s UNION ALL SELECT module_id || ':request_bodies:Plain:f' || k % 3 || ':' || k, 'request_bodies', 'Plain', substr(module_id, 8), 'f' || k % 3, k FROM s WHERE k % 4 = 0"
)
def migration_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tables_of(spark, sf_dir)
    modules = spark.createDataFrame([("module:.", "."), ("module:svc", "svc")], "id string, path string")
    return classify.tasks(modules, {n: rows[n] for n in ("entities", "request_bodies")})


@query(
    "WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages WHERE url IS NOT NULL), m AS (SELECT path FROM p UNION SELECT split_part(path, '/', 1) FROM p UNION SELECT '.') "
    "SELECT 'module:' || a.path AS id, CASE WHEN a.path <> '.' THEN coalesce('module:' || arg_max(b.path, length(b.path)), 'module:.') END AS parent_id, CASE WHEN a.path = '.' THEN 0 ELSE CAST(count(b.path) + 1 AS int) END AS depth FROM m a LEFT JOIN m b ON b.path <> '.' AND starts_with(a.path, b.path || '/') AND a.path <> b.path WHERE a.path <> '' GROUP BY a.path"
)
def module_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    paths = read(spark, sf_dir, "pages").where("url is not null").select(path.alias("path"))
    every = paths.unionByName(paths.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("path"))).unionByName(spark.range(1).select(F.lit(".").alias("path"))).where("path <> ''").distinct()
    return classify.module_tree(every.select(F.concat(F.lit("module:"), "path").alias("id"), "path")).select("id", "parent_id", "depth")


# --- builds ---

CONFIGURATIONS = picked("p_partkey", ["api", "testRuntime", "custom{k}", "classpath", None, "runtimeOnly", "testCompile"])
_SCOPE = "CASE p_partkey % 6 WHEN 1 THEN 'svc' WHEN 3 THEN 'a/b' WHEN 4 THEN 'x' ELSE '.' END"


@query(f"SELECT DISTINCT {_SCOPE} AS module_path FROM part WHERE p_partkey % 6 <> 5")
def build_scope_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builds.scopes(read(spark, sf_dir, "part").select(F.expr(BUILDS).alias("file")))


@query("SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN '.' ELSE 'a/b' END AS module_path FROM part WHERE p_partkey % 6 IN (0, 3)")
def maven_scope_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builds.scopes(read(spark, sf_dir, "part").select(F.expr(BUILDS).alias("file")), "pom.xml")


@query(
    f"WITH d AS (SELECT p_partkey, {_SCOPE} AS module_path, p_partkey % 7 AS k FROM part), e AS (SELECT module_path, p_partkey, pos, class_path FROM d JOIN (VALUES (0, 0, 'compileClasspath'), (0, 1, 'runtimeClasspath'), (1, 0, 'testRuntimeClasspath'), (5, 0, 'runtimeClasspath'), (6, 0, 'testCompileClasspath'), (6, 1, 'testRuntimeClasspath')) v(n, pos, class_path) ON n = k "
    "UNION ALL SELECT module_path, p_partkey, 0, 'custom' || p_partkey FROM d WHERE k = 2), f AS (SELECT module_path, class_path, min(row(p_partkey, pos)) AS place FROM e GROUP BY ALL) SELECT module_path, class_path, CAST(row_number() OVER (PARTITION BY module_path ORDER BY place) - 1 AS int) AS ordinal, CASE WHEN module_path = '.' THEN 'dependencies' ELSE ':' || replace(module_path, '/', ':') || ':dependencies' END AS task FROM f"
)
def scope_class_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.expr(BUILDS).alias("file"), F.expr(CONFIGURATIONS).alias("configuration"))
    return builds.scope_class_paths(rows).withColumn("task", builds.scoped_task(F.col("module_path"), "dependencies"))


@query(
    f"WITH d AS (SELECT p_partkey, {_SCOPE} AS module_path, CASE WHEN p_partkey % 4 > 0 THEN 'g' || p_partkey % 4 END AS group_id, 'a' || p_size AS artifact_id, p_brand AS version FROM part), "
    "r AS (SELECT CASE l_orderkey % 3 WHEN 0 THEN '.' WHEN 1 THEN 'svc' ELSE 'x' END AS module_path, CASE WHEN l_partkey % 4 > 0 THEN 'g' || l_partkey % 4 END AS group_id, 'a' || l_linenumber AS artifact_id, CASE WHEN l_suppkey % 5 > 0 THEN 'v' || l_suppkey END AS version, row(l_orderkey, l_partkey, l_suppkey, l_extendedprice) AS ordinal FROM lineitem), "
    "f AS (SELECT module_path, group_id, artifact_id, arg_min(row(version), ordinal) AS found FROM r GROUP BY ALL) SELECT p_partkey, coalesce(found[1], version) AS version FROM d LEFT JOIN f ON f.module_path = d.module_path AND f.group_id IS NOT DISTINCT FROM d.group_id AND f.artifact_id = d.artifact_id"
)
def effective_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = lambda k: F.expr(f"CASE WHEN {k} % 4 > 0 THEN concat('g', {k} % 4) END").alias("group_id")
    declared = read(spark, sf_dir, "part").select("p_partkey", F.expr(BUILDS).alias("file"), group("p_partkey"), F.expr("concat('a', p_size)").alias("artifact_id"), F.col("p_brand").alias("version"))
    resolved = read(spark, sf_dir, "lineitem").select(
        F.expr("CASE l_orderkey % 3 WHEN 0 THEN '.' WHEN 1 THEN 'svc' ELSE 'x' END").alias("module_path"), group("l_partkey"), F.expr("concat('a', l_linenumber)").alias("artifact_id"),
        F.expr("CASE WHEN l_suppkey % 5 > 0 THEN concat('v', l_suppkey) END").alias("version"), F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice").alias("ordinal"),
    )
    return builds.effective_versions(declared, resolved).select("p_partkey", "version")


@query(
    f"WITH v AS (SELECT {_SCOPE} AS module_path, p_partkey AS ordinal, CASE WHEN p_size % 3 = 0 THEN 'source' ELSE 'toolchain' END AS kind, CAST(p_size AS varchar) AS version FROM part WHERE p_partkey % 6 <> 4) "
    "SELECT m.module_path, coalesce(arg_min(version, row(kind <> 'source', ordinal)), (SELECT arg_min(version, row(kind <> 'source', ordinal)) FROM v)) AS source_java FROM (VALUES ('.'), ('svc'), ('a/b'), ('x')) m(module_path) LEFT JOIN v ON v.module_path = m.module_path GROUP BY m.module_path"
)
def source_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = read(spark, sf_dir, "part").where("p_partkey % 6 <> 4").select(F.expr(BUILDS).alias("file"), F.col("p_partkey").alias("ordinal"), F.expr("CASE WHEN p_size % 3 = 0 THEN 'source' ELSE 'toolchain' END").alias("kind"), F.col("p_size").cast("string").alias("version"))
    modules = spark.createDataFrame([(".",), ("svc",), ("a/b",), ("x",)], "module_path string")
    return builds.source_java(versions, modules)


@query(
    "WITH u AS (SELECT DISTINCT s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 'g' ELSE '' END || ':a' || s_suppkey % 3 AS key FROM supplier) "
    "SELECT n_nationkey AS id, n_name AS name, 'p' || n_nationkey AS path, coalesce(string_agg(key, ',' ORDER BY key), '') AS used FROM nation LEFT JOIN u ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name"
)
def module_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("module_id"), F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 'g' END").alias("group_id"), F.expr("concat('a', s_suppkey % 3)").alias("artifact_id"))
    modules = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.expr("concat('p', n_nationkey)").alias("path"))
    return builds.module_summaries(modules, used).withColumn("used", F.array_join("used_dependencies", ",")).drop("used_dependencies")


@query("SELECT o_orderkey AS task_id, 'p' || o_custkey % 30 AS module_path, 'f' || o_orderkey % 40 AS source_file, n_name AS module_name, '/src/f' || o_orderkey % 40 AS source_path, '/new/f' || o_orderkey % 40 AS expected_path FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 30 WHERE o_orderkey % 40 NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 8)")
def pending_task_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS task_id", "concat('p', o_custkey % 30) AS module_path", "concat('f', o_orderkey % 40) AS source_file")
    done = read(spark, sf_dir, "supplier").where("s_suppkey < 8").select(F.expr("concat('f', s_suppkey)").alias("path"))
    summaries = read(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "n_name AS name", "concat('p', n_nationkey) AS path", "array('x') AS used_dependencies")
    found = builds.task_contexts(builds.pending_tasks(tasks, done), summaries, "/src", "/new/")
    return found.select("task_id", "module_path", "source_file", F.col("module.name").alias("module_name"), "source_path", "expected_path")


DECLARED = picked("s_suppkey", ["List<Order>", "Map<String, List<T>>", "int", "Order{k}", "java.util.Map<A, B>"])


@query(
    "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'List|List<Order>|Order' WHEN 1 THEN 'List|List<T>|Map|Map<String, List<T>>|String|T' WHEN 2 THEN 'int' WHEN 3 THEN 'Order' || s_suppkey ELSE 'A|B|java.util.Map|java.util.Map<A, B>' END AS types FROM supplier"
)
def type_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(builds.type_texts(F.expr(DECLARED)), "|").alias("types"))
