"""Java declarations, calls and entry points of source files, as DataFrames.

`nodes` reads every file once, within a task (`java_syntax`), and gives a row for each declaration and call; the tables here select from
it, with types by their bare names and a declaration's own annotations. `java_model` gives the tables with whole types and all
annotations inside. Members of anonymous classes count for the class around them. Files with null or empty text give no rows; a file
that is no Java gives a diagnostic and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import resolve, rules
from tessera.sources import files as source_files
from tessera.sources import java_syntax

# Annotations that make a method an entry point, with kind, framework and HTTP method; fixtures; assertions.
ENTRY_POINTS = [
    ("GetMapping", "Http", "Spring MVC", "GET"),
    ("PostMapping", "Http", "Spring MVC", "POST"),
    ("PutMapping", "Http", "Spring MVC", "PUT"),
    ("PatchMapping", "Http", "Spring MVC", "PATCH"),
    ("DeleteMapping", "Http", "Spring MVC", "DELETE"),
    ("RequestMapping", "Http", "Spring MVC", "REQUEST"),
    ("Scheduled", "Scheduled", "Spring Scheduler", None),
    ("KafkaListener", "Message", "Kafka", None),
    ("JmsListener", "Message", "JMS", None),
]
TESTS = ["Test", "ParameterizedTest", "RepeatedTest", "TestFactory", "TestTemplate"]
TEST_NAMES = ["test", "should"]
FIXTURES = {
    "setup": ["BeforeEach", "BeforeAll", "Before", "BeforeClass"],
    "teardown": ["AfterEach", "AfterAll", "After", "AfterClass"],
    "framework": ["SpringBootTest", "WebMvcTest", "DataJpaTest", "ContextConfiguration"],
    "container": ["Testcontainers", "Container"],
    "mock": ["MockBean", "Mock", "SpyBean"],
    "configuration": ["ActiveProfiles", "TestPropertySource"],
}
ASSERTIONS = {
    "equality": ["assertEquals", "isEqualTo", "isSameAs"],
    "truthy": ["assertTrue", "isTrue", "exists"],
    "falsey": ["assertFalse", "isFalse", "doesNotExist"],
    "exception": ["assertThrows", "isThrownBy", "expectThrows"],
    "assertion": ["assertThat", "then"],
    "status_or_response": ["andExpect", "expectStatus", "status"],
    "verification": ["verify", "thenVerify"],
}
CALL_FIXTURES = {"mock": ["mock", "spy", "when", "given"], "container": ["withInitScript", "withExposedPorts", "start"], "database": ["execute", "executeSql", "runScript"]}
HTTP_CALLS = {"GET": ["get", "getForEntity", "getForObject"], "POST": ["post", "postForEntity", "postForObject"], "PUT": ["put"], "PATCH": ["patch", "patchForObject"], "DELETE": ["delete"]}
MESSAGE_CALLS = ["send", "sendMessage", "receive", "receiveAndConvert"]
INTEGRATION_MARKS = ["SpringBootTest", "Testcontainers"]
CALLERS = "array<struct<owner:string,name:string,line:bigint,parameters:array<struct<type:string,bare:string,spread:boolean>>,annotations:array<string>>>"
NODES = (
    f"path string, node int, package string, kind string, parent int, class_line bigint, class_annotations array<string>, top int, loose boolean, callers {CALLERS}, owner string, name string, type string, bare string, extends string, "
    "interfaces array<string>, supers array<string>, annotations array<string>, inside array<string>, "
    "parameters array<struct<name:string,type:string,bare:string,spread:boolean,line:bigint,annotations:array<string>>>, "
    "line bigint, column bigint, end_line bigint, name_line bigint, name_column bigint, body string, receiver string, expression string, literal string"
)
_PARAMETER = pa.struct([("name", pa.string()), ("type", pa.string()), ("bare", pa.string()), ("spread", pa.bool_()), ("line", pa.int64()), ("annotations", pa.list_(pa.string()))])
_CALLER = pa.struct([("owner", pa.string()), ("name", pa.string()), ("line", pa.int64()), ("parameters", pa.list_(pa.struct([("type", pa.string()), ("bare", pa.string()), ("spread", pa.bool_())]))), ("annotations", pa.list_(pa.string()))])
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), CALLERS: pa.list_(_CALLER)}
CLASS_KINDS = ["class", "interface", "enum", "record"]
METHOD_KINDS = ["method", "constructor"]


def looked_up(name: Column, kinds: dict[str, list[str]]) -> Column:
    out = F.lit(None).cast("string")
    for kind, names in kinds.items():
        out = F.when(name.isin(names), kind).otherwise(out)
    return out


def nodes(files: DataFrame) -> DataFrame:
    """A row for each package, import, type, field, method, call and local annotation of the files (path, text), numbered within its file.

    A task reads all files of its partition, so a table of many files in few partitions is to be dealt first (`functions.dealing`).
    parent and class_line tell the class around it, top the outermost class; loose is what lies inside a member; inside holds all
    annotations from there to its end. A call's row has the methods around it, from the outermost, as callers, and a method's row the own
    annotations of its class, so that neither is joined with other rows. One row of kind "error" stands for a broken file.
    """
    fields = [f.rsplit(" ", 1) for f in NODES.split(", ") if " " in f]
    schema = pa.schema([(name, _ARROW.get(kind, pa.list_(_PARAMETER))) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            waiting: list[dict] = []
            for path, text in zip(part.column("path").to_pylist(), part.column("text").to_pylist(), strict=True):
                rows = java_syntax.parse(text) if text else []
                package = next((r["name"] for r in rows if r["kind"] == "package"), None)
                for r in rows:
                    r |= {"path": path, "package": package, "inside": sorted(r["inside"]), "annotations": sorted(set(r.get("annotations", [])))}
                for r in rows:
                    r["callers"] = [rows[c] for c in r["callers"]] if r["kind"] == "call" else None
                    r["class_annotations"] = rows[r["parent"]]["annotations"] if r["kind"] in METHOD_KINDS else None
                waiting += rows
                if len(waiting) > 2000:
                    yield pa.RecordBatch.from_pylist(waiting, schema)
                    waiting = []
            if waiting:
                yield pa.RecordBatch.from_pylist(waiting, schema)

    return files.select("path", "text").mapInArrow(run, NODES)


def diagnostics(files: DataFrame) -> DataFrame:
    """path, line and message of each file that is broken."""
    return broken(nodes(files))


def broken(found: DataFrame) -> DataFrame:
    return found.where("kind = 'error'").select("path", "line", F.concat(F.lit("failed to parse Java source "), "path").alias("message"))


def dotted(*parts: str | Column) -> Column:
    return F.concat_ws(".", *parts)


def class_id(name: Column) -> Column:
    return F.concat(F.lit("class:"), "path", F.lit(":"), name)


def classes(files: DataFrame) -> DataFrame:
    """id, path, package_name, name (parents first, parted by dots), qualified_name, kind, extends, interfaces, annotations and lines of each class."""
    return classes_of(nodes(files))


def classes_of(found: DataFrame) -> DataFrame:
    rows = found.where(F.col("kind").isin([*CLASS_KINDS, "annotation"]))
    qualified = dotted("package", "owner", "name")
    return rows.select(
        class_id(qualified).alias("id"), "path", F.col("package").alias("package_name"), dotted("owner", "name").alias("name"), qualified.alias("qualified_name"), "kind",
        F.col("bare").alias("extends"), F.coalesce("supers", F.array().cast("array<string>")).alias("interfaces"), "annotations", F.col("line").alias("start_line"), "end_line",
    )


def methods(files: DataFrame) -> DataFrame:
    """Each method: id, class_id, path and file, name, signature, return_type (null: constructor), parameters (type, name), annotations,
    lines, the name's line (from 1) and column (from 0, in bytes), and body_text with its braces (null without a body)."""
    return methods_of(nodes(files))


def method_id(caller: Column | None = None) -> Column:
    """The id of a row's method, or of a method around it."""
    of = F.col if caller is None else caller.getField
    types = F.array_join(F.transform(of("parameters"), lambda p: F.concat(p["bare"], F.when(p["spread"], "...").otherwise(""))), ",")
    return F.concat(F.lit("method:"), "path", F.lit(":"), of("owner"), F.lit("."), of("name"), F.lit("("), types, F.lit("):"), of("line"))


def methods_of(found: DataFrame, *more: Column) -> DataFrame:
    parameters = F.transform("parameters", lambda p: F.struct(F.concat(p["bare"], F.when(p["spread"], "...").otherwise("")).alias("type"), p["name"].alias("name")))
    rows = found.where(F.col("kind").isin(METHOD_KINDS)).withColumns({"given": parameters, "id": method_id()})
    return rows.select(
        "id", class_id(dotted("package", "owner")).alias("class_id"), "path", "name", F.concat("name", F.lit("("), F.array_join("given.type", ","), F.lit(")")).alias("signature"), F.col("bare").alias("return_type"),
        F.col("given").alias("parameters"), "annotations", F.col("line").alias("start_line"), "end_line", "name_line", "name_column", F.col("path").alias("file"), F.when(F.col("body") != "", F.col("body")).alias("body_text"), *more,
    )


def calls(files: DataFrame) -> DataFrame:
    """Each call: path, line, column, receiver (the name before the dot, else null), name, method_id (the innermost method around it, null
    in an initializer), expression (from the chain's beginning to the closing parenthesis) and literal (the first string in it, else null)."""
    return calls_of(nodes(files))


def calls_of(found: DataFrame) -> DataFrame:
    return found.where("kind = 'call'").select("path", "line", "column", "receiver", "name", method_id(innermost()).alias("method_id"), "expression", "literal")


def innermost() -> Column:
    """The innermost method around a call, null in an initializer."""
    return F.try_element_at("callers", F.lit(-1))


def call_edges(found: DataFrame) -> DataFrame:
    """Edges from methods to the names they call, not yet resolved: source_id, target_id, kind, source, confidence."""
    rows = found.where("method_id is not null").select(F.col("method_id").alias("source_id"), F.concat(F.lit("unresolved:"), F.concat_ws(".", "receiver", "name")).alias("target_id"))
    return rows.select("source_id", "target_id", F.lit("CALLS").alias("kind"), F.lit("tree_sitter").alias("source"), F.lit(0.5).alias("confidence")).distinct()


def production_model(files: DataFrame, modules: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of the production sources of a tree: classes, methods, calls, entry_points, relationships, diagnostics, counters.

    With `modules` (id, path) classes and methods take the module of the longest path that holds their file.
    """
    found = nodes(source_files.production_sources(files)).persist()
    out = {"classes": classes_of(found).withColumn("file", F.col("path")), "methods": methods_of(found), "calls": calls_of(found), "diagnostics": broken(found), "counters": source_files.scan_counters(files)}
    if modules is not None:
        owners = modules.select(F.col("path").alias("prefix"), F.col("id").alias("module_id"))
        for name in ("classes", "methods"):
            out[name] = resolve.longest_prefix_owner(out[name], owners, "path", "prefix", "module_id")
    return {**out, "entry_points": entry_points(out["methods"]), "relationships": call_edges(out["calls"])}


def entry_points(found: DataFrame) -> DataFrame:
    """id, method_id, kind, framework, route, http_method of the entry points among `found` methods: main, mappings, schedules, listeners."""
    main = found.where((F.col("name") == "main") & (F.col("return_type") == "void") & (F.size("parameters") == 1))
    none = F.lit(None).cast("string")
    mains = main.select(F.concat(F.lit("entry:"), "id", F.lit(":main")).alias("id"), F.col("id").alias("method_id"), F.lit("Main").alias("kind"), none.alias("framework"), none.alias("route"), none.alias("http_method"))
    each = found.select("id", F.explode("annotations").alias("annotation")).withColumn("short", T.annotation_name(F.col("annotation")))
    of = F.array(*(F.struct(*(F.lit(v).cast("string").alias(k) for k, v in zip(("short", "kind", "framework", "http_method"), row, strict=True))) for row in ENTRY_POINTS))
    hit = each.withColumn("hit", F.get(F.filter(of, lambda x: x["short"] == F.col("short")), F.lit(0))).where("hit is not null")
    marked = hit.select(F.concat(F.lit("entry:"), "id", F.lit(":"), "short").alias("id"), F.col("id").alias("method_id"), "hit.kind", "hit.framework", T.first_quoted(F.col("annotation")).alias("route"), "hit.http_method")
    return mains.unionByName(marked)


def has_annotation(annotations: str | Column, names: list[str]) -> Column:
    return F.exists(annotations, lambda x: T.annotation_name(x).isin(names))


def test_kind(file: Column, annotations: Column, default: str = "unknown_test") -> Column:
    """What kind of test a suite is, by its path, its file's name or its annotations; else `default`."""
    low = T.ascii_lower(file)
    marked = F.exists(annotations, lambda x: T.annotation_name(x).isin(INTEGRATION_MARKS))
    return (
        F.when(low.contains("e2e"), "e2e")
        .when(low.contains("acceptance"), "acceptance")
        .when(low.contains("integration") | source_files.ends_with_any(file, source_files.INTEGRATION_NAMES) | marked, "integration")
        .otherwise(default)
    )


def suite_name(package: str, name: Column) -> Column:
    """The package and a class's own name, without the classes around it."""
    return F.concat_ws(".", package, F.element_at(F.split(name, r"\."), -1))


def suite_id(name: Column, line: str) -> Column:
    return F.concat(F.lit("test-suite:"), name, F.lit("@"), "path", F.lit(":"), line)


def test_suites(declared: DataFrame) -> DataFrame:
    """A suite for each class: id, class_name, package_name, qualified_name, test_kind, file, lines, annotations."""
    qualified = suite_name("package_name", F.col("name"))
    return declared.select(
        suite_id(qualified, "start_line").alias("id"), F.col("id").alias("class_id"), F.element_at(F.split("name", r"\."), -1).alias("class_name"), "package_name", qualified.alias("qualified_name"),
        test_kind(F.col("path"), F.col("annotations")).alias("test_kind"), F.col("path").alias("file"), "start_line", "end_line", "annotations",
    )


def test_case_id(suite: Column, name: Column, line: Column) -> Column:
    return F.concat(F.lit("test-case:"), suite, F.lit("#"), name, F.lit("@"), "path", F.lit(":"), line)


def is_test_case(annotations: str | Column = "annotations", name: str | Column = "name") -> Column:
    return has_annotation(annotations, TESTS) | F.regexp_like(name, F.lit(f"^(?:{'|'.join(TEST_NAMES)})"))


def is_fixture(annotations: str = "annotations") -> Column:
    return has_annotation(annotations, [n for names in FIXTURES.values() for n in names])


def display_name(annotations: Column) -> Column:
    """The text of the first @DisplayName, else null."""
    return T.first_quoted(F.get(F.filter(annotations, lambda x: T.annotation_name(x) == "DisplayName"), F.lit(0)))


def test_cases(found: DataFrame) -> DataFrame:
    """The methods that a test annotation marks or that are named as tests."""
    return found.where(is_test_case())


def fixtures(declared: DataFrame) -> DataFrame:
    """id, fixture_kind and annotation of each fixture annotation of classes or methods."""
    each = declared.select("id", F.explode("annotations").alias("annotation"))
    return each.select("id", looked_up(T.annotation_name(F.col("annotation")), FIXTURES).alias("fixture_kind"), "annotation").where("fixture_kind is not null")


def assertion_kind(name: Column) -> Column:
    """The kind of a call that asserts: by its name, any other that begins with "assert" being an assertion; else null."""
    return F.coalesce(looked_up(name, ASSERTIONS), F.when(name.startswith("assert"), "assertion"))


def assertions(found: DataFrame) -> DataFrame:
    """The calls that assert something, with assertion_kind."""
    return found.withColumn("assertion_kind", assertion_kind(F.col("name"))).where("assertion_kind is not null")


def call_entry_point(name: Column, expression: Column, literal: Column) -> Column:
    """What a test's call enters the system by (kind, framework, route, http_method, topic), null for a call that does not."""
    low = T.ascii_lower(expression)
    performed = F.lit(None).cast("string")
    for method in reversed(list(HTTP_CALLS)):
        performed = F.when(low.contains(method.lower() + "("), method).otherwise(performed)
    method = F.when(name == "perform", performed).otherwise(looked_up(name, HTTP_CALLS))
    none = F.lit(None).cast("string")
    http = F.struct(F.lit("Http").alias("kind"), F.when(name == "perform", "MockMvc").otherwise("HTTP client").alias("framework"), literal.alias("route"), method.alias("http_method"), none.alias("topic"))
    message = F.struct(F.lit("Message").alias("kind"), none.alias("framework"), none.alias("route"), none.alias("http_method"), literal.alias("topic"))
    return F.when(method.isNotNull(), http).when(name.isin(MESSAGE_CALLS), message)


def test_model(files: DataFrame) -> dict[str, DataFrame]:
    """All tables of test sources: suites, cases, fixtures, invocations, assertions, entry_points, diagnostics.

    A method's row tells its suite and a call's row its test case, so no table is joined with another. Null paths give suites alone.
    """
    read = nodes(files).persist()
    suites = test_suites(classes_of(read))
    suite = suite_name("package", F.col("owner"))
    whole = read.where("path is not null")
    inside = methods_of(whole, suite_id(suite, "class_line").alias("suite_id"), suite.alias("suite_name"), test_kind(F.col("path"), F.col("class_annotations")).alias("test_kind"))
    cases = inside.where(is_test_case()).select(
        test_case_id(F.col("suite_name"), F.col("name"), F.col("start_line")).alias("id"), "suite_id", F.col("id").alias("method_id"), "name",
        display_name(F.col("annotations")).alias("display_name"), "test_kind", "file", "start_line", "end_line", "annotations", F.coalesce("body_text", F.lit("")).alias("body_text"),
    )
    calls_inside = whole.where("kind = 'call'").withColumn("caller", innermost()).where(is_test_case(F.col("caller.annotations"), F.col("caller.name")))
    of_case = calls_inside.select(
        test_case_id(suite_name("package", F.col("caller.owner")), F.col("caller.name"), F.col("caller.line")).alias("test_case_id"), F.col("path").alias("file"), "name", "line", "column", "expression", "literal"
    )
    none = F.lit(None).cast("string")
    marks = suites.select(F.col("id").alias("suite_id"), "file", F.col("start_line").alias("line"), F.explode("annotations").alias("annotation"))
    kind = looked_up(T.annotation_name(F.col("annotation")), FIXTURES)
    of_suites = marks.select("suite_id", none.alias("test_case_id"), kind.alias("fixture_kind"), T.annotation_name(F.col("annotation")).alias("name"), F.to_json(F.array("annotation")).alias("details_json"), "file", "line").where("fixture_kind is not null")
    kinds = F.array_compact(F.transform("annotations", lambda x: looked_up(T.annotation_name(x), FIXTURES)))
    of_methods = inside.where(~is_test_case() & is_fixture()).select(
        "suite_id", none.alias("test_case_id"), F.coalesce(F.get(kinds, F.lit(0)), F.lit("lifecycle")).alias("fixture_kind"), "name", F.to_json("annotations").alias("details_json"), "file", F.col("start_line").alias("line")
    )
    of_calls = of_case.withColumn("fixture_kind", looked_up(F.col("name"), CALL_FIXTURES)).where("fixture_kind is not null").select(none.alias("suite_id"), "test_case_id", "fixture_kind", "name", F.to_json(F.array("expression")).alias("details_json"), "file", "line")
    entries = of_case.withColumn("e", call_entry_point(F.col("name"), F.col("expression"), F.col("literal"))).where("e is not null").select("test_case_id", "e.*", none.alias("command"), F.lit("tree_sitter").alias("source"))
    return {
        "suites": suites,
        "cases": cases,
        "fixtures": of_suites.unionByName(of_methods).unionByName(of_calls),
        "invocations": of_case.select("test_case_id", "file", "name", "line", "column"),
        "assertions": assertions(of_case).select("test_case_id", "assertion_kind", "expression", F.col("literal").alias("expected_value"), "file", "line"),
        "entry_points": entries,
        "diagnostics": broken(read),
    }


def syntax_candidates(files: DataFrame) -> DataFrame:
    """Texts that may name something of another library: path, line, kind, name and values of each import, call and annotation."""
    read = nodes(files).persist()
    found = imports_of(read).select("path", "line", F.lit("import").alias("kind"), F.col("symbol").alias("raw"))
    called = calls_of(read).select("path", "line", F.lit("call").alias("kind"), F.col("expression").alias("raw"))
    none = F.array().cast("array<struct<line:bigint,raw:string>>")
    given = F.coalesce(F.flatten(F.transform("parameters", lambda p: F.transform(p["annotations"], lambda a: F.struct(p["line"].alias("line"), a.alias("raw"))))), none)
    own = F.transform("annotations", lambda a: F.struct(F.col("line").alias("line"), a.alias("raw")))
    local = F.when(F.col("kind") == "mark", F.array(F.struct("line", F.col("name").alias("raw")))).otherwise(none)
    marks = read.select("path", F.lit("annotation").alias("kind"), F.explode(F.concat(own, given, local)).alias("m")).select("path", "m.line", "kind", "m.raw")
    rows = found.unionByName(called).unionByName(marks).withColumn("values", T.expression_values(F.col("raw"))).where(F.size("values") > 0)
    return rows.select("path", "line", "kind", F.col("values")[0].alias("name"), "values").distinct()


def api_scan(files: DataFrame, listed: list[rules.ApiRule], target: int) -> DataFrame:
    """path, line, kind, name, rule_id, severity, terms: what sources name that a rule in force at `target` tells of."""
    candidates = syntax_candidates(files).withColumnRenamed("values", "symbols")
    return rules.api_findings(candidates, listed, target).drop("symbols")


def imports(files: DataFrame) -> DataFrame:
    """path, symbol, static and line of each import."""
    return imports_of(nodes(files))


def imports_of(found: DataFrame) -> DataFrame:
    return found.where("kind = 'import'").select("path", F.col("name").alias("symbol"), F.col("type").isNotNull().alias("static"), "line")
