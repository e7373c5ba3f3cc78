"""Publications, phases, catalogues, build reports, module trees and symbols of annotations."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import classify, sinks
from tessera.operators.rules import all_matches, first_match
from tessera.sources import catalogues


def test_publish_and_replace(spark, tmp_path):
    base = f"{tmp_path}/db"
    assert sinks.published(spark, base) == {}
    sinks.publish({"a": spark.range(3), "b": spark.range(1)}, base)
    sinks.replace_tables(spark, base, {"b": spark.range(5)})
    found = sinks.published(spark, base)
    assert {n: t.count() for n, t in found.items()} == {"a": 3, "b": 5}


def test_append_and_logs(spark, tmp_path):
    for k in (2, 3):
        sinks.append(spark.range(k), f"{tmp_path}/rows")
        sinks.append_log(spark.range(k), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/rows").count() == spark.read.json(f"{tmp_path}/log").count() == 5
    path = sinks.write_report(spark.range(2), str(tmp_path), "/x/shop/", "report.json")
    assert path.endswith("/shop/report.json") and spark.read.json(path).count() == 2


def test_generated_files_alone_are_overwritten(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "path string, text string")
    rows = sinks.writable(frame(("a", "x"), ("b", "y"), ("c", "z")), frame(("a", "made by hand"), ("b", "// generated"), ("b2", None)), "// generated").collect()
    assert {r["path"]: r["refused"] for r in rows} == {"a": True, "b": False, "c": False}


def test_phases(spark, tmp_path):
    ran = []

    def phase(name):
        def run(tables):
            ran.append(name)
            return {**tables, name: spark.range(len(ran))}

        return name, run

    base = f"{tmp_path}/phases"
    first = sinks.run_phases(spark, base, "root", [phase("structure"), phase("scored")])
    again = sinks.run_phases(spark, base, "root", [phase("structure"), phase("scored")])
    assert ran == ["structure", "scored"] and {n: t.count() for n, t in first.items()} == {n: t.count() for n, t in again.items()} == {"structure": 1, "scored": 2}
    sinks.run_phases(spark, base, "other root", [phase("structure"), phase("scored")])
    assert ran == ["structure", "scored"] * 2 and sinks.load_phase(spark, base, "scored", "root") is None


def test_exit_code(spark):
    rows = spark.createDataFrame([("warning", "f", "m")] + [("error", f"f{9 - i}", "m") for i in range(7)], "severity string, file string, message string")
    assert sinks.exit_code(rows) == 1 and sinks.exit_code(rows.where("severity = 'warning'")) == 0
    assert [r["file"] for r in sinks.failing(rows).collect()] == ["f3", "f4", "f5", "f6", "f7"]


def test_catalogue(spark, tmp_path):
    texts = {
        "dependency_compatibility.yaml": "dependencies:\n- id: d1\n  match: {group_id: org.x, artifact_id_pattern: 'lib-*'}\n  minimum_version: {21: '2.0'}\n",
        "plugin_compatibility.yaml": "plugins:\n- {id: p1, match: {plugin_id: java}}\n",
        "removed_apis.yaml": "removed_apis:\n- {id: r1, severity: error, symbols: [a.B], symbol_prefixes: [c.], except_symbol_prefixes: [c.d], applies_when_target_java_at_least: 17}\n",
        "deprecated_for_removal.yaml": "deprecated_for_removal: []\n",
        "internal_apis.yaml": "internal_apis:\n- {id: i1, symbol_patterns: ['x*y']}\nreflective_access:\n- {id: f1}\n",
        "replacements.yaml": "replacements:\n- {id: s1, from_symbols: [a.B], to_symbols: [a.C]}\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    found = catalogues.compatibility_catalogue(spark, str(tmp_path))
    assert {k: len(v) for k, v in found.items()} == {"dependencies": 1, "plugins": 1, "removed_apis": 1, "deprecated_for_removal": 0, "internal_apis": 1, "reflective_access": 1, "replacements": 1}
    (d,) = found["dependencies"]
    rows = spark.createDataFrame([("org.x", "lib-a"), ("org.x", "other")], "group_id string, artifact_id string")
    assert d.values == {"minimum_21": "2.0"} and [r["rule_id"] for r in first_match(rows, [d]).orderBy("artifact_id").collect()] == ["d1", None]
    assert all_matches(rows, [d]).count() == 1 and all_matches(rows, []).count() == 0
    assert found["removed_apis"][0].applies_from == 17 and found["replacements"] == [("s1", ["a.B", "a.C"])]
    (tmp_path / "removed_apis.yaml").write_text("a: [")
    with pytest.raises(ValueError, match="removed_apis"):
        catalogues.compatibility_catalogue(spark, str(tmp_path))


def test_registry_and_config_rules(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("groups:\n  web: {symbols: [a.B], symbol_prefixes: [c.]}\n")
    (tmp_path / "c.yaml").write_text("rules:\n- {id: x, config_type: SPRING, categories: [a, b], file_names: [f.yml]}\n")
    registry = catalogues.symbol_registry(spark, f"{tmp_path}/r.yaml")
    values = spark.createDataFrame([("a.B",), ("c.d",), ("a.Bx",)], "v string").select("v", classify.in_registry(registry, F.col("v")).alias("hit"))
    assert {r["v"] for r in values.collect() if r["hit"]} == {"a.B", "c.d"}
    (rule,) = catalogues.config_rules(spark, f"{tmp_path}/c.yaml")
    assert (rule.type, rule.categories, rule.names) == ("SPRING", ("a", "b"), ("f.yml",))


TOOL = {"tool": "maven", "version": "3", "file": "pom.xml"}
SCOPE = {"name": "", "path": ".", "build_tools": [TOOL], "java_versions": [], "direct_dependencies": [{"group_id": "g", "artifact_id": "a"}], "direct_plugins": []}
REPORT = {"project_root": "/w/shop", "parent": SCOPE, "modules": [{**SCOPE, "path": "svc/api"}, {**SCOPE, "name": "again", "path": "svc/api"}], "diagnostics": []}


def test_build_reports(spark):
    texts = {"good": REPORT, "flat": {**REPORT, "build_tools": [TOOL]}, "extra": {**REPORT, "surprise": 1}, "deep": {**REPORT, "parent": {**SCOPE, "odd": 1}}, "no": {"x": 1}}
    files = spark.createDataFrame([(k, json.dumps(v)) for k, v in texts.items()] + [("bad", "{"), ("null", None)], "path string, text string")
    rows = {r["path"]: r for r in catalogues.build_reports(files).collect()}
    assert {k: r["error"] for k, r in rows.items()} == {"good": None, "flat": None, "extra": "unknown fields: surprise", "deep": "unknown fields: odd", "no": "not a build report", "bad": "not a build report", "null": "not a build report"}
    assert len(rows["good"]["build_tools"]) == 3 and len(rows["good"]["direct_dependencies"]) == 3 and len(rows["flat"]["build_tools"]) == 1 and not rows["flat"]["direct_dependencies"]
    good = catalogues.build_reports(files.where("path = 'good'"))
    assert {(r["module_path"], r["artifact_id"]) for r in catalogues.scope_rows(good, "direct_dependencies").collect()} == {(".", "a"), ("svc/api", "a")}
    assert {(r["id"], r["name"], r["build_system"]) for r in catalogues.report_modules(good).collect()} == {("module:.", "shop", "maven"), ("module:svc/api", "again", "maven")}


def test_flat_modules(spark):
    tree = [{"id": 1, "children": [{"id": 2, "children": [{"id": 3}]}, {"id": 4}]}, {"id": 5}]
    rows = catalogues.flat_modules(spark.createDataFrame([(json.dumps(tree),), ("[]",), (None,)], "modules string")).collect()
    assert sorted((r["places"], r["depth"], json.loads(r["module"])["id"]) for r in rows) == [([0], 0, 1), ([0, 0], 1, 2), ([0, 0, 0], 2, 3), ([0, 1], 1, 4), ([1], 0, 5)]


def test_resolved_symbols(spark):
    mark = lambda v, line: {"raw": "@X", "simple": "X", "values": v, "line": line}
    row = ("module:.", "A", "p.A", "class", "f", 1, 9, [mark(["X"], 2)], None, [], [{"name": "n", "type_name": "t", "line": 3, "annotations": [mark(["X"], 3)]}], [])
    classes = spark.createDataFrame([row], classify.CLASSES)
    resolved = spark.createDataFrame([("f", 2, ["q.X", "X"]), ("g", 3, ["z"])], "file string, line bigint, values array<string>")
    out = classify.with_resolved_symbols(classes, resolved).first()
    assert out["annotations"][0]["values"] == ["X", "q.X"] and out["fields"][0]["annotations"][0]["values"] == ["X"]


def test_candidate_values(spark):
    registry = {"g": classify.Group(symbols=("org.r.Entity",), important_symbols=("org.s.Other",))}
    rows = spark.createDataFrame([("Entity", ["a.Entity", "b.*", "c.Else"])], "s string, i array<string>")
    assert rows.select(classify.candidate_values(F.col("s"), F.col("i"), registry)).first()[0] == ["Entity", "a.Entity", "b.Entity", "org.r.Entity"]
