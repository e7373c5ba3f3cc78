"""Nested reports against a recursive fold, totals against the nested report, and contexts of methods against plain loops."""

import json
import random

import pytest

from tessera.operators import builds, classify, contexts, reports


@pytest.fixture(scope="module")
def tree(spark):
    rng = random.Random(4)
    paths = {"."}
    while len(paths) < 40:
        base = rng.choice(sorted(paths))
        paths.add(rng.choice("abcd") if base == "." else f"{base}/{rng.choice('abcd')}{rng.randrange(3)}")
    deep = "/".join(f"z{i}" for i in range(12))
    paths |= {"/".join(deep.split("/")[: k + 1]) for k in range(12)}
    rows = [(f"module:{p}", f"name {p}", p) for p in sorted(paths)]
    return classify.module_tree(spark.createDataFrame(rows, "id string, name string, path string").repartition(3)).cache(), [r[0] for r in rows]


@pytest.fixture(scope="module")
def rows(spark, tree):
    rng = random.Random(5)
    entities = [(rng.choice([*tree[1], "module:none"]), f"E{rng.randrange(30)}", f'q"{i}') for i in range(120)]
    columns = [(rng.choice(tree[1]), None if i % 9 == 0 else f"f{i % 11}", i) for i in range(80)]
    return {"entities": spark.createDataFrame(entities, "module_id string, qualified_name string, file string"), "columns": spark.createDataFrame(columns, "module_id string, field_name string, line int")}, entities, columns


def nested(rows, entities, columns):
    by_id = {}
    for r in rows:
        own = {"id": r["id"], "name": r["name"], "path": r["path"]} | {k: [] for k in [*classify.ROW_TYPES, "used_dependencies"]}
        own["entities"] = sorted(({"qualified_name": q, "file": f} for m, q, f in entities if m == r["id"]), key=lambda x: (x["qualified_name"], json.dumps(x, separators=(",", ":"))))
        mine = [({"field_name": n} if n else {}) | {"line": i} for m, n, i in columns if m == r["id"]]
        own["columns"] = sorted(mine, key=lambda x: ("field_name" in x, x.get("field_name", ""), json.dumps(x, separators=(",", ":"))))
        by_id[r["id"]] = own | {"children": []}
    for r in sorted(rows, key=lambda r: r["id"]):
        if r["parent_id"]:
            by_id[r["parent_id"]]["children"].append(by_id[r["id"]])
    return by_id["module:."]


def test_nested_report(tree, rows):
    tables, entities, columns = rows
    (root,) = reports.nested_report(tree[0], tables).collect()
    assert root["id"] == "module:."
    assert json.loads(root["report"]) == nested(tree[0].collect(), entities, columns)


def test_totals_are_those_of_the_nested_report(tree, rows):
    (root,) = reports.nested_report(tree[0], rows[0]).collect()
    want = {}

    def count(module):
        sums = {k: len(module[k]) for k in rows[0]}
        for child in module["children"]:
            for k, n in count(child).items():
                sums[k] += n
        want[module["id"]] = sums
        return sums

    count(json.loads(root["report"]))
    assert {r["id"]: {k: r[k] for k in rows[0]} for r in reports.totals(tree[0], rows[0]).collect()} == want


def test_a_root_alone_and_used_dependencies(spark):
    one = classify.module_tree(spark.createDataFrame([("module:.", "root", ".")], "id string, name string, path string"))
    used = spark.createDataFrame([("module:.", "g", "b", "1"), ("module:.", "g", "a", None)], "module_id string, group_id string, artifact_id string, version string")
    empty = {"tables": spark.createDataFrame([], "module_id string, name string")}
    (root,) = reports.nested_report(one, empty, used).collect()
    got = json.loads(root["report"])
    assert got["children"] == [] and got["tables"] == [] and [d["artifact_id"] for d in got["used_dependencies"]] == ["a", "b"]


@pytest.fixture(scope="module")
def store(spark):
    rng = random.Random(6)
    ids = [f"m{i}" for i in range(12)]
    data = {
        "entry_points": ("id long, method_id string, kind string, framework string, route string, http_method string", [(i, rng.choice([*ids, None]), rng.choice("AB"), None, rng.choice(["/x", "/y", None]), rng.choice(["GET", None])) for i in range(80)]),
        "candidate_signals": ("method_id string, name string, count long, weight long", [(rng.choice(ids), f"s{i}", rng.randrange(4), rng.randrange(3)) for i in range(90)]),
        "test_suites": ("id string, class_name string", [("s0", "Suite"), ("s1", None)]),
        "test_cases": ("id string, suite_id string, name string, file string, start_line long, end_line long", [(f"t{i}", rng.choice(["s0", "s1", "s9", None]), f"case{i}", rng.choice("FG"), rng.choice([None, *range(5)]), 9) for i in range(30)]),
        "test_targets": ("test_case_id string, target_kind string, target_id string", [(f"t{rng.randrange(33)}", rng.choice(["method", "class"]), rng.choice(ids)) for i in range(120)]),
        "test_assertions": ("id long, test_case_id string, line long, assertion_kind string, expression string", [(i, f"t{rng.randrange(30)}", rng.randrange(4), "eq", f"a*/{i}\nb") for i in range(300)]),
        "test_fixtures": ("id long, test_case_id string, line long, fixture_kind string, name string", [(i, rng.choice([None, f"t{rng.randrange(30)}"]), rng.randrange(3), "mock", f"x{i}") for i in range(300)]),
        "test_entry_points": ("id long, test_case_id string, kind string, framework string, route string, http_method string", [(i, f"t{rng.randrange(30)}", rng.choice("HM"), "fw", f"/{i % 7}", None) for i in range(200)]),
    }
    tables = {k: spark.createDataFrame(v, s).repartition(2) for k, (s, v) in data.items()}
    plain = {k: [dict(zip([c.split()[0] for c in s.split(", ")], r, strict=True)) for r in v] for k, (s, v) in data.items()}
    return tables, plain, ids


def first(rows, order, n):
    return sorted(rows, key=lambda r: [(r[k.strip("-")] is not None, -r[k[1:]] if k.startswith("-") else r[k]) if r[k.strip("-")] is not None else (False, 0) for k in order])[:n]


def wanted_context(p, method):
    entry = lambda e: (e["kind"], e["framework"], e["http_method"], e["route"])
    suites = {s["id"]: s["class_name"] for s in p["test_suites"]}
    cases = {c["id"]: c for c in p["test_cases"]}
    related = [cases[t["test_case_id"]] for t in p["test_targets"] if t["target_kind"] == "method" and t["target_id"] == method and t["test_case_id"] in cases]
    tests = []
    for c in first(related, ["file", "start_line", "id"], 5):
        of = lambda table: [r for r in p[table] if r["test_case_id"] == c["id"]]  # noqa: B023, E731
        tests.append((suites.get(c["suite_id"]), c["name"], c["file"], c["start_line"], c["end_line"], [f"eq: {a['expression']}" for a in first(of("test_assertions"), ["line", "id"], 6)],
                      [f"mock: {f['name']}" for f in first(of("test_fixtures"), ["line", "id"], 6)], [entry(e) for e in first(of("test_entry_points"), ["kind", "route", "http_method", "id"], 4)]))
    own = [e for e in p["entry_points"] if e["method_id"] == method]
    signals = [s for s in p["candidate_signals"] if s["method_id"] == method]
    return [entry(e) for e in first(own, ["kind", "route", "http_method", "id"], 5)], [(s["name"], s["count"], s["weight"]) for s in first(signals, ["-weight", "-count", "name"], 8)], tests


def test_contexts(spark, store):
    tables, plain, ids = store
    methods = spark.createDataFrame([(m,) for m in [*ids, "m1", "unknown", None]], "id string")
    got = {r["method_id"]: r for r in contexts.method_contexts(tables, methods).collect()}
    assert set(got) == {*ids, "unknown"}
    for m in got:
        e, s, t = wanted_context(plain, m)
        row = got[m]
        assert [tuple(x) for x in row["entry_points"]] == e and [tuple(x) for x in row["signals"]] == s
        assert [(*x[:5], x["assertions"], x["fixtures"], [tuple(y) for y in x["entry_points"]]) for x in row["tests"]] == t


def test_rendered(spark, store):
    tables, plain, _ = store
    text = {r["method_id"]: r for r in contexts.rendered(contexts.method_contexts(tables, spark.createDataFrame([("m3",), ("unknown",)], "id string"))).collect()}
    assert text["unknown"]["tests"] == text["unknown"]["signals"] == " * - none found\n"
    lines = text["m3"]["tests"].splitlines()
    tests = wanted_context(plain, "m3")[2]
    assert sum(x.startswith(" * - ") for x in lines) == len(tests)
    suite, name, file, start, end, made, *_ = tests[0]
    assert lines[0] == f" * - {suite or 'unknown suite'}#{name} at {file}:{f'{start}-{end}' if start is not None else 'unknown'}"
    assert all("*/" not in x for x in lines) and sum(x.startswith(" *   assertion: eq: a* /") for x in lines) == sum(len(t[5]) for t in tests)


def test_required_tables():
    builds.require_tables({"a": None, "b": None}, ["b"], "store")
    with pytest.raises(ValueError, match="store lacks the tables c, d"):
        builds.require_tables({"a": None}, ["c", "a", "d"], "store")
