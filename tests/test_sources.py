import pytest

from tessera.sources import files as S
from tessera.sources import formats as P
from pyspark.sql import functions as F


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def test_scan(spark, tmp_path):
    for path, text in {"a/src/Main.java": "class Main {}", "a/test/MainTest.java": "x", "target/Gen.java": "x", "a/generated/G.java": "x", "a/src/H.java": "// Generated by hand", "a/src/OrderIT.java": "x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = S.source_files(spark, str(tmp_path), "*.java")
    assert {r["path"] for r in S.production_sources(found).collect()} == {"a/src/Main.java"}
    assert S.scan_counters(found).first().asDict() == {"production": 1, "ignored": 1, "generated_path": 1, "generated_text": 1, "test": 2}
    assert [r["path"] for r in S.integration_tests(found).collect()] == ["a/src/OrderIT.java"]


@pytest.mark.parametrize("path, want", [("a/.env", "env"), ("x/app.YML", "yaml"), ("b.wsdl", "xml"), ("q.sql", "sql"), ("README", None), ("s.avsc", "avro")])
def test_format(spark, path, want):
    assert frame(spark, (path, None)).select(S.config_format(F.col("path"))).first()[0] == want


def test_key_values(spark):
    rows = P.key_values(frame(spark, ("p", "# no\na = 1=2\r\nb: 3\n\na=9\njunk\n"), ("q", None))).collect()
    assert {(r["path"], r["key"], r["value"]) for r in rows} == {("p", "a", "1=2"), ("p", "b", "3")}


def test_nested(spark):
    rows = P.flattened(frame(spark, ("p", "a:\n  b:\n    c: 1\n  l: [1, 2]\n"), ("bad", "a: [")), "yaml").collect()
    assert {(r["path"], r["key"], r["value"]) for r in rows} == {("p", "a.b.c", "1"), ("p", "a.l[]", "[1, 2]")}
    assert {r["key"] for r in P.flattened(frame(spark, ("p", '{"x": {"y": true}}'), ("bad", "{")), "json").collect()} == {"x.y"}


POM = """<?xml version="1.0"?><!-- c --><project><properties><v>1.2</v><java.version>17</java.version></properties>
<modules><module>service</module></modules><dependencies><dependency><groupId>org.x</groupId><artifactId>lib</artifactId><version>${v}</version></dependency>
<dependency><groupId>org.y</groupId><artifactId>other</artifactId><version>${unknown}</version><scope>test</scope></dependency></dependencies></project>"""


def test_pom(spark):
    f = frame(spark, ("pom.xml", POM))
    assert {(r["artifact_id"], r["version"], r["scope"]) for r in P.pom_rows(f, "dependency").collect()} == {("lib", "1.2", None), ("other", "${unknown}", "test")}
    assert [(r["source"], r["version"]) for r in P.pom_java_versions(f).collect()] == [("java.version", "17")]
    assert [tuple(r) for r in P.pom_modules(f).collect()] == [(".", "service")]
    assert f.select(P.xml_root(F.col("text"))).first()[0] == "project"


def test_gradle(spark):
    f = frame(spark, ("build.gradle", "plugins { id 'java'\n id(\"org.boot\") version \"3.1\" }\nsourceCompatibility = JavaVersion.VERSION_1_8\ndependencies {\n  implementation 'a.b:c:1.0'\n  testImplementation(\"d:e\")\n  other 'x:y:1'\n}"))
    assert {(r["configuration"], r["artifact_id"], r["version"]) for r in P.gradle_dependencies(f).collect()} == {("implementation", "c", "1.0"), ("testImplementation", "e", None)}
    assert {(r["plugin_id"], r["version"]) for r in P.gradle_plugins(f).collect()} == {("java", None), ("org.boot", "3.1")}
    assert [r["version"] for r in P.gradle_java_versions(f).collect()] == ["1.8"]
    toml = '[versions]\nk = "2.0"\n[libraries]\na = { module = "g:a", version.ref = "k" }\nb = "g:b:1.1"\n[plugins]\np = { id = "pl", version = "3" }\n'
    assert {(r["alias"], r["name"], r["version"]) for r in P.catalogue_rows(frame(spark, ("t", toml))).collect()} == {("a", "g:a", "2.0"), ("b", "g:b", "1.1"), ("p", "pl", "3")}
    assert {r["module"] for r in P.gradle_modules(frame(spark, ("s", "include ':a', ':b:c'\ninclude(\"d\")"))).collect()} == {"a", "b/c", "d"}


def test_reports(spark):
    lines = spark.createDataFrame([("  org.x.A -> sun.misc.Unsafe JDK internal API (jdk)",), ("class org/x/B uses deprecated method java/lang/T::stop (forRemoval=true)",), ("+--- a.b:c:1.0 -> 1.2",), (None,)], "line string")
    assert [tuple(r) for r in P.internal_uses(lines).collect()] == [("org.x.A", "sun.misc.Unsafe")]
    assert [r["class_name"] for r in P.removal_uses(lines).collect()] == ["org.x.B"]
    assert [tuple(r) for r in P.resolved_gradle(lines).collect()] == [("a.b", "c", "1.2")]


@pytest.mark.parametrize("text, want", [('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ('{"b": 2}', '{"b": 2}'), ('so: {"c": 3} ok', '{"c": 3}'), ("none", None), (None, None)])
def test_recovered_json(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(P.recovered_json(F.col("t"))).first()[0] == want


def test_plain_yaml_is_read_by_libyaml_alike(monkeypatch):
    """Plain texts go to libyaml, odd ones and those it refuses to PyYAML's own parser; rows and refusals are those of the latter for all."""
    import random

    import yaml

    def answer(load, text):
        try:
            return repr(load(text))
        except Exception as e:  # dates out of range are no YAMLError
            return type(e)

    own = lambda text: list(yaml.safe_load_all(text))
    parts = ["a", "b", "- ", ": ", ":", "\n", "\n  ", " ", '"', "'", "[", "]", "{", "}", ", ", " #", "&x ", "*x", "!", "!!str ", "1", "0x1F", "true", "---", "\n---\n", "? ", "%", "|", ">", "\\n", "\t", "é", "<<: ", "2020-01-01", "2020-99-99", "12:30"]
    draw = random.Random(5)
    texts = ["", "{null':}", "[2020-01-01.5:]", "|#", "!", "%1on\n---\n\n  ?", "a:\n  b: 1\n  list:\n  - 1\n\"on\": true\n---\nnone:\n", *("".join(draw.choices(parts, k=draw.randint(1, 14))) for _ in range(3000))]
    assert [t for t in texts if answer(P.yaml_documents, t) != answer(own, t)] == []
    if yaml.__with_libyaml__:
        monkeypatch.setattr(yaml, "safe_load_all", None)
        assert P.yaml_documents("a: {b: [1, x]}") == [{"a": {"b": [1, "x"]}}]
