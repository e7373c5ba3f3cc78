"""Catalogues as indexes against the same catalogues as expressions of the row, and catalogues of many rules."""

import random
import time
from collections import Counter

import pytest

from tessera.operators import rule_index, rules

WORDS = ["org.a", "org.a.b", "org", "spring-boot", "spring", "boot", "org.abc", "", "x", "a.b", "org.a.b.c.D"]


def rows_of(df):
    return sorted((tuple(map(repr, r)) for r in df.collect()), key=repr)


def random_rules(rng, n):
    def pattern():
        w = rng.choice(WORDS)
        return rng.choice(["*", w, w + "*", "*" + w, "*" + w + "*", None if rng.random() < 0.1 else w])

    return [rules.Rule(f"r{i}", {c: pattern() for c in rng.sample(["g", "a"], rng.randrange(0, 3))}) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(i % 150, rng.choice([*WORDS, None]), rng.choice([*WORDS, None]), 1) for i in range(200)], "id long, g string, a string, ordinal int").repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_index_gives_the_rows_of_the_expression(table, seed):
    listed = random_rules(random.Random(seed), 40)
    assert rows_of(rule_index.first_match(table, listed)) == rows_of(rules.first_match(table, listed))
    assert rows_of(rule_index.all_matches(table, listed)) == rows_of(rules.all_matches(table, listed))


def test_symbols_prefixes_patterns_exclusions(spark):
    rng = random.Random(5)
    parts = ["java", "util", "Date", "sun", "misc", "a", "b()", "Q\\E", ""]
    name = lambda: ".".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))
    listed = [
        rules.ApiRule(f"r{i}", rng.choice(["error", "info"]), tuple(name() for _ in range(rng.randrange(3))), tuple(name()[: rng.randrange(8)] for _ in range(rng.randrange(2))),
                      tuple(name() for _ in range(rng.randrange(2))), tuple(rng.choice([name(), name()[:4] + "*" + name()[-3:], "*" + name()]) for _ in range(rng.randrange(2))))
        for i in range(25)
    ]
    listed = [r if "" not in r.patterns else rules.ApiRule(r.id) for r in listed]
    found = [[name() for _ in range(rng.randrange(4))] for _ in range(120)] + [None, [None, "java.util"]]
    rows = spark.createDataFrame([(i % 100, s) for i, s in enumerate(found)], "line long, symbols array<string>")
    assert rows_of(rule_index.api_findings(rows, listed)) == rows_of(rules.api_findings(rows, listed, 21))


def test_mutual_prefixes(spark, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(20)]
    rows = spark.createDataFrame([(i, "".join(rng.choice("ab") for _ in range(rng.randrange(6)))) for i in range(60)] + [(99, None)], "id long, symbol string")
    listed = {f"n{i}": rng.sample(texts, 3) for i in range(6)}
    want = rows_of(rules.mutual_prefix(rows, "symbol", texts)), rows_of(rules.replacements(rows, listed))
    monkeypatch.setattr(rules, "CODED_RULES", 0)
    assert (rows_of(rules.mutual_prefix(rows, "symbol", texts)), rows_of(rules.replacements(rows, listed))) == want


def test_hundred_thousand_rules(spark):
    many = [rules.Rule(f"r{i}", {"g": f"org.g{i}", "a": "*" if i % 2 else f"*-{i}"}, {"minimum_21": "2.0", "recommended_21": "3.0"}) for i in range(100_000)]
    deps = spark.range(3000).selectExpr("id", "concat('org.g', id * 40) AS g", "concat('art-', id * 40) AS a", "if(id % 2 = 0, '1.0', '2.5') AS version")
    began = time.time()
    got = rules.recommendations(deps, many, 21).select("id", "rule_id", "minimum", "recommended").collect()
    assert sorted((r["id"], r["rule_id"]) for r in got) == [(i, f"r{i * 40}") for i in range(0, 2500, 2)]
    apis = [rules.ApiRule(f"s{i}", symbols=(f"com.k{i}",), prefixes=(f"net.p{i}.",), patterns=(f"Pat{i}x",) if i % 100 == 0 else ()) for i in range(100_000)]
    rows = spark.range(3000).selectExpr("id AS line", "array(concat('com.k', id, '.C'), concat('net.p', id, '.D'), concat('z.Pat', id, 'xy')) AS symbols")
    found = {(r["line"], r["rule_id"]): r["terms"] for r in rules.api_findings(rows, apis, 21).collect()}
    assert len(found) == 3000 and found[7, "s7"] == ["com.k7", "net.p7."] and found[200, "s200"] == ["Pat200x", "com.k200", "net.p200."]
    assert time.time() - began < 90


def test_configuration_rules_and_hints(spark, monkeypatch):
    rng = random.Random(8)
    some = lambda xs, n=2: tuple(rng.sample(xs, rng.randrange(n + 1)))
    names, keys = ["a.yml", "b.xml", "c.properties"], ["spring.x.y", "spring", "springy.z", "server.port", ".", "a..b", ""]
    listed = [
        rules.ConfigRule(f"r{i}", rng.choice("AB"), rng.choice([None, "f1", "f2"]), some(["k1", "k2", "k3"]), some(names), some(["^a", "xml$", "(bad"]), some(["conf/", "[.]yml$", "["]), some(["beans", "root"]), some(["http://orm", "urn:", "x", "urn:long-name"]),
                         some(["spring", "spring.", "server.", "a.", "a", ".", "spring.x"]))
        for i in range(30)
    ]
    rows = [(f"conf/{i % 7}/{n}" if i % 3 else n, n, rng.choice([None, "<b xmlns='http://orm'/>", "urn:long-names x", ""]), rng.choice([None, "beans", "other"]), rng.choice([None, list(some(keys, 4))])) for i in range(80) for n in [rng.choice(names)]]
    files = spark.createDataFrame(rows + rows[:5], "path string, file_name string, contents string, xml_root string, keys array<string>").repartition(3)
    hints = {"one": "^conf", "two": "xml$|yml$", "bad": "(", "dots": "[.].*[.]"}
    want = rows_of(rules.config_files(files, listed)), rows_of(rules.hint_links(files.select("path", "file_name"), hints, ["path", "file_name"]))
    assert want[0] and want[1]
    monkeypatch.setattr(rules, "CODED_RULES", 0)
    assert (rows_of(rules.config_files(files, listed)), rows_of(rules.hint_links(files.select("path", "file_name"), hints, ["path", "file_name"]))) == want


def test_namespaces_of_one_beginning(spark):
    """A thousand namespaces that begin alike: a text meets those it holds, not all that share its beginning."""
    spaces = [f"http://schema.org/n{i}'" for i in range(1000)] + ["urn:", "x"]
    grams = rule_index.telling_grams(spaces)
    assert all(grams[t] in t for t in spaces) and max(Counter(grams.values()).values()) <= 3
    listed = [rules.ConfigRule(f"r{i}", namespaces=(t,)) for i, t in enumerate(spaces)]
    rows = [(f"f{i}", "a", f"<b a='http://schema.org/n{i % 40}'/>" if i % 4 else "urn:q", None, None) for i in range(400)]
    files = spark.createDataFrame(rows, "path string, file_name string, contents string, xml_root string, keys array<string>")
    got = {r["path"]: sorted(r["rule_ids"]) for r in rules.config_files(files, listed).collect()}
    assert got == {p: sorted(f"r{n}" for n, t in enumerate(spaces) if t in c) for p, _, c, _, _ in rows if any(t in c for t in spaces)}
