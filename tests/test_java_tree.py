"""The grammar of Java sources: declarations of any depth, what is no Java, the model with whole types, and source text to a classification."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import classify
from tessera.sources import java, java_model, java_syntax

PROBES = {
    "record": ("record R(int a, @X String b) { int sum() { return a; } }", {("class", "R"), ("method", "R#sum()")}),
    "compact constructor": ("record R(int a) { R { check(a); } R(long b) { this((int) b); } }", {("class", "R"), ("method", "R#R(long)")}),
    "enum constant bodies": ("enum E { ONE(1) { void one() { a(); } }, TWO; E(int... n) {} }", {("class", "E"), ("method", "E#one()"), ("method", "E#E(_)")}),
    "anonymous class": ("class A { void f() { run(new R() { public void in() { g(); } }); } }", {("class", "A"), ("method", "A#f()"), ("method", "A#in()")}),
    "anonymous class of a field": ("class A { R r = new R<>(1) { void in() {} }; }", {("class", "A"), ("method", "A#in()")}),
    "static initializer": ("class A { static { init(); } { more(); } void f() {} }", {("class", "A"), ("method", "A#f()")}),
    "deep type arguments": ("class A { A<B<C<D<E<F<G<H>>>>>>> f(Map<String, List<Map<K, Set<List<V[]>>>>> m) { return null; } }", {("class", "A"), ("method", "A#f(Map<String, List<Map<K, Set<List<V[]>>>>>)")}),
    "deep annotations": ('class A { @B(@C(@D(@E(x = {@F("("), @F(")")})))) void f() {} }', {("class", "A"), ("method", "A#f()")}),
    "local class": ("class A { void f() { class L { void g() {} } record P(int x) {} } }", {("class", "A"), ("class", "A.L"), ("class", "A.P"), ("method", "A#f()"), ("method", "A.L#g()")}),
    "interface and annotation": ("@interface Q { int v() default 1; class In { void x() {} } } sealed interface S permits T { int C = 1; default <U> U d() { return null; } } non-sealed class T implements S {}",
                                 {("class", "In"), ("method", "In#x()"), ("class", "S"), ("method", "S#d()"), ("class", "T")}),
    "modifiers and generics": ("abstract class A<T extends B & C<? super T>> { protected abstract <X> int[] f(final T[] a, int b[]) throws E, F; strictfp synchronized void g() {} }", {("class", "A"), ("method", "A#f(T[],int)"), ("method", "A#g()")}),
    "receiver and arrays": ("class A { int f(A this, int x)[] { return new int[] {1, 2}; } }", {("class", "A"), ("method", "A#f(int)")}),
}

BROKEN = ["class A { void f( { }", "class A { int x = ; }", "class A { void f() { return x } }", "class A { void f() { foo bar baz; } }", "class A { void f() { a + ; } }", "clas A {}", 'class A { void f() { "a" "b"; } }',
          "class A { int }", "class A { void f() { foo.; } }", "class { }", 'class A { String s = "abc; }', "class A { void f() { int x = 1 } }", "class A { enum B { X Y } }", "package a", "class A { void f(int a,) {} }", "class A { A() ; }", "}", "class A { /* ",
          "class A { @B( void f() {} }", "class A { List<List<X> y; }"]

SOUND = ["", "// only\n/* comments */", "class A { int f(int a) { return a < 3 ? -a : +a; } }", "class A { Map<String, Integer> m = new HashMap<String, Integer>(), n; int g = a < b ? c : d, h = 2; }",
         "class A { Supplier<X> s = () -> { return 1; }; Function<A, B> q = Map.Entry<A, B>::getKey; }", "module x.y { requires z; }", "open module x {}", "import a.b.*; ; class A { ; }",
         "class A { void f() { int i = 0, j = 1; l: for (;;) { continue l; } do x(); while (y()); try (R r = o()) { } catch (A | B e) { } finally { } char c = '\"'; long n = 1_000L; double d = .5e3; i >>= 2; i >>>= 1; synchronized (this) { } assert x : \"y\"; } }",
         'class A { void f() { int r = switch (k) { case 1, 2 -> 3; case P(int x) when x > 1 -> 4; default -> { yield 5; } }; String t = """\n  { "q" (\n"""; foo(new int[]{1}, new X[0], (Runnable & Q) () -> {}); if (o instanceof A a && a.b) return; else throw new E(); } }',
         "class A { void f() { switch (a) { case B: case C: default: } var v = x -> y -> x.<T>z(y)[0].w(); @X final int q = 'a'; } }"]


@pytest.fixture(scope="module")
def probed(spark):
    rows = [(name, text) for name, (text, _) in PROBES.items()] + [(f"broken{i}", t) for i, t in enumerate(BROKEN)] + [(f"sound{i}", t) for i, t in enumerate(SOUND)] + [("null", None)]
    return java.nodes(spark.createDataFrame(rows, "path string, text string").repartition(4)).cache()


def test_probes(probed):
    found = [("class", r["file"], r["qualified_name"]) for r in java_model.classes(probed).collect()]
    found += [("method", r["file"], r["id"].split("method:", 1)[1].rsplit("@", 1)[0]) for r in java_model.methods(probed).collect()]
    for name, (_, want) in PROBES.items():
        assert {(kind, what) for kind, file, what in found if file == name} == want, name


def test_broken_files_give_one_diagnostic_and_no_rows(probed):
    assert {r["path"] for r in java.broken(probed).collect()} == {f"broken{i}" for i in range(len(BROKEN))}
    assert probed.where("startswith(path, 'broken') and kind <> 'error'").count() == 0
    assert {r["path"] for r in java_model.classes(probed).where("startswith(file, 'sound')").select(F.col("file").alias("path")).collect()} == {f"sound{i}" for i, t in enumerate(SOUND) if "class A" in t}


def test_calls_count_for_every_method_around(probed):
    found = {(r["file"], r["caller_method_id"].split("#")[1].split("@")[0], r["name"]) for r in java_model.invocations(probed).collect() if not r["file"].startswith("sound")}
    assert {x for x in found if x[0] == "anonymous class"} == {("anonymous class", "f()", "run"), ("anonymous class", "f()", "g"), ("anonymous class", "in()", "g")}
    assert {x for x in found if x[0] in ("compact constructor", "static initializer")} == set()
    assert {x for x in found if x[0] == "enum constant bodies"} == {("enum constant bodies", "one()", "a")}


def test_whole_rows():
    text = 'package p.q;\n@RestController\npublic class A extends B<C> implements I, x.J<K> {\n  @GetMapping("/é/{id}")\n  public Map<String, List<K>>\n    get(@Id final List<K> é, int... n) { @Y int k = é.size(); return null; }\n}'
    _, a, get, mark, size = java_syntax.parse(text)
    assert (a["extends"], a["interfaces"]) == ("B", ["I", "J", "K", "x", "x.J", "x.J<K>"])
    assert a["inside"] == {"@RestController", '@GetMapping("/é/{id}")', "@Id", "@Y"} and a["annotations"] == ["@RestController"]
    assert (get["type"], get["line"], get["end_line"], get["name_line"], get["name_column"]) == ("Map<String, List<K>>", 4, 6, 6, 4)
    assert [(p["name"], p["type"], p["spread"]) for p in get["parameters"]] == [("é", "List<K>", False), ("n", "int", True)]
    assert (mark["name"], size["name"], size["expression"], size["column"]) == ("@Y", "size", "é.size()", text.split("\n")[5].encode().index(b"size"))


def test_depth_is_no_limit():
    deep = 400
    assert len(java_syntax.parse("class A { " * deep + "}" * deep)) == deep
    assert len(java_syntax.parse("class A { void f() { " + "new B() { void g() { " * deep + "} }; " * deep + "} }")) == deep + 2
    text = "class A { " + "L<" * deep + "X" + ">" * deep + " f = g" + "(" * deep + ")" * deep + "; }"
    assert [r["kind"] for r in java_syntax.parse(text)].count("field") == 1


ORDER = """
package demo;
import jakarta.persistence.*;
@Entity
@Table(name = "orders")
class Order {
  @Id Long id;
  @Column(name = "order_status") String status;
}
"""
REPOSITORY = """
package demo;
import org.springframework.data.jpa.repository.JpaRepository;
import org.springframework.data.jpa.repository.Query;
interface OrderRepository extends JpaRepository<Order, Long> {
  @Query("select o from Order o") Order findReady();
}
"""
CONTROLLER = """
package demo;
import org.springframework.web.bind.annotation.*;
import org.springframework.http.ResponseEntity;
@RestController
class OrderController {
  @PostMapping("/orders")
  ResponseEntity<OrderResponse> create(@RequestBody CreateOrderRequest request) {
    return null;
  }
}
record CreateOrderRequest(String name) {}
record OrderResponse(String id) {}
"""
REGISTRY = {
    "jakarta_persistence": classify.Group(symbol_prefixes=("jakarta.persistence.",)),
    "spring_data_jpa": classify.Group(symbols=("org.springframework.data.jpa.repository.Query",)),
    "spring_mvc": classify.Group(symbol_prefixes=("org.springframework.web.",)),
}


def test_source_text_to_classification(spark):
    files = spark.createDataFrame([("service/src/Order.java", ORDER), ("service/src/OrderRepository.java", REPOSITORY), ("web/OrderController.java", CONTROLLER), ("x.txt", ORDER), ("service/Bad.java", "class {")], "path string, text string")
    modules = spark.createDataFrame([("module:.", "."), ("module:service", "service")], "id string, path string")
    dependencies = spark.createDataFrame(
        [("module:service", 0, "jakarta.persistence", "jakarta.persistence-api", "1.0.0"), ("module:service", 1, "org.springframework.boot", "spring-boot-starter-data-jpa", "1.0.0"), ("module:.", 0, "org.springframework.boot", "spring-boot-starter-web", "1.0.0")],
        "module_id string, ordinal int, group_id string, artifact_id string, version string",
    )
    found = {k: v.collect() for k, v in java_model.classification(files, modules, dependencies, REGISTRY).items()}
    (entity,) = found["entities"]
    assert (entity["qualified_name"], entity["table_name"], entity["module_id"], entity["start_line"]) == ("demo.Order", "orders", "module:service", 4)
    assert {e["symbol"] for e in entity["evidence"]} == {"jakarta.persistence.Entity", "jakarta.persistence.Table", "jakarta.persistence.Id", "jakarta.persistence.Column"}
    assert found["tables"][0]["name"] == "orders"
    assert {(c["field_name"], c["column_name"], c["java_type"]) for c in found["columns"]} == {("id", "id", "Long"), ("status", "order_status", "String")}
    (repository,) = found["repositories"]
    assert (repository["qualified_name"], repository["query_methods"], repository["entity_type"]) == ("demo.OrderRepository", ["findReady"], None)
    assert {e["symbol"] for e in repository["evidence"]} == {"org.springframework.data.jpa.repository.Query"}
    assert [b["type_name"] for b in found["request_bodies"]] == ["CreateOrderRequest"] and [b["type_name"] for b in found["response_bodies"]] == ["OrderResponse"]
    assert {d["qualified_name"]: (d["kind"], d["module_id"]) for d in found["dtos"]} == {"demo.CreateOrderRequest": ("record", "module:."), "demo.OrderResponse": ("record", "module:.")}
    assert [d["path"] for d in found["diagnostics"]] == ["service/Bad.java"]


def test_members_of_nested_classes_and_what_is_left_out(spark):
    text = "class A { int a; class B { @X long b, c; void m(@Y int p) { int no; new T() { int no2; void no3() {} }; } } R r = new R() { void no4() {} }; A() {} interface I { int NO = 1; void n(); } }"
    (row,) = java_model.source_classes(java.nodes(spark.createDataFrame([("A.java", text)], "path string, text string")), spark.createDataFrame([("u.X",), ("v.X",), ("w.Z",)], "symbol string")).collect()
    assert sorted(f["name"] for f in row["fields"]) == ["a", "b", "c", "r"]
    assert sorted(m["name"] for m in row["methods"]) == ["A", "m", "n"]
    method = next(m for m in row["methods"] if m["name"] == "m")
    assert [(p["type_name"], [a["values"] for a in p["annotations"]]) for p in method["parameters"]] == [("int", [["Y"]])]
    assert next(f for f in row["fields"] if f["name"] == "b")["annotations"][0]["values"] == ["X", "u.X", "v.X"]


def test_names(spark):
    wanted = spark.createDataFrame([("a", "X"), ("a", "X"), ("a", "Y"), ("b", "X"), (None, "X")], "path string, simple string")
    imports = spark.createDataFrame([("a", "p.X"), ("a", "q.*"), ("a", "q.*"), ("a", "r.s.*.*"), ("b", "X"), ("c", "z.X"), (None, "n.X")], "path string, symbol string")
    symbols = spark.range(100_000).selectExpr("concat('k', id, '.N', id % 1000) AS symbol").union(spark.createDataFrame([("m.X",), ("X",), (None,)], "symbol string"))
    got = {(r["path"], r["simple"]): r["values"] for r in java_model.resolved_names(wanted, imports, symbols).collect()}
    assert got["a", "X"] == ["X", "m.X", "p.X", "q.X", "r.s.X"] and got["a", "Y"] == ["Y", "q.Y", "r.s.Y"] and got["b", "X"] == ["X", "m.X"]
