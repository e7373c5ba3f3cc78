import pytest

from tessera.sources import java as J

SHOP = """package org.shop; // {
import java.util.*;
import static org.x.Y.z;

/* class Ghost { */
@RestController("a(b")
public class Orders<T extends Comparable<T>> extends Base<T> implements Api, Closeable {
    private final String s = "class { \\" (";
    int[] sizes = {1, 2};

    Orders(final Store store) { this.store = store; }

    @PostMapping("/orders(new)")
    @Audited
    public Map<String, List<T>> create(@RequestBody("x") Request<T> in, int... more) throws Oops {
        if (in.ok()) {
            for (int i = 0; i < 3; i++) { store.save(in); }
        }
        run(() -> { log.info("}"); });
        return new Thing().build();
    }

    interface Inner extends A, B {
        void go();
    }

    enum Kind { ONE(1), TWO(2); Kind(int n) { check(n); } }

    @Scheduled
    void nightly() {}

    public static void main(String[] args) { helper(); }
}
"""
TEST = """@SpringBootTest class OrdersIT {
  @BeforeEach void setUp() {}
  @Test void creates() { assertEquals(1, api.get("/x")); }
}"""


@pytest.fixture(scope="module")
def files(spark):
    rows = [("Orders.java", SHOP), ("OrdersIT.java", TEST), ("Bad.java", "class A { void f( { }"), ("Empty.java", ""), ("Null.java", None)]
    return spark.createDataFrame(rows, "path string, text string")


def test_diagnostics(files):
    assert [r["path"] for r in J.diagnostics(files).collect()] == ["Bad.java"]


def test_classes(files):
    rows = {r["qualified_name"]: r for r in J.classes(files).collect()}
    assert set(rows) == {"org.shop.Orders", "org.shop.Orders.Inner", "org.shop.Orders.Kind", "OrdersIT"}
    orders = rows["org.shop.Orders"]
    assert (orders["kind"], orders["extends"], orders["interfaces"]) == ("class", "Base", ["Api", "Closeable"])
    assert orders["annotations"] == ['@RestController("a(b")']
    assert (orders["start_line"], orders["end_line"]) == (6, 33)
    assert (rows["org.shop.Orders.Inner"]["kind"], rows["org.shop.Orders.Inner"]["interfaces"]) == ("interface", ["A", "B"])
    assert rows["org.shop.Orders.Kind"]["kind"] == "enum"


def test_methods(files):
    rows = {r["signature"]: r for r in J.methods(files).where("path = 'Orders.java'").collect()}
    assert set(rows) == {"Orders(Store)", "create(Request,int...)", "go()", "Kind(int)", "nightly()", "main(String[])"}
    create = rows["create(Request,int...)"]
    assert [tuple(p) for p in create["parameters"]] == [("Request", "in"), ("int...", "more")]
    assert create["return_type"] == "Map" and rows["Orders(Store)"]["return_type"] is None
    assert create["annotations"] == ["@Audited", '@PostMapping("/orders(new)")']
    assert (create["start_line"], create["end_line"]) == (13, 21)


def test_calls(files):
    rows = J.calls(files).where("path = 'Orders.java'").collect()
    names = {m["id"]: m["name"] for m in J.methods(files).collect()}
    want = {("in", "ok", "create"), ("store", "save", "create"), (None, "run", "create"), ("log", "info", "create"), (None, "build", "create"), (None, "check", "Kind"), (None, "helper", "main")}
    assert {(r["receiver"], r["name"], names[r["method_id"]]) for r in rows} == want


def test_entry_points(files):
    rows = J.entry_points(J.methods(files)).collect()
    assert {(r["kind"], r["framework"], r["route"], r["http_method"]) for r in rows} == {("Http", "Spring MVC", "/orders(new)", "POST"), ("Scheduled", "Spring Scheduler", None, None), ("Main", None, None, None)}


def test_tests(files):
    found = J.methods(files).where("path = 'OrdersIT.java'")
    assert [r["name"] for r in J.test_cases(found).collect()] == ["creates"]
    assert [r["fixture_kind"] for r in J.fixtures(found).collect()] == ["setup"]
    assert [r["fixture_kind"] for r in J.fixtures(J.classes(files)).collect()] == ["framework"]
    assert [(r["name"], r["assertion_kind"]) for r in J.assertions(J.calls(files)).collect()] == [("assertEquals", "equality")]


def test_imports(files):
    assert {(r["symbol"], r["static"], r["line"]) for r in J.imports(files).collect()} == {("java.util.*", False, 2), ("org.x.Y.z", True, 3)}
