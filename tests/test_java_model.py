"""From Java text to ranked candidates, and the model of tests."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, score
from tessera.sources import java as J

SERVICE = '''package org.shop;

@Service
public class Orders {
    private final Store store;

    @Transactional
    public Status approve(Order order) {
        if (order.total() > 10) {
            throw new IllegalStateException("} {");
        }
        order.status = Status.OPEN; /* ( */
        store.save(order);
        return order.status;
    }

    void idle() {}
}
'''
TESTS = '''package org.shop;

@SpringBootTest
@ActiveProfiles("it")
class OrdersIT {
    @BeforeEach
    void setUp() { when(store.find(1)).thenReturn(null); }

    @Test
    @DisplayName("approves an order")
    void approves() {
        mock(Store.class);
        String body = client.getForObject("/orders/1", String.class);
        assertThat(body).isEqualTo("ok");
        mvc.perform(post("/orders")).andExpect(status().isOk());
        assertNotNull(body);
        queue.send("topic-a", body);
    }

    void shouldReject() { assertSame(a, run("x")); }

    void helper() {}
}
'''


@pytest.fixture(scope="module")
def files(spark):
    rows = [("svc/src/main/java/Orders.java", SERVICE), ("svc/src/it/OrdersIT.java", TESTS), ("svc/target/Gen.java", SERVICE), ("Null.java", None)]
    return spark.createDataFrame(rows, "path string, text string")


def test_text_to_candidates(spark, files):
    modules = spark.createDataFrame([("module:.", "."), ("module:svc", "svc")], "id string, path string")
    model = J.production_model(files, modules)
    methods = {r["name"]: r for r in model["methods"].collect()}
    assert set(methods) == {"approve", "idle"}
    approve = methods["approve"]
    assert approve["body_text"] == SERVICE[SERVICE.index("Order order) {") + 13 : SERVICE.index("    void idle") - 2].rstrip()
    assert (approve["name_line"], approve["name_column"], approve["file"], approve["module_id"]) == (8, 18, "svc/src/main/java/Orders.java", "module:svc")
    assert methods["idle"]["body_text"] == "{}"
    scores = score.candidate_scores(model["methods"])
    ranked = score.select_candidates(model["methods"], model["classes"], scores, "high", 10).collect()
    assert [(r["name"], r["qualified_name"], r["priority"]) for r in ranked] == [("approve", "org.shop.Orders", "high")]
    assert score.evidence_ranges(model["methods"]).count() == 2
    edges = {r["target_id"] for r in graph.distinct_edges(model["relationships"]).collect()}
    assert edges == {"unresolved:order.total", "unresolved:store.save"}
    assert model["counters"].first().asDict() == {"production": 2, "ignored": 1, "generated_path": 0, "generated_text": 0, "test": 1}


def test_test_model(files):
    model = {k: v.collect() for k, v in J.test_model(files.where("path like '%IT.java'")).items()}
    (suite,) = model["suites"]
    assert (suite["class_name"], suite["qualified_name"], suite["test_kind"], suite["id"]) == ("OrdersIT", "org.shop.OrdersIT", "integration", "test-suite:org.shop.OrdersIT@svc/src/it/OrdersIT.java:3")
    assert {(c["name"], c["display_name"]) for c in model["cases"]} == {("approves", "approves an order"), ("shouldReject", None)}
    case = next(c for c in model["cases"] if c["name"] == "approves")
    assert case["body_text"].startswith("{\n        mock(") and case["body_text"].endswith('body);\n    }')
    assert {(f["fixture_kind"], f["name"]) for f in model["fixtures"]} == {("framework", "SpringBootTest"), ("configuration", "ActiveProfiles"), ("setup", "setUp"), ("mock", "mock")}
    found = {(a["assertion_kind"], a["expression"], a["expected_value"]) for a in model["assertions"]}
    assert found == {
        ("assertion", "assertThat(body)", None),
        ("equality", 'assertThat(body).isEqualTo("ok")', "ok"),
        ("status_or_response", 'mvc.perform(post("/orders")).andExpect(status().isOk())', "/orders"),
        ("status_or_response", "status()", None),
        ("assertion", "assertNotNull(body)", None),
        ("assertion", 'assertSame(a, run("x"))', "x"),
    }
    entries = {(e["kind"], e["framework"], e["route"], e["http_method"], e["topic"]) for e in model["entry_points"]}
    assert entries == {("Http", "HTTP client", "/orders/1", "GET", None), ("Http", "MockMvc", "/orders", "POST", None), ("Http", "HTTP client", "/orders", "POST", None), ("Message", None, None, None, "topic-a")}
    assert not model["diagnostics"] and len(model["invocations"]) == 13


@pytest.mark.parametrize(
    "path, marks, want",
    [("a/E2eFlow.java", [], "e2e"), ("a/acceptance/B.java", [], "acceptance"), ("a/CIT.java", [], "integration"), ("a/D.java", ["@org.x.Testcontainers(1)"], "integration"), ("a/E.java", ["@Test"], "unknown_test"), ("a/integration/e2e.java", [], "e2e")],
)
def test_kinds(spark, path, marks, want):
    row = spark.createDataFrame([(path, marks)], "p string, a array<string>").select(J.test_kind(F.col("p"), F.col("a")))
    assert row.first()[0] == want


def test_candidates(files):
    rows = {(r["kind"], r["name"]): r["values"] for r in J.syntax_candidates(files.where("path like '%main%'")).collect()}
    assert rows["call", "save(order)"] == ["save(order)", "store.save(order)"]
    assert ("annotation", "@Transactional") in rows and ("annotation", "@Service") in rows
