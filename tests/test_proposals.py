"""The commit of proposals: whole methods are refused for a bad node, edges one by one, and nothing is inserted twice."""

import pytest

from tessera.operators import upsert

EVIDENCE = "array<struct<method_id:string,source_lines:array<bigint>,reason:string>>"
SCHEMA = (
    f"method_id string, start_line bigint, end_line bigint, nodes array<struct<client_id:string,kind:string,name:string,statement:string,confidence:double,evidence:{EVIDENCE}>>, "
    f"edges array<struct<source_client_id:string,source_node_id:string,target_client_id:string,target_node_id:string,source:string,target:string,kind:string,confidence:double,reason:string,source_lines:array<bigint>,evidence:{EVIDENCE}>>"
)


def evidence(m, *lines, reason="seen"):
    return [{"method_id": m, "source_lines": list(lines), "reason": reason}]


def node(m, client, name="Limit", **other):
    return {"client_id": client, "kind": "BusinessRule", "name": name, "statement": f"{name} holds", "confidence": 0.9, "evidence": evidence(m, 3), **other}


def edge(**other):
    return {k: other.get(k) for k in ("source_client_id", "source_node_id", "target_client_id", "target_node_id", "source", "target", "reason")} | {"kind": "DEPENDS_ON", "confidence": 0.5, "source_lines": [], "evidence": [], **other}


def proposals(spark, *rows):
    return spark.createDataFrame([(m, 1, 10, nodes, edges) for m, nodes, edges in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "id string"), spark.createDataFrame([], "source_id string, target_id string, kind string")


def test_same_proposal_twice(spark, empty):
    p = proposals(spark, ("m1", [node("m1", "a")], []), ("m2", [node("m2", "a", name="  limit ", statement="Limit   HOLDS")], []))
    out = upsert.commit(p, *empty, 1)
    (row,) = out["nodes"].collect()
    assert (row["method_id"], row["created_by_run_id"]) == ("m1", 1)
    assert {r["method_id"] for r in out["evidence"].collect()} == {"m1", "m2"}
    assert upsert.commit(p, out["nodes"].select("id"), empty[1], 2)["nodes"].count() == 0


@pytest.mark.parametrize(
    "bad",
    [{"evidence": []}, {"kind": "Nonsense"}, {"confidence": 1.5}, {"name": "  "}, {"evidence": evidence("m9", 3)}, {"evidence": evidence("m1", 11)}, {"evidence": evidence("m1", 4, 3)}, {"evidence": evidence("m1", 3, reason=" ")}, {"client_id": "a"}],
)
def test_a_bad_node_rejects_its_method(spark, empty, bad):
    second = node("m1", **{"client": bad.get("client_id", "b"), "name": "Other"} | {k: v for k, v in bad.items() if k != "client_id"})
    out = upsert.commit(proposals(spark, ("m1", [node("m1", "a"), second], []), ("m2", [node("m2", "a")], [])), *empty, 1)
    assert [r["method_id"] for r in out["nodes"].collect()] == ["m2"]


def test_edges_one_by_one(spark, empty):
    nodes = [node("m1", "a"), node("m1", "b", name="Other")]
    good = edge(source_client_id="a", target_client_id="b", evidence=evidence("m1", 4))
    edges = [
        good,
        edge(source_client_id="a", target_client_id="zz", evidence=evidence("m1", 4)),
        edge(source_client_id="a", source_node_id="business-node:x", target_client_id="b", evidence=evidence("m1", 4)),
        edge(source="b", target="business-node:known", confidence=0.0, reason="calls"),
        edge(source="b", target="a", kind="NONSENSE", reason="calls"),
        edge(source="b", target="a", reason=" "),
    ]
    out = upsert.commit(proposals(spark, ("m1", nodes, edges)), *empty, 3)
    ids = {r["name"]: r["id"] for r in out["nodes"].collect()}
    rows = {(r["source_id"], r["target_id"]): r["confidence"] for r in out["edges"].collect()}
    assert rows == {(ids["Limit"], ids["Other"]): 0.5, (ids["Other"], "business-node:known"): 0.75}
    made = [r for r in out["evidence"].collect() if r["edge_key"] and "known" in r["edge_key"]]
    assert [(r["source_lines"], r["reason"]) for r in made] == [([3], "calls")]


def stored(spark, store, new):
    """The store after a commit, as its next reader finds it."""
    return {k: spark.createDataFrame([*store[k].collect(), *new[k].select(*store[k].columns).collect()], store[k].schema) for k in store}


def test_a_batch_committed_twice_adds_nothing(spark):
    store = {k: spark.createDataFrame([], s) for k, s in upsert.STORE.items()}
    nodes = [node("m1", "a"), node("m1", "b", name="Other", evidence=evidence("m1", 3) + evidence("m1", 3, reason="also") + evidence("m1", 3))]
    edges = [edge(source_client_id="a", target_client_id="b", evidence=evidence("m1", 4)), edge(source="b", target="business-node:known", reason="calls")]
    first = proposals(spark, ("m1", nodes, edges))
    store = stored(spark, store, upsert.commit_to(store, first, 1))
    assert {k: v.count() for k, v in store.items()} == {"nodes": 2, "edges": 2, "evidence": 5}
    assert {k: v.count() for k, v in upsert.commit_to(store, first, 2).items()} == {"nodes": 0, "edges": 0, "evidence": 0}
    # another method says the same of the same edge: evidence of the stored edge's id, and no new edge
    second = proposals(spark, ("m2", [node("m2", "x"), node("m2", "y", name="Other")], [edge(source_client_id="x", target_client_id="y", evidence=evidence("m2", 4))]))
    new = upsert.commit_to(store, second, 3)
    assert (new["nodes"].count(), new["edges"].count()) == (0, 0)
    ids = {r["target_id"]: r["id"] for r in store["edges"].collect()}
    rows = [(r["edge_id"], r["method_id"], r["source_lines_json"], r["created_by_run_id"]) for r in new["evidence"].collect()]
    known = next(v for k, v in ids.items() if k != "business-node:known")
    assert sorted(rows, key=repr) == sorted([(known, "m2", "[4]", 3), (None, "m2", "[3]", 3), (None, "m2", "[3]", 3)], key=repr)
    again = stored(spark, store, new)
    assert again["edges"].select("id").distinct().count() == again["edges"].count() == 2
    third = upsert.commit_to(again, proposals(spark, ("m3", [node("m3", "p", name="P"), node("m3", "q", name="Q")], [edge(source_client_id="p", target_client_id="q", evidence=evidence("m3", 4))])), 4)
    assert third["edges"].first()["id"] > max(ids.values())
