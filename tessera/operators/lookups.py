"""The read-only lookups over the extracted tables and the graph: 15 bounded functions, each a DataFrame.

Tables are a dict of DataFrames by name. A lookup over many ids at once is the same function over a join: every bound is per key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import truncated
from tessera.operators.graph import both_directions, top_per_key

Tables = Mapping[str, DataFrame]
MOST = 20
#: lengths at which body and expression texts are cut
BODY, EXPRESSION = 4000, 1000


def clamped(limit: int | None) -> int:
    """1 to 20, 20 by default."""
    return MOST if limit is None else max(1, min(MOST, int(limit)))


def contains_text(column: str, text: str) -> Column:
    """Case-insensitive substring test in which %, _ and the backslash are plain characters."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.col(column).ilike(f"%{escaped}%")


def get_method(t: Tables, method_id: str) -> DataFrame:
    m, c = t["methods"].where(F.col("id") == method_id), t["classes"]
    return m.join(c.select(F.col("id").alias("class_id"), "qualified_name", F.col("kind").alias("class_kind")), "class_id")


def get_method_relationships(t: Tables, method_ids: list[str], limit: int | None = None) -> DataFrame:
    """Edges of the methods in both directions, best first; the other end's name is null where it is not a known method."""
    ids = F.col("node_id").isin(method_ids)
    seen = top_per_key(both_directions(t["relationships"]).where(ids), ["node_id", "direction"], [F.desc("confidence"), F.col("id")], clamped(limit))
    return seen.join(t["methods"].select(F.col("id").alias("other_id"), F.col("name").alias("other_name")), "other_id", "left")


def get_method_analysis(t: Tables, method_id: str) -> DataFrame:
    """Score, priority and the 20 heaviest signals in one row."""
    own = t["candidate_signals"].where(F.col("method_id") == method_id)
    signals = top_per_key(own, ["method_id"], [F.desc("weight"), F.col("name")], MOST)
    listed = signals.groupBy("method_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("order"), "name", "count"))).alias("signals"))
    return t["candidate_scores"].where(F.col("method_id") == method_id).join(listed, "method_id", "left")


def numbered_lines(files: DataFrame) -> DataFrame:
    """path, line_number (from 1), line: without a final empty line and without carriage returns."""
    lines = F.split(F.regexp_replace("text", r"\r?\n\z", ""), r"\r?\n", -1)
    return files.select("path", F.posexplode(lines).alias("pos", "line")).select("path", (F.col("pos") + 1).cast("long").alias("line_number"), "line")


def read_source_range(files: DataFrame, path: str, start: int, end: int, most: int | None = None) -> DataFrame:
    """Numbered lines of a file, both ends included, `most` at most. A path that leaves the tree is refused."""
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"path leaves the source tree: {path}")
    end = end if most is None else min(end, start + most - 1)
    return numbered_lines(files.where(F.col("path") == path)).where(F.col("line_number").between(start, end)).orderBy("line_number")


def read_method_source(t: Tables, files: DataFrame, method_id: str) -> DataFrame:
    """Numbered lines of a method, at most 81."""
    m = t["methods"].where(F.col("id") == method_id).select(F.col("file").alias("path"), "start_line", "end_line")
    lines = numbered_lines(files.join(m.select("path"), "path", "left_semi"))
    return lines.join(m, "path").where(F.col("line_number").between(F.col("start_line"), F.least("end_line", F.col("start_line") + 80))).select("path", "line_number", "line").orderBy("line_number")


def get_related_method(t: Tables, allowed: DataFrame, method_id: str) -> DataFrame:
    """A method that earlier reads have surfaced (`allowed`, column id); any other gives no row."""
    return get_method(t, method_id).join(allowed.select("id").distinct(), "id", "left_semi")


def search_methods(t: Tables, text: str, limit: int | None = None) -> DataFrame:
    return t["methods"].where(contains_text("name", text) | contains_text("signature", text)).orderBy("name", "id").limit(clamped(limit))


def search_classes(t: Tables, text: str, limit: int | None = None) -> DataFrame:
    return t["classes"].where(contains_text("name", text) | contains_text("qualified_name", text)).orderBy("qualified_name", "id").limit(clamped(limit))


def find_business_nodes(t: Tables, text: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
    rows = t["business_nodes"].where(contains_text("name", text) | contains_text("statement", text))
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    return rows.orderBy(F.desc("created_at"), "id").limit(clamped(limit))


def get_business_node(t: Tables, node_id: str) -> DataFrame:
    return t["business_nodes"].where(F.col("id") == node_id)


def get_business_neighbors(t: Tables, node_ids: list[str], limit: int | None = None) -> DataFrame:
    seen = both_directions(t["business_edges"]).where(F.col("node_id").isin(node_ids))
    joined = seen.join(t["business_nodes"].select(F.col("id").alias("other_id"), F.col("name").alias("other_name"), F.col("kind").alias("other_kind")), "other_id")
    return top_per_key(joined, ["node_id", "direction"], [F.col("id")], clamped(limit))


def get_tests_for_method(t: Tables, method_ids: list[str], limit: int | None = None) -> DataFrame:
    targets = t["test_targets"].where((F.col("target_kind") == "method") & F.col("target_id").isin(method_ids))
    joined = targets.select("target_id", "confidence", "relationship", F.col("test_case_id").alias("id")).join(t["test_cases"], "id")
    return top_per_key(joined, ["target_id"], [F.desc("confidence"), F.col("file"), F.col("start_line"), F.col("id")], clamped(limit))


def get_test_case(t: Tables, case_id: str) -> DataFrame:
    suites = t["test_suites"].select(F.col("id").alias("suite_id"), F.col("qualified_name").alias("suite_name"))
    return t["test_cases"].where(F.col("id") == case_id).join(suites, "suite_id", "left").withColumn("body_text", truncated(F.col("body_text"), BODY, "…"))


def _of_case(t: Tables, table: str, case_id: str, order: list[str], limit: int | None) -> DataFrame:
    return t[table].where(F.col("test_case_id") == case_id).orderBy(*order).limit(clamped(limit))


def get_test_assertions(t: Tables, case_id: str, limit: int | None = None) -> DataFrame:
    return _of_case(t, "test_assertions", case_id, ["line", "id"], limit).withColumn("expression", truncated(F.col("expression"), EXPRESSION, "…"))


def get_test_entry_points(t: Tables, case_id: str, limit: int | None = None) -> DataFrame:
    return _of_case(t, "test_entry_points", case_id, ["id"], limit)


def get_test_fixtures(t: Tables, case_id: str, limit: int | None = None) -> DataFrame:
    """Fixtures of the case and of its suite, labelled."""
    suite = t["test_cases"].where(F.col("id") == case_id).select("suite_id")
    f = t["test_fixtures"]
    own = f.where(F.col("test_case_id") == case_id).withColumn("scope", F.lit("case"))
    shared = f.where("test_case_id is null").join(suite, "suite_id", "left_semi").select(*f.columns).withColumn("scope", F.lit("suite"))
    return own.unionByName(shared).orderBy("line", "id").limit(clamped(limit))


def entry_points_of(t: Tables, method_ids: list[str], limit: int = 5) -> DataFrame:
    """The first entry points of each method, by id."""
    return top_per_key(t["entry_points"].where(F.col("method_id").isin(method_ids)), ["method_id"], [F.col("id")], limit)


def recent_nodes(t: Tables, limit: int | None = None) -> DataFrame:
    return t["business_nodes"].orderBy(F.desc("created_at"), "id").limit(clamped(limit))


def behaviours_in_order(nodes: DataFrame, kinds: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Nodes by kind, name and id, cut to `limit`."""
    rows = nodes if kinds is None else nodes.where(F.col("kind").isin(kinds))
    ordered = rows.orderBy("kind", "name", "id")
    return ordered if limit is None else ordered.limit(limit)


#: what is read of a method to write a test of it (`contexts`): table, key, order and bound
CONTEXT = {
    "entry_points": ("method_id", ["kind", "route", "http_method", "id"], 5),
    "signals": ("method_id", ["-weight", "-count", "name"], 8),
    "tests": ("target_id", ["file", "start_line", "id"], 5),
    "assertions": ("test_case_id", ["line", "id"], 6),
    "fixtures": ("test_case_id", ["line", "id"], 6),
    "test_entry_points": ("test_case_id", ["kind", "route", "http_method", "id"], 4),
}


def bounded_context(rows: DataFrame, part: str) -> DataFrame:
    """The rows of one part of the context, for all its keys at once, within the part's bound."""
    key, order, most = CONTEXT[part]
    return top_per_key(rows, [key], [F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in order], most)


def java_files(t: Tables) -> DataFrame:
    """The distinct files of test cases and of the methods they target."""
    targeted = t["methods"].join(t["test_targets"].where("target_kind = 'method'").select(F.col("target_id").alias("id")), "id", "left_semi")
    return t["test_cases"].select("file").unionByName(targeted.select("file")).where("file is not null").distinct()


#: lookups that may be made for a method
CALLS = 5


def allowed_calls(calls: DataFrame, most: int = CALLS) -> DataFrame:
    """The first `most` lookups of each method in the order they were asked (method_id, seq); later ones are refused."""
    return top_per_key(calls, ["method_id"], [F.col("seq")], most)


def ranked_by(rows: DataFrame, column: str, ranks: list[str], then: list[str], limit: int) -> DataFrame:
    """The first rows in the order of a listed ranking of a column's values, values that are not listed last, then of further columns."""
    place = F.coalesce(F.nullif(F.array_position(F.lit(ranks), F.col(column)), F.lit(0)), F.lit(len(ranks) + 1))
    return rows.orderBy(place, *then).limit(limit)


def with_names(rows: DataFrame, known: DataFrame, key: str, name: str, otherwise: str | None = None) -> DataFrame:
    """`rows` with the name that `known` (key, name; one row a key) gives their key, `otherwise` where it gives none."""
    found = rows.join(known.select(key, name), key, "left")
    return found if otherwise is None else found.withColumn(name, F.coalesce(name, F.lit(otherwise)))


def related_ids(rows: DataFrame, t: Tables) -> DataFrame:
    """`rows` (method_id) with what is known of the method and of its class, each looked up by one join; unknown ids stay with nulls."""
    m = t["methods"].select(F.col("id").alias("method_id"), "class_id", F.col("name").alias("method_name"), "file")
    c = t["classes"].select(F.col("id").alias("class_id"), "qualified_name")
    return rows.join(m, "method_id", "left").join(c, "class_id", "left")


def row_counts(t: Tables) -> DataFrame:
    """name and n of each table; only counts meet."""
    parts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in t.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- the row browser ---


def table_schema(table: DataFrame) -> DataFrame:
    """name, type, nullable, position of each column, from the schema alone."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable, i) for i, f in enumerate(table.schema.fields)]
    return table.sparkSession.createDataFrame(rows, "name string, type string, nullable boolean, position int")


def page(table: DataFrame, keys: list[str], limit: int = 20, offset: int = 0) -> DataFrame:
    """Rows of one page in key order, 1 to 100 of them."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("a page has 1 to 100 rows from offset 0")
    return table.orderBy(*require_columns(table, keys)).offset(offset).limit(limit)


def require_columns(table: DataFrame, names: list[str]) -> list[str]:
    if unknown := [n for n in names if n not in table.columns]:
        raise ValueError(f"unknown columns: {unknown}")
    return names
