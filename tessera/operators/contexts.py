"""What is known of a method, in one row: entry points, signals and tests, and of each test assertions, fixtures and entry points.

The parts are streams of one shape, tagged by their name, each with its own order and bound. One window over all streams keeps the first
rows of each method and part, cutting them before the shuffle too, so a method that a third of all rows belong to costs a few rows a task;
the kept rows, a bounded number a method, then become one row. Tests are filled in the same way first, by test case.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tessera.functions import text as T
from tessera.operators.lookups import CONTEXT

Tables = Mapping[str, DataFrame]

ENTRY = "struct<kind:string,framework:string,http_method:string,route:string>"
SIGNAL = "struct<name:string,count:bigint,weight:bigint>"
TEST = f"struct<suite_name:string,case_name:string,file:string,start_line:bigint,end_line:bigint,assertions:array<string>,fixtures:array<string>,entry_points:array<{ENTRY}>>"
#: columns of an order, numbers and texts in turn, so that every part's order fits one type
PLACES = 4


def place(rows: DataFrame, order: list[str]) -> Column:
    """The columns of an order as one struct of a type that all parts share; nulls are first, as in the store."""
    fields = []
    for i in range(PLACES):
        name = order[i] if i < len(order) else None
        column = None if name is None else -F.col(name[1:]) if name.startswith("-") else F.col(name)
        numeric = column is not None and (name.startswith("-") or isinstance(rows.schema[name].dataType, NumericType))
        fields += [(column if numeric else F.lit(None)).cast("double").alias(f"n{i}"), (column if column is not None and not numeric else F.lit(None)).cast("string").alias(f"s{i}")]
    return F.struct(*fields)


def stream(rows: DataFrame, part: str, payload: dict[str, Column], kinds: dict[str, str]) -> DataFrame:
    """key, part, place, and the part's payload beside nulls for the others."""
    key, order, _ = CONTEXT[part]
    values = [payload[k].cast(kind).alias(k) if k in payload else F.lit(None).cast(kind).alias(k) for k, kind in kinds.items()]
    return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lit(part).alias("part"), place(rows, order).alias("place"), *values)


def gathered(streams: list[DataFrame], parts: dict[str, str]) -> DataFrame:
    """key and for each part (name: its payload column) the array of its first rows in order."""
    rows = streams[0]
    for s in streams[1:]:
        rows = rows.unionByName(s)
    most = max(CONTEXT[p][2] for p in parts)
    ranked = rows.withColumn("rank__", F.row_number().over(Window.partitionBy("key", "part").orderBy("place"))).where(F.col("rank__") <= most)
    bound = F.create_map(*(F.lit(x) for p in parts for x in (p, CONTEXT[p][2])))
    kept = ranked.where(F.col("rank__") <= F.element_at(bound, F.col("part")))
    arrays = [F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("rank__", F.col(c).alias("it"))))), lambda x: x["it"]).alias(p) for p, c in parts.items()]
    return kept.groupBy("key").agg(*arrays)


def entry_of(rows: DataFrame) -> Column:
    fields = [F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in ("kind", "framework", "http_method", "route")]
    return F.struct(*(f.alias(c) for f, c in zip(fields, ("kind", "framework", "http_method", "route"), strict=True)))


def case_details(t: Tables, cases: DataFrame) -> DataFrame:
    """test_case_id with assertions, fixtures and test_entry_points of the cases (id) that have any."""
    wanted = cases.select(F.col("id").alias("test_case_id")).distinct()
    of = {name: t[table].join(wanted, "test_case_id", "left_semi") for name, table in (("assertions", "test_assertions"), ("fixtures", "test_fixtures"), ("test_entry_points", "test_entry_points"))}
    kinds = {"text": "string", "entry": ENTRY}
    streams = [
        stream(of["assertions"], "assertions", {"text": F.concat_ws(": ", "assertion_kind", "expression")}, kinds),
        stream(of["fixtures"], "fixtures", {"text": F.concat_ws(": ", "fixture_kind", "name")}, kinds),
        stream(of["test_entry_points"], "test_entry_points", {"entry": entry_of(of["test_entry_points"])}, kinds),
    ]
    return gathered(streams, {"assertions": "text", "fixtures": "text", "test_entry_points": "entry"}).withColumnRenamed("key", "test_case_id")


def related_tests(t: Tables) -> DataFrame:
    """target_id and the columns of each test case of a method, with its suite's class_name; case and suite by their ids."""
    suites = t["test_suites"].select(F.col("id").alias("suite_id"), F.col("class_name").alias("suite_name"))
    targets = t["test_targets"].where("target_kind = 'method'").select("target_id", F.col("test_case_id").alias("id"))
    return targets.join(t["test_cases"].select("id", "suite_id", "name", "file", "start_line", "end_line"), "id").join(suites, "suite_id", "left").drop("suite_id")


def method_contexts(t: Tables, methods: DataFrame) -> DataFrame:
    """One row for each of `methods` (id): method_id, entry_points, signals and tests, empty arrays where nothing is known.

    Ids that repeat give one row; a null id gives none. Tables read: entry_points, candidate_signals, test_targets, test_cases,
    test_suites, test_assertions, test_fixtures, test_entry_points.
    """
    wanted = methods.where("id is not null").select(F.col("id").alias("method_id")).distinct()
    targeted = related_tests({**t, "test_targets": t["test_targets"].join(wanted.withColumnRenamed("method_id", "target_id"), "target_id", "left_semi")})
    first = Window.partitionBy("target_id").orderBy("place")
    tests = targeted.withColumn("place", place(targeted, CONTEXT["tests"][1])).withColumn("rank__", F.row_number().over(first)).where(F.col("rank__") <= CONTEXT["tests"][2]).drop("rank__", "place")
    details = case_details(t, tests).withColumnRenamed("test_case_id", "id")
    none = F.array()
    tests = tests.join(details, "id", "left")
    filled = F.struct(
        "suite_name", F.col("name").alias("case_name"), "file", "start_line", "end_line", F.coalesce("assertions", none).alias("assertions"), F.coalesce("fixtures", none).alias("fixtures"), F.coalesce("test_entry_points", none).alias("entry_points")
    )
    own = {name: t[name].join(wanted, "method_id", "left_semi") for name in ("entry_points", "candidate_signals")}
    kinds = {"entry": ENTRY, "signal": SIGNAL, "test": TEST}
    streams = [
        stream(own["entry_points"], "entry_points", {"entry": entry_of(own["entry_points"])}, kinds),
        stream(own["candidate_signals"], "signals", {"signal": F.struct("name", "count", "weight")}, kinds),
        stream(tests, "tests", {"test": filled}, kinds),
    ]
    found = gathered(streams, {"entry_points": "entry", "signals": "signal", "tests": "test"}).withColumnRenamed("key", "method_id")
    whole = wanted.join(found, "method_id", "left")
    return whole.select("method_id", *(F.coalesce(p, none).alias(p) for p in ("entry_points", "signals", "tests")))


# --- the same as text ---
# The wording of the lines, here and below.


def said(value: Column, otherwise: str = "unknown") -> Column:
    """A value as text of a comment, on one line."""
    return F.replace(T.comment_text(F.coalesce(value.cast("string"), F.lit(otherwise))), F.lit("\n"), F.lit(" "))


def listed(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.array_join(lines, "")).otherwise(F.lit(" * - none found\n"))


def entry_line(mark: str, e: Column) -> Column:
    return F.concat(F.lit(f" * {mark}kind="), said(e["kind"]), F.lit(" framework="), said(e["framework"]), F.lit(" method="), said(e["http_method"]), F.lit(" route="), said(e["route"]), F.lit("\n"))


def rendered(contexts: DataFrame) -> DataFrame:
    """method_id and the texts of its entry points, signals and tests, as lines of a comment; "none found" for an empty part."""

    def signal(s: Column) -> Column:
        return F.concat(F.lit(" * - "), said(s["name"]), F.lit(" count="), s["count"].cast("string"), F.lit(" weight="), s["weight"].cast("string"), F.lit("\n"))

    def detail(kind: str, texts: Column) -> Column:
        return F.array_join(F.transform(texts, lambda x: F.concat(F.lit(f" *   {kind}: "), said(x), F.lit("\n"))), "")

    def test(x: Column) -> Column:
        lines = F.when(x["start_line"].isNotNull() & x["end_line"].isNotNull(), F.concat_ws("-", x["start_line"].cast("string"), x["end_line"].cast("string"))).otherwise("unknown")
        head = F.concat(F.lit(" * - "), said(x["suite_name"], "unknown suite"), F.lit("#"), said(x["case_name"]), F.lit(" at "), said(x["file"]), F.lit(":"), lines, F.lit("\n"))
        entries = F.array_join(F.transform(x["entry_points"], lambda e: entry_line("  entry point: ", e)), "")
        return F.concat(head, entries, detail("assertion", x["assertions"]), detail("fixture", x["fixtures"]))

    return contexts.select(
        "method_id",
        listed(F.transform("entry_points", lambda e: entry_line("- ", e))).alias("entry_points"),
        listed(F.transform("signals", signal)).alias("signals"),
        listed(F.transform("tests", test)).alias("tests"),
    )
