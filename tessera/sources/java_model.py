"""The model of a Java source tree with whole types: classes, methods, invocations, edges and entry points, and classes with their members.

All tables come from `java.nodes`, which reads each file once. Every row carries the chain of classes around it, and a call the methods
around it, so ids and invocations need no join. An invocation counts for every method around it, a local or anonymous class's own method
included. Annotations of a class or method are all that stand from its beginning to its end. Variadic parameters have the name "_"
and no type, as in signatures. Files with null or empty text and broken files give no rows, broken ones a diagnostic; paths that repeat
are read as one file each time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.dealing import tasks_for
from tessera.operators import classify, resolve
from tessera.sources import files as source_files
from tessera.sources import java
from tessera.sources.java import CLASS_KINDS, METHOD_KINDS, dotted

SYMBOL = "array<struct<raw:string,simple:string,values:array<string>,line:bigint>>"


def class_id(qualified: Column, line: str) -> Column:
    return F.concat(F.lit("class:"), qualified, F.lit("@"), "path", F.lit(":"), line)


def classes(nodes: DataFrame) -> DataFrame:
    """id, name, package_name, qualified_name, kind, file, lines, superclass (the first of its type texts), interfaces (type texts of what it implements), annotations."""
    qualified = dotted("package", "owner", "name")
    return nodes.where(F.col("kind").isin(CLASS_KINDS)).select(
        class_id(qualified, "line").alias("id"), "name", F.col("package").alias("package_name"), qualified.alias("qualified_name"), "kind", F.col("path").alias("file"), F.col("line").alias("start_line"), "end_line",
        F.col("extends").alias("superclass"), F.coalesce("interfaces", F.array().cast("array<string>")).alias("interfaces"), F.col("inside").alias("annotations"),
    )


def parameter_type(p: Column) -> Column:
    return F.when(~p["spread"], p["type"])


def signature(caller: Column | None = None) -> Column:
    of = F.col if caller is None else caller.getField
    return F.concat(of("name"), F.lit("("), F.array_join(F.transform(of("parameters"), lambda p: F.coalesce(parameter_type(p), F.lit("_"))), ","), F.lit(")"))


def method_id(caller: Column | None = None) -> Column:
    """The id of a row's method, or of a method around it."""
    of = F.col if caller is None else caller.getField
    return F.concat(F.lit("method:"), dotted("package", of("owner")), F.lit("#"), signature(caller), F.lit("@"), "path", F.lit(":"), of("line"))


def methods(nodes: DataFrame) -> DataFrame:
    """id, class_id, name, signature, return_type (null: constructor), parameters (name, type_name), annotations, file, lines, the name's line and column (in bytes from 0), body_text (empty without a body)."""
    given = F.transform("parameters", lambda p: F.struct(F.when(p["spread"], "_").otherwise(p["name"]).alias("name"), parameter_type(p).alias("type_name")))
    return nodes.where(F.col("kind").isin(METHOD_KINDS)).select(
        method_id().alias("id"), class_id(dotted("package", "owner"), "class_line").alias("class_id"), "name", signature().alias("signature"), F.col("type").alias("return_type"), given.alias("parameters"),
        F.col("inside").alias("annotations"), F.col("path").alias("file"), F.col("line").alias("start_line"), "end_line", "name_line", "name_column", F.col("body").alias("body_text"),
    )


def invocations(nodes: DataFrame) -> DataFrame:
    """caller_method_id, file, name, line, column, expression, literal: one row for each call and each method around it."""
    each = nodes.where("kind = 'call' AND path IS NOT NULL").select("path", "package", "name", "line", "column", "expression", "literal", F.explode("callers").alias("caller"))
    return each.select(method_id(F.col("caller")).alias("caller_method_id"), F.col("path").alias("file"), "name", "line", "column", "expression", "literal")


def relationships(found: DataFrame, called: DataFrame) -> DataFrame:
    """What classes extend and implement and which names methods call, as edges to targets that are not yet resolved."""

    def edge(rows: DataFrame, source: str, target: Column, kind: str, confidence: float) -> DataFrame:
        return rows.select(F.col(source).alias("source_id"), target.alias("target_id"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit("tree_sitter").alias("source"))

    # fixed values: kinds, prefixes of unresolved targets, confidences
    implemented = found.select("id", F.explode("interfaces").alias("type"))
    extended = found.where("superclass is not null")
    return (
        edge(implemented, "id", F.concat(F.lit("type:"), "type"), "IMPLEMENTS", 0.6)
        .unionByName(edge(extended, "id", F.concat(F.lit("type:"), "superclass"), "EXTENDS", 0.6))
        .unionByName(edge(called, "caller_method_id", F.concat(F.lit("unresolved-call:"), "name"), "CALLS", 0.25))
    )


def model(files: DataFrame, modules: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a tree's production sources; with `modules` (id, path) classes and methods take the module whose path holds their file."""
    nodes = java.nodes(source_files.production_sources(files)).persist()
    found, own, called = classes(nodes), methods(nodes), invocations(nodes)
    if modules is not None:
        owners = modules.select(F.col("path").alias("prefix"), F.col("id").alias("module_id"))
        found, own = (resolve.longest_prefix_owner(t, owners, "file", "prefix", "module_id") for t in (found, own))
    entries = java.entry_points(own).withColumn("source", F.when(F.col("kind") == "Main", "tree_sitter").otherwise("heuristic"))
    return {"classes": found, "methods": own, "invocations": called, "relationships": relationships(found, called), "entry_points": entries, "diagnostics": java.broken(nodes)}


# --- classes with their members, for classification ---


def registry_symbols(registry: classify.Registry) -> Iterable[tuple[str]]:
    return sorted({(s,) for g in registry.values() for s in (*g.symbols, *g.important_symbols)})


def resolved_names(wanted: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, simple and values: each simple name with what it may mean by the file's imports, its imports of packages, and known symbols.

    Imports and symbols are indexed by their last part and met by equi-joins, so a row never scans a list of names. A simple name's
    symbols are gathered into one row before the join, so a name that is everywhere meets one row. Columns read: path, simple / path,
    symbol / symbol. Nulls match nothing; rows that repeat count once.
    """
    wanted = wanted.select("path", "simple").distinct()
    known = symbols.select("symbol", F.substring_index("symbol", ".", -1).alias("simple")).groupBy("simple").agg(F.collect_set("symbol").alias("found"))
    parts = imports.select("path", "symbol").distinct()
    named = parts.where("contains(symbol, '.')").select("path", F.substring_index("symbol", ".", -1).alias("simple"), "symbol").groupBy("path", "simple").agg(F.collect_set("symbol").alias("named"))
    packages = parts.where("endswith(symbol, '.*')").groupBy("path").agg(F.collect_set(F.regexp_replace("symbol", r"(\.\*)+$", "")).alias("packages"))
    none = F.array().cast("array<string>")
    out = wanted.join(named, ["path", "simple"], "left").join(packages, "path", "left").join(known, "simple", "left")
    below = F.transform(F.coalesce("packages", none), lambda p: F.concat(p, F.lit("."), "simple"))
    return out.select("path", "simple", F.array_sort(F.array_distinct(F.concat(F.array("simple"), F.coalesce("named", none), below, F.coalesce("found", none)))).alias("values"))


def symbols_of(raw: Column, line: Column) -> Column:
    """Annotations as symbols whose values are not yet known; they take the line of what they mark."""
    return F.transform(raw, lambda a: F.struct(a.alias("raw"), T.annotation_name(a).alias("simple"), F.lit(None).cast("array<string>").alias("values"), line.alias("line")))


def source_classes(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """The outermost classes of all files with their fields, methods and parameters, as `classify.CLASSES` but for module_id.

    Members of nested classes count for the outermost class; those inside methods and initial values are left out. Rows meet by (path,
    outermost class) in one shuffle, and names by `resolved_names` with `symbols` (symbol), the registry.
    """
    top = F.coalesce("top", "node")
    given = F.transform("parameters", lambda p: F.struct(parameter_type(p).alias("type_name"), p["line"].alias("line"), symbols_of(p["annotations"], p["line"]).alias("annotations")))
    field = F.struct("node", F.struct("name", F.col("type").alias("type_name"), "line", symbols_of(F.col("inside"), F.col("line")).alias("annotations")).alias("it"))
    method = F.struct("node", F.struct("name", F.col("type").alias("return_type"), "line", symbols_of(F.col("inside"), F.col("line")).alias("annotations"), given.alias("parameters")).alias("it"))
    is_top = F.col("top").isNull() & F.col("kind").isin(CLASS_KINDS)
    head = F.struct(
        "name", dotted("package", "name").alias("qualified_name"), "kind", F.col("path").alias("file"), F.col("line").alias("start_line"), "end_line", symbols_of(F.col("inside"), F.col("line")).alias("annotations"),
        F.col("extends").alias("superclass"), F.coalesce("interfaces", F.array().cast("array<string>")).alias("interfaces"),
    )
    member = ~F.col("loose") & F.col("top").isNotNull()
    rows = nodes.where(is_top | (member & F.col("kind").isin("field", *METHOD_KINDS))).select(
        "path", top.alias("top_node"), F.when(is_top, head).alias("head"), F.when(F.col("kind") == "field", field).alias("field"), F.when(F.col("kind").isin(METHOD_KINDS), method).alias("method")
    )
    whole = rows.groupBy("path", "top_node").agg(F.first("head", ignorenulls=True).alias("head"), F.array_sort(F.collect_list("field"), lambda a, b: a["node"] - b["node"])["it"].alias("fields"), F.array_sort(F.collect_list("method"), lambda a, b: a["node"] - b["node"])["it"].alias("methods"))
    whole = whole.select("path", "head.*", "fields", "methods")
    every = F.concat("annotations", F.flatten(F.col("fields")["annotations"]), F.flatten(F.col("methods")["annotations"]), F.flatten(F.flatten(F.transform("methods", lambda m: m["parameters"]["annotations"]))))
    wanted = whole.select("path", F.explode(F.array_distinct(every["simple"])).alias("simple"))
    imports = java.imports_of(nodes)
    names = resolved_names(wanted, imports, symbols).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("simple", "values"))).alias("names__"))

    def known(found: Column) -> Column:
        return F.transform(found, lambda s: s.withField("values", F.try_element_at("names__", s["simple"])))

    def parameter(p: Column) -> Column:
        return p.withField("annotations", known(p["annotations"]))

    return (
        whole.join(names, "path", "left")
        .withColumns(
            {
                "annotations": known(F.col("annotations")),
                "fields": F.transform("fields", lambda f: f.withField("annotations", known(f["annotations"]))),
                "methods": F.transform("methods", lambda m: m.withField("annotations", known(m["annotations"])).withField("parameters", F.transform(m["parameters"], parameter))),
            }
        )
        .drop("path", "names__")
    )


def classification(files: DataFrame, modules: DataFrame, dependencies: DataFrame, registry: classify.Registry, resolved: DataFrame | None = None) -> dict[str, DataFrame]:
    """Source text to a classification: all tables of `classify.classified`, and the diagnostics.

    modules: id, path; dependencies: module_id, ordinal, group_id, artifact_id, version; resolved: file, line, values of a language server.
    """
    sources = files.where("endswith(path, '.java')")
    nodes = java.nodes(sources).persist()
    symbols = files.sparkSession.createDataFrame(registry_symbols(registry), "symbol string")
    found = source_classes(nodes, symbols)
    if resolved is not None:
        found = classify.with_resolved_symbols(found, resolved)
    # the classes are kept below, so that their number, not a setting, tells how many parts they are
    tasks = tasks_for(nodes.where(F.col("top").isNull() & F.col("kind").isin(CLASS_KINDS)))
    if tasks > 1:
        found = found.repartition(tasks, "file")
    owners = modules.select(F.col("path").alias("prefix"), F.col("id").alias("module_id"))
    owned = resolve.longest_prefix_owner(found, owners, "file", "prefix", "module_id").withColumn("module_id", F.coalesce("module_id", F.lit(classify.ROOT)))
    return {**classify.classified(owned.persist(), dependencies, registry), "diagnostics": java.broken(nodes)}
