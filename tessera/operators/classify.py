"""Classes told apart as entities, repositories, endpoints' bodies and transfer objects, with evidence and the dependencies they use.

`classes` holds one row a class: module_id, name, qualified_name, kind, file, start_line, end_line, annotations, superclass, interfaces,
fields and methods (see CLASSES). Members stay nested, so each row's signs are array expressions and nothing is gathered by class; rows
meet others only where a dependency, a body's class or a duplicate is looked up, always by an equi-join or a combining aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import annotation_value, generic_argument, unwrapped
from tessera.operators.graph import first_per_key

SYMBOLS = "array<struct<raw:string,simple:string,values:array<string>,line:bigint>>"
CLASSES = (
    f"module_id string, name string, qualified_name string, kind string, file string, start_line bigint, end_line bigint, annotations {SYMBOLS}, superclass string, interfaces array<string>, "
    f"fields array<struct<name:string,type_name:string,line:bigint,annotations:{SYMBOLS}>>, "
    f"methods array<struct<name:string,return_type:string,line:bigint,annotations:{SYMBOLS},parameters:array<struct<type_name:string,line:bigint,annotations:{SYMBOLS}>>>>"
)
DEPENDENCY = "struct<group_id:string,artifact_id:string,version:string>"
ROOT = "module:."

# The annotations, type names and prefixes that classes are told by.
ENTITY = ["Entity", "Embeddable", "MappedSuperclass"]
COLUMN = ["Column", "Id", "Embedded", "EmbeddedId", "OneToOne", "OneToMany", "ManyToOne", "ManyToMany", "JoinColumn"]
CONTROLLER = ["RestController", "Controller", "Path"]
ENDPOINT = ["RequestMapping", "GetMapping", "PostMapping", "PutMapping", "PatchMapping", "DeleteMapping", "Path", "GET", "POST", "PUT", "PATCH", "DELETE"]
FRAMEWORK_TYPES = ["HttpServletRequest", "HttpServletResponse", "HttpExchange", "UriInfo", "HttpHeaders"]
QUERY_PREFIXES = ["find", "read", "get", "count", "exists", "delete"]
PERSISTENCE = ["jakarta_persistence", "javax_persistence", "hibernate"]
#: prefixes of symbols and the group of each, the first that fits
SYMBOL_GROUPS = [
    ("org.springframework.web", "spring_mvc"),
    ("org.springframework.http", "spring_mvc"),
    ("org.springframework.data.jpa", "spring_data_jpa"),
    ("org.springframework.data", "spring_data"),
    ("jakarta.persistence", "jakarta_persistence"),
    ("javax.persistence", "javax_persistence"),
    ("org.hibernate", "hibernate"),
    ("jakarta.ws.rs", "jakarta_rest"),
    ("javax.ws.rs", "jakarta_rest"),
    ("jakarta.servlet", "jakarta_servlet"),
    ("javax.servlet", "jakarta_servlet"),
    ("java.sql", "jdbc"),
    ("javax.sql", "jdbc"),
]


@dataclass(frozen=True)
class Group:
    """Symbols of a registry's group; a literal of a hand-written catalogue."""

    symbols: tuple[str, ...] = ()
    important_symbols: tuple[str, ...] = ()
    symbol_prefixes: tuple[str, ...] = ()

    def matches(self, value: Column) -> Column:
        hit = value.isin([*self.symbols, *self.important_symbols])
        for p in self.symbol_prefixes:
            hit = hit | value.startswith(p)
        return hit


Registry = Mapping[str, Group]


def in_group(registry: Registry, group: str, value: Column) -> Column:
    """Whether a registry's group holds a symbol; "persistence" stands for three further groups too."""
    hit = F.lit(False)
    for name in [group, *(PERSISTENCE if group == "persistence" else [])]:
        if name in registry:
            hit = hit | registry[name].matches(value)
    return hit


def in_registry(registry: Registry, value: Column) -> Column:
    hit = F.lit(False)
    for g in registry.values():
        hit = hit | g.matches(value)
    return hit


def candidate_values(simple: Column, imports: Column, registry: Registry) -> Column:
    """A simple name with its whole names by imports, by imports of whole packages, and by the registry; sorted, each once."""
    named = F.filter(imports, lambda i: i.endswith(F.concat(F.lit("."), simple)))
    below = F.transform(F.filter(imports, lambda i: i.endswith(".*") & ~i.endswith(F.concat(F.lit("."), simple))), lambda i: F.concat(F.regexp_replace(i, r"(\.\*)+$", ""), F.lit("."), simple))
    known = F.array(*(F.lit(s) for g in registry.values() for s in (*g.symbols, *g.important_symbols))).cast("array<string>")
    of_registry = F.filter(known, lambda s: F.substring_index(s, ".", -1) == simple)
    return F.array_sort(F.array_distinct(F.concat(F.array(simple), named, below, of_registry)))


def has_any(annotations: Column, names: list[str]) -> Column:
    return F.exists(annotations, lambda a: a["simple"].isin(names))


def with_resolved_symbols(classes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Classes whose annotations, those of members and parameters too, hold the resolved symbols (file, line, values) of their lines as well.

    The answers are collected by file first, so each class meets one row.
    """
    by_file = resolved.groupBy("file").agg(F.collect_list(F.struct("line", "values")).alias("resolved__"))

    def merged(symbols: Column) -> Column:
        def one(s: Column) -> Column:
            found = F.flatten(F.transform(F.filter("resolved__", lambda r: r["line"] == s["line"]), lambda r: r["values"]))
            return s.withField("values", F.when(F.size(found) > 0, F.array_sort(F.array_distinct(F.concat(s["values"], found)))).otherwise(s["values"]))

        return F.when(F.col("resolved__").isNull(), symbols).otherwise(F.transform(symbols, one))

    def parameter(p: Column) -> Column:
        return p.withField("annotations", merged(p["annotations"]))

    return (
        classes.join(by_file, "file", "left")
        .withColumns(
            {
                "annotations": merged(F.col("annotations")),
                "fields": F.transform("fields", lambda f: f.withField("annotations", merged(f["annotations"]))),
                "methods": F.transform("methods", lambda m: m.withField("annotations", merged(m["annotations"])).withField("parameters", F.transform(m["parameters"], parameter))),
            }
        )
        .select(*classes.columns)
    )


# --- dependencies ---


def symbol_group(symbol: Column) -> Column:
    out = F.lit(None).cast("string")
    for prefix, group in reversed(SYMBOL_GROUPS):
        out = F.when(symbol.startswith(prefix), group).otherwise(out)
    return out


def dependency_groups(group_id: Column, artifact_id: Column) -> Column:
    """The groups that a declared dependency provides."""
    g, a = F.coalesce(group_id, F.lit("")), artifact_id
    tests = {
        "spring_mvc": (g == "org.springframework") | (a == "spring-boot-starter-web"),
        "spring_data": g == "org.springframework.data",
        "spring_data_jpa": a.isin("spring-data-jpa", "spring-boot-starter-data-jpa"),
        "jakarta_persistence": a == "jakarta.persistence-api",
        "javax_persistence": a == "javax.persistence-api",
        "hibernate": g.isin("org.hibernate", "org.hibernate.orm"),
        "jakarta_rest": a.endswith("ws.rs-api") | g.contains("jersey") | g.contains("resteasy"),
        "jakarta_servlet": a.endswith("servlet-api"),
    }
    return F.array_compact(F.array(*(F.when(test, name) for name, test in tests.items())))


def first_dependencies(dependencies: DataFrame) -> DataFrame:
    """module_id and, by group, the first dependency declared in it. Columns read: module_id, ordinal, group_id, artifact_id, version."""
    each = dependencies.withColumn("group", F.explode(dependency_groups(F.col("group_id"), F.col("artifact_id"))))
    first = each.groupBy("module_id", "group").agg(F.min_by(F.struct("group_id", "artifact_id", "version"), "ordinal").alias("dependency"))
    return first.groupBy("module_id").agg(F.map_from_entries(F.collect_list(F.struct("group", "dependency"))).alias("deps"))  # a row holds 8 groups at most


def with_dependencies(classes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Classes with `deps`, the first dependency of each group: that of their own module, else the root's."""
    own = first_dependencies(dependencies)
    none = F.create_map().cast(f"map<string,{DEPENDENCY}>")
    root = own.where(F.col("module_id") == ROOT).select("deps").scalar()  # one row at most, which a scalar subquery gives to all
    out = classes.join(own, "module_id", "left").withColumn("root__", root)
    both = F.map_zip_with(F.coalesce("deps", none), F.coalesce("root__", none), lambda k, a, b: F.coalesce(a, b))
    return out.withColumn("deps", both).select(*classes.columns, "deps")


def dependency_of(group: Column) -> Column:
    return F.try_element_at("deps", group)


# --- evidence: array<struct<source, symbol, dependency>> ---


def distinct_evidence(evidence: Column) -> Column:
    """Evidence once for each (source, symbol), the first, in order."""
    return F.filter(evidence, lambda e, i: ~F.exists(F.slice(evidence, F.lit(1), i), lambda x: (x["source"] == e["source"]) & (x["symbol"] == e["symbol"])))


def evidence_of(symbols: Column, group: str, registry: Registry) -> Column:
    """The symbols' values that the group, or any group of the registry, holds."""
    values = F.filter(F.array_distinct(F.flatten(F.transform(symbols, lambda s: s["values"]))), lambda v: in_group(registry, group, v) | in_registry(registry, v))
    return F.transform(values, lambda v: F.struct(F.lit("tree_sitter_jdtls").alias("source"), v.alias("symbol"), dependency_of(symbol_group(v)).alias("dependency")))


def sign(symbol: Column, *groups: str) -> Column:
    return F.struct(F.lit("tree_sitter").alias("source"), symbol.alias("symbol"), F.coalesce(*(dependency_of(F.lit(g)) for g in groups)).alias("dependency"))


def no_evidence() -> Column:
    return F.array().cast(f"array<struct<source:string,symbol:string,dependency:{DEPENDENCY}>>")


def is_repository_type(name: Column) -> Column:
    return name.contains("Repository")


def repository_evidence(registry: Registry) -> Column:
    supertypes = F.array_compact(F.concat(F.col("interfaces"), F.array("superclass")))
    of_types = F.transform(F.filter(supertypes, is_repository_type), lambda t: sign(t, "spring_data_jpa", "spring_data"))
    annotations = F.flatten(F.transform("methods", lambda m: m["annotations"]))
    of_queries = F.when(has_any(annotations, ["Query"]), evidence_of(annotations, "spring_data_jpa", registry)).otherwise(no_evidence())
    own = F.col("name").endswith("Repository") & F.exists("fields", lambda f: F.coalesce(f["type_name"].contains("EntityManager") | f["type_name"].contains("Connection"), F.lit(False)))
    of_fields = F.when(own, F.array(sign(F.lit("custom_repository"), "jakarta_persistence", "jdbc"))).otherwise(no_evidence())
    return distinct_evidence(F.concat(of_types, of_queries, of_fields))


# --- rows ---


def table_name() -> Column:
    """The name in the class's @Table annotation, else null."""
    return annotation_value(F.get(F.filter("annotations", lambda a: a["simple"] == "Table"), F.lit(0))["raw"])


def query_methods() -> Column:
    """Sorted distinct names of the methods that query: by annotation or by the name's beginning."""
    found = F.filter("methods", lambda m: has_any(m["annotations"], ["Query"]) | F.regexp_like(m["name"], F.lit(f"^({'|'.join(QUERY_PREFIXES)})")))
    return F.array_sort(F.array_distinct(F.transform(found, lambda m: m["name"])))


def response_type(return_type: Column) -> Column:
    """The type in a response's body: null for void, the argument of a wrapping entity, else the type itself."""
    wrapped = return_type.contains("ResponseEntity") | return_type.contains("HttpEntity")
    return F.when(return_type.isin("void", "Void"), None).when(wrapped, generic_argument(return_type)).otherwise(return_type)


def is_framework_parameter(type_name: Column) -> Column:
    hit = F.lit(False)
    for t in FRAMEWORK_TYPES:
        hit = hit | type_name.contains(t)
    return F.coalesce(hit, F.lit(False))


def signed(classes: DataFrame, dependencies: DataFrame, registry: Registry) -> DataFrame:
    """Classes with their dependencies, evidence and the marks entity and repository."""
    out = with_dependencies(classes, dependencies).withColumns({"entity_evidence": evidence_of(F.col("annotations"), "persistence", registry), "repository_evidence": repository_evidence(registry)})
    return out.withColumns({"is_entity": has_any(F.col("annotations"), ENTITY), "is_repository": F.size("repository_evidence") > 0})


PLACE = ["module_id", "file", "start_line", "end_line"]


def entities(found: DataFrame) -> DataFrame:
    rows = found.where("is_entity").select("qualified_name", *PLACE, table_name().alias("table_name"), F.col("entity_evidence").alias("evidence"))
    return first_per_key(rows, ["qualified_name"], [F.col("file"), F.col("start_line")])


def tables(found: DataFrame) -> DataFrame:
    rows = found.where("is_entity").select(
        F.col("qualified_name").alias("entity"), "module_id", "file", F.col("start_line").alias("line"), F.coalesce(table_name(), "name").alias("name"),
        F.when(has_any(F.col("annotations"), ["Table"]), "annotation").otherwise("class_name").alias("source"), F.col("entity_evidence").alias("evidence"),
    )
    return first_per_key(rows, ["entity", "name"], [F.col("file"), F.col("line")])


def columns(found: DataFrame, registry: Registry) -> DataFrame:
    each = found.where("is_entity").select(F.col("qualified_name").alias("entity"), "module_id", "file", "deps", F.explode("fields").alias("f")).where(has_any(F.col("f.annotations"), COLUMN))
    names = F.filter(F.transform("f.annotations", lambda a: annotation_value(a["raw"])), lambda n: n.isNotNull())
    rows = each.select(
        "entity", "module_id", "file", "f.line", F.col("f.name").alias("field_name"), F.col("f.type_name").alias("java_type"), F.coalesce(F.get(names, F.lit(0)), "f.name").alias("column_name"),
        F.lit("annotation").alias("source"), evidence_of(F.col("f.annotations"), "persistence", registry).alias("evidence"),
    )
    return first_per_key(rows, ["entity", "field_name"], [F.col("file"), F.col("line")])


def repositories(found: DataFrame) -> DataFrame:
    entity = F.filter(F.transform(F.filter("interfaces", is_repository_type), generic_argument), lambda t: t.isNotNull())
    rows = found.where("is_repository").select("qualified_name", *PLACE, F.get(entity, F.lit(0)).alias("entity_type"), query_methods().alias("query_methods"), F.col("repository_evidence").alias("evidence"))
    return first_per_key(rows, ["qualified_name"], [F.col("file"), F.col("start_line")])


def bodies(found: DataFrame, registry: Registry) -> DataFrame:
    """Request and response bodies of endpoints, each with its place in the order of files, methods and parameters: body, owner, method, type_name, line, evidence, seq."""
    own = ["module_id", "file", "start_line", "end_line", F.col("qualified_name").alias("owner")]
    controller = has_any(F.col("annotations"), CONTROLLER)
    each = found.select(*own, "deps", controller.alias("controller"), F.posexplode("methods").alias("m_pos", "m")).withColumn("endpoint", F.col("controller") & has_any(F.col("m.annotations"), ENDPOINT))
    asked = each.select("*", F.posexplode("m.parameters").alias("p_pos", "p")).withColumn("marked", has_any(F.col("p.annotations"), ["RequestBody"]))
    asked = asked.where(F.col("p.type_name").isNotNull() & (F.col("marked") | (F.col("endpoint") & ~is_framework_parameter(F.col("p.type_name")))))
    place = [*PLACE, "owner", F.col("m.name").alias("method")]
    requests = asked.select(
        F.lit("request_body").alias("body"), *place, F.col("p.type_name").alias("type_name"), F.col("p.line").alias("line"),
        F.when(F.col("marked"), evidence_of(F.col("p.annotations"), "spring_mvc", registry)).otherwise(no_evidence()).alias("evidence"), F.struct("file", "start_line", "m_pos", F.lit(0).alias("k"), "p_pos").alias("seq"),
    )
    answered = each.where("endpoint").withColumn("type_name", response_type(F.col("m.return_type"))).where("type_name is not null")
    responses = answered.select(
        F.lit("response_body").alias("body"), *place, "type_name", F.col("m.line").alias("line"), evidence_of(F.col("m.annotations"), "spring_mvc", registry).alias("evidence"),
        F.struct("file", "start_line", "m_pos", F.lit(1).alias("k"), F.lit(0).alias("p_pos")).alias("seq"),
    )
    return requests.unionByName(responses)


def body_rows(found: DataFrame, registry: Registry) -> DataFrame:
    """The first of each (body, owner, method, type_name)."""
    rows = bodies(found, registry).drop("start_line", "end_line")
    return first_per_key(rows, ["body", "owner", "method", "type_name"], [F.col("seq")]).drop("seq")


def class_index(found: DataFrame) -> DataFrame:
    """The class of each simple and qualified name; of classes that share one the last by place."""
    entry = found.select(F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("key"), F.struct("qualified_name", "kind", *PLACE).alias("class"))
    return entry.groupBy("key").agg(F.max_by("class", F.struct("class.file", "class.start_line")).alias("class"))


def transfer_objects(found: DataFrame, registry: Registry) -> DataFrame:
    """Body types with their own class's place where that is known, else their endpoint's; the first of each module and name, with seq."""
    each = bodies(found, registry).withColumn("key", unwrapped(F.col("type_name"))).join(class_index(found), "key", "left")
    of = lambda name, other: F.coalesce(F.col(f"class.{name}"), other).alias(name)
    rows = each.select(of("qualified_name", F.col("key")), of("kind", F.lit("class_or_record")), *(of(p, F.col(p)) for p in PLACE), F.col("body").alias("classification"), "evidence", "seq")
    return first_per_key(rows, ["module_id", "qualified_name"], [F.col("seq")])


def models(found: DataFrame, registry: Registry) -> DataFrame:
    """One row a qualified name: its transfer object or its entity or repository, whichever comes first."""
    dto = transfer_objects(found, registry)
    kind = F.when(F.col("is_entity"), "entity").otherwise("repository")
    last = F.struct("file", "start_line", F.lit(1 << 30).alias("m_pos"), F.lit(0).alias("k"), F.lit(0).alias("p_pos"))
    own = found.where("is_entity or is_repository").select("qualified_name", "kind", *PLACE, kind.alias("classification"), F.col("entity_evidence").alias("evidence"), last.alias("seq"))
    return first_per_key(dto.unionByName(own), ["qualified_name"], [F.col("seq")]).drop("seq")


def classified(classes: DataFrame, dependencies: DataFrame, registry: Registry) -> dict[str, DataFrame]:
    """All tables of a classification by name; the marks of classes, which all tables start from, are worked out once and kept."""
    found = signed(classes, dependencies, registry).persist()
    body = body_rows(found, registry)
    return {
        "models": models(found, registry),
        "dtos": transfer_objects(found, registry).drop("seq"),
        "request_bodies": body.where("body = 'request_body'").drop("body"),
        "response_bodies": body.where("body = 'response_body'").drop("body"),
        "repositories": repositories(found),
        "entities": entities(found),
        "tables": tables(found),
        "columns": columns(found, registry),
    }


def used_dependencies(rows: Mapping[str, DataFrame]) -> DataFrame:
    """module_id and each dependency that evidence of its rows names, once."""
    parts = [t.select("module_id", F.explode("evidence").alias("e")).select("module_id", "e.dependency.*").where("artifact_id is not null") for t in rows.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def summary(modules: DataFrame, rows: Mapping[str, DataFrame]) -> DataFrame:
    """One row: the number of modules and of each table's rows; only counts meet."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in {"modules": modules, **rows}.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy().pivot("name", ["modules", *rows]).agg(F.first("n"))


# --- the module tree and the tasks it gives ---


def module_tree(modules: DataFrame) -> DataFrame:
    """Modules (id, name, path) with parent_id (the longest proper prefix of the path, else the root; null for the root) and depth."""
    from tessera.operators.resolve import path_prefixes

    names = modules.select(F.col("path").alias("prefix"), F.col("id").alias("above"))
    each = modules.withColumn("prefix", F.explode(path_prefixes(F.col("path"), proper=True))).where("prefix <> path").join(names, "prefix")
    found = each.groupBy("id").agg(F.max_by("above", F.length("prefix") - (F.col("prefix") == ".").cast("int")).alias("parent_id"), F.count(F.lit(1)).cast("int").alias("depth"))
    return modules.join(found, "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


ROW_TYPES = ["models", "dtos", "request_bodies", "response_bodies", "repositories", "entities", "tables", "columns"]


def task_name(row: DataFrame) -> Column:
    """The first of qualified_name, type_name, entity that a row has; else owner and method; else "unknown"."""
    have = [c for c in ("qualified_name", "type_name", "entity") if c in row.columns]
    filled = [F.when(F.col(c) != "", F.col(c)) for c in have]
    pair = [F.when((F.col("owner") != "") & (F.col("method") != ""), F.concat_ws(".", "owner", "method"))] if {"owner", "method"} <= set(row.columns) else []
    return F.coalesce(*filled, *pair, F.lit("unknown"))


def tasks(modules: DataFrame, rows: Mapping[str, DataFrame]) -> DataFrame:
    """Work items of all classified rows with a file: task_id, row_type, name, module_path, source_file, start_line, in that path, file, line, type and name order."""
    paths = modules.select(F.col("id").alias("module_id"), F.col("path").alias("module_path"))
    out = None
    for kind, t in rows.items():
        line = next(c for c in ("start_line", "line") if c in t.columns)
        part = t.where("file <> ''").select("module_id", F.lit(kind).alias("row_type"), task_name(t).alias("name"), F.col("file").alias("source_file"), F.coalesce(F.col(line), F.lit(0)).alias("start_line"))
        out = part if out is None else out.unionByName(part)
    named = out.join(paths, "module_id").withColumn("task_id", F.concat_ws(":", "module_id", "row_type", "name", "source_file", "start_line"))
    return named.select("task_id", "row_type", "name", "module_path", "source_file", "start_line").orderBy("module_path", "source_file", "start_line", "row_type", "name")


# The skills that every task takes, and those told by words in its dependencies or by its kind.
SKILLS = ["version-rewrite-modernization", "java-best-practices", "java-lombok-modernization"]
SKILL_SIGNS = [
    ("spring-boot-best-practices", ["spring-boot"], []),
    ("spring-mvc-best-practices", ["spring-web", "spring-mvc", "starter-web"], ["request_bodies", "response_bodies"]),
    ("spring-security-best-practices", ["spring-security", "starter-security"], []),
    ("database-orm-best-practices", ["hibernate", "spring-data-jpa", "starter-data-jpa", "data-jpa", "jakarta.persistence", "javax.persistence"], ["entities", "repositories"]),
    ("junit-mockito-testing-best-practices", ["junit", "mockito"], []),
]


def task_skills(dependency_text: Column, row_type: Column) -> Column:
    """The skills of a task in order, each once."""
    text = F.lower(dependency_text)
    hits = [F.when(F.coalesce(F.regexp_like(text, F.lit("|".join(s.replace(".", "\\.") for s in signs))), F.lit(False)) | row_type.isin(kinds), name) for name, signs, kinds in SKILL_SIGNS]
    hits.append(F.when(text.contains("jakarta") & ~text.contains("spring-boot"), "jakarta-ee-best-practices"))
    return F.array_distinct(F.array_compact(F.array(*(F.lit(s) for s in SKILLS), *hits)))
