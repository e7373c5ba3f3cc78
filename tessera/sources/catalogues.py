"""Hand-written catalogues and reports: rules, symbol groups, build reports, module trees.

A catalogue is a few small YAML files that people write; the driver reads them, as their rules become literals of a plan. Reports are
data: Spark reads them, with a schema, from any store.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.classify import Group
from tessera.operators.rules import ApiRule, ConfigRule, Rule

# The files of a compatibility catalogue, and the list in each.
FILES = {
    "dependencies": ("dependency_compatibility.yaml", "dependencies"),
    "plugins": ("plugin_compatibility.yaml", "plugins"),
    "removed_apis": ("removed_apis.yaml", "removed_apis"),
    "deprecated_for_removal": ("deprecated_for_removal.yaml", "deprecated_for_removal"),
    "internal_apis": ("internal_apis.yaml", "internal_apis"),
    "reflective_access": ("internal_apis.yaml", "reflective_access"),
    "replacements": ("replacements.yaml", "replacements"),
}
API_FIELDS = {"symbols": "symbols", "prefixes": "symbol_prefixes", "excluded_prefixes": "except_symbol_prefixes", "patterns": "symbol_patterns"}
MATCHED = {"group_id": ("group_id", "group_id_pattern"), "artifact_id": ("artifact_id", "artifact_id_pattern"), "plugin_id": ("plugin_id",), "tool": ("tool",)}


def document(spark: SparkSession, path: str) -> dict:
    """One YAML file, read through Spark so that any store will do; ValueError where it cannot be read as a mapping."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    try:
        found = yaml.safe_load(text[0] if text else "")
    except yaml.YAMLError as e:
        raise ValueError(f"{path}: {e}") from None
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def rule(entry: Mapping) -> Rule:
    """A dependency or plugin rule: patterns of its match, minimum and recommended version by target."""
    match = entry.get("match") or {}
    patterns = {name: str(next(match[f] for f in fields if match.get(f) is not None)) for name, fields in MATCHED.items() if any(match.get(f) is not None for f in fields)}
    values = {f"{kind}_{target}": None if v is None else str(v) for kind in ("minimum", "recommended") for target, v in (entry.get(f"{kind}_version") or entry.get(kind) or {}).items()}
    return Rule(str(entry["id"]), patterns, values)


def api_rule(entry: Mapping) -> ApiRule:
    lists = {ours: tuple(map(str, entry.get(theirs) or ())) for ours, theirs in API_FIELDS.items()}
    lists["patterns"] += tuple(map(str, entry.get("patterns") or ()))
    return ApiRule(str(entry["id"]), str(entry.get("severity", "warning")), applies_from=entry.get("applies_when_target_java_at_least"), **lists)


def replacement(entry: Mapping) -> tuple[str, list[str]]:
    return str(entry["id"]), [str(x) for x in (*(entry.get("from_symbols") or ()), *(entry.get("to_symbols") or ()))]


def compatibility_catalogue(spark: SparkSession, folder: str) -> dict[str, list]:
    """All seven lists of a compatibility catalogue, from its six files; a missing file is an error, a missing list is empty."""
    makers = {"dependencies": rule, "plugins": rule, "replacements": replacement}
    documents = {f: document(spark, f"{folder}/{f}") for f in dict.fromkeys(f for f, _ in FILES.values())}
    return {name: [makers.get(name, api_rule)(x) for x in documents[f].get(key) or ()] for name, (f, key) in FILES.items()}


def symbol_registry(spark: SparkSession, path: str) -> dict[str, Group]:
    groups = document(spark, path).get("groups") or {}
    return {name: Group(*(tuple(map(str, g.get(f) or ())) for f in ("symbols", "important_symbols", "symbol_prefixes"))) for name, g in groups.items()}


def config_rules(spark: SparkSession, path: str) -> list[ConfigRule]:
    def one(e: Mapping) -> ConfigRule:
        lists = {"names": "file_names", "file_patterns": "file_name_patterns", "path_patterns": "path_patterns", "xml_roots": "xml_roots", "namespaces": "xml_namespaces", "prefixes": "property_prefixes"}
        return ConfigRule(str(e["id"]), str(e.get("config_type", "UNKNOWN")), e.get("framework"), categories=tuple(e.get("categories") or ()), **{k: tuple(e.get(v) or ()) for k, v in lists.items()})

    return [one(e) for e in document(spark, path).get("rules") or ()]


# --- build reports ---

_TOOL = "array<struct<tool:string,version:string,file:string>>"
_JAVA = "array<struct<version:string,source:string,file:string>>"
_DEPENDENCY = "array<struct<group_id:string,artifact_id:string,version:string,scope:string,file:string>>"
_PLUGIN = "array<struct<plugin_id:string,group_id:string,artifact_id:string,version:string,file:string>>"
LISTS = {"build_tools": _TOOL, "java_versions": _JAVA, "direct_dependencies": _DEPENDENCY, "direct_plugins": _PLUGIN}
_SCOPE = "struct<name:string,path:string," + ",".join(f"{k}:{v}" for k, v in LISTS.items()) + ">"
REPORT = f"project_root string, parent {_SCOPE}, modules array<{_SCOPE}>, diagnostics array<struct<message:string,file:string>>, " + ", ".join(f"{k} {v}" for k, v in LISTS.items())
STRICT = ["project_root", "parent", "modules", "diagnostics", *LISTS]


def unknown_fields(text: Column, known: list[str] = STRICT) -> Column:
    """The sorted top-level fields of a JSON object that are not known."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), F.array(*(F.lit(k) for k in known))))


def build_reports(files: DataFrame) -> DataFrame:
    """path, error and the fields of a report for each JSON file (path, text).

    A field that is not known, at the top or in a scope, and text that is no report give an error and nulls. Where all flat lists are
    empty they are made anew from the parent's and the modules' own.
    """
    scopes = F.concat(F.array(F.get_json_object("text", "$.parent")), F.coalesce(F.transform(F.from_json(F.get_json_object("text", "$.modules"), "array<string>"), lambda x: x), F.array().cast("array<string>")))
    of_scopes = F.array_distinct(F.flatten(F.transform(F.array_compact(scopes), lambda s: unknown_fields(s, ["name", "path", *LISTS]))))
    parsed = files.select("path", F.from_json("text", REPORT).alias("r"), F.concat(unknown_fields(F.col("text")), of_scopes).alias("unknown"))
    error = F.when(F.col("r.project_root").isNull(), "not a build report").when(F.size("unknown") > 0, F.concat(F.lit("unknown fields: "), F.array_join("unknown", ", ")))
    rows = parsed.withColumn("error", error).withColumn("r", F.when(F.col("error").isNull(), F.col("r"))).select("path", "error", "r.*")
    empty = F.lit(True)
    for name in LISTS:
        empty = empty & (F.size(F.coalesce(name, F.array())) == 0)
    every = F.array_compact(F.concat(F.array("parent"), F.coalesce("modules", F.array())))

    def listed(name: str) -> Column:
        return F.flatten(F.transform(every, lambda s: F.coalesce(s[name], F.array())))

    return rows.withColumns({n: F.when(empty, listed(n)).otherwise(F.col(n)) for n in LISTS})


def scope_rows(reports: DataFrame, name: str) -> DataFrame:
    """The rows of one list over the parent ("." as module_path) and all modules: project_root, module_path, ordinal and the list's fields."""
    every = F.concat(F.array(F.col("parent").withField("path", F.lit("."))), F.coalesce("modules", F.array()))
    each = reports.where("error is null").select("project_root", F.explode(F.array_compact(every)).alias("s"))
    path = F.when(F.coalesce("s.path", F.lit("")) == "", ".").otherwise(F.col("s.path"))
    return each.select("project_root", path.alias("module_path"), F.posexplode(f"s.{name}").alias("ordinal", "x")).select("project_root", "module_path", "ordinal", "x.*")


def report_modules(reports: DataFrame) -> DataFrame:
    """id, name, path, build_system, build_file of the parent and each module; of modules with one path the last counts.

    A module without a name takes its path's last part, the root that of the project.
    """
    root = F.element_at(F.split(F.regexp_replace("project_root", "/+$", ""), "/"), -1)
    every = F.concat(F.array(F.col("parent").withField("path", F.lit("."))), F.coalesce("modules", F.array()))
    each = reports.where("error is null").select(root.alias("root"), F.posexplode(F.array_compact(every)).alias("pos", "s"))
    path = F.when(F.coalesce("s.path", F.lit("")) == "", ".").otherwise(F.col("s.path"))
    default = F.when((F.col("pos") == 0) & (F.col("root") != ""), F.col("root")).when(F.col("pos") == 0, "root").otherwise(F.element_at(F.split(path, "/"), -1))
    rows = each.select("root", "pos", path.alias("path"), F.when(F.coalesce("s.name", F.lit("")) != "", F.col("s.name")).otherwise(default).alias("name"), F.get("s.build_tools", F.lit(0))["tool"].alias("build_system"), F.get("s.build_tools", F.lit(0))["file"].alias("build_file"))
    last = rows.groupBy("root", "path").agg(F.max_by(F.struct("name", "build_system", "build_file"), "pos").alias("x"))
    return last.select(F.concat(F.lit("module:"), "path").alias("id"), "path", "x.*")


def regrouped(rows: DataFrame, file: str = "file") -> DataFrame:
    """Rows with the scope that their file belongs to: module_path ("." for the parent) and module_name."""
    path = F.replace(F.coalesce(F.col(file), F.lit("")), F.lit("\\"), F.lit("/"))
    inner = F.when(path.contains("/gradle/"), F.substring_index(path, "/gradle/", 1)).otherwise(F.regexp_replace(path, "/[^/]*$", ""))
    own = F.when(~path.contains("/") | path.startswith("gradle/") | (inner == ""), ".").otherwise(inner)
    return rows.withColumn("module_path", own).withColumn("module_name", F.when(F.col("module_path") == ".", "parent").otherwise(F.element_at(F.split("module_path", "/"), -1)))


# --- nested module trees ---


def flat_modules(trees: DataFrame, column: str = "modules") -> DataFrame:
    """All modules of nested JSON trees, whatever their depth: path of places, depth, and the module's own JSON.

    `column` is a JSON list of objects with `children`. Each level is one explode of a narrow pass; the loop runs once a level, until a
    level has no children, and a checkpoint keeps a level from being read again.
    """
    level = trees.select(F.posexplode(F.from_json(column, "array<string>")).alias("place", "module")).select(F.array("place").alias("places"), F.lit(0).alias("depth"), "module")
    out = None
    while True:
        level = level.checkpoint()
        if not level.take(1):
            return level if out is None else out
        out = level if out is None else out.unionByName(level)
        below = level.select("places", "depth", F.posexplode(F.from_json(F.get_json_object("module", "$.children"), "array<string>")).alias("place", "module"))
        level = below.select(F.concat("places", F.array("place")).alias("places"), (F.col("depth") + 1).alias("depth"), "module")
