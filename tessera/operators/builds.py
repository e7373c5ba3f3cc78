"""Scopes of builds: which modules declare something, which class paths a declaration stands on, which Java a module is written for."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.catalogues import regrouped

# The class paths that a Gradle configuration stands on, and the kinds that tell a source's Java version.
BOTH, TESTS = ["compileClasspath", "runtimeClasspath"], ["testCompileClasspath", "testRuntimeClasspath"]
CLASS_PATHS = {
    "api": BOTH, "compile": BOTH, "compileOnly": BOTH, "implementation": BOTH, "runtime": ["runtimeClasspath"], "runtimeOnly": ["runtimeClasspath"],
    "testCompile": TESTS, "testCompileOnly": TESTS, "testImplementation": TESTS, "testRuntime": ["testRuntimeClasspath"], "testRuntimeOnly": ["testRuntimeClasspath"], "classpath": [],
}
SOURCE_KINDS = ["release", "source", "target"]
# The tables of each store.
TABLES = {
    "extraction": [
        "modules", "classes", "methods", "relationships", "entry_points", "candidate_scores", "candidate_signals", "evidence_ranges", "context_packets", "diagnostics",
        "test_suites", "test_cases", "test_targets", "test_assertions", "test_fixtures", "test_entry_points", "test_diagnostics",
    ],
    "graph": ["llm_extraction_runs", "business_nodes", "business_edges", "business_evidence"],
    "characterization": [
        "characterization_runs", "characterization_behaviors", "characterization_scenarios", "characterization_inputs", "characterization_observations", "characterization_files", "characterization_fakes", "characterization_diagnostics",
    ],
}


def require_tables(tables: Mapping[str, DataFrame], names: list[str], store: str) -> None:
    """ValueError unless all tables are there."""
    if missing := [n for n in names if n not in tables]:
        raise ValueError(f"{store} lacks the tables {', '.join(missing)}")


def scopes(declared: DataFrame, ending: str | None = None) -> DataFrame:
    """The distinct module_path of declared rows ("." for the root), of files with one ending if told."""
    rows = declared.where("file is not null")
    rows = rows if ending is None else rows.where(F.col("file").endswith(ending))
    return regrouped(rows.select("file")).select("module_path").distinct()


def class_paths(configuration: Column) -> Column:
    """The class paths of a configuration in order; one that is not known stands on its own."""
    out = F.array(configuration)
    for name, paths in CLASS_PATHS.items():
        out = F.when(configuration == name, F.array(*(F.lit(p) for p in paths)).cast("array<string>")).otherwise(out)
    return out


def scope_class_paths(dependencies: DataFrame) -> DataFrame:
    """module_path, class_path, ordinal (from 0) of each scope's class paths, each once, in the order of the declarations (ordinal)."""
    from pyspark.sql import Window

    rows = regrouped(dependencies.where("configuration is not null")).select("module_path", "ordinal", F.posexplode(class_paths(F.col("configuration"))).alias("pos", "class_path"))
    first = rows.groupBy("module_path", "class_path").agg(F.min(F.struct("ordinal", "pos")).alias("at"))
    return first.select("module_path", "class_path", (F.row_number().over(Window.partitionBy("module_path").orderBy("at")) - 1).alias("ordinal"))


def scoped_task(module_path: Column, task: str) -> Column:
    """A task's name within a scope."""
    return F.when(module_path == ".", F.lit(task)).otherwise(F.concat(F.lit(":"), F.replace(module_path, F.lit("/"), F.lit(":")), F.lit(f":{task}")))


def coordinates(group_id: Column, artifact_id: Column) -> Column:
    """group:artifact, the group empty where there is none."""
    return F.concat(F.coalesce(group_id, F.lit("")), F.lit(":"), artifact_id)


def effective_versions(declared: DataFrame, resolved: DataFrame) -> DataFrame:
    """Declared dependencies with the version that their scope resolved for the same coordinates (no group equals no group), where it has one; the first by ordinal counts."""
    first = resolved.groupBy("module_path", coordinates(F.col("group_id"), F.col("artifact_id")).alias("key__")).agg(F.min_by(F.struct("version"), "ordinal").alias("found__"))
    rows = regrouped(declared).withColumn("key__", coordinates(F.col("group_id"), F.col("artifact_id"))).join(first, ["module_path", "key__"], "left")
    return rows.withColumn("version", F.coalesce("found__.version", "version")).select(*declared.columns)


def source_java(versions: DataFrame, modules: DataFrame) -> DataFrame:
    """Modules (module_path) with source_java: the first of a preferred kind in the module, else its first, else the same of all rows."""
    preferred = F.struct(~F.col("kind").isin(SOURCE_KINDS), F.col("ordinal"))
    rows = regrouped(versions)
    own = rows.groupBy("module_path").agg(F.min_by("version", preferred).alias("own"))
    every = rows.groupBy().agg(F.min_by("version", preferred).alias("every")).withColumn("one", F.lit(1))
    return modules.withColumn("one", F.lit(1)).join(own, "module_path", "left").join(F.broadcast(every), "one", "left").withColumn("source_java", F.coalesce("own", "every")).select(*modules.columns, "source_java")


def target_value(values: Column, target: int) -> Column:
    """What a map by target version says for one target, else null."""
    return F.try_element_at(values, F.lit(str(target)))


def module_summaries(modules: DataFrame, used: DataFrame) -> DataFrame:
    """id, name, path and used_dependencies (sorted coordinates) of each module."""
    listed = used.groupBy(F.col("module_id").alias("id")).agg(F.array_sort(F.collect_set(coordinates(F.col("group_id"), F.col("artifact_id")))).alias("used_dependencies"))
    return modules.select("id", "name", "path").join(listed, "id", "left").withColumn("used_dependencies", F.coalesce("used_dependencies", F.array().cast("array<string>")))


def task_contexts(tasks: DataFrame, summaries: DataFrame, root: str, workspace: str) -> DataFrame:
    """Each task with its module's summary, its source file and where the rewritten file is expected."""
    named = summaries.select(F.col("path").alias("module_path"), F.struct("id", "name", "path", "used_dependencies").alias("module"))
    place = lambda base: F.concat(F.lit(base.rstrip("/") + "/"), "source_file")
    return tasks.join(named, "module_path", "left").withColumns({"source_path": place(root), "expected_path": place(workspace)})


def pending_tasks(tasks: DataFrame, existing: DataFrame) -> DataFrame:
    """Tasks whose rewritten file (column path) does not exist yet."""
    return tasks.join(existing.select(F.col("path").alias("source_file")).distinct(), "source_file", "left_anti")


def type_texts(text: Column) -> Column:
    """The sorted distinct types in a type's text: itself, the generic types within it and all names; Map<String, List<T>> has five."""
    name = r"[A-Za-z_$][A-Za-z0-9_$.]*"
    forms = [name]
    for _ in range(3):  # generic types, three deep
        forms.append(rf"{name}(?:\s*<(?:[^<>]|<[^<>]*>|<(?:[^<>]|<[^<>]*>)*>)*>)" if len(forms) == 3 else rf"{name}(?:\s*<(?:[^<>]{'|<[^<>]*>' * (len(forms) - 1)})*>)")
    found = [F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9_$.])({p})"), F.lit(1)) for p in forms]
    parts = F.transform(F.concat(F.array(text), *found), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.rlike("^[A-Za-z_$]"))))
