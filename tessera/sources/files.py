"""Files of a source tree as DataFrames: listing, path and content predicates, formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are skipped, folders and name endings of tests, signs of generated code, build files.
SKIPPED = [".git", "target", "build", ".gradle", ".idea"]
INTEGRATION_FOLDERS = ["integrationtest", "integration-test", "integrationtests", "integration-tests", "acceptancetest", "acceptance-test", "acceptancetests", "acceptance-tests"]
TEST_FOLDERS = ["test", "tests", "testsrc", *INTEGRATION_FOLDERS]
END_TO_END_FOLDERS = ["e2e", "e2etest", "e2e-test", "e2etests", "e2e-tests"]
GENERATED_FOLDERS = ["generated", "generated-sources", "generated-src", "generatedsources", "gensrc", "autogen", "auto-generated", ".openapi-generator"]
INTEGRATION_NAMES = ["IT.java", "ITCase.java", "IntegrationTest.java", "IntegrationTests.java", "AcceptanceTest.java", "AcceptanceTests.java"]
TEST_NAMES = ["Test.java", "Tests.java", *INTEGRATION_NAMES, "Spec.java"]
END_TO_END_NAMES = ["E2ETest.java", "E2ETests.java"]
GENERATED_SIGNS = ["@Generated", "@javax.annotation.Generated", "@jakarta.annotation.Generated", "<auto-generated", "AUTO-GENERATED", "Auto-generated", "Generated by", "This file was generated", "do not edit", "DO NOT EDIT"]
BUILD_FILES = ["pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "gradle-wrapper.properties", "libs.versions.toml"]
FORMATS = {"properties": "properties", "env": "env", "yml": "yaml", "yaml": "yaml", "xml": "xml", "wsdl": "xml", "xsd": "xml", "json": "json", "graphql": "graphql", "graphqls": "graphql", "proto": "proto", "avsc": "avro", "avdl": "avro", "avpr": "avro", "sql": "sql"}
HEAD = 4096


def source_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path (relative to `root`) and text of all files under it, read by Spark from any store it knows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    inner = F.regexp_replace("path", r"^[a-zA-Z0-9+.-]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return files.select(F.replace(inner, F.lit(base), F.lit("")).alias("path"), F.decode("content", "UTF-8").alias("text"))


def folders(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def has_folder(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(folders(path), F.array(*(F.lit(n) for n in names)))


def ends_with_any(path: Column, endings: list[str]) -> Column:
    hit = F.lit(False)
    for e in endings:
        hit = hit | path.endswith(e)
    return hit


def generated_text(text: Column) -> Column:
    head = F.left(F.coalesce(text, F.lit("")), F.lit(HEAD))
    hit = F.lit(False)
    for sign in GENERATED_SIGNS:
        hit = hit | head.contains(sign)
    return hit


def classified(files: DataFrame) -> DataFrame:
    """`files` with what becomes of each: ignored, generated_path, generated_text, test or production."""
    path = F.col("path")
    kind = (
        F.when(has_folder(path, SKIPPED), "ignored")
        .when(has_folder(path, GENERATED_FOLDERS), "generated_path")
        .when(has_folder(path, TEST_FOLDERS) | ends_with_any(path, TEST_NAMES), "test")
        .when(generated_text(F.col("text")), "generated_text")
        .otherwise("production")
    )
    return files.withColumn("kind", kind)


def production_sources(files: DataFrame) -> DataFrame:
    return classified(files).where("kind = 'production'").drop("kind")


def integration_tests(files: DataFrame) -> DataFrame:
    """Integration and end-to-end tests that are not generated."""
    path = F.col("path")
    wanted = has_folder(path, INTEGRATION_FOLDERS + END_TO_END_FOLDERS) | ends_with_any(path, INTEGRATION_NAMES + END_TO_END_NAMES)
    return files.where(wanted & ~has_folder(path, SKIPPED + GENERATED_FOLDERS) & ~generated_text(F.col("text")))


def scan_counters(files: DataFrame) -> DataFrame:
    """One row: how many files are read, and how many are skipped for which reason."""
    kinds = ["production", "ignored", "generated_path", "generated_text", "test"]
    return classified(files).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def build_files(files: DataFrame) -> DataFrame:
    return files.where(file_name(F.col("path")).isin(BUILD_FILES) & ~has_folder(F.col("path"), SKIPPED))


def config_format(path: Column) -> Column:
    """The format of a configuration file by its name, else null."""
    name = F.lower(file_name(path))
    ending = F.element_at(F.split(name, r"\."), -1)
    out = F.when((name == ".env") | name.startswith(".env."), "env")
    for e, kind in FORMATS.items():
        out = out.when(ending == e, kind)
    return out


def config_files(files: DataFrame) -> DataFrame:
    found = files.withColumn("format", config_format(F.col("path")))
    return found.where(F.col("format").isNotNull() & ~has_folder(F.col("path"), SKIPPED))


def compiled_folders(files: DataFrame) -> DataFrame:
    """The distinct folders that hold compiled classes."""
    folder = F.regexp_extract("path", r"^(.*?(?:target|build)/(?:classes|test-classes)(?:/java/(?:main|test))?)/", 1)
    return files.select(folder.alias("path")).where("path <> ''").distinct()
