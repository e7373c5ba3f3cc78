"""Texts of build and configuration files as rows, with column expressions; nested documents by one small Python function."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import substituted
from tessera.operators.graph import first_per_key

# Configurations of a Gradle build that declare dependencies, and the endings of further ones.
CONFIGURATIONS = [
    "api", "annotationProcessor", "classpath", "compile", "compileOnly", "implementation", "runtime", "runtimeOnly",
    "testAnnotationProcessor", "testCompile", "testCompileOnly", "testImplementation", "testRuntime", "testRuntimeOnly",
]
CONFIGURATION_ENDINGS = ["Compile", "CompileOnly", "Implementation", "Runtime", "RuntimeOnly"]


#: what YAML's two parsers are known to read differently: signs of tags, directives, block texts, keys and escapes; control and other letters
ODD_YAML = re.compile(r"[^ -~\n]|[!%|>?\\@`]")


def key_values(files: DataFrame) -> DataFrame:
    """path, key, value of the lines of properties and env files: parted at the first "=", else the first ":"; comments are left out."""
    lines = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    kept = lines.where("line <> '' and not startswith(line, '#') and not startswith(line, '!')")
    at = F.when(F.instr("line", "=") > 0, F.instr("line", "=")).otherwise(F.instr("line", ":"))
    rows = kept.withColumn("at", at).where("at > 1").select("path", "pos", F.trim(F.expr("left(line, at - 1)")).alias("key"), F.trim(F.expr("substring(line, at + 1)")).alias("value"))
    return first_per_key(rows, ["path", "key"], [F.col("pos")]).drop("pos")


def flat(value: object, key: str = "") -> Iterator[tuple[str, str]]:
    """Dotted keys of a nested value; a list is one entry that ends in []."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from flat(v, f"{key}.{k}" if key else str(k))
    elif isinstance(value, list):
        yield f"{key}[]", json.dumps(value, default=str)
    elif key:
        yield key, "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def yaml_documents(text: str) -> list[object]:
    """The documents of a YAML text as PyYAML's own parser reads them, by libyaml where both read alike, which takes a sixth of the time.

    A text with a sign of ODD_YAML, or one that libyaml refuses, is read by PyYAML's own parser.
    """
    import yaml

    if yaml.__with_libyaml__ and not ODD_YAML.search(text):
        try:
            return list(yaml.load_all(text, yaml.CSafeLoader))
        except yaml.YAMLError:
            pass
    return list(yaml.safe_load_all(text))


def flattened(files: DataFrame, kind: str) -> DataFrame:
    """path, key, value of JSON or YAML files; a file that cannot be read gives no rows. A task reads all files of its partition, as in `java.nodes`."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if kind == "yaml":
            import yaml

            load, wrong = yaml_documents, yaml.YAMLError
        else:
            load, wrong = (lambda t: [json.loads(t)]), ValueError
        for part in parts:
            rows = []
            for path, text in zip(part["path"], part["text"], strict=True):
                try:
                    rows += [(path, k, v) for d in load(text or "null") for k, v in flat(d)]
                except wrong:
                    continue
            yield pd.DataFrame(rows, columns=["path", "key", "value"], dtype="object")

    return files.select("path", "text").mapInPandas(run, "path string, key string, value string")


def xml_root(text: Column) -> Column:
    """The name of the first element, without its prefix; null where there is none."""
    body = F.regexp_replace(text, r"(?s)<!--.*?-->|<\?.*?\?>|<![^>]*>", "")
    name = F.regexp_extract(body, r"<(?:[\w.-]+:)?([\w.-]+)", 1)
    return F.when(name != "", name)


def tag(block: Column, name: str) -> Column:
    found = F.trim(F.regexp_extract(block, rf"(?s)<{name}>(.*?)</{name}>", 1))
    return F.when(found != "", found)


def blocks(text: Column, name: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{name}>(.*?)</{name}>"), F.lit(1))


def pom_properties(text: Column) -> Column:
    """The map of a POM's properties."""
    inside = F.regexp_extract(text, r"(?s)<properties>(.*?)</properties>", 1)
    entry = r"(?s)<([\w.-]+)>([^<]*)</\1>"
    keys = F.regexp_extract_all(inside, F.lit(entry), F.lit(1))
    values = F.transform(F.regexp_extract_all(inside, F.lit(entry), F.lit(2)), lambda v: F.trim(v))
    first = F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.element_at(values, F.array_position(keys, k).cast("int")).alias("value")))
    return F.map_from_entries(first)


def pom_rows(files: DataFrame, kind: str) -> DataFrame:
    """path, group_id, artifact_id, version, scope of each dependency or plugin (`kind`) of POM files, references put in."""
    read = files.select("path", pom_properties(F.col("text")).alias("properties"), F.explode(blocks(F.col("text"), kind)).alias("block"))
    value = lambda name: substituted(tag(F.col("block"), name), F.col("properties"))
    rows = read.select("path", value("groupId").alias("group_id"), value("artifactId").alias("artifact_id"), value("version").alias("version"), tag(F.col("block"), "scope").alias("scope"))
    return rows.where("artifact_id is not null")


def pom_java_versions(files: DataFrame) -> DataFrame:
    """path, source, version: what a POM asks of the compiler, each once."""
    names = ["maven.compiler.release", "maven.compiler.source", "maven.compiler.target", "java.version"]
    p = pom_properties(F.col("text"))
    own = [F.struct(F.lit(n).alias("source"), F.try_element_at(p, F.lit(n)).alias("version")) for n in names]
    own += [F.struct(F.lit(n).alias("source"), substituted(tag(F.col("text"), n), p).alias("version")) for n in ("release", "source", "target")]
    return files.select("path", F.explode(F.array(*own)).alias("v")).select("path", "v.*").where("version is not null").distinct()


def pom_tools(files: DataFrame) -> DataFrame:
    """tool, version, file, source of each POM with a model version, references put in."""
    version = substituted(tag(F.col("text"), "modelVersion"), pom_properties(F.col("text")))
    # a filter on an exploded value is not put in place of it, with all that it is made of, a second time
    found = files.where(F.contains("text", F.lit("<modelVersion>"))).select("path", F.explode(F.array(version)).alias("version")).where("version is not null")
    return found.select(F.lit("maven-model").alias("tool"), "version", F.col("path").alias("file"), F.lit("pom.xml").alias("source"))


def wrapper_tools(files: DataFrame) -> DataFrame:
    """tool, version, file, source of each Gradle wrapper file that names a distribution."""
    found = files.select("path", gradle_wrapper_version(F.col("text")).alias("version")).where("version is not null")
    return found.select(F.lit("gradle").alias("tool"), "version", F.col("path").alias("file"), F.lit("gradle-wrapper.properties").alias("source"))


def pom_modules(files: DataFrame) -> DataFrame:
    """path (the POM's folder, "." at the root) and module path of each module listed."""
    folder = F.regexp_replace("path", r"/?[^/]+$", "")
    names = files.select(F.when(folder == "", ".").otherwise(folder).alias("parent"), F.explode(blocks(F.col("text"), "module")).alias("name"))
    return names.select("parent", F.when(F.col("parent") == ".", F.trim("name")).otherwise(F.concat_ws("/", "parent", F.trim("name"))).alias("module"))


def gradle_dependencies(files: DataFrame) -> DataFrame:
    """path, configuration, group_id, artifact_id, version of dependency lines in Gradle scripts."""
    line = r"""(?m)^\s*(\w+)\s*\(?\s*(?:platform\s*\(\s*)?["']([\w.-]+):([\w.-]+)(?::([\w.${}-]+))?["']"""
    part = lambda n: F.regexp_extract_all("text", F.lit(line), F.lit(n))
    rows = files.select("path", F.explode(F.arrays_zip(part(1).alias("configuration"), part(2).alias("group_id"), part(3).alias("artifact_id"), part(4).alias("version"))).alias("d")).select("path", "d.*")
    known = F.col("configuration").isin(CONFIGURATIONS) | F.regexp_like("configuration", F.lit(f"({'|'.join(CONFIGURATION_ENDINGS)})$"))
    return rows.where(known).withColumn("version", F.when(F.col("version") != "", F.col("version")))


def gradle_plugins(files: DataFrame) -> DataFrame:
    line = r"""\bid\s*\(?\s*["']([\w.-]+)["']\s*\)?(?:\s+version\s+["']([^"']+)["'])?"""
    part = lambda n: F.regexp_extract_all("text", F.lit(line), F.lit(n))
    rows = files.select("path", F.explode(F.arrays_zip(part(1).alias("plugin_id"), part(2).alias("version"))).alias("p")).select("path", "p.*")
    return rows.withColumn("version", F.when(F.col("version") != "", F.col("version")))


def gradle_java_versions(files: DataFrame) -> DataFrame:
    """path and version, each once, from toolchains, compatibility settings and release options."""
    pattern = r"""(?:JavaLanguageVersion\.of\(\s*|(?:source|target)Compatibility\s*=?\s*(?:JavaVersion\.VERSION_|["'])?|options\.release(?:\.set\(|\s*=)\s*)([0-9]+(?:[._][0-9]+)?)"""
    rows = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("version"))
    return rows.select("path", F.replace("version", F.lit("_"), F.lit(".")).alias("version")).distinct()


def gradle_wrapper_version(text: Column) -> Column:
    found = F.regexp_extract(text, r"gradle-([0-9][\w.]*?)-(?:bin|all)\.zip", 1)
    return F.when(found != "", found)


def gradle_modules(files: DataFrame) -> DataFrame:
    """Modules that settings scripts include; ":" parts folders."""
    calls = F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*include\s*\(?([^\n)]*)"), F.lit(1)))
    names = files.select(calls.alias("call")).select(F.explode(F.regexp_extract_all("call", F.lit(r"""["']:?([^"']+)["']"""), F.lit(1))).alias("name"))
    return names.select(F.replace("name", F.lit(":"), F.lit("/")).alias("module")).distinct()


def catalogue_rows(files: DataFrame) -> DataFrame:
    """path, section, alias, name, version of the libraries and plugins of a version catalogue; version references are looked up.

    Lines belong to the last section header above them; a file's lines stay in its own row until they are labelled.
    """
    parts = F.split("text", r"(?m)^\s*(?=\[)")
    each = files.select("path", F.explode(parts).alias("part")).select("path", F.regexp_extract("part", r"^\[([\w-]+)\]", 1).alias("section"), F.explode(F.split("part", r"\r?\n")).alias("line"))
    entry = each.select("path", "section", F.regexp_extract("line", r"^\s*([\w.-]+)\s*=", 1).alias("alias"), F.regexp_extract("line", r"=\s*(.*)$", 1).alias("body")).where("alias <> ''")
    quoted = lambda name: F.regexp_extract("body", rf'\b{name}\s*=\s*"([^"]*)"', 1)
    plain = F.regexp_extract("body", r'^"([^"]*)"', 1)
    versions = entry.where("section = 'versions'").select("path", F.col("alias").alias("ref"), plain.alias("of_ref"))
    name = F.coalesce(F.nullif(quoted("module"), F.lit("")), F.nullif(quoted("id"), F.lit("")), F.nullif(F.concat_ws(":", F.nullif(quoted("group"), F.lit("")), F.nullif(quoted("name"), F.lit(""))), F.lit("")), F.nullif(F.regexp_extract(plain, r"^([^:]+(?::[^:]+)?)", 1), F.lit("")))
    inline = F.when(F.regexp_like("body", F.lit('^"[^"]*:[^"]*:[^"]*"')), F.element_at(F.split(plain, ":"), -1)).otherwise(F.nullif(F.regexp_extract("body", r'\bversion\s*=\s*"([^"]*)"', 1), F.lit("")))
    rows = entry.where("section in ('libraries', 'plugins')").select("path", "section", "alias", name.alias("name"), inline.alias("inline"), F.nullif(F.regexp_extract("body", r'version(?:\.ref|\s*=\s*\{\s*ref)\s*=\s*"([^"]*)"', 1), F.lit("")).alias("ref"))
    return rows.join(versions, ["path", "ref"], "left").select("path", "section", "alias", "name", F.coalesce("inline", "of_ref").alias("version"))


def resolved_gradle(text_rows: DataFrame) -> DataFrame:
    """group_id, artifact_id, version from the lines of a printed dependency tree (column line); "->" gives the version chosen."""
    pattern = r"[+\\]---\s+([\w.-]+):([\w.-]+)(?::([\w.-]+))?(?:\s+->\s+([\w.-]+))?"
    part = lambda n: F.regexp_extract("line", pattern, n)
    rows = text_rows.select(part(1).alias("group_id"), part(2).alias("artifact_id"), F.coalesce(F.nullif(part(4), F.lit("")), F.nullif(part(3), F.lit(""))).alias("version"))
    return rows.where("group_id <> ''").distinct()


def internal_uses(text_rows: DataFrame) -> DataFrame:
    """source, symbol of the lines in a dependency report that name an internal interface of the platform."""
    rows = text_rows.where(F.contains("line", F.lit("JDK internal API")))
    sides = F.split(F.trim("line"), r"\s*->\s*")
    return rows.where(F.size(sides) > 1).select(F.element_at(sides, 1).alias("source"), F.split_part(F.element_at(sides, 2), F.lit(" "), F.lit(1)).alias("symbol"))


def removal_uses(text_rows: DataFrame) -> DataFrame:
    """class_name of the lines in a deprecation report that tell something marked for removal."""
    name = F.element_at(F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x.contains("/")), 1)
    return text_rows.where(F.contains("line", F.lit("forRemoval=true")) & F.contains("line", F.lit("/"))).select("line", F.replace(name, F.lit("/"), F.lit(".")).alias("class_name"))


def resolved_maven(files: DataFrame) -> DataFrame:
    """group_id, artifact_id, version, scope from effective POMs, each once."""
    return pom_rows(files, "dependency").where("version is not null").select("group_id", "artifact_id", "version", "scope").distinct()


def closed_json(text: Column) -> Column:
    """A JSON object that was cut off, from its first brace on, with what is open closed: a string, then brackets and braces from the
    innermost; null where brackets do not match."""
    start = F.instr(text, "{")
    body = F.trim(F.substr(text, start, F.length(text)))
    outline = F.regexp_replace(body, r'"(?:[^"\\]|\\[\s\S])*+"', "")
    inside = outline.contains('"')
    signs = F.regexp_extract_all(F.regexp_replace(outline, r'"[\s\S]*$', ""), F.lit(r"[{}\[\]]"), F.lit(0))

    def step(stack: Column, sign: Column) -> Column:
        closer = F.when(sign == "{", "}").when(sign == "[", "]")
        return F.when(closer.isNotNull(), F.concat(closer, stack)).when(F.left(stack, F.lit(1)) == sign, F.substring(stack, 2, 1 << 30))  # null once they do not match

    open_ = F.aggregate(signs, F.lit("").cast("string"), step)
    return F.when(start > 0, F.concat(body, F.when(inside, '"').otherwise(""), open_))


def recovered_json(text: Column) -> Column:
    """The JSON object in an answer: what a fence holds, the text itself, its outermost braces, or the text with what is open closed; null where none can be read."""
    fenced = F.regexp_extract(text, r"(?s)\n\s*(.*?)\s*```[^`]*$", 1)
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    valid = lambda c: F.when(F.json_object_keys(c).isNotNull(), c)
    return F.coalesce(valid(fenced), valid(F.trim(text)), valid(outer), valid(closed_json(text)))
