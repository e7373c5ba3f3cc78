"""Column expressions over text: counts, keys, hashes, versions, truncation, references, names and paths. All run inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def occurrences(text: Column, term: str) -> Column:
    """How often `term` stands in `text`, counted from the left without overlap; null text: null."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def term_count(text: Column, terms: list[str]) -> Column:
    """The sum of the occurrences of several terms."""
    out = F.lit(0).cast("long")
    for t in terms:
        out = out + occurrences(text, t)
    return out


def normalized(text: Column) -> Column:
    """Lower case, every run of white space one space, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def content_id(prefix: str, *parts: Column) -> Column:
    """`prefix` and the SHA-256 of the normalized parts, joined by a NUL so that no two lists of parts collide."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\0", *(normalized(p) for p in parts)), 256))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def version_parts(version: Column) -> Column:
    """The runs of digits in a version as integers; runs beyond 32 bits are left out."""
    parts = F.transform(F.regexp_extract_all(version, F.lit("([0-9]+)"), F.lit(1)), lambda x: F.when(F.length(F.ltrim(x, F.lit("0"))) <= 10, x.cast("decimal(30,0)").cast("long")))
    return F.filter(parts, lambda x: x.isNotNull() & (x < 2**32))


def version_below(version: Column, minimum: Column) -> Column:
    """Whether a version comes before another, part by part; one without any digits is below."""
    have = version_parts(version)
    return (F.size(have) == 0) | (have < version_parts(minimum))


def java_major(version: Column) -> Column:
    """1.8 and 8.0.2 are 8, 17 is 17; no digits: null."""
    first = F.regexp_extract(version, r"([0-9]+)", 1)
    second = F.regexp_extract(version, r"[0-9]+\.([0-9]+)", 1)
    return F.when(first == "", None).when((first == "1") & (second != ""), second.cast("long")).otherwise(first.cast("long"))


def truncated(text: Column, limit: int, marker: str) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(marker))).otherwise(text)


def excerpt(text: Column, limit: int, marker: str) -> Column:
    """Beginning and end of a long text, with a marker for what lies between."""
    half = limit // 2
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(half)), F.lit(marker), F.right(text, F.lit(limit - half)))).otherwise(text)


def first_line(text: Column, limit: int = 240) -> Column:
    return F.left(F.split_part(text, F.lit("\n"), F.lit(1)), F.lit(limit))


def annotation_name(annotation: Column) -> Column:
    """@org.x.Name(args) is Name."""
    return F.regexp_extract(F.split_part(F.ltrim(annotation, F.lit("@ ")), F.lit("("), F.lit(1)), r"([^.\s]+)\s*$", 1)


def first_quoted(text: Column) -> Column:
    """What stands between the first two double quotes; null without both."""
    return F.when(F.regexp_like(text, F.lit('"[^"]*"')), F.regexp_extract(text, '"([^"]*)"', 1))


def named_value(annotation: Column, name: str) -> Column:
    """The quoted value given to `name` in an annotation, else null."""
    pattern = rf'\b{name}\s*=\s*"([^"]*)"'
    return F.when(F.regexp_like(annotation, F.lit(pattern)), F.regexp_extract(annotation, pattern, 1))


def captured(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the pattern's first match; null where it does not match."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def annotation_value(annotation: Column) -> Column:
    """The quoted name = value of an annotation, else the quoted value that stands alone in it, else null."""
    return F.coalesce(captured(annotation, r'name\s*=\s*"([^"]+)"'), captured(annotation, r'\(\s*"([^"]+)"'))


def generic_argument(kind: Column) -> Column:
    """The first argument of a generic type, else null."""
    found = F.trim(F.regexp_extract(kind, r"<([^>,]*)", 1))
    return F.when(found != "", found)


def unwrapped(kind: Column) -> Column:
    """The first argument of a generic type, else the type itself."""
    return F.coalesce(generic_argument(kind), kind)


def json_field(text: Column, name: str) -> Column:
    return F.get_json_object(text, f"$.{name}")


def reference_name(value: Column) -> Column:
    """The name inside the first ${name} or ${name:default}; else null."""
    pattern = r"\$\{([^}:]+)(?::[^}]*)?\}"
    return F.when(F.regexp_like(value, F.lit(pattern)), F.regexp_extract(value, pattern, 1))


def value_kind(value: Column) -> Column:
    """What a configured value is: a reference to the environment, to a property or to a name service, a URL, a path, or a literal."""
    value = F.trim(value)
    name = reference_name(value)
    environment = name.contains("_") | F.regexp_like(name, F.lit("^[A-Z0-9]*$"))
    starts = lambda *p: F.regexp_like(value, F.lit(f"^({'|'.join(p)})"))
    return (
        F.when(name.isNotNull() & environment, "ENVIRONMENT_REFERENCE")
        .when(name.isNotNull(), "PROPERTY_REFERENCE")
        .when(starts("java:", "jdbc/", "jms/"), "JNDI_REFERENCE")
        .when(starts("http://", "https://", "jdbc:", "r2dbc:"), "URL")
        .when(value.contains("/") | value.contains("\\"), "FILE_PATH")
        .otherwise("LITERAL")
    )


def sensitivity(key: Column, patterns: list[str]) -> Column:
    low = ascii_lower(key)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | low.contains(p.lower())
    return F.when(hit, "secret").otherwise("normal")


def clipped_lines(lines: Column, start: Column, end: Column) -> Column:
    """Line numbers inside a range, sorted, each once."""
    return F.array_sort(F.array_distinct(F.filter(lines, lambda x: (x >= start) & (x <= end))))


def substituted(text: Column, properties: Column) -> Column:
    """One pass over ${name} references: known names are replaced, unknown ones left as they are."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$\{([^}]+)\}"), F.lit(1)))
    return F.aggregate(names, text, lambda out, n: F.replace(out, F.concat(F.lit("${"), n, F.lit("}")), F.coalesce(F.element_at(properties, n), F.concat(F.lit("${"), n, F.lit("}")))))


def path_segment(text: Column) -> Column:
    """Safe as a name in a path: everything but letters, digits, dot, dash and underscore is a dash."""
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", "-")


# What a path writes as percent codes in a file's address.
PERCENT_CODES = [("%", "%25"), (" ", "%20"), ("#", "%23"), ("?", "%3F")]


def percent_coded(path: Column) -> Column:
    """A path as part of a file's address."""
    for sign, code in PERCENT_CODES:
        path = F.replace(path, F.lit(sign), F.lit(code))
    return path


def percent_decoded(address: Column) -> Column:
    """The path in a file's address, the codes of percent signs last."""
    for sign, code in reversed(PERCENT_CODES):
        address = F.replace(address, F.lit(code), F.lit(sign))
    return address


def string_literal(text: Column) -> Column:
    """Escaped for a double-quoted literal."""
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.concat(F.lit('"'), text, F.lit('"'))


def comment_text(text: Column) -> Column:
    return F.replace(text, F.lit("*/"), F.lit("* /"))


def module_path(file: Column, names: list[str]) -> Column:
    """The folder of a build file, "." at the root."""
    folder = F.regexp_replace(file, r"/?[^/]+$", "")
    return F.when(folder == "", ".").otherwise(folder)


def compacted(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"\s+", "")


def expression_values(raw: Column) -> Column:
    """The texts by which an expression may be known, sorted, each once: itself trimmed, without white space, the called method with its
    arguments, and the class that Class.forName names. A blank expression has none."""
    text = F.trim(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    tight = compacted(text)
    before, inside = F.substring_index(text, "(", 1), captured(text, r"(?s)^[^(]*\((.*)\)")
    called = F.trim(F.substring_index(F.trim(before), ".", -1))
    call = F.when(text.contains("(") & (called != "") & inside.isNotNull(), F.concat(called, F.lit("("), compacted(inside), F.lit(")")))
    name = captured(tight, r'^Class\.forName\("([^"]*)"')
    values = F.array_compact(F.array(text, tight, call, name, F.concat(F.lit('Class.forName("'), name)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(values)))


def file_profile(file_name: Column) -> Column:
    """The profile in the name of an application or bootstrap file, else null."""
    return captured(file_name, r"^(?:application|bootstrap)-([A-Za-z0-9_.-]+)\.(?:properties|ya?ml)$")


def text_profile(contents: Column) -> Column:
    """The first profile that a configuration's own lines name, else null."""
    return captured(contents, r"(?m)^\s*(?:spring\.profiles\.active|spring\.profiles\.default|spring\.config\.activate\.on-profile)\s*[:=]\s*([A-Za-z0-9_.-]+)")


def profile(file_name: Column, contents: Column) -> Column:
    return F.coalesce(file_profile(file_name), text_profile(contents))


def source_scope(path: Column) -> Column:
    return F.when(path.contains("/src/test/") | path.startswith("src/test/"), "test").otherwise("main")


def invocation_kind(kind: Column) -> Column:
    """The kind of a method's entry point, else that of a direct call."""
    return F.coalesce(kind, F.lit("direct_method_scaffold"))


def generated_package(package: Column, below: str) -> Column:
    """The package of generated tests: `below` under the source's own, or alone."""
    return F.when(F.coalesce(package, F.lit("")) != "", F.concat(package, F.lit(f".{below}"))).otherwise(F.lit(below))


def generated_class(name: Column, node_id: Column, prefix: str = "", suffix: str = "CharacterizationTest") -> Column:
    """A class name from any text: words of letters and digits joined with capitals, "Behavior" without any, and a short hash of the id."""
    words = F.filter(F.split(name, "[^A-Za-z0-9]+"), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")
    return F.concat(F.lit(prefix), F.when(joined == "", "Behavior").otherwise(joined), short_hash(node_id), F.lit(suffix))


def generated_path(file: Column, package: Column, class_name: Column) -> Column:
    """Where a generated test lies: the source's folder above src/main/java, src/test/java, the package's folders, the class's file."""
    above = F.regexp_replace(F.coalesce(F.when(file.contains("src/main/java"), F.substring_index(file, "src/main/java", 1)), F.lit("")), "/+$", "")
    return F.concat_ws("/", F.when(above != "", above), F.lit("src/test/java"), F.replace(package, F.lit("."), F.lit("/")), F.concat(class_name, F.lit(".java")))


def test_method_names(source: Column) -> Column:
    """Sorted distinct names of the void methods that @Test marks, whatever annotations stand between."""
    pattern = r"@Test(?:\s*\([^)]*\))?(?:\s*@\w+(?:\([^)]*\))?)*\s*(?:public\s+)?void\s+([A-Za-z_]\w*)\s*\("
    return F.array_sort(F.array_distinct(F.regexp_extract_all(source, F.lit(pattern), F.lit(1))))


def epoch_text(at: Column | None = None) -> Column:
    """Seconds since 1970 as text, of now unless told."""
    return F.unix_timestamp(F.current_timestamp() if at is None else at).cast("string")


#: fields of an answer
ANSWER_FIELDS = ["blockers", "changed_files", "status", "verification"]


def answer_error(text: Column) -> Column:
    """Why a text is no answer of the agreed form, null where it is one: one JSON object, of these fields alone, of these types and values."""
    text = F.trim(text)
    keys = F.array_sort(F.json_object_keys(text))
    item = lambda name: F.get_json_object(text, f"$.{name}")
    kind = lambda name: F.coalesce(F.schema_of_variant(F.try_parse_json(item(name))), F.lit(""))
    empty = lambda name: F.coalesce(compacted(item(name)) == "[]", F.lit(False))
    listed = lambda name: (kind(name) == "ARRAY<STRING>") | empty(name)
    return (
        F.when(text.startswith("```") | text.endswith("```"), "agent response must be JSON only")
        .when(F.try_parse_json(text).isNull(), "agent response must be valid JSON")
        .when(~text.startswith("{"), "agent response must be a JSON object")
        .when(keys != F.array(*(F.lit(k) for k in ANSWER_FIELDS)), "agent response fields do not match schema")
        .when(~F.coalesce(item("status").isin("completed", "blocked"), F.lit(False)), "agent response status must be completed or blocked")
        .when(~listed("changed_files"), "agent response changed_files must be string array")
        .when(~listed("blockers"), "agent response blockers must be string array")
        .when(~((kind("verification") == "ARRAY<OBJECT<command: STRING, status: STRING>>") | empty("verification")), "agent response verification item must match schema")
        .when((item("status") == "blocked") & empty("blockers"), "blocked agent response must include blocker")
    )
