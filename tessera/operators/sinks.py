"""Writing tables, reports, logs and phase outputs so that a reader never sees half of one.

A publication is a new folder of Parquet tables and, last, a marker row that names a folder for each table; readers follow the newest
marker, and a table that a publication does not replace keeps its folder. All writes go through Spark's committers to the store that the
path names, so a lost executor costs its tasks alone. A report is written beside its place and moved there when it is whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

VERSION = 1


PLACE = "struct<name:string,folder:string>"


def publish(tables: Mapping[str, DataFrame], base: str, kept: Mapping[str, str] | None = None) -> str:
    """Write all tables to a new folder under `base`, then the marker that names them and the folders of `kept` ones: all are seen or none. Returns the folder."""
    folder = f"{base}/{uuid.uuid4().hex}"
    spark = next(iter(tables.values())).sparkSession
    for name, t in tables.items():
        t.write.parquet(f"{folder}/{name}")
    places = {**(kept or {}), **{n: f"{folder}/{n}" for n in tables}}
    listed = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("folder")) for n, p in places.items()))
    marker = spark.range(1).select(listed.alias("tables"), F.current_timestamp().alias("at"), F.lit(VERSION).alias("version"), F.lit(folder).alias("folder"))
    marker.coalesce(1).write.mode("append").json(f"{base}/_published")
    return folder


def places(spark: SparkSession, base: str) -> dict[str, str]:
    """The folder of each table of the newest publication; none where nothing was published."""
    try:
        newest = spark.read.schema(f"folder string, tables array<{PLACE}>, at timestamp, version int").json(f"{base}/_published").orderBy(F.desc("at"), F.desc("folder")).first()
    except AnalysisException:
        return {}
    return {} if newest is None else {t["name"]: t["folder"] for t in newest["tables"]}


def published(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The tables of the newest publication; none where nothing was published."""
    return {name: spark.read.parquet(folder) for name, folder in places(spark, base).items()}


def replace_tables(spark: SparkSession, base: str, tables: Mapping[str, DataFrame]) -> str:
    """A publication in which these tables replace their namesakes and all others stay where they are, unread."""
    return publish(tables, base, {n: p for n, p in places(spark, base).items() if n not in tables})


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    rows.write.mode("append").json(path)


def write_report(rows: DataFrame, output: str, project: str, name: str) -> str:
    """Rows as JSON lines in the project's own folder. They are written whole before they take the place of what was there."""
    path = f"{output}/{project.rstrip('/').rpartition('/')[2] or 'project'}/{name}"
    moved_into(rows.sparkSession, path, lambda new: rows.write.json(new))
    return path


def moved_into(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Have `write` fill a new folder beside `path`, then rename it to `path`; until then, and if the write fails, the old one stays."""
    new, old = (f"{path}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    write(new)
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(of(path)):
        store.rename(of(path), of(old))
    if not store.rename(of(new), of(path)):
        raise OSError(f"cannot move {new} to {path}")
    store.delete(of(old), True)


def writable(new: DataFrame, existing: DataFrame, marker: str) -> DataFrame:
    """`new` files (path, text) with `refused`: true where a file of that path exists without the marker of generated files."""
    foreign = existing.where(~F.coalesce(F.col("text").contains(marker), F.lit(False))).select("path").distinct().withColumn("refused", F.lit(True))
    return new.join(foreign, "path", "left").withColumn("refused", F.coalesce("refused", F.lit(False)))


# --- phases ---


def save_phase(tables: Mapping[str, DataFrame], base: str, phase: str, root: str) -> None:
    """A phase's tables, and with them what they were made from and by which version."""
    spark = next(iter(tables.values())).sparkSession
    publish({**tables, "phase__": spark.range(1).select(F.lit(phase).alias("phase"), F.lit(root).alias("root"), F.lit(VERSION).alias("version"))}, f"{base}/{phase}")


def load_phase(spark: SparkSession, base: str, phase: str, root: str) -> dict[str, DataFrame] | None:
    """The tables of a phase, null where there are none or they are another version's or of another root."""
    tables = published(spark, f"{base}/{phase}")
    if "phase__" not in tables:
        return None
    told = tables.pop("phase__").first()
    return tables if (told["phase"], told["root"], told["version"]) == (phase, root, VERSION) else None


def run_phases(spark: SparkSession, base: str, root: str, phases: list[tuple[str, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]]) -> dict[str, DataFrame]:
    """Run phases in order, each on what the one before it left; those that are stored are not run again. A phase that runs makes all after it run."""
    tables: dict[str, DataFrame] = {}
    fresh = False
    for name, run in phases:
        found = None if fresh else load_phase(spark, base, name, root)
        if found is None:
            save_phase(run(tables), base, name, root)
            fresh = True
            found = load_phase(spark, base, name, root)
            assert found is not None
        tables = found
    return tables


# --- what a report says ---


def failing(diagnostics: DataFrame) -> DataFrame:
    """The first five errors, in file and message order."""
    return diagnostics.where("severity = 'error'").orderBy("file", "message").limit(5)


def exit_code(diagnostics: DataFrame) -> int:
    """1 where any diagnostic is an error, else 0."""
    return int(bool(diagnostics.where("severity = 'error'").take(1)))
