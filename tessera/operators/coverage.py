"""Coverage and progress: which scenarios are done, which inputs have observations, what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Statuses that end a scenario.
FINISHED = ["accepted", "committed", "skipped"]
ACCEPTED = ["accepted", "committed"]


def behaviours(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Nodes with the sorted distinct method ids of their evidence."""
    ids = evidence.where("node_id is not null").groupBy("node_id").agg(F.array_sort(F.collect_set("method_id")).alias("method_ids"))
    return nodes.join(ids, nodes["id"] == ids["node_id"]).drop("node_id")


def with_any(candidates: DataFrame, ids: str, known: DataFrame, key: str) -> DataFrame:
    """Candidates of whose id list at least one is known, in list order the first known one as first_known."""
    each = candidates.select("id", F.posexplode(ids).alias("pos", key)).join(known.select(key).distinct(), key)
    first = each.groupBy("id").agg(F.min_by(key, "pos").alias("first_known"))
    return candidates.join(first, "id")


def scenario_counts(scenarios: DataFrame, inputs: DataFrame, observations: DataFrame) -> DataFrame:
    """Scenarios with their numbers of inputs and observations. Each side is counted before the join, so neither multiplies the other."""
    n_in = inputs.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n_inputs"))
    n_obs = observations.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n_observations"))
    out = scenarios.join(n_in, scenarios["id"] == n_in["scenario_id"], "left").drop("scenario_id").join(n_obs, scenarios["id"] == n_obs["scenario_id"], "left").drop("scenario_id")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_inputs", "n_observations")})


def observed_methods(inputs: DataFrame, observations: DataFrame) -> DataFrame:
    """scenario_id and the sorted methods of inputs that have an observation under both keys."""
    seen = observations.select("scenario_id", "input_id").distinct()
    method = F.get_json_object("input_json", "$.method")
    joined = inputs.withColumn("method", method).join(seen, (inputs["scenario_id"] == seen["scenario_id"]) & (inputs["id"] == seen["input_id"])).drop(seen["scenario_id"])
    return joined.where("method is not null").groupBy("scenario_id").agg(F.array_sort(F.collect_set("method")).alias("methods"))


def observations_of_inputs(inputs: DataFrame, observations: DataFrame) -> DataFrame:
    """Inputs with their number of observations under both keys, 0 included."""
    n = observations.groupBy("scenario_id", F.col("input_id").alias("id")).agg(F.count(F.lit(1)).alias("n_observations"))
    return inputs.join(n, ["scenario_id", "id"], "left").withColumn("n_observations", F.coalesce("n_observations", F.lit(0).cast("long")))


def coverage_gaps(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """scenario_id and the sorted methods expected of it that no observation covers."""
    out = expected.join(observed.withColumnRenamed("methods", "seen"), "scenario_id", "left")
    return out.select("scenario_id", F.array_sort(F.array_except("methods", F.coalesce("seen", F.array().cast("array<string>")))).alias("missing"))


def complete(scenarios: DataFrame, gaps: DataFrame) -> DataFrame:
    """Scenarios with `complete`: skipped ones are, accepted ones where every expected method is covered and there are inputs."""
    joined = scenarios.join(gaps, scenarios["id"] == gaps["scenario_id"], "left").drop("scenario_id")
    covered = F.size(F.coalesce("missing", F.array().cast("array<string>"))) == 0
    done = (F.col("status") == "skipped") | (F.col("status").isin(ACCEPTED) & covered & (F.col("n_inputs") > 0) & (F.col("n_observations") > 0))
    return joined.withColumn("complete", done)


def incomplete_count(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count_if(~F.col("complete")).alias("n"))


def next_pending(scenarios: DataFrame) -> DataFrame:
    """The unfinished scenario of the smallest id."""
    return scenarios.where(~F.col("status").isin(FINISHED)).orderBy("id").limit(1)


def first_files(scenarios: DataFrame, files: DataFrame) -> DataFrame:
    """Scenarios with the smallest path of their files."""
    least = files.groupBy("scenario_id").agg(F.min("path").alias("path"))
    return scenarios.join(least, scenarios["id"] == least["scenario_id"], "left").drop("scenario_id")


def status_funnel(scenarios: DataFrame, group: str) -> DataFrame:
    return scenarios.groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin(FINISHED)).alias("finished"), F.count_if(F.col("status") == "failed").alias("failed"))
