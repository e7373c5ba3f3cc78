"""Rows dealt evenly over as many tasks as their number asks for."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows of a task that makes and reads a text of each, and the fewest that are worth a task
PER_TASK = 10_000
LEAST = 500


def tasks_for(rows: DataFrame, per_task: int = PER_TASK) -> int:
    """A task for each `per_task` rows, or as many as there are cores if there are fewer rows; the rows are counted."""
    n = rows.count()
    return max(math.ceil(n / per_task), min(rows.sparkSession.sparkContext.defaultParallelism, n // LEAST))


def dealt(rows: DataFrame, *by: str, per_task: int = PER_TASK) -> DataFrame:
    """`rows`, dealt by their keys over a task for each `per_task` of them, or over all cores if there are fewer; a small table stays as it is.

    A table of one file and row group is one task, whatever its number of rows, and all that follows up to the next shuffle with it. Rows
    are dealt before they become texts, as keys are small. Rows of equal keys stay together, so `by` should be unique. The number of rows
    is counted, which a file format tells without reading them.
    """
    tasks = tasks_for(rows, per_task)
    if tasks <= 1:
        return rows
    # Spark moves filters below a repartition, and the texts they read with them, but not below what a partition's number is part of
    return rows.repartition(tasks, *by).withColumns({k: F.when(F.spark_partition_id() >= 0, F.col(k)) for k in by})
