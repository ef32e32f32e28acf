"""Partitions of inputs, and how many tasks share what is sorted."""

from pyspark.sql import DataFrame

#: Rows of an input for each task that sorts what is made of it.
ROWS_PER_TASK = 1 << 18


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows, dealt by a key over as many partitions as there are cores if the input has fewer than that, else as they are.

    Few splits (small tables, files of one row group) would leave cores idle through all that follows; what is grouped by the
    key later needs no further shuffle. Large inputs have more splits than cores and are not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < 2 * cores else df


def tasks_for(df: DataFrame) -> int:
    """How many tasks share the sorts of an input's rows: at least the cores, else so many that each has about ROWS_PER_TASK, whatever the input's size."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """The rows, dealt by keys over that many tasks; without a number the session's shuffle partitions hold."""
    return df.repartition(tasks, *keys) if tasks else df
