"""Running sums, numbers and last values in two levels, for keys that may hold a large share of all rows.

A key's rows are cut into ranges of its order: the leading order columns, and the last one by its multiples of a width. Each range
is a window of its own; ranges are summed, and only their sums are ordered by key. So no task sorts a whole
key, and the rows move once. Keys are compared as structs, so null keys are groups like others. With `tasks` each shuffle is dealt over
that many, so a task's memory doesn't grow with the input where the session's shuffle partitions are few.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.operators.partitioning import dealt

#: Whole numbers, or seconds, of one range.
WIDTH = 4096


def _ranged(rows: DataFrame, keys: list[str], order: list[str], width: float, tasks: int | None = None) -> DataFrame:
    held = rows.withColumns({"_key": F.struct(*keys), "_range": F.struct(*order[:-1], F.floor(F.col(order[-1]) / width).alias("_step"))})
    return dealt(held, tasks, "_key", "_range")


def _up_to(*keys, order, last=-1):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)


def sum_before(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, width: float = WIDTH, tasks: int | None = None) -> DataFrame:
    """rows with `name`: the sum of value over the rows of their key before them, 0 for the first. The last order column is a number."""
    held = _ranged(rows.withColumn("_value", value), keys, order, width, tasks)
    zero = F.lit(0)
    sums = dealt(held.groupBy("_key", "_range").agg(F.sum("_value").alias("_sum")), tasks, "_key")
    carried = sums.select("_key", "_range", F.coalesce(F.sum("_sum").over(_up_to("_key", order=["_range"])), zero).alias("_carry"))
    inside = F.coalesce(F.sum("_value").over(_up_to("_key", "_range", order=order)), zero)
    held = held.withColumn("_inside", inside)  # before the join, which then finds the rows in order
    return held.join(dealt(carried, tasks, "_key", "_range"), ["_key", "_range"]).withColumn(name, F.col("_carry") + F.col("_inside")).select(*[c for c in rows.columns if c != name], name)


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, width: float = WIDTH, tasks: int | None = None) -> DataFrame:
    """rows with `name`: how many rows of their key are before them."""
    return sum_before(rows, keys, order, F.lit(1), name, width, tasks).withColumn(name, F.col(name).cast("long"))


def last_before(rows: DataFrame, key: str, at: str, kind: str, item: str, name: str, width: float = WIDTH, first_if_before: bool = False, tasks: int | None = None) -> DataFrame:
    """rows with `name`: the item of the last row of their key that has one, in order of `at` and `kind`, up to each row itself;
    with first_if_before the key's first item where there is none."""
    held = _ranged(rows, [key], [at], width, tasks)
    placed = F.when(F.col(item).isNotNull(), F.col(at))
    ends = dealt(held.groupBy("_key", "_range").agg(F.max_by(item, placed).alias("_last"), F.min_by(item, placed).alias("_first")), tasks, "_key")
    carry = F.last("_last", ignorenulls=True).over(_up_to("_key", order=["_range"]))
    if first_if_before:
        carry = F.coalesce(carry, F.first("_first", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    carried = ends.select("_key", "_range", carry.alias("_carry"))
    inside = F.last(item, ignorenulls=True).over(_up_to("_key", "_range", order=[at, kind], last=0))
    held = held.withColumn("_inside", inside)
    return held.join(dealt(carried, tasks, "_key", "_range"), ["_key", "_range"]).withColumn(name, F.coalesce("_inside", "_carry")).drop("_key", "_range", "_carry", "_inside")
