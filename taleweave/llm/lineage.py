"""Intermediate tables in the folder that driver and executors share, and joins that fit their sizes."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taleweave.streaming.folders import shared_folder


def stored(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read back: lost executors can't lose them, and nothing is computed twice."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A side of a join is sent to every executor only if its rows are measured and take less than this.
BROADCAST_BYTES = 48 << 20
#: What a row takes beside its values.
ROW_BYTES = 40


def measured_bytes(df: DataFrame) -> int:
    """The bytes of the rows: fixed-width values by their type, strings and binaries by their lengths, nested values by their JSON."""
    size = F.lit(ROW_BYTES)
    for field in df.schema:
        kind, column = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = size + 8 + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            size = size + 8
    return df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """The rows, marked for broadcast if they are measured and found small; else as they are, to be joined by a shuffle."""
    return F.broadcast(df) if measured_bytes(df) <= BROADCAST_BYTES else df


#: A key is hot if it has more rows than HOT_ROWS and than a HOT_KEYS-th of all, so that there are at most HOT_KEYS hot keys.
HOT_ROWS, HOT_KEYS = 1000, 50_000


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, members: str) -> DataFrame:
    """rows joined with keyed, which has one row a key and says in the column members how many rows the key has in rows.

    Hot keys, at most HOT_KEYS, are sent to where the rows are; rows of the other keys are shuffled. Both tables should be stored.
    """
    total = keyed.agg(F.coalesce(F.sum(members), F.lit(0))).first()[0]
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = keyed.where(F.col(members) > limit)
    if hot.isEmpty():
        return rows.join(keyed, key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(F.col(members) <= limit), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))
