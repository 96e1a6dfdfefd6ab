"""Tables written between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: `spark.checkpoint.dir` of the session. Only a
    local session, where all tasks run on one machine, may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _scratch:
        _scratch[context.applicationId] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _scratch[context.applicationId]


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back, where several branches use it: what
    lies below, such as the parsing of pages, then runs once, and a lost
    executor does not bring it back."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SMALL = 64 << 20


_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows of `df`, by counting: fixed widths, lengths of texts, and the
    JSON form of nested columns only."""
    fixed, sized = 0, []
    for field in df.schema.fields:
        kind, column = field.dataType.simpleString(), F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            sized.append(F.octet_length(column))
        elif kind.startswith(("array", "map", "struct")):
            sized.append(F.octet_length(F.to_json(F.struct(column))))
        else:
            fixed += _WIDTHS.get(kind, 16 if kind.startswith("decimal") else 8)
    row = F.lit(fixed)
    for part in sized:
        row = row + F.coalesce(part, F.lit(0))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int = SMALL) -> DataFrame:
    """Mark `df` for broadcasting if its rows, measured, fit in `max_bytes`.

    Spark's own estimate goes by the size of compressed files and by default
    widths of columns, so next to a table of pages it may take the pages for
    the smaller side. Beyond the limit the join is left to Spark (shuffled,
    with adaptive splitting of skewed keys).
    """
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df
