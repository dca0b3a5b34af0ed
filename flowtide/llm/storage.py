"""Where jobs put what they write: the folder that all executors share."""

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; in local mode a temporary folder where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write as Parquet to the shared folder and read it back: lineage ends there, no executor's loss undoes it."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def extended(df: DataFrame, added: str) -> tuple[DataFrame, StructType]:
    """df without columns named as the added ones, and its schema with those behind."""
    new = StructType.fromDDL(added)
    df = df.drop(*new.names)
    return df, StructType(df.schema.fields + new.fields)
