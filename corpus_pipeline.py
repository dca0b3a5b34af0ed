"""A training corpus from raw documents, stage by stage; each stage is one of the llm operators.

Every function takes (spark, docs, sf_dir) and returns a DataFrame: the columns of documents, but for
the last, which returns token digests. ``run`` writes each stage's rows as Parquet and rereads them as
the next one's docs.
"""

from pyspark.sql import DataFrame, SparkSession

from flowtide.llm import queries
from flowtide.llm.storage import materialize

STAGES = queries.STAGES

#: SQL can't express the trained classifier, so the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
