"""The corpus pipeline: documents pass a toxicity filter, near-duplicate removal, source mixing and BPE encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakframe.llm.bpe import bpe_stage
from cloakframe.llm.common import written
from cloakframe.llm.jaccard import jaccard_stage
from cloakframe.llm.mixing import mix_stage
from cloakframe.llm.toxicity import toxicity_stage

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", jaccard_stage),
    ("mixing", mix_stage),
    ("byte_bpe", bpe_stage),
]

#: The toxicity model, near-duplicate components and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared folder and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
