"""The corpus pipeline: quality, near duplicates, benchmark decontamination, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelode.llm.common import work_dir, written
from tracelode.llm.decontaminate import clean
from tracelode.llm.mixing import copies_of
from tracelode.llm.neardup import one_of_each
from tracelode.llm.quality import accepted
from tracelode.llm.tokenbin import binary_output

STAGES = [
    ("quality", accepted),
    ("near_duplicates", one_of_each),
    ("decontaminate", clean),
    ("mixing", copies_of),
    ("token_ids", binary_output),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"{work_dir(spark)}/{name}")
    return docs
