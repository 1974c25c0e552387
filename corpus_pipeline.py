"""Corpus pipeline: toxic documents go, near duplicates and contaminated documents go, sources are mixed, ids are written.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder and
reads it again as the next stage's docs. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetgrain.llm import common, decontamination, mixing, simhash, tokens, toxicity

STAGES = [
    ("toxicity", toxicity.ordinary),
    ("near_duplicates", simhash.one_of_each_group),
    ("decontamination", decontamination.decontaminated),
    ("mixing", mixing.mixed),
    ("tokens", tokens.tokenized),
]

#: Tokenising isn't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has stored for itself is deleted as soon as its result is written."""
    docs = common.table(spark, sf_dir, "documents")
    last: list[str] = []
    for name, stage in STAGES:
        before = set(common.MADE)
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        made = [path for path in common.MADE if path not in before]
        common.discard(spark, last + made[:-1])
        last = made[-1:]
    return docs
