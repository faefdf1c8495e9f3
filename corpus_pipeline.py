"""A corpus pipeline: five stages, each one operator of ``gapseries.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapseries.llm import decontaminate, mixing, quality, simhash, token_store
from gapseries.llm import queries as q
from gapseries.llm.common import crc_of_id, materialize, read_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents it rejects go."""
    held_out = F.pmod(crc_of_id("doc_id"), F.lit(q.QUALITY_FOLDS)) == 0
    forest = quality.train(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score(docs, forest)
    return scored.where(F.col(scored.columns[-1]) == 1).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: one document of each group stays."""
    return simhash.drop_near_duplicates(docs, seed=q.SEED)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as many times as its source's target weight takes it."""
    mixed = mixing.mix_sources(docs, lambda s: mixing.cyclic_weights(s, q.WEIGHT_CYCLE),
                               max_epochs=q.MAX_EPOCHS, seed=q.SEED)
    return mixing.expand(mixed, docs.columns, mixed.columns[-2])


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in seekable files, and where each document stands in them."""
    return token_store.read_tokens(token_store.write_tokens(docs, q.tokenizer_path(), end_id=q.END_ID))


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing to target weights", mix),
    ("token ids", store_tokens),
]

# Trained trees, fingerprints and a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
