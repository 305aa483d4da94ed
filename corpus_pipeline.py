"""A cleaning pipeline for documents: quality, near duplicates, benchmark passages, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import stored, table
from annalist.llm.decontaminate import contaminated
from annalist.llm.disclosure import sanitised
from annalist.llm.ngram_join import jaccard_groups
from annalist.llm.quality_eb import quality
from annalist.llm.raking import mixture

#: No SQL for it: the fitted classifier and the iterative weights are out of SQL's reach.
ORACLE_SQL = None
#: So many ids at most are broadcast; with more, both sides are shuffled by id.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the ids of gone. Rows without an id stay; rows that share an id share its fate."""
    gone = stored(gone.where("doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(side, docs["doc_id"] == F.col("_gone"), "left_anti")


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, quality(docs, table(spark, sf_dir, "labels")).where("not kept"))


def by_similarity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, jaccard_groups(docs).where("component_id <> doc_id"))


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def by_privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = F.col("clean_text")
    new = {"text": clean, "n_chars": F.length(clean).cast("long")}
    return sanitised(docs).select(*((new[c].alias(c) if c in new else F.col(c)) for c in docs.columns))


def by_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, mixture(docs).where("not kept"))


STAGES = [("quality classifier", by_quality), ("n-gram jaccard join", by_similarity), ("benchmark decontamination", by_benchmark), ("pii", by_privacy), ("mixing", by_mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs, f"stage{i}") if i < len(STAGES) - 1 else docs
    return docs
