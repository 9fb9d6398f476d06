"""A corpus from raw documents: toxicity, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import line_dedup, mixing, near_dedup, packing, toxicity
from meterlake.llm._spark import read, stage_table


BROADCAST_IDS = 200_000  # 8 bytes each


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity reaches the threshold.

    Null and empty texts get the score of an empty text and are judged by it; of repeated
    rows each is judged by its own text; without labels of both classes nothing is learned
    and every row gets the share of toxic labels; an empty table stays empty.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, "__toxicity")
    return scored.where(F.col("__toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines, by source; every document stays, ``n_chars`` follows its text.

    Null texts stay null (n_chars too); rows of a null source are unchanged; repeated rows
    count as rows of their own; an empty table stays empty.
    """
    cut = line_dedup.drop_boilerplate(docs, "source", "text")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the least doc_id.

    All rows of a kept doc_id stay, whatever their texts; rows without text or doc_id are
    near to nothing and stay; an empty table stays empty.
    """
    found = stage_table(near_dedup.near_duplicates(docs), "near")
    gone = stage_table(found.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources towards the target weights; every document stays.

    A null source is a source of its own; documents without tokens are repeated as their
    source is; repeated rows share their fate; an empty table stays empty.
    """
    return mixing.realise(mixing.mix(docs)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences; one row for each piece.

    Null and empty texts are one end token; repeated rows, those that mixing made too, are
    packed once each; an empty table gives no pieces.
    """
    return packing.digest(packing.pack(docs))


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL expresses neither the learned scores nor the tokens; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs
