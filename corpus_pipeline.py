"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, jaccard, lines, quality, tokens
from veilspark.llm.common import Scratch, settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    docs = docs.select(*COLUMNS)
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, machine).where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go from the texts; n_chars follows."""
    settle(spark)
    out = lines.deduplicated(docs.select(*COLUMNS), "lang", "source")
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays; rows that repeat it stay once.

    Documents without words, which link with nothing, and rows without doc_id stay."""
    settle(spark)
    docs = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = jaccard.similarity_classes(docs.select(*COLUMNS))
    others = found.where("n_shingles > 0 AND doc_id IS NOT NULL AND NOT doc_id <=> component_id").select("doc_id", "text_hash").distinct()
    return docs.join(others.hint("merge"), ["doc_id", "text_hash"], "left_anti").dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    settle(spark)
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 ids."""
    settle(spark)
    return tokens.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The stages learn a classifier, choose minima of hashes and run a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written and read again as the next one's docs."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
