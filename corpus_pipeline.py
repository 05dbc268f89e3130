"""A training corpus from raw documents: rules, line templates, near duplicates, decontamination, packing.

Every stage works on all that the stage before it kept; ``run`` stores each stage's result in the shared
folder, so a stage that is repeated after a failure starts from files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablerisk.llm import contamination, jaccard, packing, quality, queries, templates
from tablerisk.llm.store import growing, new_folder, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key of their own as doc_id and the given one as ``own_id``: only rows alike in doc_id, text
    and lang share a key, so rows with a null or a repeated doc_id are judged apart."""
    return docs.withColumn("own_id", F.col("doc_id")).withColumn("doc_id", F.xxhash64("doc_id", "text", "lang"))


def unkeyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.col("own_id")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word rules and the perplexity bands keep, each row judged by its own text."""
    docs = keyed(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "own_id")
    labels = labels.join(growing(docs.select("own_id", "doc_id")), "own_id").select("doc_id", "quality")
    judged = quality.quality_rules(docs, labels).groupBy("doc_id").agg(F.min("kept").alias("kept"))
    return unkeyed(docs.join(growing(judged.where("kept").select("doc_id")), "doc_id", "left_semi"))


def line_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring template lines; n_chars follows the text."""
    cut = templates.drop_recurring_lines(keyed(docs))
    return unkeyed(cut.withColumn("n_chars", F.length("text").cast("long")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by 5-word shingles at 80 %; a null doc_id comes last."""
    docs = keyed(docs)
    groups = jaccard.similar_documents(docs, size=5, percent=80).select("doc_id", "component_id")
    named = groups.join(growing(docs.select("doc_id", "own_id").distinct()), "doc_id")
    order = F.struct(F.col("own_id").isNull(), "own_id", "doc_id")
    first = named.groupBy("component_id").agg(F.min_by("doc_id", order).alias("doc_id")).select("doc_id")
    return unkeyed(docs.join(growing(first), "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    docs = keyed(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = contamination.contaminated(docs, benchmark).select("doc_id").distinct()
    return unkeyed(docs.join(growing(hit), "doc_id", "left_anti"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of 1024 tokens."""
    return packing.packed(docs, queries.tokenizer_path("byte_bpe_50k.json"), keeps_space=True, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_templates", line_templates),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Perplexity, templates, similarity joins and packing are not expressible in SQL over whole tables.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each from the stored result of the one before it."""
    folder = new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
    return docs
