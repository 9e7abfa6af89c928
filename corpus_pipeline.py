"""From raw documents to packed training sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of documents, whatever these are named. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmetrics.llm import decontamination, language, ngram_join, packing, quality
from callmetrics.llm.scratch import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _key(docs: DataFrame) -> str:
    """A name for the key of rows that no column of the documents has."""
    name = "row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """The documents with a key, a number that no other row has: its file's number and its place there. What isn't read from files is written first."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = written(docs, "pipeline-rows")
    files = docs.select(F.col("_metadata.file_path").alias("f")).distinct()
    numbers = files.select("f", F.row_number().over(Window.orderBy("f")).cast("long").alias("n"))  # a row a file
    placed = docs.select(F.struct("*").alias("d"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    return placed.join(F.broadcast(numbers), "f").select("d.*", F.expr("shiftleft(n, 40) + i").alias(key))


def _without(rows: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """The keyed documents whose row is not among the removed ones, without their key."""
    return rows.join(removed, key, "left_anti").drop(key)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language that was learned, go. Null and empty texts have no letters; repeated rows are judged each for itself."""
    return language.accepted(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the current policy go, by the bits of their ledger. A null text has no words and goes; repeated rows are judged each for itself."""
    return quality.passing(docs, quality.POLICIES["v1"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: the first with the least doc_id, one without doc_id only if all are. Texts without words are in no group and stay."""
    key = _key(docs)
    rows = _keyed(docs, key)
    groups = ngram_join.join(rows, id_column=key).filter("doc_id <> component_id")
    others = written(groups.select(F.col("doc_id").alias(key), F.col("component_id").alias("component")), "pipeline-copies")
    members = others.unionByName(others.select(F.col("component").alias(key), "component").distinct())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)
    first = members.join(rows.select(key, "doc_id"), key).groupBy("component").agg(F.min(order).alias("x"))
    return _without(rows, members.select(key).join(first.select(F.col("x")[key].alias(key)), key, "left_anti"), key)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, whatever their id; items without an id are searched as one item. An empty benchmark takes nothing."""
    key = _key(docs)
    rows = _keyed(docs, key)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    found = decontamination.contamination(rows.select(F.col(key).alias("doc_id"), "text"), benchmark)
    return _without(rows, found.filter("contaminated").select(F.col("doc_id").alias(key)), key)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens. A null text is its end id alone; repeated rows are packed each for itself."""
    return packing.query_docs(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("packing", packed),
]
ORACLE_SQL = None  # the network's predictions and the vocabulary's ids are not SQL's to compute


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
