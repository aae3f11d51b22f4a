"""A corpus pipeline: each stage takes the documents that the one before it kept, and rewrites them.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir). ``run`` applies them to
``documents``, writing each stage's result as Parquet in the shared folder and reading it again, so that
a lost executor costs a stage's tasks and not the stages before it; a stage's input goes when its result is written.

A stage's decision about a row finds it by a key made of the row itself, so that ids may be null or repeated. Rows that are
equal in all columns are decided alike, but that the join stage keeps one of them. All stages give empty tables for empty ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, ngram_join, packing, quality, suffix_dedup
from tidemark.llm.common import cut_lineage, remove, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """The documents' columns and ``_row``, a hash of them all."""
    return docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts have a score like any other; equal texts share theirs."""
    docs = keyed(docs)
    verdicts = quality.classify(docs, table(spark, sf_dir, "labels"), carry=("_row",))
    accepted = verdicts.where("predicted = 1").select(F.col("carried__row").alias("_row")).distinct()
    return docs.join(accepted, "_row", "left_semi").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones: that with the smallest id, null first, then the smallest key. Texts without words all stay."""
    docs = keyed(docs)
    found = cut_lineage(ngram_join.join(docs, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id", "n_shingles"))
    members = found.distinct().join(docs.select("_row", "doc_id").distinct(), "_row")
    kept = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("first")).select(F.col("first._row").alias("_row"))
    rest = docs.join(kept, "_row", "left_semi")
    again = cut_lineage(found.where("n_shingles > 0").groupBy("_row").count().where("count > 1").select("_row"))
    if not again.isEmpty():
        rest = rest.join(again, "_row", "left_anti").unionByName(rest.join(again, "_row", "left_semi").dropDuplicates(["_row"]))
    return rest.select(*COLUMNS)


def repeated_text_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long passages that stand earlier; a character that is cut through goes with its passage.

    Rows of one id stand in the order of their texts, null ids first. A null text stays null.
    """
    rest = suffix_dedup.dedup(docs.withColumn("is_null", F.col("text").isNull()), with_kept=True, carry=("lang", "source", "is_null"))
    text = F.when(~F.col("carried_is_null"), whole_characters(F.col("kept")))
    x = rest.select("doc_id", text.alias("text"), F.col("carried_lang").alias("lang"), F.col("carried_source").alias("source"))
    return x.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def whole_characters(raw):
    """UTF-8 bytes as a string, without the pieces of cut characters."""
    replaced = F.make_valid_utf8(raw.cast("string"))
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.replace(replaced, F.lit("�"), F.lit("")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; where its last block ends within one, that far. Texts without words aren't taken."""
    docs = keyed(docs)
    return mixing.taken_rows(docs, mixing.mix(docs, id_col="_row"), id_col="_row").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents in their sequences. A null text is the end id alone; repeated rows are packed each."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeated_text_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
