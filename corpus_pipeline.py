"""Corpus pipeline: raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the columns of `documents`; the last
one returns the placement of every piece. Stages are written as Parquet and read again, so a lost executor
repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendguard.llm.jaccard import similar_documents
from spendguard.llm.language import fit_languages, identify
from spendguard.llm.mixing import mix
from spendguard.llm.packing import packed_digests
from spendguard.scratch import materialise
from spendguard.session import ship_package


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def row_key() -> Column:
    """Identity of a document: its id and its text, so rows without an id or with a repeated one stay apart."""
    return F.xxhash64("doc_id", "text")


def prepare(spark: SparkSession) -> None:
    """Make the package known to the workers, and keep Arrow batches of whole texts small unless the session says how large."""
    ship_package(spark)
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, "2000")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; texts that are null or have no letter (`und`) go.

    The languages are learned from the labels that the documents carry; without any label, a letter is enough.
    """
    prepare(spark)
    model = fit_languages(docs)
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    others = F.struct(*[c for c in docs.columns if c != "text"]).alias("_row")
    found = identify(docs.select("doc_id", "text", others), model, carry=["_row", "text"])
    return found.where("lang_pred <> 'und'").select("_row.*", "text").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of texts linked by five-word Jaccard similarity 0.8: the smallest id, named ones first.

    Rows that share an id but not a text are different documents; texts without a word are linked with nothing.
    """
    prepare(spark)
    # The key is the id, so that the groups start from the oldest document; further texts of an id get a negative one.
    digest = F.xxhash64("text")
    texts = docs.groupBy("doc_id").agg(F.min(digest).alias("_first"), F.max(digest).alias("_last"))
    reused = materialise(texts.where("doc_id is not null and _first <> _last").drop("_last"), "reused_ids")
    own = F.col("doc_id").isNotNull() & (F.col("_first").isNull() | (F.col("_first") == digest))
    other = row_key().bitwiseOR(F.lit(-(1 << 63)))
    keyed = docs.join(reused, "doc_id", "left").withColumn("_key", F.when(own, F.col("doc_id")).otherwise(other))
    groups = similar_documents(keyed.select("_key", "text"), width=5, numerator=80, id_col="_key")
    members = groups.select("_key", "component_id").join(keyed.select("_key", "doc_id"), "_key")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_key")
    first = members.groupBy("component_id").agg(F.min(order)["_key"].alias("_key")).select("_key")
    return keyed.join(first, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    prepare(spark)
    keyed = docs.withColumn("_key", row_key())
    taken = mix(keyed.withColumn("doc_id", F.col("_key")).drop("_key"))
    copies = taken.where("taken > 0").groupBy(F.col("doc_id").alias("_key")).agg(
        F.sum(F.expr("taken div size")).cast("int").alias("_copies")
    )
    repeated = keyed.dropDuplicates(["_key"]).join(copies, "_key")
    return repeated.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document (repeats are packed each) in sequences of 1024 tokens."""
    prepare(spark)
    return packed_digests(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
