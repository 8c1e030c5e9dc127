"""From raw documents to packed training sequences, in five stages, each over all that the one before kept.

Quality rules drop what they reject; of each group of near copies the document of the smallest id
stays; repeated passages are cut out of the texts; live secrets are masked; the texts are packed.
All stages but the last return the columns of ``documents``. A text that a stage changes has its
``n_chars`` counted anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm import jaccard, packing, quality_rules, secret_scan, unit_dedup
from peakloom.llm.common import hot_join, stored


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; trusted are those labelled as good."""
    return quality_rules.keep_good(docs, quality_rules.trusted_ids(spark, sf_dir))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each linked group, the one of the smallest id, then text hash; rows equal in id and text count once, rows without id stay."""
    keyed = docs.withColumn("__h", F.xxhash64("text"))
    names = stored(keyed.where("doc_id is not null").select("doc_id", "__h").distinct())
    if names.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        gone = jaccard.link(docs.select("doc_id", "text")).where("doc_id <> component_id").select("doc_id").distinct()
        kept = keyed.join(gone, "doc_id", "left_anti")
    else:
        gone = _later_texts(keyed, names)
        kept = keyed.join(gone, ["doc_id", "__h"], "left_anti")
    named = kept.where("doc_id is not null").dropDuplicates(["doc_id", "__h"])
    return named.unionByName(kept.where("doc_id is null")).select(*docs.columns)


def _later_texts(keyed: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, __h of every text that isn't the first of its group, where ids hold several texts; ``names``: all doc_id, __h."""
    names = stored(names.withColumn("__key", F.monotonically_increasing_id()))
    texts = keyed.join(names, ["doc_id", "__h"]).select("__key", "text") \
        .unionByName(keyed.where("doc_id is null").select(F.lit(None).cast("long").alias("__key"), "text"))
    groups = jaccard.link(texts, id_col="__key").where("doc_id is not null").select(F.col("doc_id").alias("__key"), "component_id").distinct()
    members = stored(groups.join(names, "__key").select("doc_id", "__h", "component_id"))
    firsts = stored(members.groupBy("component_id").agg(F.min(F.struct("doc_id", "__h")).alias("first"), F.count("*").alias("n")))
    found = hot_join(members, firsts, ["component_id"], "n", members.count())
    return found.where(F.struct("doc_id", "__h") != F.col("first")).select("doc_id", "__h")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the units that an earlier document holds, passages of short sentences or lines too."""
    return _counted(unit_dedup.dedup(docs, whole=True))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with live secrets masked."""
    return _counted(secret_scan.redact(docs, few_owners=None))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences."""
    return packing.pack(packing.tokenized(docs, packing.public_bpe()))


STAGES = [("quality_rules", quality), ("near_copies", near_copies), ("passages", passages), ("secrets", secrets), ("packing", packed)]

#: The quality rules hash with a function that SQL engines don't share, and the tokens come from a vocabulary file.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each stage's rows are written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = _reread(spark, docs)
    return docs


def _reread(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
    path = f"{folder.rstrip('/')}/stage-{uuid.uuid4().hex}"
    docs.write.parquet(path)
    return spark.read.parquet(path)
