"""The corpus pipeline: each stage reads what its predecessor kept and returns what goes on.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``documents``.  A row stands or falls by its own text: verdicts are joined back on a
hash of id and text, never on the id alone.  :func:`run` writes each stage's rows to
the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import decontamination, mixing, quality, resharding, signature_trees
from parley.llm.tables import split_join
from parley.session import materialize

SHARDS = 8


def _keyed(docs: DataFrame) -> DataFrame:
    """Add ``_row``: the same for rows of equal id and text only."""
    return docs.withColumn("_row", mixing.row_hash(1))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rejected = quality.quality_scores(_keyed(docs), labels, key_col="_row").where("predicted = 0").select("_row").distinct()
    return split_join(_keyed(docs), rejected, ["_row"], "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that five-word shingles link at 0.8 or more, one of the smallest id stays, no id being the greatest.

    Texts without words link with nothing and stay.
    """
    found = signature_trees.near_duplicates(_keyed(docs), id_col="_row")
    found = materialize(found.select(F.col("doc_id").alias("_row"), "n_shingles", "component_id"), "found")
    rows = found.groupBy("_row", "n_shingles", "component_id").agg(F.count(F.lit(1)).alias("n"))
    ids = _keyed(docs).select("_row", F.col("doc_id").cast("long").alias("id")).distinct()
    order = F.struct(F.col("id").isNull().alias("last"), "id", "_row", "n")
    first = rows.where("n_shingles > 0").join(ids, "_row").groupBy("component_id").agg(F.min(order).alias("f"))
    stay = materialize(first.select("f._row", (F.col("f.n") > 1).alias("_again")).union(rows.where("n_shingles = 0").select("_row", F.lit(False))), "stay")
    kept = split_join(_keyed(docs), stay, ["_row"])
    once = kept.where("not _again")
    if stay.where("_again").isEmpty():
        return once.select(docs.columns)
    return once.unionByName(kept.where("_again").dropDuplicates(["_row"])).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a window of a benchmark item go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times."""
    return mixing.take_documents(docs, mixing.mix_sources(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in eight shards of near equal bytes, with their slots."""
    placed = resharding.reshard(docs, SHARDS, F.pmod(F.xxhash64("source"), F.lit(6)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("sharding", sharding),
]

#: The stages learn, follow links and sample by hashes, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
