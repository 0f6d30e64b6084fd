"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.
All but the last return the columns of ``documents``; ``n_chars`` follows changed texts.
Null texts count as empty and stay null where a stage keeps them, rows without an id are kept
like others, rows with one id are one document where documents are compared, an empty table
stays empty, and further columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tidewell.llm import lines, packing, quality, secrets, simhash
from tidewell.llm.common import materialise


def _counted(docs: DataFrame) -> DataFrame:
    """docs with ``n_chars`` set anew, where there is one."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))


def _small_batches(spark: SparkSession) -> None:
    """A worker gets 1,000 documents at once, as executors also hold what earlier stages left."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    _small_batches(spark)
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another one keeps; one that loses all its lines stays, empty."""
    _small_batches(spark)
    return _counted(lines.dedup_lines(docs, keep_text=True).select(*docs.columns))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group.

    Rows with one id are one document, and the first of them stays, in the order of their text
    (null last) and then of their other columns.  A null id names no document to prefer, so
    its row stays.
    """
    first = simhash.near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    place = next(f"_place{k}" for k in range(len(docs.columns) + 1) if f"_place{k}" not in docs.columns)
    others = [F.col(f"`{f.name}`").asc_nulls_last() for f in docs.schema if f.name not in ("doc_id", "text") and not isinstance(f.dataType, (MapType, VariantType))]
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), *others)
    named = docs.where("doc_id is not null").join(first, "doc_id", "left_semi").select(*docs.columns)
    once = named.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return once.unionByName(docs.where("doc_id is null"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark."""
    return _counted(secrets.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    _small_batches(spark)
    return packing.pack_documents(docs, memo=150_000, at_once=1 << 20)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Expectation-maximisation, SimHash and the tokenizer have no SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
