"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
folder and reads it again as the next stage's docs. What stages do with nulls in any column, empty and very long texts,
ties, repeated rows, empty tables and further columns is said at each; none fails on them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import near_dedup, packing, quality_rules, secret_scan, toxicity
from lamina.llm.common import table, temporary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go; its cutoffs come from the labels of the documents there are.

    Null and blank texts go. Null ids stay unless they break a rule, null languages are a stratum of their own, repeated
    rows are judged alike, long texts are judged whole. An empty table stays empty; without labels only blank texts go.
    Further columns are kept.
    """
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the lexicon is learned from the labels of the documents there are.

    Null and empty texts aren't toxic. Null ids and repeated rows are scored like others, long texts whole. An empty
    table stays empty; without labels the built-in lexicon holds. Further columns are kept.
    """
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least doc_id stays, null ids last.

    Null texts all stay; texts without words are copies of equal ones only; of rows repeated in doc_id and text one
    stays; long texts are compared whole. An empty table stays empty. Further columns are kept.
    """
    return near_dedup.keep(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reported parts of credentials are struck out of the texts; no row goes.

    Null and empty texts stay as they are. Null ids and repeated rows are each redacted, long texts and parts whole. An
    empty table stays empty. n_chars is renewed where a text changed; further columns are kept.
    """
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its bin and place there.

    Null texts have no piece, empty ones their end token, long ones several pieces. Null ids, ties and repeated rows are
    packed like others. An empty table gives no rows. Further columns are left out.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("toxicity_grammar", toxic),
    ("simhash_forest", dedup),
    ("multipart_secrets", secrets),
    ("best_two_fit", pack),
]

#: Trained cutoffs and lexicons, fingerprints and packing have no SQL: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from documents. A stage's result is deleted once the next one's is written, but the last."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = f"{path or temporary('pipeline-')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{k - 1}-{STAGES[k - 1][0]}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
