"""A corpus from raw documents: toxic text out, near duplicates out, benchmark leaks out, secrets redacted, sources mixed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``, and further columns whatever their names. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.decontaminate import find_leaks
from corvane.llm.minhash import drop_near_duplicates
from corvane.llm.mixing import mix_sources
from corvane.llm.secrets import redact_secrets
from corvane.llm.shared import written
from corvane.llm.toxicity import fit_toxicity, toxicity_scores


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifiers don't reject. Null and empty texts are kept, rows without an id too; repeated rows share one fate. Without toxic labels all stay."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_scores(docs, model).filter("not toxic_flag").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates.

    Rows without an id or a text take no part and stay. Texts without words are copies of each other: one of their ids
    stays. Rows of one id are one document: of a repeated row each stays or goes with its id.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts hold none and stay. Rows of one id are one document: a passage in one of them removes all. A row
    without an id is a document of its own. A benchmark without items of five words removes nothing.
    """
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # a row without an id is a document of its own
    keyed = docs.withColumn("__row", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64(*docs.columns)))
    leaks = written(find_leaks(keyed, bench, id_col="__row").select("__row").distinct(), "leaks")
    return keyed.join(leaks, "__row", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by ``[kind]`` and ``n_chars`` set anew where that was done; null and empty texts and all other rows come back as they are."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with epoch and tokens to take, every source at the same share of as many tokens as there are.

    Texts without tokens, null ones too, aren't chosen. A null source is a source; rows without an id and repeated rows count each for
    itself. Columns named epoch, n_tokens or take_tokens are replaced.
    """
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: SQL can't express the fitted classifiers, the trees and the latent axes of the first stages.
ORACLE_SQL: str | None = None
