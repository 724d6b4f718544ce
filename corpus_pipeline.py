"""The corpus pipeline: documents in, a decontaminated, masked and weighted mix out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernmill.llm import decontaminate, mixing, pii, simhash, toxicity
from fernmill.llm.scratch import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold; learned from the labels that aren't held out.

    A null or empty text is not toxic. Rows that repeat stay or go together, an
    empty table stays empty, and columns are kept whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return docs.where(toxicity.score(F.col("text"), model) < toxicity.THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word similarities of 0.8 or more join: that of the smallest id.

    Texts that are null or without words are one group. Of rows alike in id and
    text the first by all their columns stays; a null id only where its group has
    no other. Empty tables and other columns go as in ``simhash.deduplicate``.
    """
    return simhash.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it is or with other numbers and names.

    Null and empty texts hold none. Rows that repeat stay or go together, an
    empty table stays empty, and columns are kept whatever their names.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; n_chars follows the text and is null with it.

    Rows that repeat are masked alike; other columns, clean and null texts stay as they are.
    """
    out = pii.mask(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their words (``size``), ``copies`` and ``taken`` words.

    These three replace columns of the same names; all others are kept. A null
    source is a source like others, a text without words is not taken, ties fall
    as in ``mixing.mix``, and an empty table stays empty.
    """
    kept = [c for c in docs.columns if c not in ("size", "copies", "taken")]
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = docs.select(*(F.col(f"`{c}`") for c in kept), words.alias("size"), F.array(F.col("source").cast("string")).alias("_pipeline_members"))
    mixed, _, _ = mixing.mix(sized, members="_pipeline_members")
    return mixed.where("copies > 0").select(*(F.col(f"`{c}`") for c in kept), "size", "copies", (F.col("copies") * F.col("size")).alias("taken"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_benchmark),
    ("personal_data", mask_personal),
    ("mixing", mix_sources),
]

#: SQL can express neither fingerprints nor learned scores: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
