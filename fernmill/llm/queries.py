"""The registered queries over the operators of this subpackage.

Each query reads whole tables, calls its operator with production parameters
and derives the columns to report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernmill.llm import conversations, decontaminate, hard_negatives, html_text, licenses, mixing, pii, quality, secrets, simhash, tokens, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and of its lines: the heading line, the rest, and what crosses lines."""
    found = tokens.section_tokens(_table(spark, sf_dir, "documents"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y.cast("long"))
    return found.select(
        "doc_id",
        "n_chars",
        "n_tokens",
        F.size("tokens").cast("long").alias("n_sections"),
        F.get("tokens", F.lit(0)).cast("long").alias("first_tokens"),
        F.array_max("tokens").cast("long").alias("longest_tokens"),
        total(F.col("tokens")).alias("allocated_tokens"),
        total(F.col("crossed")).alias("crossing_tokens"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds, also with other numbers or names."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document by SimHash."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id", "copies")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    found = warc.round_trip(_table(spark, sf_dir, "pages"), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first quality verdict and base measures of every document."""
    return quality.measure(_table(spark, sf_dir, "documents")).drop("text")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: fixed patterns and the network's findings."""
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secrets.joined(F.col("spans")).alias("spans"), "n_network", F.array_join(F.transform("spans", lambda x: F.format_string("%.4f", x["score"])), ",").alias("scores"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source to target weights."""
    return mixing.by_source(_table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", html_text.extract(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out third."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: fixed patterns and discovered identifiers."""
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS[:4]), F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule: its faults and the cheapest repair."""
    return conversations.damaged_and_repaired(_table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives that score just below each anchor's positives."""
    return hard_negatives.mined(_table(spark, sf_dir, "embeddings"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tokens": op1_tokens,
    "op2_decontaminate": op2_decontaminate,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_mixing": op7_mixing,
    "op8_html": op8_html,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_conversations": op11_conversations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_licenses": op13_licenses,
}
SQL: dict[str, str] = {
    "op4_warc": warc.SQL,
    "op5_quality": quality.SQL,
    "op7_mixing": mixing.SQL,
    "op11_conversations": conversations.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_licenses": licenses.SQL,
}
