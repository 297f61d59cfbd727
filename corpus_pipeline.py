"""From raw documents to sampled token ids, in five stages that each call one operator of infragraph.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the
shared folder and rereads it as the next stage's documents. All stages but the last return the columns of
``documents``. SQL cannot express language ID, the samples or the mix, so ``ORACLE_SQL`` is None and
tests/llm/test_pipeline.py holds the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from infragraph.llm.common import documents, fold
from infragraph.llm.language_id import fit_language_model, identify
from infragraph.llm.line_dedup import drop_repeated_lines
from infragraph.llm.mixing import mixed_documents
from infragraph.llm.queries import tokenizer_path
from infragraph.llm.sampling import encode_samples
from infragraph.llm.simhash import keep_first
from infragraph.plans.lineage import stored

#: A document goes if its language is undetermined, if its posterior is under this, or if the best language's model
#: needs more bits a byte than the plain text has: then it is in none of the languages that were learned.
MIN_LANGUAGE_SCORE, MOST_BITS_PER_BYTE = 0.5, 8.0


def named(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a clear language."""
    model = fit_language_model(docs, ~F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
    prefix = "__"
    while any(c.startswith(prefix) for c in docs.columns):  # names that no column of the documents has
        prefix += "_"
    found = identify(docs, model, prefix=prefix)
    clear = (F.col(f"{prefix}lang_pred") != "und") & (F.col(f"{prefix}score") >= MIN_LANGUAGE_SCORE) & (F.col(f"{prefix}bits_per_byte") <= MOST_BITS_PER_BYTE)
    return found.where(clear).select(*named(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are near a line before them in the corpus."""
    return drop_repeated_lines(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*named(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def sample_segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, with piece ids that decode to its text."""
    return encode_samples(docs, tokenizer_path(), k=2).select("doc_id", "sample", "n_pieces", "log_prob", "log_inclusion", "round_trip", "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("sample_segmentations", sample_segmentations),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", "zstd")
    return docs
