"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from infragraph.llm import quality, search
from infragraph.llm.common import documents, fold
from infragraph.plans.lineage import scratch_path

TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each whole text as piece ids, each decoded again and held against the text."""
    from infragraph.llm.sampling import encode_samples

    found = encode_samples(documents(spark, sf_dir), tokenizer_path(), k=2)
    return found.select("doc_id", "sample", "n_pieces", "log_prob", "log_inclusion", "ids_hash", "round_trip", "ids")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with remainder 0 are only scored; those with remainder 1 are counted and tune the weights."""
    from infragraph.llm.lm_scoring import COUNTED, SCORED, TUNING, score_documents

    docs = documents(spark, sf_dir)
    rest = fold("doc_id", 10)
    folds = F.when(rest == 0, SCORED).when(rest == 1, TUNING).otherwise(COUNTED)
    scored = score_documents(docs, folds)
    return scored.select("doc_id", (F.col("fold") == SCORED).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from infragraph.llm.line_dedup import line_classes

    return line_classes(documents(spark, sf_dir)).drop("row")


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from infragraph.llm.fingerprint import fingerprint_edits

    return fingerprint_edits(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from infragraph.llm.language_id import fit_language_model, identify

    docs = documents(spark, sf_dir)
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = fit_language_model(docs, ~held)
    found = identify(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from infragraph.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from infragraph.llm.repeats import remove_repeats

    return remove_repeats(documents(spark, sf_dir)).drop("kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from infragraph.llm.token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), tokenizer_path())


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from infragraph.llm.mixing import mix_report

    return mix_report(documents(spark, sf_dir))


def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least four periods and six words, in texts of which one in ten gets a tail that repeats."""
    from infragraph.llm.runs import periodic_runs, run_report, with_planted_periods

    docs = documents(spark, sf_dir).select("doc_id", with_planted_periods("doc_id", "text").alias("text"))
    return run_report(periodic_runs(docs))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as grammars of token ids, and read back from the files."""
    from infragraph.llm.token_files import read_documents, write_token_files

    path = scratch_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return read_documents(spark, path, with_ids=False)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sampled_segmentations, op2_lm_scoring, op3_line_dedup, op4_document_fingerprints, op5_language_id, op6_simhash_near_dedup, op7_suffix_array_dedup, op8_token_counts, op9_mix_sources, op10_quality_cascade, op11_periodic_runs, op12_token_files, op13_ranked_search)
}

ORACLES: dict[str, str] = {"op10_quality_cascade": quality.ORACLE, "op13_ranked_search": search.ORACLE}
