"""Registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablerisk.llm import alignment, contamination, conversations, factorisation, jaccard, language_model, packing, quality, sequences, spans, substrings, templates, warc
from tablerisk.llm.sql import ORACLE  # noqa: F401


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the machine keeps a public tokenizer; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without bytes that a 200-byte string covers which starts elsewhere too."""
    return substrings.remove_repeats(table(spark, folder, "documents"), length=200)


def op2_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    """WARC records of all pages, revisits resolved, as read back from the archives."""
    return warc.deduplicated_archives(table(spark, folder, "pages"), least_bytes=0)


def op3_elias_fano_lm(spark: SparkSession, folder: str) -> DataFrame:
    """All documents scored with the trigram trie learned from six of seven folds."""
    return language_model.language_model_scores(table(spark, folder, "documents"), fold=2, folds=7)


def op4_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without sentences that a repeated run of two or more, 20 words or more, covers, but for its first document."""
    cut = spans.remove_repeated_spans(table(spark, folder, "documents"), sentences=2, min_words=20)
    return cut.select("doc_id", "n_sentences", "n_removed", "text")


def op5_arrow_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents as read back from the Arrow stream files."""
    return sequences.token_sequences(
        table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"), keeps_space=False, end_id=1
    )


def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets are at least 90 % similar."""
    return jaccard.similar_documents(table(spark, folder, "documents"), size=3, percent=90)


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.packed(
        table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), keeps_space=True, end_id=2
    )


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Word statistics and Kneser-Ney perplexity bands over all documents."""
    return quality.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the best window."""
    return contamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without lines whose template recurs across documents."""
    cut = templates.drop_recurring_lines(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped_lines", "text")


def op11_bidirectional_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest repair and repaired text's hash of all conversations, damaged by rule."""
    return conversations.repaired(table(spark, folder, "conversations"), damage=True)


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of aligned tokens of two public tokenizers in all documents, and counts of their links."""
    byte_level, pieces = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return alignment.aligned_documents(table(spark, folder, "documents"), byte_level, pieces)


def op13_factorisation_machine(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents by a factorisation machine learned from four of five folds of the labels."""
    return factorisation.classified(table(spark, folder, "documents"), table(spark, folder, "labels"), fold=0, folds=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_substrings": op1_suffix_substrings,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_elias_fano_lm": op3_elias_fano_lm,
    "op4_sentence_spans": op4_sentence_spans,
    "op5_arrow_sequences": op5_arrow_sequences,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_line_templates": op10_line_templates,
    "op11_bidirectional_repair": op11_bidirectional_repair,
    "op12_token_alignment": op12_token_alignment,
    "op13_factorisation_machine": op13_factorisation_machine,
}
