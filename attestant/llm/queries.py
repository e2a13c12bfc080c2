"""Queries of this subpackage, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestant.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each type of personal information in each testimony row and participant."""
    from attestant.llm.pii import redact

    found = redact(table(spark, folder, "canonical_rows"), table(spark, folder, "participants"))
    return found.select("rec_table", "doc_id", "rec_id", F.explode(F.array_distinct("spans.pii_type")).alias("pii_type")).distinct()


def p2_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of each transcript (page 0) and page, with a confidence."""
    from attestant.llm.language import languages

    return languages(*(table(spark, folder, t) for t in ("canonical_rows", "transcript_lines", "doc_context", "common_words")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts whose hint is missing or wrong, and pages in another language."""
    from attestant.llm.language import corrections

    return corrections(*(table(spark, folder, t) for t in ("canonical_rows", "transcript_lines", "doc_context", "common_words"))).select("doc_id", "physical_page", "lang_code")


def p3_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered turns with roles and parents of the transcripts without defect."""
    from attestant.llm.conversations import conversations

    return conversations(*(table(spark, folder, t) for t in ("canonical_rows", "transcript_lines", "doc_context", "page_frames")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts that are empty, broken or lack answers."""
    from attestant.llm.conversations import defects

    return defects(*(table(spark, folder, t) for t in ("canonical_rows", "transcript_lines", "doc_context", "page_frames")))


def p4_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Clean speaker turns of interviews."""
    from attestant.llm.speech import speaker_turns

    return speaker_turns(*(table(spark, folder, t) for t in ("canonical_rows", "transcript_lines", "doc_context", "participants")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Time marks, fillers, sounds and openings of turns in interviews."""
    from attestant.llm.speech import findings

    return findings(*(table(spark, folder, t) for t in ("canonical_rows", "transcript_lines", "doc_context", "participants")))


def p5_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The person or organisation of each named participant."""
    from attestant.llm.names import linked

    return linked(table(spark, folder, "participants"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of participants of a matter that are the same."""
    from attestant.llm.names import pairs

    return pairs(table(spark, folder, "participants"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records with wrongly decoded characters."""
    from attestant.llm.encoding import damaged_records

    found = damaged_records(table(spark, folder, "canonical_rows", "doc_id", "id", "raw_text", "text"), table(spark, folder, "fragments", "doc_id", "fragment_id", "text"))
    return found.select("rec_table", "doc_id", "rec_id").distinct()


def p7_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Scanned pages as continuous, repaired paragraphs."""
    from attestant.llm.scans import paragraphs

    return paragraphs(table(spark, folder, "canonical_rows"), table(spark, folder, "transcript_lines"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Headers, page numbers, broken words and misread letters in scanned rows."""
    from attestant.llm.scans import findings

    return findings(table(spark, folder, "canonical_rows"), table(spark, folder, "transcript_lines"))


def p8_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with leaked evaluation texts, without these."""
    from attestant.llm.leaks import cleaned

    return cleaned(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and the evaluation items that leaked into them."""
    from attestant.llm.leaks import leaked

    return leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture, with their tokens and copies."""
    from attestant.llm.mixing import mixture

    return mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each listed source."""
    from attestant.llm.mixing import shares

    return shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Text statistics of each page."""
    from attestant.llm.quality import statistics

    return statistics(table(spark, folder, "documents"), table(spark, folder, "common_words"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that are mainly lists, tables or junk."""
    from attestant.llm.quality import kinds

    return kinds(table(spark, folder, "documents"), table(spark, folder, "common_words")).distinct()


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from attestant.llm import oracles

    return oracles.oracle_sql()
