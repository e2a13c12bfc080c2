"""Structural checks and the gate (Q01-Q07)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestant.functions.text import trimmed

PROCEDURAL = ("examination_heading", "heading", "parenthetical", "exhibit_marker", "redaction_marker", "page_header")
BLOCKING = ("source_inventory_mismatch", "dialogue_row_ownership", "ocr_required", "participant_reference")
ISSUE = ("doc_id", "code", "physical_page", "row_id")


def _issue(df: DataFrame, code: str, page: bool = True, row: str | None = None) -> DataFrame:
    return df.select("doc_id", F.lit(code).alias("code"), (F.col("physical_page") if page else F.lit(None)).cast("int").alias("physical_page"), (F.col(row) if row else F.lit(None)).cast("string").alias("row_id"))


def inventory(expected: DataFrame, rows: DataFrame) -> DataFrame:
    """Q01: doc_id, expected, rows, distinct_rows. expected: doc_id, expected (lines that aren't blank)."""
    have = rows.groupBy("doc_id").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("distinct_rows"))
    return expected.join(have, "doc_id", "left").fillna(0, ["rows", "distinct_rows"])


def inventory_issues(counts: DataFrame) -> DataFrame:
    return _issue(counts.filter("distinct_rows <> expected or distinct_rows <> rows"), "source_inventory_mismatch", page=False)


def row_ownership(rows: DataFrame, made: DataFrame) -> DataFrame:
    """Q02: doc_id, id, physical_page, owners of each testimony row: how many blocks hold it. Sound transcripts have 1 everywhere."""
    owners = made.select("doc_id", F.explode("source_row_ids").alias("id")).groupBy("doc_id", "id").agg(F.count("*").alias("owners"))
    return rows.filter("disposition = 'dialogue'").select("doc_id", "id", "physical_page").join(owners, ["doc_id", "id"], "left").fillna(0, ["owners"])


def row_issues(rows: DataFrame) -> DataFrame:
    """Q03."""
    out = _issue(rows.filter("disposition = 'unclassified'"), "unclassified_source_row", row="id")
    return out.unionByName(_issue(rows.filter("ocr_confidence < 0.85"), "low_ocr_confidence", row="id")) if "ocr_confidence" in rows.columns else out


def page_issues(pages: DataFrame) -> DataFrame:
    """Q04: pages may lack the layout's columns; what they lack raises nothing."""
    out = _issue(pages.filter(trimmed(F.coalesce("text", F.lit(""))) == ""), "empty_page")
    flags = (("requires_ocr", "requires_ocr", "ocr_required"), ("ocr_performed", "ocr_performed", "ocr_review_required"), ("extraction_engine", "extraction_engine = 'lopdf_fallback'", "fallback_extraction"), ("reading_order_uncertain", "reading_order_uncertain or column_count > 1", "reading_order_review"))
    for column, when, code in flags:
        if column in pages.columns:
            out = out.unionByName(_issue(pages.filter(when), code))
    if "warnings" in pages.columns:
        out = out.unionByName(_issue(pages.select("doc_id", "physical_page", F.explode("warnings")), "extraction_warning"))
    return out


def line_issues(lines: DataFrame, people: DataFrame) -> DataFrame:
    """Q05."""
    unresolved = lines.filter(~F.col("kind").isin(*PROCEDURAL) & (F.col("participant_id").isNull() | (F.col("kind") == "unknown")))
    absent = lines.filter("participant_id is not null").join(people.select("doc_id", F.col("id").alias("participant_id")).distinct(), ["doc_id", "participant_id"], "left_anti")
    out = _issue(unresolved, "unresolved_attribution", row="source_row_id").unionByName(_issue(absent, "participant_reference", row="source_row_id")).unionByName(_issue(lines.filter("speaker.redacted"), "redacted_identity", row="source_row_id"))
    return out.unionByName(_issue(lines.filter("verification = 'conflict'"), "classification_conflict", row="source_row_id"))


def passed_on(gaps: DataFrame, verification: DataFrame, languages: DataFrame, rows: DataFrame) -> DataFrame:
    """Q06: gaps, conflicts, languages the grammar isn't made for, and documents without testimony."""
    out = _issue(gaps, "source_gap_candidate").unionByName(verification.select("doc_id", "code", F.col("physical_page").cast("int").alias("physical_page"), F.lit(None).cast("string").alias("row_id")))
    none = languages.select("doc_id").distinct().join(rows.filter("disposition = 'dialogue'").select("doc_id").distinct(), "doc_id", "left_anti")
    return out.unionByName(_issue(languages.filter("code <> 'en'"), "language_review", page=False)).unionByName(_issue(none, "no_dialogue", page=False))


def gate(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """Q07: doc_id, status, ready, confidence_ceiling, issues: blocked without testimony or by one of BLOCKING, passed only without any issue."""
    found = issues.groupBy("doc_id").agg(F.count("*").alias("issues"), F.bool_or(F.col("code").isin(*BLOCKING, "no_dialogue")).alias("blocked"))
    both = documents.select("doc_id").distinct().join(found, "doc_id", "left").fillna(0, ["issues"]).fillna(False, ["blocked"])
    ready = ~F.col("blocked") & (F.col("issues") == 0)
    return both.select("doc_id", F.when(F.col("blocked"), "blocked").when(ready, "passed_structural_checks").otherwise("needs_review").alias("status"), ready.alias("ready"), F.when(F.col("blocked"), 0.35).when(ready, 0.95).otherwise(0.75).alias("confidence_ceiling"), "issues")
