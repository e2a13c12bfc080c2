"""Participants after classification, verification of lines and confidences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestant.functions.marks import NUMBERED, NUMBERED_BODY, has_redaction, is_redaction, marker, speaker_label

WEIGHTS = {"verified": 1.0, "verified_with_inference": 0.88, "redacted": 0.80, "source_missing": 0.45, "uncertain": 0.25, "conflict": 0.0}


def unregistered(lines: DataFrame, people: DataFrame) -> DataFrame:
    """doc_id, id of speakers that are in no registry: an anti join of the lines' speakers."""
    spoken = lines.filter("participant_id is not null").select("doc_id", F.col("participant_id").alias("id")).distinct()
    return spoken.join(people.select("doc_id", "id"), ["doc_id", "id"], "left_anti")


def reconciled(people: DataFrame, lines: DataFrame, types: DataFrame) -> DataFrame:
    """The participants and those that only the lines know, all counted anew over the lines that begin a block."""
    at = F.struct("physical_page", "row_index")
    spoken = lines.filter("participant_id is not null").withColumnRenamed("participant_id", "id")
    fresh = spoken.join(people.select("doc_id", "id"), ["doc_id", "id"], "left_anti").groupBy("doc_id", "id").agg(F.min_by("speaker", at).alias("s"), F.count_if(F.col("kind") == "question").alias("asked"), F.min(at).alias("first_seen"))
    typed = fresh.join(types, "doc_id", "left")
    role, interview = F.col("s.speaker_role"), F.coalesce(F.col("document_type") == "interview", F.lit(False))
    function = F.when(role == "witness", F.when(interview, "interviewee").otherwise("witness")).when(role == "attorney", F.when(interview & (F.col("asked") > 0), "interviewer").otherwise("counsel")).otherwise(role)
    nameless = F.col("s.redacted") | F.col("s.label").startswith("THE ") | F.col("s.label").startswith("ANONYMOUS ")
    new = typed.select(
        "doc_id", "id", F.col("s.label").alias("display_label"), F.when(~nameless, F.col("s.label")).alias("canonical_name"), F.array("s.label").alias("observed_labels"), role.alias("speaker_role"), F.when(role == "unknown", 0.4).otherwise(0.9).alias("role_confidence"),
        function.alias("participant_function"), F.when(role == "unknown", 0.3).otherwise(0.78).alias("function_confidence"), F.col("s.redacted").alias("redacted"), F.lit(1).alias("source_rank"), F.col("first_seen.physical_page").alias("seen_page"), F.col("first_seen.row_index").alias("seen_row"),
    )
    old = people.select("doc_id", "id", "display_label", "canonical_name", "observed_labels", "speaker_role", "role_confidence", "participant_function", "function_confidence", "redacted", F.lit(0).alias("source_rank"), F.col("first_seen.physical_page").alias("seen_page"), F.col("first_seen.line_index").alias("seen_row"))
    counts = spoken.filter("starts_new_block").groupBy("doc_id", "id").agg(F.count("*").alias("observations"), *[F.count_if(F.col("kind") == k).alias(f"{k}_observations") for k in ("question", "answer", "objection")])
    both = old.unionByName(new).join(counts, ["doc_id", "id"], "left").fillna(0, ["observations", "question_observations", "answer_observations", "objection_observations"])
    return both.withColumn("statement_observations", F.col("observations") - F.col("question_observations") - F.col("answer_observations") - F.col("objection_observations"))


def _checked(lines: DataFrame, people: DataFrame) -> DataFrame:
    raw = F.col("raw_text")
    body = F.when(F.col("line_number").isNotNull() & raw.rlike(NUMBERED), F.regexp_replace(raw, NUMBERED_BODY, "")).otherwise(raw)
    rest = F.coalesce(speaker_label(body)["rest"], body)
    found = marker(rest)
    explicit = F.exists("evidence.items", lambda e: e["source"] == "explicit_marker")
    told = lines.withColumn("found", found).withColumn("shown", F.col("found").isNotNull() & ((F.col("found.style") != "bare_uppercase") | explicit))
    roles = people.select("doc_id", F.col("id").alias("participant_id"), F.col("speaker_role").alias("registered_role"))
    joined = told.join(roles, ["doc_id", "participant_id"], "left")
    marker_conflict = F.col("shown") & (F.col("found.kind") != F.col("kind"))
    role_conflict = F.coalesce((F.col("registered_role") != "unknown") & (F.col("speaker.speaker_role") != "unknown") & (F.col("registered_role") != F.col("speaker.speaker_role")), F.lit(False))
    return joined.withColumn("marker_conflict", marker_conflict).withColumn("role_conflict", role_conflict)


def verified(lines: DataFrame, people: DataFrame) -> DataFrame:
    """Lines with their verification."""
    told = _checked(lines, people)
    redacted = is_redaction(F.col("text")) | has_redaction(F.col("raw_text"))
    plain = F.when(redacted, F.when(F.col("kind") == "redaction_marker", "redacted").otherwise("verified_with_inference")).when(F.col("confidence") == "explicit", "verified").when(F.col("confidence") == "inferred", "verified_with_inference").otherwise("uncertain")
    conflict = F.col("marker_conflict") | F.col("role_conflict")
    hidden = F.coalesce(F.col("speaker.redacted"), F.lit(False))
    out = F.when(hidden, "uncertain").when(conflict, "conflict").when(F.col("kind") == "unknown", "uncertain").otherwise(plain)
    return told.withColumn("verification", out).select(*lines.columns, "verification")


def issues(lines: DataFrame, people: DataFrame) -> DataFrame:
    """doc_id, code, physical_page, source_row_id of conflicts."""
    told = _checked(lines, people)
    codes = F.array(F.when(F.col("marker_conflict"), F.lit("explicit_marker_conflict")), F.when(F.col("role_conflict"), F.lit("participant_role_conflict")))
    return told.select("doc_id", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"), "physical_page", "source_row_id")


def parse_confidence(lines: DataFrame) -> DataFrame:
    """doc_id, line_confidence: mean weight of the lines' verification; documents without lines have none."""
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])[F.col("verification")]
    return lines.groupBy("doc_id").agg(F.avg(weight).alias("line_confidence"))


def final_confidence(line: DataFrame, ir: DataFrame, gate: DataFrame) -> DataFrame:
    """doc_id, parse_confidence: of lines and conversation, lowered by what is not covered, at most the gate's ceiling."""
    both = gate.select("doc_id", "confidence_ceiling").join(line, "doc_id", "left").join(ir.select("doc_id", "conversation_confidence", "source_row_coverage"), "doc_id", "left").fillna(0.0)
    value = (0.35 * F.col("line_confidence") + 0.65 * F.col("conversation_confidence")) * (0.45 + 0.55 * F.col("source_row_coverage"))
    return both.select("doc_id", F.least("confidence_ceiling", F.least(F.lit(1.0), value)).alias("parse_confidence"))


def diagnostics(lines: DataFrame) -> DataFrame:
    """doc_id and counts of lines by confidence, kind and verification."""
    v = lambda s: F.count_if(F.col("verification") == s)
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.count_if(F.col("confidence") == "inferred").alias("inferred_lines"), F.count_if(F.col("kind") == "unknown").alias("unknown_lines"), v("verified").alias("verified_lines"), v("verified_with_inference").alias("verified_with_inference_lines"), v("conflict").alias("conflict_lines"), v("uncertain").alias("uncertain_lines"),
        F.countDistinct("physical_page").alias("transcript_pages"), F.countDistinct(F.when(F.col("transcript_page").isNull(), F.col("physical_page"))).alias("pages_without_label"),
    )
