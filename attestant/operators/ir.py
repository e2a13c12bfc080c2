"""The document's relations for further use: enriched rows, format regions, utterances, frames, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PROCEDURAL = ("parenthetical", "examination_heading", "heading", "exhibit_marker", "redaction_marker")


def event_kind(kind: Column, opens: Column, speaker: Column) -> Column:
    """What a line's kind is as a row's event."""
    return (
        F.when(kind == "question", "question_marker").when(kind == "answer", "answer_marker").when(kind == "examination_heading", "examination_heading").when(kind.isin("parenthetical", "exhibit_marker"), "parenthetical").when(kind == "redaction_marker", "redaction").when(kind == "heading", "procedural")
        .when(opens & speaker.isNotNull(), "speaker_anchor").otherwise("text")
    )


def enriched_rows(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows with event_kind, speaker_anchor_label and speaker_participant_id of their lines; rows without one keep theirs."""
    told = lines.select("doc_id", F.col("source_row_id").alias("id"), event_kind(F.col("kind"), F.col("starts_new_block"), F.col("speaker")).alias("e"), F.col("speaker.label").alias("speaker_anchor_label"), F.col("participant_id").alias("speaker_participant_id"))
    both = rows.join(told, ["doc_id", "id"], "left")
    return both.select(*rows.columns, "speaker_anchor_label", "speaker_participant_id", F.col("e")).withColumn("event_kind", F.coalesce("e", "event_kind")).drop("e")


def page_signals(lines: DataFrame) -> DataFrame:
    """doc_id, physical_page and counts of labels, explicit questions and answers and headings that begin a block."""
    starts = F.col("starts_new_block")
    explicit = starts & (F.col("confidence") == "explicit")
    labelled = F.exists("evidence.items", lambda e: e["source"] == "speaker_label") if "evidence" in lines.columns else F.col("labelled")
    return lines.groupBy("doc_id", "physical_page").agg(F.count_if(starts & labelled).alias("speakers"), F.count_if(explicit & (F.col("kind") == "question")).alias("questions"), F.count_if(explicit & (F.col("kind") == "answer")).alias("answers"), F.count_if(starts & (F.col("kind") == "examination_heading")).alias("headings"))


def region_pages(signals: DataFrame) -> DataFrame:
    """Pages with grammar and region_no: neighbouring pages of one grammar are a region. Windows run over a document's pages."""
    marks = F.col("questions") + F.col("answers")
    grammar = F.when((F.col("speakers") > 0) & (marks > 0), "hybrid").when(F.col("speakers") > 0, "speaker_prefixed").when(marks > 0, "qa_markers").otherwise("unknown")
    order = W.partitionBy("doc_id").orderBy("physical_page")
    told = signals.withColumn("grammar", grammar)
    new = ~((F.lag("grammar").over(order) == F.col("grammar")) & (F.lag("physical_page").over(order) + 1 == F.col("physical_page")))
    return told.withColumn("new", F.coalesce(new, F.lit(True)).cast("long")).withColumn("region_no", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("new")


def format_regions(signals: DataFrame) -> DataFrame:
    """doc_id, region_id, grammar, page range, summed counts, confidence."""
    told = region_pages(signals).groupBy("doc_id", "region_no", "grammar").agg(F.min("physical_page").alias("physical_page_start"), F.max("physical_page").alias("physical_page_end"), *[F.sum(c).alias(c) for c in ("speakers", "questions", "answers", "headings")])
    return told.select("doc_id", F.concat(F.lit("format_region_"), F.col("region_no").cast("string")).alias("region_id"), "grammar", "physical_page_start", "physical_page_end", "speakers", "questions", "answers", "headings", F.when(F.col("grammar") == "unknown", 0.3).otherwise(0.9).alias("confidence"))


def row_regions(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """doc_id, id, region_id of testimony rows: the region is carried by its pages, so the join is on equal pages."""
    pages = region_pages(signals).select("doc_id", "physical_page", F.concat(F.lit("format_region_"), F.col("region_no").cast("string")).alias("region_id"))
    return rows.filter("disposition = 'dialogue'").join(pages, ["doc_id", "physical_page"]).select("doc_id", "id", "region_id")


def source_spans(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, block_no, span_no, physical_page, transcript_page, line_start, line_end, row_ids: a block's rows, parted where page or label changes."""
    owned = blocks.select("doc_id", "block_no", F.explode("source_row_ids").alias("id")).join(rows.select("doc_id", "id", "physical_page", "row_index", "transcript_page", "line_number"), ["doc_id", "id"])
    order = W.partitionBy("doc_id", "block_no").orderBy("physical_page", "row_index")
    key = F.struct("physical_page", "transcript_page")
    told = owned.withColumn("new", F.when(F.row_number().over(order) == 1, 1).otherwise((~F.lag(key).over(order).eqNullSafe(key)).cast("int"))).withColumn("span_no", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("row_index", "id", "line_number")))
    spans = told.groupBy("doc_id", "block_no", "span_no", "physical_page", "transcript_page").agg(ordered.alias("r"))
    return spans.select("doc_id", "block_no", F.col("span_no").cast("int").alias("span_no"), "physical_page", "transcript_page", F.element_at("r", 1)["line_number"].alias("line_start"), F.element_at("r", -1)["line_number"].alias("line_end"), F.transform("r", lambda x: x["id"]).alias("row_ids"))


def discourse_role(kind: Column) -> Column:
    """What a block's kind is in the conversation."""
    return F.when(kind == "question", "question").when(kind == "answer", "response").when(kind == "objection", "objection").when(kind == "interpreter_statement", "interpretation").when(kind == "unknown", "unknown").when(kind.isin(*PROCEDURAL), "procedural").otherwise("statement")


def utterances(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, utterance_id, block_no, participant, label, discourse_role, text, verification and four confidences. pages: reconstruction_confidence."""
    sure = pages.select("doc_id", "physical_page", F.coalesce("reconstruction_confidence", F.lit(0.0)).alias("c")) if "reconstruction_confidence" in pages.columns else pages.select("doc_id", "physical_page", F.lit(1.0).alias("c"))
    own = blocks.select("doc_id", "block_no", F.explode(F.array_distinct(F.transform("source_row_ids", lambda i: F.regexp_extract(i, r"^p([0-9]+)_", 1).cast("int")))).alias("physical_page"))
    least = own.join(sure, ["doc_id", "physical_page"], "left").groupBy("doc_id", "block_no").agg(F.least(F.lit(1.0), F.min(F.coalesce("c", F.lit(0.0)))).alias("source_confidence"))
    explicit = F.col("confidence") == "explicit"
    return blocks.join(least, ["doc_id", "block_no"]).select(
        "doc_id", F.concat(F.lit("utterance_"), "block_id").alias("utterance_id"), "block_no", "participant_id", F.col("speaker.label").alias("speaker_label"), discourse_role(F.col("kind")).alias("discourse_role"), "text",
        F.when(F.coalesce("speaker.redacted", F.lit(False)), "uncertain").otherwise(F.col("verification")).alias("verification"), F.when(F.col("participant_id").isNotNull(), 0.9).otherwise(0.0).alias("speaker_confidence"), F.when(explicit, 0.95).otherwise(0.7).alias("boundary_confidence"), F.when(explicit, 0.95).otherwise(0.65).alias("role_confidence"), "source_confidence",
    )


def entities(people: DataFrame) -> DataFrame:
    """A person for each participant that isn't redacted."""
    return people.filter("not redacted").select("doc_id", F.concat(F.lit("entity_"), "id").alias("entity_id"), F.coalesce("canonical_name", "display_label").alias("canonical_label"), F.lit("person").alias("entity_kind"), F.col("id").alias("participant_id"))


def conversation_edges(edges: DataFrame) -> DataFrame:
    """The graph's edges between utterances."""
    names = F.create_map(*[F.lit(x) for pair in (("follows", "follows"), ("responds_to", "responds_to"), ("interrupts", "interrupts"), ("resumes_after", "resumes"), ("interprets", "clarifies")) for x in pair])
    return edges.select("doc_id", F.concat(F.lit("utterance_"), "from_block").alias("from_utterance"), F.concat(F.lit("utterance_"), "to_block").alias("to_utterance"), names[F.col("edge_kind")].alias("relation"), F.when(F.col("edge_kind") == "follows", 1.0).otherwise(0.7).alias("confidence"))


def page_frames(rows: DataFrame, spans: DataFrame, said: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, physical_page, row_ids in order, region ids, and the first utterance that comes in from another page and that goes on to one."""
    ids = rows.groupBy("doc_id", "physical_page").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "id"))), lambda x: x["id"]).alias("row_ids"))
    own = rows.select("doc_id", "id", "physical_page").join(regions, ["doc_id", "id"]).groupBy("doc_id", "physical_page").agg(F.array_sort(F.collect_set("region_id")).alias("format_region_ids"))
    reach = spans.groupBy("doc_id", "block_no").agg(F.min("physical_page").alias("lo"), F.max("physical_page").alias("hi")).filter("lo < hi")
    named = reach.join(said.select("doc_id", "block_no", "utterance_id", "participant_id"), ["doc_id", "block_no"])
    on_page = spans.select("doc_id", "block_no", "physical_page").distinct().join(named, ["doc_id", "block_no"])
    what = F.struct("utterance_id", "participant_id")
    crossing = on_page.groupBy("doc_id", "physical_page").agg(F.min_by(what, F.when(F.col("lo") < F.col("physical_page"), F.col("block_no"))).alias("continuity_in"), F.min_by(what, F.when(F.col("hi") > F.col("physical_page"), F.col("block_no"))).alias("continuity_out"))
    return ids.join(own, ["doc_id", "physical_page"], "left").join(crossing, ["doc_id", "physical_page"], "left").withColumn("format_region_ids", F.coalesce("format_region_ids", F.array().cast("array<string>")))


def diagnostics(rows: DataFrame, lines: DataFrame, made: DataFrame, said: DataFrame, spans: DataFrame, signals: DataFrame) -> DataFrame:
    """doc_id and counts of rows, utterances and regions, coverage and conversation confidence."""
    owned = made.select("doc_id", F.explode("source_row_ids").alias("id")).distinct().withColumn("owned", F.lit(True))
    dialogue = F.col("disposition") == "dialogue"
    counts = rows.join(owned, ["doc_id", "id"], "left").groupBy("doc_id").agg(F.count("*").alias("canonical_rows"), F.count_if(dialogue).alias("transcript_rows"), F.count_if(dialogue & F.coalesce("owned", F.lit(False))).alias("rows_assigned"), F.countDistinct(F.when(dialogue, F.col("physical_page"))).alias("transcript_pages"))
    nameless = lines.groupBy("doc_id").agg(F.count_if(F.col("speaker").isNull() & ~F.col("kind").isin(*PROCEDURAL)).alias("unresolved_speaker_rows"))
    crossing = spans.groupBy("doc_id", "block_no").agg(F.countDistinct("physical_page").alias("n")).groupBy("doc_id").agg(F.count_if(F.col("n") > 1).alias("cross_page_utterances"))
    regions = region_pages(signals).groupBy("doc_id").agg(F.countDistinct("region_no").alias("format_regions"))
    sure = F.least("source_confidence", "role_confidence", F.when(F.col("discourse_role") == "procedural", 1.0).otherwise(F.col("speaker_confidence")))
    spoken = said.groupBy("doc_id").agg(F.count("*").alias("utterances"), F.avg(sure).alias("conversation_confidence"))
    both = counts
    for part in (nameless, crossing, regions, spoken):
        both = both.join(part, "doc_id", "left")
    return both.fillna(0).withColumn("source_row_coverage", F.when(F.col("transcript_rows") > 0, F.col("rows_assigned") / F.col("transcript_rows")).otherwise(0.0))
