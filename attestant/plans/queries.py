"""Queries of the operators over the tables of a data folder. Each has the same in SQL in ``oracles`` where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestant.functions import marks, text
from attestant.operators import classify, inventory, ir, layout, preflight, quality, reconcile, sections, turns
from attestant.plans.transcript import Transcripts
from attestant.sources.tables import cut_lineage, spread, table

#: Top margin of the transcripts' pages, for repeated furniture.
TOP_MARGIN = 90.0


def rows(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """canonical_rows, each delivered row once: that delivered last; only the named columns if any are named, as one value of a row."""
    given = table(spark, folder, "canonical_rows")
    wanted = [c for c in columns or given.columns if c not in ("doc_id", "id")]
    last = given.groupBy("doc_id", "id").agg(F.max_by(F.struct(*wanted), "ingested_at").alias("r"))
    return last.select("doc_id", "id", *[F.col("r")[c].alias(c) for c in wanted])


def talk(spark: SparkSession, folder: str) -> DataFrame:
    """Testimony lines in the shape classification gives: kinds and speakers as delivered, a block begins at every row that isn't plain text."""
    own = inventory.continuity(rows(spark, folder, "physical_page", "row_index", "transcript_page", "line_number", "event_kind", "text", "raw_text").filter("line_number is not null or event_kind <> 'page_header'"))
    lines = table(spark, folder, "transcript_lines").select("doc_id", "source_row_id", "kind", "speaker", "confidence").dropDuplicates(["doc_id", "source_row_id"])
    both = own.join(lines, (own.doc_id == lines.doc_id) & (own.id == lines.source_row_id)).drop(lines.doc_id)
    return both.select(
        "doc_id", "source_row_id", "physical_page", "row_index", "transcript_page", "line_number", "kind", "speaker", F.col("speaker.participant_id").alias("participant_id"), "confidence", "source_continuity", (F.col("event_kind") != "text").alias("starts_new_block"), "text", "raw_text",
        (F.col("event_kind") == "speaker_anchor").alias("labelled"), F.when(F.col("confidence") == "unknown", "uncertain").when(F.col("confidence") == "inferred", "verified_with_inference").otherwise("verified").alias("verification"),
    )


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of ``talk``; both are written once, as what follows reads them more than once."""
    return cut_lineage(turns.blocks(cut_lineage(talk(spark, folder))))


def _page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, physical_page, text of the pages, put together from their rows."""
    return rows(spark, folder, "physical_page", "row_index", "raw_text").groupBy("doc_id", "physical_page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", F.coalesce("raw_text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def rebuilt_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as texts, put together from their rows, with the kind of their document."""
    return _page_texts(spark, folder).join(table(spark, folder, "doc_context", "doc_id", "kind").dropDuplicates(["doc_id"]), "doc_id", "left")


def corpus_pages(spark: SparkSession, folder: str) -> DataFrame:
    """documents as pages of their source: doc_id (the source), physical_page (the document's number)."""
    return spread(table(spark, folder, "documents").select(F.coalesce("source", F.lit("?")).alias("doc_id"), F.col("doc_id").cast("int").alias("physical_page"), "text"))


def parsed(spark: SparkSession, folder: str) -> Transcripts:
    return Transcripts(rebuilt_pages(spark, folder))


# --- marks of lines


def numbered_lines(spark, folder):
    """F01."""
    return rows(spark, folder, "raw_text").select("doc_id", "id", marks.numbered(text.trimmed(F.col("raw_text"))).alias("n")).select("doc_id", "id", F.col("n.number").cast("long").alias("number"), "n.body")


def page_numbers(spark, folder):
    """F04."""
    return rows(spark, folder, "text").select("doc_id", "id", marks.page_mark(F.col("text")).cast("long").alias("page_mark"), marks.pure_number(F.col("text")).cast("long").alias("pure_number")).filter("page_mark is not null or pure_number is not null")


def marker_candidates(spark, folder):
    """F08."""
    return rows(spark, folder, "text").select("doc_id", "id", marks.marker(F.col("text")).alias("m")).filter("m is not null").select("doc_id", "id", "m.kind", "m.style", "m.pattern", F.col("m.priority").cast("long").alias("priority"), "m.rest")


def line_flags(spark, folder):
    """F10, F17-F19."""
    c = F.col("text")
    return rows(spark, folder, "text").select("doc_id", "id", marks.is_redacted(c).alias("redacted"), marks.has_redaction(c).alias("has_redaction"), marks.is_redaction(c).alias("pure_redaction"), marks.is_objection(c).alias("objection"), marks.opens_parenthetical(c).alias("opens"), marks.closes_parenthetical(c).alias("closes"), marks.is_exhibit(c).alias("exhibit"), marks.is_examination(c).alias("examination"), marks.is_heading(c).alias("heading"))


def label_roles(spark, folder):
    """F11, F20, F21."""
    c = F.col("display_label")
    return table(spark, folder, "participants").select("doc_id", "id", "display_label").distinct().select("doc_id", "id", marks.label_role(c).alias("label_role"), text.label_id(c).alias("label_id"), text.canonical_label(c).alias("canonical_label"), text.shortened(c, 12).alias("short_label"))


def colon_labels(spark, folder):
    """F13."""
    return rows(spark, folder, "text").select("doc_id", "id", marks.colon_label(F.col("text")).alias("l")).filter("l is not null").select("doc_id", "id", "l.label", "l.rest")


def titled_labels(spark, folder):
    """F14."""
    return rows(spark, folder, "text").select("doc_id", "id", marks.titled_label(F.col("text")).alias("l")).filter("l is not null").select("doc_id", "id", "l.label", "l.rest")


def titled_lines(spark, folder):
    """lines made of a title, a participant's name and its label."""
    title = F.element_at(F.array(*[F.lit(t) for t in ("Mr. ", "DR ", "The Witness ", "JUDGE ", "Captain ")]), (F.col("participant_key") % 5 + 1).cast("int"))
    people = table(spark, folder, "participants").filter("canonical_name is not null").select("participant_key", F.concat(title, F.col("canonical_name"), F.lit(". "), F.coalesce("display_label", F.lit(""))).alias("line")).distinct()
    return people.select("participant_key", marks.titled_label(F.col("line")).alias("l")).filter("l is not null").select("participant_key", "l.label", "l.rest")


def introductions(spark, folder):
    """F15, F16."""
    return rows(spark, folder, "text").select("doc_id", "id", marks.introduced(F.col("text")).alias("introduced"), marks.by_label(F.col("text")).alias("by_label")).filter("introduced is not null or by_label is not null")


def label_matches(spark, folder):
    """F22."""
    return table(spark, folder, "participants").filter("canonical_name is not null and display_label is not null").select("doc_id", "id", "canonical_name", "display_label").distinct().select("doc_id", "id", marks.labels_match(F.col("canonical_name"), F.col("display_label")).alias("matches"))


# --- preflight


def marker_rules(spark, folder):
    """F07, P03."""
    own = rows(spark, folder, "text")
    return preflight.marker_rules(own.select("doc_id", F.lit("transcript").alias("section"), F.col("text").alias("body")), own).select("doc_id", "kind", "style", "pattern", F.col("priority").cast("long").alias("priority"), "observations")


def dominant_markers(spark, folder):
    """P19."""
    own = rows(spark, folder, "text")
    return preflight.dominant_markers(preflight.marker_rules(own.select("doc_id", F.lit("transcript").alias("section"), F.col("text").alias("body")), own))


def _said(spark, folder):
    return rows(spark, folder, "physical_page", "transcript_page", "line_number").select("doc_id", "physical_page", "transcript_page", F.col("line_number").alias("number"), F.lit(False).alias("header"))


def _labels(spark, folder):
    return table(spark, folder, "page_frames").select("doc_id", "physical_page", "transcript_page", "section")


def typical_line_range(spark, folder):
    """P13."""
    return preflight.line_range(_said(spark, folder)).select("doc_id", F.col("typical_line_min").cast("long").alias("typical_line_min"), F.col("typical_line_max").cast("long").alias("typical_line_max"))


def gaps(spark, folder):
    """P14."""
    return preflight.gaps(_said(spark, folder).withColumn("transcript_page", F.lit(None).cast("string")), _labels(spark, folder)).select("doc_id", "gap_kind", F.col("physical_page").cast("long").alias("physical_page"), F.col("first_missing").cast("long").alias("first_missing"), F.col("last_missing").cast("long").alias("last_missing"))


def source_completeness(spark, folder):
    """P15."""
    said = _said(spark, folder)
    return preflight.completeness(said, _labels(spark, folder), preflight.line_range(said)).select("doc_id", F.round("source_completeness", 6).alias("source_completeness"))


def layout_summary(spark, folder):
    """P02."""
    return preflight.layout_summary(_labels(spark, folder))


def participant_votes(spark, folder):
    """P04-P07 on the labels as delivered: each label's counts, the voted role, ids in order of appearance."""
    said = talk(spark, folder).filter("speaker.label is not null")
    kind = F.when(F.col("kind").isin("question", "answer", "objection"), F.col("kind")).otherwise("statement")
    seen = said.select("doc_id", "physical_page", F.col("row_index").alias("line_index"), F.col("speaker.label").alias("label"), text.canonical_label(F.col("speaker.label")).alias("canonical"), F.col("speaker.speaker_role").alias("speaker_role"), kind.alias("observation"))
    return preflight.participants(seen).select("doc_id", "id", "display_label", "canonical_name", F.array_join("observed_labels", "|").alias("observed_labels"), "speaker_role", F.round("role_confidence", 6).alias("role_confidence"), "observations", "question_observations", "answer_observations", "objection_observations", "statement_observations")


def primaries(spark, folder):
    """P11, P12."""
    people = table(spark, folder, "participants").dropDuplicates(["doc_id", "id"]).withColumn("first_seen", F.col("id"))
    rules = people.select("doc_id", F.lit("answer").alias("kind"), F.lit(0).alias("observations"))
    return preflight.primaries(people, rules).select("doc_id", F.col("primary_questioner.participant_id").alias("questioner"), F.col("primary_witness.participant_id").alias("witness"), F.col("witnesses").cast("long").alias("witnesses"))


def redaction_candidates(spark, folder):
    """Marked lines of the transcripts' pages, whole pages, in page order."""
    return preflight.redaction_candidates(rebuilt_pages(spark, folder)).select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), "signal", "confidence", "note")


def redaction_summary(spark, folder):
    """P17."""
    return preflight.redaction_summary(rebuilt_pages(spark, folder)).select("doc_id", "textual_redaction_markers", "requires_visual_confirmation")


def language_hints(spark, folder):
    """P21."""
    return preflight.language_hint(rebuilt_pages(spark, folder))


# --- sections


def page_features(spark, folder):
    """C07, C08."""
    f = sections.features(corpus_pages(spark, folder))
    return f.select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), F.col("numbered").cast("long").alias("numbered"), F.round("sequence", 6).alias("sequence"), F.col("citations").cast("long").alias("citations"), "index_like", F.col("marks").cast("long").alias("marks"))


def page_sections(spark, folder):
    """C01-C06 over the pages of the transcripts."""
    return sections.sections(rebuilt_pages(spark, folder)).select("doc_id", "physical_page", "section", "section_confidence")


def sequence_scores(spark, folder):
    """Over the printed numbers of each page of the transcripts."""
    n = rows(spark, folder, "physical_page", "row_index", "line_number").filter("line_number is not null").groupBy("doc_id", "physical_page").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "line_number"))), lambda x: x["line_number"]).alias("n"))
    return n.select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), F.round(sections.share_of_successors(F.col("n")), 6).alias("sequence"), F.round(sections.share_of_successors(F.col("n"), 4), 6).alias("tolerant"))


# --- inventory and continuity


def source_rows(spark, folder):
    """Rows of the corpus pages."""
    from attestant.sources.text import rows_of

    pages = table(spark, folder, "documents").select("doc_id", F.lit(1).alias("physical_page"), "text")
    return rows_of(pages).select("doc_id", "row_id", F.col("row_index").cast("long").alias("row_index"), "raw_text", F.col("leading_number").cast("long").alias("leading_number"))


def document_sha256(spark, folder):
    """S20."""
    return table(spark, folder, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def repeated_furniture(spark, folder):
    """R05."""
    return inventory.repeated_furniture(rows(spark, folder, "physical_page", "line_number", "text", "bbox"), top=TOP_MARGIN).distinct()


def source_continuity(spark, folder):
    """K03, K04."""
    return inventory.continuity(rows(spark, folder, "physical_page", "row_index", "transcript_page", "line_number")).select("doc_id", "id", "source_continuity", "suspicious")


# --- pages with the sections they were delivered in


def _sectioned(spark, folder):
    told = table(spark, folder, "page_frames", "doc_id", "physical_page", "section").distinct()
    return cut_lineage(rebuilt_pages(spark, folder).join(told, ["doc_id", "physical_page"], "left").withColumn("section", F.coalesce("section", F.lit("unknown"))))


def page_lines(spark, folder):
    """F02, F03."""
    return inventory.source_lines(_sectioned(spark, folder)).select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), F.col("line_index").cast("long").alias("line_index"), F.col("row_index").cast("long").alias("row_index"), "raw", "has_numbers", F.col("number").cast("long").alias("number"), "body")


def page_labels(spark, folder):
    """F05, P01."""
    pages = _sectioned(spark, folder)
    return inventory.page_contexts(pages, inventory.source_lines(pages)).select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), "section", "transcript_page")


def inventory_rows(spark, folder):
    """The inventory of the pages' lines."""
    pages = _sectioned(spark, folder)
    lines = cut_lineage(inventory.source_lines(pages))
    made = inventory.canonical_rows(lines, cut_lineage(inventory.page_contexts(pages, lines)))
    return made.select("doc_id", "id", "transcript_page", F.col("line_number").cast("long").alias("line_number"), "text", "event_kind", "disposition", "source", "anchor")


def named_subjects(spark, folder):
    """P09."""
    return preflight.named_subject(_sectioned(spark, folder))


def _people(spark, folder):
    return table(spark, folder, "participants").dropDuplicates(["doc_id", "id"]).withColumn("first_seen", F.col("id"))


def front_names(spark, folder):
    """P10."""
    return preflight.front_names(_sectioned(spark, folder), _people(spark, folder))


def front_roles(spark, folder):
    """F23."""
    return preflight.front_roles(_sectioned(spark, folder), _people(spark, folder))


def _rules(own):
    return preflight.marker_rules(own.select("doc_id", F.lit("transcript").alias("section"), F.col("text").alias("body")), own)


def document_types(spark, folder):
    """P22."""
    return preflight.document_types(_sectioned(spark, folder), _rules(rows(spark, folder, "text")), _people(spark, folder))


def titled_style(spark, folder):
    """P20."""
    return preflight.titled_style(rows(spark, folder, "text").select("doc_id", F.lit("transcript").alias("section"), F.col("text").alias("body")))


def participant_functions(spark, folder):
    """Roles, functions and names as front matter and subject set them, by the delivered document types."""
    people = _people(spark, folder).drop("participant_function", "function_confidence")
    types = table(spark, folder, "doc_context", "doc_id", "document_type").dropDuplicates(["doc_id"])
    return preflight.functions_of(people, _sectioned(spark, folder), types).select("doc_id", "id", "canonical_name", "speaker_role", F.round("role_confidence", 6).alias("role_confidence"), "participant_function", F.round("function_confidence", 6).alias("function_confidence"))


def _prints(spark, folder):
    own = rows(spark, folder, "text")
    lines = own.select("doc_id", F.lit("transcript").alias("section"), F.col("text").alias("body"))
    return preflight.fingerprint(lines, _rules(own), _labels(spark, folder).distinct())


def format_prints(spark, folder):
    """P18."""
    return _prints(spark, folder)


def router_flags(spark, folder):
    """Confidences of the learned format, and whether a document should be looked at by other means."""
    pages, people, own = rebuilt_pages(spark, folder), _people(spark, folder), rows(spark, folder, "text")
    sure = cut_lineage(preflight.confidences(people, _rules(own), _prints(spark, folder), _labels(spark, folder).distinct()))
    types = table(spark, folder, "doc_context", "doc_id", "document_type").dropDuplicates(["doc_id"])
    flags = preflight.router_flags(sure, preflight.language_hint(pages), types, preflight.layout_summary(_labels(spark, folder).distinct()), preflight.redaction_summary(pages))
    return sure.join(flags, "doc_id").select("doc_id", *[F.round(c, 6).alias(c) for c in ("participant_confidence", "marker_confidence", "page_confidence", "format_confidence")], "router_recommended")


def page_issues(spark, folder):
    """Q04: pages as their rows' sources and panels describe them."""
    told = rows(spark, folder, "physical_page", "row_index", "source", "ocr_confidence", "panel").groupBy("doc_id", "physical_page").agg(F.max(F.col("source") == "ocr").alias("ocr_performed"), F.coalesce(F.min("ocr_confidence") < 0.7, F.lit(False)).alias("requires_ocr"), F.when(F.max(F.col("source") == "fallback_text"), "lopdf_fallback").otherwise("positioned").alias("extraction_engine"), F.coalesce(F.max("panel") > 1, F.lit(False)).alias("reading_order_uncertain"), F.lit(1).alias("column_count"), F.filter(F.array(F.when(F.count("*") == 1, "one row"), F.when(F.max("row_index") >= F.count("*"), "absent rows")), lambda w: w.isNotNull()).alias("warnings"))
    pages = rebuilt_pages(spark, folder).join(told, ["doc_id", "physical_page"])
    return quality.page_issues(pages).select("doc_id", "code", F.col("physical_page").cast("long").alias("physical_page"))


# --- classification of the rows as delivered


def _classified(spark, folder):
    own = cut_lineage(rows(spark, folder, "physical_page", "row_index", "transcript_page", "line_number", "text", "raw_text", "disposition", "section"))
    people, rules = _people(spark, folder), _rules(own)
    return classify.classified(own, people, preflight.primaries(people, rules), rules)


def _evidence():
    return F.array_join(F.transform("evidence.items", lambda e: F.concat(e["source"], F.lit(":"), F.round(e["weight"] * 100).cast("int").cast("string"))), " ").alias("evidence")


def classified_lines(spark, folder):
    """The delivered rows' lines, with the delivered participants and the marks learned from all rows."""
    scores = [F.col(f"evidence.{k}_score").alias(f"{k}_score") for k in ("question", "answer", "objection", "statement")]
    return _classified(spark, folder).select("doc_id", "source_row_id", "kind", "participant_id", F.col("speaker.label").alias("label"), F.col("speaker.speaker_role").alias("speaker_role"), F.coalesce("speaker.redacted", F.lit(False)).alias("redacted"), "confidence", "source_continuity", "starts_new_block", "text", _evidence(), *scores)


def _registered(spark, folder):
    """The delivered participants, every third one under another role, so that roles disagree."""
    return _people(spark, folder).withColumn("speaker_role", F.when(F.col("participant_key") % 3 == 0, "judge").otherwise(F.col("speaker_role")))


def line_verification(spark, folder):
    """The lines' verification against their own text and the registered roles."""
    lines = cut_lineage(_classified(spark, folder))
    return reconcile.verified(lines, _registered(spark, folder)).select("doc_id", "source_row_id", "verification")


def passed_on_issues(spark, folder):
    """Conflicts, gaps and languages that the checks pass on."""
    lines = cut_lineage(_classified(spark, folder))
    found = preflight.gaps(_said(spark, folder).withColumn("transcript_page", F.lit(None).cast("string")), _labels(spark, folder))
    told = quality.passed_on(found, reconcile.issues(lines, _registered(spark, folder)), preflight.language_hint(rebuilt_pages(spark, folder)), rows(spark, folder, "physical_page", "disposition", "section").filter("section = 'transcript'"))
    return told.groupBy("doc_id", "code").agg(F.count("*").alias("issues"))


def completed_turns(spark, folder):
    """Those lines after their turns are complete."""
    return classify.completed(cut_lineage(_classified(spark, folder))).select("doc_id", "source_row_id", "kind", "confidence", _evidence())


# --- turns


def block_turns(spark, folder):
    """B01, B02."""
    return blocks(spark, folder).select("doc_id", "block_no", "block_id", "kind", "participant_id", "confidence", "verification", F.size("source_row_ids").cast("long").alias("rows"), "text")


def exchanges(spark, folder):
    """B03."""
    return turns.exchanges(blocks(spark, folder)).select("doc_id", "exchange_no", "question_block", F.array_join("responses", " ").alias("responses"), "answered")


def unpaired_answers(spark, folder):
    """B04."""
    return turns.unpaired_answers(blocks(spark, folder)).select("doc_id", "block_id")


def unanswered_questions(spark, folder):
    """B05."""
    return turns.unanswered_questions(blocks(spark, folder)).select("doc_id", "question_block")


def graph_edges(spark, folder):
    """B06, B07."""
    return turns.graph_edges(blocks(spark, folder))


def conversation_edges(spark, folder):
    """O08."""
    return ir.conversation_edges(turns.graph_edges(blocks(spark, folder)))


# --- relations


def event_kinds(spark, folder):
    """O01."""
    return talk(spark, folder).select("doc_id", "source_row_id", ir.event_kind(F.col("kind"), F.col("starts_new_block"), F.col("speaker")).alias("event_kind"))


def page_signals(spark, folder):
    """O02."""
    return ir.page_signals(talk(spark, folder)).withColumn("physical_page", F.col("physical_page").cast("long"))


def format_regions(spark, folder):
    """O03."""
    f = ir.format_regions(ir.page_signals(talk(spark, folder)))
    return f.withColumn("physical_page_start", F.col("physical_page_start").cast("long")).withColumn("physical_page_end", F.col("physical_page_end").cast("long"))


def row_regions(spark, folder):
    """O04."""
    return ir.row_regions(rows(spark, folder, "physical_page", "disposition"), ir.page_signals(talk(spark, folder)))


def utterances(spark, folder):
    """O05."""
    pages = rows(spark, folder, "physical_page", "ocr_confidence").groupBy("doc_id", "physical_page").agg(F.coalesce(F.min("ocr_confidence"), F.lit(1.0)).alias("reconstruction_confidence"))
    return ir.utterances(blocks(spark, folder), pages).select("doc_id", "utterance_id", "participant_id", "discourse_role", "verification", "speaker_confidence", "boundary_confidence", "role_confidence", F.round("source_confidence", 6).alias("source_confidence"))


def source_spans(spark, folder):
    """O06."""
    return ir.source_spans(blocks(spark, folder), rows(spark, folder, "physical_page", "row_index", "transcript_page", "line_number")).select("doc_id", "block_no", F.col("span_no").cast("long").alias("span_no"), F.col("physical_page").cast("long").alias("physical_page"), F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), F.array_join("row_ids", " ").alias("row_ids"))


def entities(spark, folder):
    """O07."""
    return ir.entities(table(spark, folder, "participants").select("doc_id", "id", "canonical_name", "display_label", "redacted").distinct())


def page_frames(spark, folder):
    """O09."""
    own, made = rows(spark, folder, "physical_page", "row_index", "transcript_page", "line_number", "disposition"), blocks(spark, folder)
    spans = ir.source_spans(made, own)
    said = made.select("doc_id", "block_no", F.concat(F.lit("utterance_"), "block_id").alias("utterance_id"), "participant_id")
    f = ir.page_frames(own, spans, said, ir.row_regions(own, ir.page_signals(talk(spark, folder))))
    return f.select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), F.array_join("row_ids", " ").alias("row_ids"), F.array_join("format_region_ids", " ").alias("format_region_ids"), F.col("continuity_in.utterance_id").alias("utterance_in"), F.col("continuity_out.utterance_id").alias("utterance_out"))


def ir_diagnostics(spark, folder):
    """O10, O11."""
    own, lines, made = rows(spark, folder, "physical_page", "row_index", "transcript_page", "line_number", "disposition", "ocr_confidence"), talk(spark, folder), blocks(spark, folder)
    said = ir.utterances(made, own.groupBy("doc_id", "physical_page").agg(F.coalesce(F.min("ocr_confidence"), F.lit(1.0)).alias("reconstruction_confidence")))
    d = ir.diagnostics(own, lines, made, said, ir.source_spans(made, own), ir.page_signals(lines))
    return d.select("doc_id", "canonical_rows", "transcript_rows", "rows_assigned", "utterances", "format_regions", "cross_page_utterances", "unresolved_speaker_rows", F.round("source_row_coverage", 6).alias("source_row_coverage"), F.round("conversation_confidence", 10).alias("conversation_confidence"))


# --- reconciliation and quality


def unregistered_speakers(spark, folder):
    """Speakers of lines that no participant row has."""
    return reconcile.unregistered(talk(spark, folder), table(spark, folder, "participants"))


def unlisted_speakers(spark, folder):
    """Speakers missing from a registry that lacks every fourth participant."""
    return reconcile.unregistered(talk(spark, folder), table(spark, folder, "participants").filter("participant_key % 4 <> 0"))


def disputed_rows(spark, folder):
    """Q02: rows with no block or two, where some blocks are left out and some come twice."""
    made = blocks(spark, folder)
    some = made.filter("block_no % 9 <> 0").unionByName(made.filter("block_no % 11 = 0"))
    return quality.row_ownership(rows(spark, folder, "physical_page", "disposition"), some).filter("owners <> 1").select("doc_id", "id", "owners")


def line_confidence(spark, folder):
    """K14."""
    return reconcile.parse_confidence(talk(spark, folder)).select("doc_id", F.round("line_confidence", 10).alias("line_confidence"))


def line_diagnostics(spark, folder):
    """K15."""
    return reconcile.diagnostics(talk(spark, folder))


def row_inventory(spark, folder):
    """Q01: rows the source lists against rows delivered."""
    expected = table(spark, folder, "page_frames").groupBy("doc_id").agg(F.sum(F.size("row_ids")).alias("expected"))
    return quality.inventory(expected, rows(spark, folder, "physical_page"))


def row_ownership(spark, folder):
    """Q02: testimony rows that aren't in exactly one block."""
    return quality.row_ownership(rows(spark, folder, "physical_page", "disposition"), blocks(spark, folder)).filter("owners <> 1").select("doc_id", "id", "owners")


def _issues(spark, folder):
    own, people, lines = rows(spark, folder, "physical_page", "disposition", "ocr_confidence"), table(spark, folder, "participants"), talk(spark, folder)
    return quality.row_issues(own).unionByName(quality.line_issues(lines, people)).unionByName(quality.inventory_issues(row_inventory(spark, folder)))


def quality_issues(spark, folder):
    """Q03, Q05."""
    return _issues(spark, folder).groupBy("doc_id", "code").agg(F.count("*").alias("issues"))


def quality_gate(spark, folder):
    """Q07."""
    return quality.gate(table(spark, folder, "doc_context", "doc_id"), _issues(spark, folder))


# --- sources, over files and pages made of the tables' texts and numbers


def decoded_files(spark, folder):
    """Texts written in six ways under five endings, decoded."""
    from attestant.sources.text import decoded

    n = F.col("doc_id") % 6
    wide = lambda e: F.encode("text", e)
    plain = F.encode("text", "UTF-8")
    joined = lambda head, body: F.unhex(F.concat(F.lit(head), F.hex(body)))
    content = F.when(n == 0, plain).when(n == 1, joined("EFBBBF", plain)).when(n == 2, joined("FFFE", wide("UTF-16LE"))).when(n == 3, joined("FEFF", wide("UTF-16BE"))).when(n == 4, F.unhex(F.concat(F.lit("FFFE41"), F.hex(wide("UTF-16LE"))))).otherwise(joined("FF20", plain))
    ending = F.element_at(F.array(*[F.lit(e) for e in (".txt", ".TXT", ".pdf", ".doc", "")]), (F.col("doc_id") % 5 + 1).cast("int"))
    files = table(spark, folder, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("page."), F.col("doc_id").cast("string"), ending).alias("filename"), content.alias("content"))
    utf8 = F.col("doc_id").cast("long") % 6
    return decoded(files).select("doc_id", "kind", "error", "text", F.when(utf8.isin(0, 1, 5), F.sha2("content", 256)).alias("source_sha256"))


def split_pages(spark, folder):
    """Texts with form feeds, with PAGE lines, and with neither, as pages."""
    from attestant.sources.text import pages_of

    n = F.col("doc_id") % 3
    made = F.when(n == 0, F.replace(F.col("text"), F.lit(".\n"), F.lit(".\f"))).when(n == 1, F.concat(F.lit("\n \n"), F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n page  12 \n\n")))).otherwise(F.col("text"))
    return pages_of(table(spark, folder, "documents").select("doc_id", made.alias("text"))).withColumn("physical_page", F.col("physical_page").cast("long"))


def joined_lines(spark, folder):
    """Pages whose printed numbers stand on lines of their own."""
    from attestant.sources.text import joined_numbers

    own = rows(spark, folder, "physical_page", "row_index", "line_number", "text").select("doc_id", "physical_page", "row_index", F.filter(F.array(F.col("line_number").cast("string"), F.when(F.col("row_index") % 7 == 3, F.lit(" 9 ")), F.coalesce("text", F.lit("")), F.when(F.col("row_index") % 5 == 2, F.lit("13A. Yes."))), lambda x: x.isNotNull()).alias("ls"))
    pages = own.groupBy("doc_id", "physical_page").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "ls"))), lambda x: x["ls"])).alias("ls"))
    return pages.select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), F.array_join(joined_numbers(F.col("ls")), "\n").alias("lines"))


def dark_colours(spark, folder):
    """Greys, RGB and CMYK colours made of the line items' rates."""
    n, d, t = F.col("l_linenumber") % 4, F.col("l_discount").cast("double"), F.col("l_tax").cast("double")
    colour = F.when(n == 0, F.array(d + t)).when(n == 1, F.array(d, t, d + t)).when(n == 2, F.array(d, t * 5, d * 4, 0.6 + 2 * d)).otherwise(F.array(d, t))
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), layout.is_dark(colour).alias("is_dark"))


def rectangle_signals(spark, folder):
    """The fragments' boxes as filled rectangles."""
    f = _pieces(spark, folder)
    grey = F.pmod(F.col("sequence"), F.lit(4)) * 0.05
    boxes = f.select("doc_id", "physical_page", "fragment_id", F.array("x_pos", "y_pos", "width", F.col("height") * (F.pmod(F.col("sequence"), F.lit(3)) + 1) / 4).alias("rect"), F.array(grey).alias("color_components"), F.struct("row_index", "sequence", "fragment_id").alias("place"))
    return layout.rectangle_signals(boxes, most=40).select("doc_id", "fragment_id", "is_dark", "possible_redaction")


def annotation_signals(spark, folder):
    """Annotations of eight kinds in colours made of the participants' confidences."""
    kinds = F.array(*[F.lit(k) for k in ("Redact", "Square", "highlight", "Polygon", "Link", "text", "REDACT", "Ink")])
    colour = F.array(F.coalesce("role_confidence", F.lit(0.0)) / 8, F.coalesce("function_confidence", F.lit(0.0)) / 8, F.lit(0.05))
    marks_ = table(spark, folder, "participants").select("participant_key", F.element_at(kinds, (F.col("participant_key") % 8 + 1).cast("int")).alias("subtype"), colour.alias("color_components")).distinct()
    return layout.annotation_signals(marks_).select("participant_key", "subtype", "is_explicit_redaction", "is_dark_overlay_candidate")


def affine_points(spark, folder):
    """The fragments' corners under two matrices, one after the other and combined."""
    f = _pieces(spark, folder).filter("x_pos is not null and y_pos is not null and font_size is not null")
    m, n = F.array(F.lit(2.0), F.lit(0.5), F.lit(-1.0), F.lit(1.5), F.col("font_size"), F.lit(3.0)), F.array(F.lit(0.25), F.lit(0.0), F.lit(0.5), F.lit(4.0), F.lit(-7.0), F.col("font_size"))
    once = layout.affine(m, F.col("x_pos"), F.col("y_pos"))
    told = f.select("doc_id", "fragment_id", layout.affine(layout.combined(m, n), F.col("x_pos"), F.col("y_pos")).alias("c"), layout.affine(n, once["x"], once["y"]).alias("s"))
    return told.select("doc_id", "fragment_id", F.round("c.x", 4).alias("x"), F.round("c.y", 4).alias("y"), (F.abs(F.col("c.x") - F.col("s.x")) + F.abs(F.col("c.y") - F.col("s.y")) < 1e-6).alias("same"))


def ocr_need(spark, folder):
    """Pages as the line items' numbers describe them."""
    q, p = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    need = layout.needs_ocr(q * 12, F.col("l_linenumber") % 2 == 0, q / 4, F.col("l_discount").cast("double") * 5, F.col("l_tax").cast("double") * 300, p / 100)
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), need.alias("needs_ocr"))


def box_overlaps(spark, folder):
    """Each row's box over the fragments' boxes, and how much of each fragment lies in the box of the row before its own."""
    f = _pieces(spark, folder).filter("x_pos is not null and y_pos is not null").withColumn("box", F.array("x_pos", "y_pos", F.col("x_pos") + F.col("width"), F.col("y_pos") + 3 * F.col("height")))
    around = f.groupBy("doc_id", "physical_page", "row_index").agg(layout.union_boxes(F.col("box")).alias("row_box"))
    before = around.select("doc_id", "physical_page", (F.col("row_index") + 1).alias("row_index"), F.col("row_box").alias("above"))
    both = f.join(around, ["doc_id", "physical_page", "row_index"]).join(before, ["doc_id", "physical_page", "row_index"])
    return both.select("doc_id", "fragment_id", F.round(layout.overlap_share(F.col("box"), F.col("above")), 6).alias("share"), F.round(F.col("row_box")[0], 4).alias("left_x"), F.round(F.col("row_box")[2], 4).alias("right_x"))


# --- layout of the fragments' rows as delivered


def _given_rows(spark, folder):
    return _pieces(spark, folder).select("doc_id", "physical_page", "fragment_id", F.col("row_index").alias("row_no"), F.row_number().over(W.partitionBy("doc_id", "physical_page", "row_index").orderBy("x_pos", "sequence")).alias("place"))


def _given_texts(spark, folder):
    return layout.row_texts(_pieces(spark, folder), _given_rows(spark, folder))


def given_row_texts(spark, folder):
    """The delivered rows' texts, put together from their fragments."""
    return _given_texts(spark, folder).select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), F.col("row_no").cast("long").alias("row_no"), "text", "left_x", F.col("line_number").cast("long").alias("line_number"))


def given_gutters(spark, folder):
    """L14-L16."""
    return layout.gutters(_given_texts(spark, folder)).select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), "gutter_x", "likely_x", F.round("tolerant_sequence", 6).alias("tolerant_sequence"), F.col("numbered_rows").cast("long").alias("numbered_rows"))


def inherited_gutters(spark, folder):
    """Pages with few numbers take the gutter of their neighbours."""
    texts = _given_texts(spark, folder)
    firsts = texts.groupBy("doc_id", "physical_page").agg(F.min_by("left_x", "row_no").alias("first_x"), F.min_by(F.col("line_number").isNotNull(), "row_no").alias("first_is_number"))
    g = layout.gutters(texts).select("doc_id", "physical_page", "numbered_rows", F.coalesce("gutter_x", "likely_x").alias("gutter_x"))
    return layout.inherited_gutters(firsts.join(g, ["doc_id", "physical_page"], "left").withColumn("column_count", F.lit(1))).select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), "gutter_x")


def given_reconstruction(spark, folder):
    """L17."""
    return layout.reconstruction_confidence(_given_texts(spark, folder), rebuilt_pages(spark, folder)).select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), F.round("reconstruction_confidence", 6).alias("reconstruction_confidence"))


def column_splits(spark, folder):
    """Pages of two columns and the order their rows are read in."""
    pieces, given = _pieces(spark, folder), _given_rows(spark, folder)
    shifted = pieces.withColumn("x_pos", F.col("x_pos") + F.when(F.col("sequence") % 2 == 1, 260.0).otherwise(0.0))  # every second fragment in a second column
    read = layout.reading_order(layout.row_texts(shifted, given), layout.two_columns(shifted, shifted, given))
    return read.select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), F.col("row_no").cast("long").alias("row_no"), F.col("pane").cast("long").alias("pane"), F.col("reading_no").cast("long").alias("reading_no"))


# --- layout


def _pieces(spark, folder):
    return table(spark, folder, "fragments")


def row_tolerance(spark, folder):
    """L11."""
    return layout.row_tolerance(_pieces(spark, folder)).select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), F.round("tolerance", 6).alias("tolerance"))


def text_widths(spark, folder):
    """S15."""
    return _pieces(spark, folder).filter("text is not null").select("doc_id", "fragment_id", F.round(layout.estimated_width(F.col("text"), F.coalesce("font_size", F.lit(10.0))), 4).alias("width"))


def masked_fragments(spark, folder):
    """Fragments under the boxes of rows that hold a redaction, on their page."""
    masks = rows(spark, folder, "physical_page", "bbox", "text").filter("bbox is not null").filter(marks.has_redaction(F.col("text"))).select("doc_id", "physical_page", F.array(F.col("bbox")[0], -F.col("bbox")[3], F.col("bbox")[2], -F.col("bbox")[1]).alias("rect"))
    return layout.masked(_pieces(spark, folder), masks).filter("redaction_masked").select("doc_id", "fragment_id")


def visual_rows(spark, folder):
    """Rows by moving means."""
    return layout.visual_rows(_pieces(spark, folder)).select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), "fragment_id", F.col("row_no").cast("long").alias("row_no"), F.col("place").cast("long").alias("place"))


def anchored_rows(spark, folder):
    """Rows by anchors."""
    return layout.anchored_rows(_pieces(spark, folder)).select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), "fragment_id", F.col("row_no").cast("long").alias("row_no"))


def row_texts(spark, folder):
    """The visual rows' texts and numbers."""
    pieces = _pieces(spark, folder)
    return layout.row_texts(pieces, layout.visual_rows(pieces)).select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), F.col("row_no").cast("long").alias("row_no"), "text", "left_x", F.col("line_number").cast("long").alias("line_number"))


def printed_gutters(spark, folder):
    """L14-L16."""
    pieces = _pieces(spark, folder)
    g = layout.gutters(layout.row_texts(pieces, layout.visual_rows(pieces)))
    return g.select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), "gutter_x", "likely_x", F.round("tolerant_sequence", 6).alias("tolerant_sequence"), F.col("numbered_rows").cast("long").alias("numbered_rows"))


def number_columns(spark, folder):
    """The likeliest column of lone numbers of each page."""
    pieces = _pieces(spark, folder)
    return layout.number_columns(pieces, layout.visual_rows(pieces)).select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), "x", F.round("score", 6).alias("score"))


def glyph_words(spark, folder):
    """The fragments' letters, some printed twice, as words."""
    f = _pieces(spark, folder).filter("text is not null and text <> ''").withColumn("n", F.char_length("text"))
    letters = f.select("doc_id", "physical_page", "y_pos", "height", "font_size", F.col("x_pos").alias("x0"), (F.col("width") / F.col("n")).alias("width"), "sequence", F.posexplode(F.split("text", "")).alias("i", "text")).filter("text <> ''")
    twice = F.explode(F.when((F.col("sequence") % 13 == 0) & (F.col("i") == 2), F.array(F.lit(0.0), F.lit(0.05))).otherwise(F.array(F.lit(0.0))))
    glyphs = letters.withColumn("shift", twice).select("doc_id", "physical_page", "text", (F.col("x0") + F.col("i") * F.col("width") + F.col("shift")).alias("x_pos"), "y_pos", "width", "height", "font_size", (F.col("sequence") * 1000 + F.col("i")).alias("sequence"))
    w = layout.words(glyphs)
    return w.select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), F.col("line_no").cast("long").alias("line_no"), F.col("word_no").cast("long").alias("word_no"), "text", F.round("x_pos", 3).alias("x_pos"), F.round("right_x", 3).alias("right_x"), "y_pos")


def gutter_columns(spark, folder):
    """L04."""
    return layout.gutter_columns(_pieces(spark, folder)).select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), F.col("column_no").cast("long").alias("column_no"), "fragment_id")


def masked_words(spark, folder):
    """Every tenth row's box, moved by a third of its height, hides what it covers."""
    f = _pieces(spark, folder)
    masks = f.filter("row_index % 10 = 3").groupBy("doc_id", "physical_page", "row_index").agg(F.array(F.min("x_pos") + 20, F.min("y_pos") + 4, F.max(F.col("x_pos") + F.col("width")), F.max(F.col("y_pos") + F.col("height")) + 4).alias("rect"))
    return layout.masked_by_overlap(f, masks).select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), "text", *[F.round(c, 4).alias(c) for c in ("x_pos", "y_pos", "width", "height")], "masked")


def reconstruction(spark, folder):
    """L17."""
    pieces = _pieces(spark, folder)
    sure = layout.reconstruction_confidence(layout.row_texts(pieces, layout.visual_rows(pieces)), rebuilt_pages(spark, folder))
    return sure.select("doc_id", F.col("physical_page").cast("long").alias("physical_page"), F.round("reconstruction_confidence", 6).alias("reconstruction_confidence"))


def positioned_pages(spark, folder):
    """Pages put together from their fragments."""
    from attestant.plans.positioned import pages_of_fragments

    return pages_of_fragments(_pieces(spark, folder), texts=_page_texts(spark, folder)).drop("warnings")


# --- the whole pipeline


def parsed_lines(spark, folder):
    """S04-Q07 up to K12: lines classified from the pages' texts."""
    return parsed(spark, folder).lines.select("doc_id", "source_row_id", "kind", "participant_id", "confidence", "verification", "source_continuity", "starts_new_block", "text")


def parsed_blocks(spark, folder):
    """Blocks of the lines classified from the pages' texts."""
    return parsed(spark, folder).blocks.select("doc_id", "block_id", "kind", "participant_id", "confidence", "verification", "text")


def parsed_gate(spark, folder):
    """Gate and confidence of the transcripts parsed from the pages' texts."""
    t = parsed(spark, folder)
    return t.gate.join(t.confidence, "doc_id")


_HIDDEN = {"W", "cut_lineage", "spread", "rows", "talk", "blocks", "rebuilt_pages", "corpus_pages", "parsed", "table"}


def queries() -> dict:
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in _HIDDEN and k != "queries"}


__all__ = ["classify", "queries"]
