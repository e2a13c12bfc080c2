"""From pages to every relation of the transcripts: one lazy plan for each, learned formats and lines written once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestant.functions.text import lines_of, trimmed
from attestant.operators import classify, inventory, ir, preflight, quality, reconcile, sections, turns
from attestant.sources.tables import cut_lineage


class Transcripts:
    """Relations of the documents whose pages are given: doc_id, physical_page, text, and kind ('text', 'pdf').

    Sections are worked out where the column is missing. Pages may carry the layout's columns. Documents with a null id are left out.
    With the pages' ``fragments`` (row_index, x_pos, width, font_size, text, sequence) a bare Q or A counts only before a wide enough gap.
    With the rows' ``boxes`` (doc_id, physical_page, row_index, bbox) text repeated in the top margin is page furniture.
    ``store`` writes the relations that many others read, so that they are made once; without it all is one plan.
    """

    def __init__(self, pages: DataFrame, store: bool = True, fragments: DataFrame | None = None, boxes: DataFrame | None = None):
        pages = pages.filter("doc_id is not null")
        if "kind" not in pages.columns:
            pages = pages.withColumn("kind", F.lit("text"))
        self._fragments, self._boxes = fragments, boxes
        self._pages, self._keep = pages, cut_lineage if store else (lambda df: df)

    @cached_property
    def pages(self) -> DataFrame:
        return self._pages if "section" in self._pages.columns else self._keep(sections.sections(self._pages))

    @cached_property
    def lines_in(self) -> DataFrame:
        return self._keep(inventory.source_lines(self.pages))

    @cached_property
    def contexts(self) -> DataFrame:
        return self._keep(inventory.page_contexts(self.pages, self.lines_in))

    @cached_property
    def said(self) -> DataFrame:
        return preflight.testimony_lines(self.lines_in, self.contexts)

    @cached_property
    def rules(self) -> DataFrame:
        return self._keep(preflight.marker_rules(self.lines_in, self.pages))

    @cached_property
    def first_participants(self) -> DataFrame:
        return self._keep(preflight.participants(preflight.observations(self.said, self._keep)))

    @cached_property
    def types(self) -> DataFrame:
        return preflight.document_types(self.pages, self.rules, self.first_participants)

    @cached_property
    def participants_before(self) -> DataFrame:
        return self._keep(preflight.functions_of(self.first_participants, self.pages, self.types))

    @cached_property
    def primaries(self) -> DataFrame:
        return preflight.primaries(self.participants_before, self.rules)

    @cached_property
    def gaps(self) -> DataFrame:
        return preflight.gaps(self.said, self.contexts)

    @cached_property
    def languages(self) -> DataFrame:
        return preflight.language_hint(self.pages)

    @cached_property
    def source_rows(self) -> DataFrame:
        made = inventory.canonical_rows(self.lines_in, self.contexts)
        if self._boxes is not None:
            made = inventory.with_furniture(self._keep(made.join(self._boxes.select("doc_id", "physical_page", "row_index", "bbox"), ["doc_id", "physical_page", "row_index"], "left")))
        return self._keep(made)

    @cached_property
    def format_prints(self) -> DataFrame:
        """The conventions of each document's testimony lines."""
        return preflight.fingerprint(self.lines_in, self.rules, self.contexts)

    @cached_property
    def format_confidence(self) -> DataFrame:
        """How sure the learned format is."""
        return preflight.confidences(self.participants_before, self.rules, self.format_prints, self.contexts)

    @cached_property
    def router(self) -> DataFrame:
        """Documents that should be looked at by other means."""
        return preflight.router_flags(self.format_confidence, self.languages, self.types, preflight.layout_summary(self.pages), preflight.redaction_summary(self.pages))

    @cached_property
    def unverified(self) -> DataFrame:
        rows = self.source_rows if self._fragments is None else classify.bare_marks_allowed(self.source_rows, self._fragments)
        return self._keep(classify.completed(self._keep(classify.classified(rows, self.participants_before, self.primaries, self.rules))))

    @cached_property
    def participants(self) -> DataFrame:
        return self._keep(reconcile.reconciled(self.participants_before, self.unverified, self.types))

    @cached_property
    def lines(self) -> DataFrame:
        return self._keep(reconcile.verified(self.unverified, self.participants))

    @cached_property
    def conflicts(self) -> DataFrame:
        return reconcile.issues(self.unverified, self.participants)

    @cached_property
    def blocks(self) -> DataFrame:
        return self._keep(turns.blocks(self.lines))

    @cached_property
    def exchanges(self) -> DataFrame:
        return turns.exchanges(self.blocks)

    @cached_property
    def edges(self) -> DataFrame:
        return turns.graph_edges(self.blocks)

    @cached_property
    def rows(self) -> DataFrame:
        return ir.enriched_rows(self.source_rows, self.lines)

    @cached_property
    def signals(self) -> DataFrame:
        return ir.page_signals(self.lines)

    @cached_property
    def spans(self) -> DataFrame:
        return ir.source_spans(self.blocks, self.source_rows)

    @cached_property
    def utterances(self) -> DataFrame:
        return ir.utterances(self.blocks, self.pages)

    @cached_property
    def page_frames(self) -> DataFrame:
        return ir.page_frames(self.source_rows, self.spans, self.utterances, ir.row_regions(self.source_rows, self.signals))

    @cached_property
    def diagnostics(self) -> DataFrame:
        return ir.diagnostics(self.source_rows, self.lines, self.blocks, self.utterances, self.spans, self.signals)

    @cached_property
    def issues(self) -> DataFrame:
        expected = self.pages.groupBy("doc_id").agg(F.sum(F.size(F.filter(lines_of(F.coalesce("text", F.lit(""))), lambda x: trimmed(x) != ""))).alias("expected"))
        out = quality.inventory_issues(quality.inventory(expected, self.source_rows))
        owners = quality.row_ownership(self.source_rows, self.blocks).filter("owners <> 1")
        out = out.unionByName(owners.select("doc_id", F.lit("dialogue_row_ownership").alias("code"), "physical_page", F.col("id").alias("row_id")))
        for part in (quality.row_issues(self.source_rows), quality.page_issues(self.pages), quality.line_issues(self.lines, self.participants), quality.passed_on(self.gaps, self.conflicts, self.languages, self.source_rows)):
            out = out.unionByName(part)
        return out

    @cached_property
    def gate(self) -> DataFrame:
        return quality.gate(self.pages, self.issues)

    @cached_property
    def confidence(self) -> DataFrame:
        return reconcile.final_confidence(reconcile.parse_confidence(self.lines), self.diagnostics, self.gate)

    def document_json(self) -> DataFrame:
        """doc_id and one JSON text of its blocks, exchanges, participants and gate; nulls are written."""
        def many(df: DataFrame, name: str, *order: str) -> DataFrame:
            return df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in ("doc_id", *order)]))).alias(name))

        out = self.pages.select("doc_id").distinct()
        for part in (many(self.blocks.select("doc_id", "block_no", "block_id", "kind", "participant_id", "text"), "blocks", "block_no"), many(self.exchanges, "exchanges", "exchange_no"), many(self.participants.select("doc_id", "id", "display_label", "canonical_name", "speaker_role", "participant_function"), "participants", "id")):
            out = out.join(part, "doc_id", "left")
        out = out.join(self.gate.withColumnRenamed("issues", "issue_count"), "doc_id", "left")
        return out.select("doc_id", F.to_json(F.struct(*[c for c in out.columns if c != "doc_id"]), {"ignoreNullFields": "false"}).alias("json"))
