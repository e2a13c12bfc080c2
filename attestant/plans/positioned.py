"""From positioned fragments to pages (L05-L17): masked, put in rows, read pane by pane."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestant.functions.text import lines_of, trimmed
from attestant.operators import layout
from attestant.sources.tables import cut_lineage
from attestant.sources.text import joined_numbers


def pages_of_fragments(fragments: DataFrame, masks: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """doc_id, physical_page, text, kind and the layout's columns for each page that has fragments.

    ``masks``: boxes that hide what lies under them. ``texts`` (doc_id, physical_page, text): the pages' plain texts; where the rows found
    again are too few (confidence under 0.42) and nothing is masked, the plain text is kept.
    """
    pieces = fragments if masks is None else layout.masked(fragments, masks)
    pieces = cut_lineage(pieces)
    rows = cut_lineage(layout.visual_rows(pieces))
    # a row's text is a fold over its pieces, and five tables are made of these texts: worked out once
    told = cut_lineage(layout.row_texts(pieces, rows))
    read = layout.reading_order(told, cut_lineage(layout.two_columns(told, pieces, rows)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_no", "text"))), lambda r: r["text"]), "\n")
    made = read.groupBy("doc_id", "physical_page").agg(text.alias("rebuilt"), F.count("*").alias("visual_row_count"), F.count("line_number").alias("numbered_row_count"), (F.max("pane") + 1).alias("column_count"))
    hidden = pieces.groupBy("doc_id", "physical_page").agg(F.count("*").alias("fragment_count"), F.count_if(F.coalesce("redaction_masked", F.lit(False))).alias("masked_redaction_fragments"))
    # in plain texts printed numbers may stand on lines of their own
    joined = F.array_join(joined_numbers(lines_of(F.coalesce("text", F.lit("")))), "\n").alias("text")
    plain = cut_lineage(texts.select("doc_id", "physical_page", joined)) if texts is not None else made.select("doc_id", "physical_page", F.col("rebuilt").alias("text"))
    sure = layout.reconstruction_confidence(told, plain)
    firsts = told.groupBy("doc_id", "physical_page").agg(F.min_by("left_x", "row_no").alias("first_x"), F.min_by(F.col("line_number").isNotNull(), "row_no").alias("first_is_number"))
    own = layout.gutters(told).select("doc_id", "physical_page", "numbered_rows", F.coalesce("gutter_x", "likely_x").alias("gutter_x"))
    placed = firsts.join(own.hint("merge"), ["doc_id", "physical_page"], "left").join(made.select("doc_id", "physical_page", "column_count").hint("merge"), ["doc_id", "physical_page"])
    gutter = layout.inherited_gutters(placed).select("doc_id", "physical_page", F.col("gutter_x").alias("likely_line_number_column_x"))
    both = made.join(hidden.hint("merge"), ["doc_id", "physical_page"]).join(sure.hint("merge"), ["doc_id", "physical_page"], "left").join(gutter.hint("merge"), ["doc_id", "physical_page"], "left").join(plain.hint("merge"), ["doc_id", "physical_page"], "left")
    shown = F.coalesce("rebuilt", F.lit(""))
    ocr = layout.needs_ocr(F.char_length(trimmed(shown)), F.coalesce("image_count", F.lit(0)) > 0, F.regexp_count(shown, F.lit(r"\x{FFFD}|\(cid:")), F.lit(0.0), F.lit(0), F.char_length(shown))
    both = both if "image_count" in both.columns else both.withColumn("image_count", F.lit(0))
    use = (F.col("reconstruction_confidence") >= 0.42) | (F.col("masked_redaction_fragments") > 0)
    return both.select(
        "doc_id", "physical_page", F.when(use, F.col("rebuilt")).otherwise(F.col("text")).alias("text"), F.lit("pdf").alias("kind"), F.lit(True).alias("positioned_text_available"), use.alias("used_positioned_reconstruction"), "reconstruction_confidence", "fragment_count", "visual_row_count", "numbered_row_count", "masked_redaction_fragments", "column_count",
        (F.col("column_count") > 1).alias("reading_order_uncertain"), "likely_line_number_column_x", ocr.alias("requires_ocr"), F.lit(False).alias("ocr_performed"), F.lit("positioned").alias("extraction_engine"), F.array().cast("array<string>").alias("warnings"),
    )
