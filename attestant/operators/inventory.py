"""Source lines and the inventory of rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestant.functions.marks import MAX_LINE, is_anchor, numbered, page_mark, pure_number
from attestant.functions.text import WS, ascii_upper, lines_of, trimmed
from attestant.operators.scan import running
from attestant.operators.sections import FAMILY, REFERENCE


#: Sections whose printed numbers go on from page to page.
KEEPS = (*FAMILY, "unknown")


def source_lines(pages: DataFrame, most: int = MAX_LINE) -> DataFrame:
    """every line of a page: doc_id, physical_page, section, kind, line_index, row_index (null for blank lines), raw, number, body.

    A page has printed line numbers if a numbered line begins with a mark, or if of three or more at least half grow.
    """
    lines = pages.filter("text is not null").select("doc_id", "physical_page", "section", "kind", F.posexplode(lines_of(F.col("text"))).alias("line_index", "line")).withColumn("raw", trimmed(F.col("line"))).withColumn("n", numbered(F.col("raw"), most))
    page = W.partitionBy("doc_id", "physical_page")
    seen = lines.filter("n.number is not null").withColumn("grows", (F.col("n.number") > F.lag("n.number").over(page.orderBy("line_index"))).cast("int"))
    shaped = seen.groupBy("doc_id", "physical_page").agg(F.max(F.col("n.body").rlike(r"^[QA][.:]")).alias("marked"), F.count("*").alias("c"), F.coalesce(F.sum("grows"), F.lit(0)).alias("g"))
    convention = shaped.select("doc_id", "physical_page", (F.col("marked") | ((F.col("c") >= 3) & (F.col("g") * 2 >= F.col("c") - 1))).alias("has_numbers"))
    joined = lines.join(convention, ["doc_id", "physical_page"], "left").withColumn("has_numbers", F.coalesce("has_numbers", F.lit(False)))
    row = F.when(F.col("raw") != "", F.sum((F.col("raw") != "").cast("int")).over(page.orderBy("line_index").rowsBetween(W.unboundedPreceding, 0)) - 1)
    return joined.select("doc_id", "physical_page", "section", "kind", "line_index", row.cast("int").alias("row_index"), "raw", "has_numbers", F.when(F.col("has_numbers"), F.col("n.number")).alias("number"), F.when(F.col("has_numbers"), trimmed(F.col("n.body"))).otherwise(F.col("raw")).alias("body"))


def page_contexts(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, physical_page, section, transcript_page: the printed label of each page.

    Candidates of a page are scored without the page before it; what hangs on that page's number is resolved by a pass over the document's
    pages, which come sorted, one row each; it holds only the number before.
    """
    rows = lines.filter("row_index < 10")
    mark, number = page_mark(F.col("body")), pure_number(F.col("body"))
    early = F.col("row_index") < 5
    base = (
        F.when((F.octet_length("body") >= 3) & F.col("body").startswith("0"), 100).otherwise(0)
        + F.when(F.col("number").isNull() & early & (number > MAX_LINE), 80).otherwise(0)
        + F.when((F.col("row_index") == 0) & F.col("number").isNull() & F.col("has_numbers"), 80).otherwise(0)
        + F.when(early, 10).otherwise(0)
    )
    found = rows.filter(mark.isNotNull() | number.isNotNull()).select("doc_id", "physical_page", F.struct("row_index", mark.alias("mark"), F.coalesce(mark, number).alias("number"), base.alias("score"), early.alias("early")).alias("c"))
    cs = found.groupBy("doc_id", "physical_page").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    per_page = pages.select("doc_id", "physical_page", "section").join(cs, ["doc_id", "physical_page"], "left")
    held = per_page.withColumn("may", ~F.coalesce(F.col("section").isin(*REFERENCE), F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, previous = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["doc_id"] != doc:
                    doc, previous = r["doc_id"], None
                label = None
                if r["may"] and r["cs"]:
                    best = max((1000 if c["mark"] is not None else c["score"] + 80 * (c["early"] and previous is not None and c["number"] == previous + 1), -c["row_index"], c["number"]) for c in r["cs"])
                    label = best[2] if best[0] >= 80 else None
                if label is not None and r["section"] in KEEPS:
                    previous = label
                out.append((doc, r["physical_page"], r["section"], None if label is None else str(label)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["doc_id", "physical_page", "section", "transcript_page"])

    told = held.select("doc_id", "physical_page", "section", "cs", "may").repartition("doc_id").sortWithinPartitions("doc_id", "physical_page")
    return told.mapInArrow(run, "doc_id string, physical_page int, section string, transcript_page string")


def is_header(body: Column, label: Column, line_index: Column) -> Column:
    """whether one of a page's first eight lines is its printed label."""
    return F.coalesce((line_index < 8) & (F.coalesce(page_mark(body), pure_number(body)) == label.try_cast("int")), F.lit(False))


def canonical_rows(lines: DataFrame, contexts: DataFrame) -> DataFrame:
    """One row for each line that isn't blank: id, transcript_page, line_number, text, raw_text, event_kind, disposition, source."""
    rows = lines.filter("row_index is not null").join(contexts.select("doc_id", "physical_page", "transcript_page"), ["doc_id", "physical_page"], "left")
    number = F.coalesce(pure_number(F.col("body")), page_mark(F.col("body")))
    header = F.coalesce(F.col("number").isNull() & (number.cast("string") == F.col("transcript_page")), F.lit(False))
    second = F.try_element_at(F.split("raw", rf"{WS}+"), F.lit(2))
    legacy = F.coalesce(F.col("number").isNotNull() & (F.octet_length(second) >= 3) & second.startswith("0") & (F.col("row_index") < 3) & (pure_number(F.col("body")).cast("string") == F.col("transcript_page")), F.lit(False))
    told = rows.withColumn("furniture", header | legacy).withColumn("anchor", is_anchor(F.col("body"))).withColumn("spoken", F.col("section") == "transcript")
    upper = ascii_upper(F.col("body"))
    preamble = told.withColumn("p", upper.startswith("APPEARANCES") | (upper.startswith("FOR ") & upper.endswith(":"))).groupBy("doc_id", "physical_page").agg(F.max("p").alias("preamble"))
    # a run of testimony pages ends at any other page; before its first anchor, rows of pages with a preamble are front matter
    pages = contexts.select("doc_id", "physical_page", (F.col("section") != "transcript").cast("int").alias("other"))
    runs = pages.withColumn("run", F.sum("other").over(W.partitionBy("doc_id").orderBy("physical_page").rowsBetween(W.unboundedPreceding, 0))).select("doc_id", "physical_page", "run")
    opened = told.filter(F.col("anchor") & F.col("spoken") & ~F.col("furniture") & (F.col("body") != "")).join(runs, ["doc_id", "physical_page"]).groupBy("doc_id", "run").agg(F.min(F.struct("physical_page", "row_index")).alias("first_anchor"))
    placed = told.join(preamble, ["doc_id", "physical_page"]).join(runs, ["doc_id", "physical_page"]).join(opened, ["doc_id", "run"], "left")
    early = F.col("spoken") & (F.col("body") != "") & F.col("preamble") & (F.col("first_anchor").isNull() | (F.struct("physical_page", "row_index") < F.col("first_anchor")))
    disposition = (
        F.when(F.col("furniture"), "page_furniture").when(F.col("body") == "", "blank_numbered_line").when(F.col("section").isin(*REFERENCE), "reference").when(F.col("section").isin("cover", "caption", "appearances"), "front_matter")
        .when(early, "front_matter").when(F.col("spoken"), "dialogue").otherwise("unclassified")
    )
    return placed.select(
        "doc_id", F.format_string("p%d_r%d", F.col("physical_page"), F.col("row_index") + 1).alias("id"), "physical_page", "row_index", "transcript_page", F.col("number").alias("line_number"), F.col("body").alias("text"), F.col("raw").alias("raw_text"), "section",
        F.when(F.col("furniture"), "page_header").otherwise("unknown").alias("event_kind"), disposition.alias("disposition"), F.when(F.col("kind") == "text", "plain_text").otherwise("fallback_text").alias("source"), "anchor",
    )


def repeated_furniture(rows: DataFrame, pages: int = 3, top: float = 45.0) -> DataFrame:
    """Rows (doc_id, id, physical_page, line_number, text, bbox) in the top margin, without number, whose text stands there on at least ``pages`` pages.

    Counted per document and text before anything is joined; anchors don't count as repetitions but are told as rows.
    """
    margin = rows.filter(F.col("line_number").isNull() & (F.try_element_at("bbox", F.lit(2)) < top)).withColumn("body", trimmed(F.col("text"))).filter("body <> ''")
    often = margin.filter(~is_anchor(F.col("body"))).groupBy("doc_id", "body").agg(F.countDistinct("physical_page").alias("n")).filter(F.col("n") >= pages)
    return margin.join(often.select("doc_id", "body"), ["doc_id", "body"], "left_semi").select("doc_id", "id")


def with_furniture(rows: DataFrame) -> DataFrame:
    """R05 applied to rows that have a box."""
    found = repeated_furniture(rows).distinct().withColumn("repeated", F.lit(True))
    both = rows.join(found, ["doc_id", "id"], "left")
    return both.withColumn("disposition", F.when(F.col("repeated"), "page_furniture").otherwise(F.col("disposition"))).withColumn("event_kind", F.when(F.col("repeated"), "page_header").otherwise(F.col("event_kind"))).drop("repeated")


def continuity(rows: DataFrame) -> DataFrame:
    """source_continuity of each row against the one before it in its document, and whether the break is suspicious.

    rows: doc_id, physical_page, row_index (unique in the page), transcript_page, line_number. Documents are chained page by page.
    """
    here = F.struct(F.col("physical_page").alias("page"), F.col("transcript_page").try_cast("int").alias("label"), F.col("line_number").alias("line"))
    told = running(rows, ["row_index"], lasts={"prior": here})
    p, page, line, label = F.col("prior"), F.col("physical_page"), F.col("line_number"), F.col("transcript_page").try_cast("int")
    same = p["page"] == page
    kind = (
        F.when(page > p["page"] + 1, "gap_before")
        .when(p.isNotNull() & line.isNull() & p["line"].isNull(), F.when(same, "continuous").otherwise("cross_page_continuous"))
        .when(p.isNull() | p["line"].isNull() | line.isNull(), "first_observed")
        .when(same, F.when(line == p["line"] + 1, "continuous").otherwise("gap_before"))
        .when(p["label"].isNull() | label.isNull(), "unknown")
        .when((label == p["label"] + 1) & (line == 1), "cross_page_continuous").otherwise("gap_before")
    )
    doubt = F.coalesce((page > p["page"] + 1) | F.when(line.isNotNull(), F.when(same, line != p["line"] + 1).otherwise((label != p["label"] + 1) | (line != 1))), F.lit(False))
    return told.select(*rows.columns, kind.alias("source_continuity"), doubt.alias("suspicious"))
