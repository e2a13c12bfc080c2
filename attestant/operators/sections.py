"""Sections of a document's pages: cover, testimony, index and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestant.functions.marks import leading_number, speaker_label, without_leading_digits
from attestant.functions.text import WS, ascii_upper, lines_of, trimmed

FAMILY = ("cover", "caption", "appearances", "transcript")
REFERENCE = ("word_index", "exhibit_index", "certificate", "errata", "appendix", "attachment")
# What a line with a question or answer mark begins with, in capitals, and a page:line citation.
DIALOGUE_MARK = r"^(?:[QA][. :]|QUESTION:|ANSWER:)"
CITATION = r"^[,;()\[\].:]*[0-9]+:(?:[1-9]|[1-4][0-9]|50)[,;()\[\].:]*$"


def share_of_successors(numbers: Column, most: int = 1) -> Column:
    """Share of neighbours in an array of numbers that grow by 1..most; 0 for fewer than two."""
    n = F.size(numbers)
    pairs = F.zip_with(F.slice(numbers, 1, n - 1), F.slice(numbers, 2, n - 1), lambda a, b: ((b > a) & (b - a <= most)).cast("int"))
    return F.when(n >= 2, F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / (n - 1)).otherwise(0.0)


def features(pages: DataFrame) -> DataFrame:
    """Adds numbered (count), sequence, citations, index_like, labels, marks, dialogue_like, headings to pages; null texts count as empty."""
    # each step names what the next ones use more than once, so that it is worked out once a page
    split = pages.select("*", lines_of(F.coalesce("text", F.lit(""))).alias("ls"), trimmed(F.coalesce("text", F.lit(""))).alias("whole"))
    told = split.select("*", F.transform("ls", lambda x: trimmed(x)).alias("trim"), F.filter(F.transform("ls", leading_number), lambda n: n.isNotNull()).alias("numbers"))
    plain = told.select("*", F.transform("trim", without_leading_digits).alias("plain"), F.filter("trim", lambda x: x != "").alias("full"))
    cites = lambda c: F.exists(F.split(c, rf"{WS}+"), lambda t: t.contains(":") & t.rlike(CITATION))
    heads = F.slice(F.filter(F.transform("plain", ascii_upper), lambda x: (x != "") & ~x.rlike("^[0-9]+$")), 1, 8)
    citations = F.when(F.col("whole").contains(":"), F.size(F.filter(F.split("whole", rf"{WS}+"), lambda t: t.contains(":") & t.rlike(CITATION)))).otherwise(0)
    base = plain.select(
        "*", citations.alias("citations"), F.size(F.filter("full", lambda x: x.contains(":") & cites(x))).alias("cited_lines"), F.size("full").alias("full_lines"), F.size(F.filter("plain", lambda x: x.rlike("[:.]") & speaker_label(x).isNotNull())).alias("labels"),
        F.size(F.filter("plain", lambda x: x.rlike("(?i)" + DIALOGUE_MARK))).alias("marks"), heads.alias("headings"),
    )
    return base.select(*pages.columns, F.size("numbers").alias("numbered"), share_of_successors(F.col("numbers")).alias("sequence"), "citations", F.coalesce(F.col("cited_lines") / F.nullif("full_lines", F.lit(0)) >= 0.2, F.lit(False)).alias("index_like"), "labels", "marks", ((F.col("labels") >= 3) | (F.size("numbers") >= 5) | (F.col("marks") >= 4)).alias("dialogue_like"), "headings")


def first_section(described: DataFrame) -> DataFrame:
    """Adds section and section_confidence, by the first rule that fits."""
    u = ascii_upper(F.coalesce("text", F.lit("")))
    has = lambda *words: F.exists("headings", lambda h: F.lit(False) if not words else _any(h.startswith(w) for w in words))
    quiet = (F.col("labels") == 0) & (F.col("marks") == 0)
    few = F.col("numbered") < 8
    cut = lambda s, c: F.struct(F.lit(s).alias("section"), F.lit(c).alias("section_confidence"))
    rules = [
        (has("CERTIFICATE OF", "REPORTER'S CERTIFICATE", "CERTIFICATION OF"), cut("certificate", 0.96)),
        (has("ERRATA"), cut("errata", 0.96)),
        (has("APPEARANCES") & quiet, cut("appearances", 0.97)),
        ((F.col("physical_page") <= 3) & has("INTERVIEW OF", "DEPOSITION OF", "TRANSCRIPT OF") & quiet, cut("cover", 0.96)),
        ((F.col("labels") >= 2) | (F.col("marks") >= 2), cut("transcript", 0.92)),
        (u.contains("WORD INDEX") | u.contains("WORD/PHRASE INDEX") | ((F.col("citations") >= 10) & (F.col("numbered") <= 5) & F.col("index_like")), cut("word_index", 0.96)),
        (u.contains("EXHIBIT INDEX") | u.contains("INDEX OF EXHIBITS") | (u.contains("EXHIBIT") & u.contains("DESCRIPTION") & few), cut("exhibit_index", 0.94)),
        (u.contains("CERTIFICATE") & (u.contains("CERTIFICATE OF TRANSCRIPTION") | u.contains("I CERTIFY") | u.contains("COURT REPORTER") | u.contains("NOTARY")) & few, cut("certificate", 0.92)),
        ((u.contains("ERRATA SHEET") | (u.contains("ERRATA") & u.contains("PAGE") & u.contains("LINE"))) & few, cut("errata", 0.92)),
        (u.contains("ATTACHMENT") & few, cut("attachment", 0.84)),
        (u.contains("APPENDIX") & few, cut("appendix", 0.86)),
        ((u.contains("CASE NO.") | u.contains("CASE NUMBER")) & (u.contains("COURT") | u.contains("DISTRICT")) & (F.col("numbered") < 6) & quiet, cut("caption", 0.82)),
        (u.contains("APPEARANCES") & few, cut("appearances", 0.97)),
        ((F.col("numbered") >= 8) & (F.col("sequence") >= 0.62), cut("transcript", 0.97)),
        ((u.contains("DEPOSITION OF") | u.contains("INTERVIEW OF") | u.contains("TRANSCRIPT OF")) & few, cut("cover", 0.90)),
        ((F.col("numbered") >= 4) & (F.col("sequence") >= 0.5), cut("transcript", 0.70)),
    ]
    chain = None
    for when, then in rules:
        chain = F.when(when, then) if chain is None else chain.when(when, then)
    chosen = chain.otherwise(cut("unknown", 0.35))
    return described.withColumn("cut", chosen).select(*described.columns, "cut.section", "cut.section_confidence")


def _any(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out


def smoothed(classified: DataFrame) -> DataFrame:
    """Sections put right by their neighbours. Windows run over a document's pages."""
    pages = W.partitionBy("doc_id").orderBy("physical_page")
    upto = pages.rowsBetween(W.unboundedPreceding, 0)
    before = pages.rowsBetween(W.unboundedPreceding, -1)
    quiet = (F.col("labels") == 0) & (F.col("marks") == 0)
    u = ascii_upper(F.coalesce("text", F.lit("")))
    examined = u.contains("EXAMINATION") | F.exists("headings", lambda h: h.startswith("BY "))
    set_ = lambda df, when, s, c: df.withColumn("section_confidence", F.when(when, F.lit(c)).otherwise(F.col("section_confidence"))).withColumn("section", F.when(when, F.lit(s)).otherwise(F.col("section")))
    # Opened by an appearances page, closed by a reference page or a page with an anchor
    event = F.when(F.col("section") == "appearances", True).when(F.col("section").isin(*REFERENCE) | ~(quiet & ~examined), False)
    df = classified.withColumn("open", F.coalesce(F.last(event, ignorenulls=True).over(before), F.lit(False)))
    df = set_(df, F.col("open") & (F.col("section") != "appearances") & ~F.col("section").isin(*REFERENCE) & quiet & ~examined, "appearances", 0.88).drop("open")
    # Candidates next to each other join a run of three index pages or more before them
    may = F.col("section").isin("unknown", "transcript") & ((F.col("citations") >= 3) | F.col("index_like")) & (F.col("labels") < 2) & (F.col("marks") < 2)
    df = df.withColumn("may", may).withColumn("part", F.sum((~(F.col("may") | (F.col("section") == "word_index"))).cast("int")).over(upto))
    run = W.partitionBy("doc_id", "part").orderBy("physical_page")
    df = df.withColumn("gap", F.sum(F.col("may").cast("int")).over(run.rowsBetween(W.unboundedPreceding, 0)))
    # within a part: index pages since the last page that broke the run; candidates count once joined
    df = df.withColumn("index_run", F.sum(((F.col("section") == "word_index") & (F.col("gap") == 0)).cast("int")).over(run.rowsBetween(W.unboundedPreceding, -1)))
    first_three = F.max(F.when(F.col("index_run") >= 3, 1).otherwise(0)).over(run.rowsBetween(W.unboundedPreceding, 0))
    df = set_(df.withColumn("joins", F.col("may") & (first_three == 1)), F.col("joins"), "word_index", 0.90).drop("may", "part", "gap", "index_run", "joins")
    # C04
    near = (F.lag("section").over(pages) == "transcript") & (F.lead("section").over(pages) == "transcript")
    df = set_(df.withColumn("near", F.coalesce(near, F.lit(False))), F.col("near") & (F.col("section") == "unknown"), "transcript", 0.72).drop("near")
    for _ in range(2):  # C05
        beside = F.coalesce(F.lag("section").over(pages) == "transcript", F.lit(False)) | F.coalesce(F.lead("section").over(pages) == "transcript", F.lit(False))
        df = set_(df.withColumn("beside", beside), F.col("beside") & F.col("dialogue_like") & (F.col("section") == "unknown"), "transcript", 0.64).drop("beside")
    # C06
    df = df.withColumn("some", F.max((F.col("section") == "transcript").cast("int")).over(W.partitionBy("doc_id")))
    return set_(df, (F.col("some") == 0) & F.col("dialogue_like") & (F.col("section") == "unknown"), "transcript", 0.52).drop("some")


def sections(pages: DataFrame) -> DataFrame:
    """Pages with section and section_confidence."""
    return smoothed(first_section(features(pages))).select(*pages.columns, "section", "section_confidence")
