"""Blocks, exchanges and the conversation's graph.

Lines of a document are chained page by page; blocks are numbered by running sums, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestant.operators.scan import running

# Worst first.
CONFIDENCE = ("unknown", "inferred", "explicit")
VERIFICATION = ("conflict", "uncertain", "source_missing", "redacted", "verified_with_inference", "verified")
OFF_RECORD = "off the record|concluded|adjourned|recess"


def worst(c: Column, ranks: tuple[str, ...]) -> Column:
    """The worst value of a group: an aggregate."""
    rank = F.array_position(F.array(*[F.lit(r) for r in ranks]), c)
    return F.try_element_at(F.array(*[F.lit(r) for r in ranks]), F.min(F.when(rank > 0, rank)).cast("int"))


def blocks(lines: DataFrame) -> DataFrame:
    """A row for each turn: doc_id, block_no, block_id, kind, speaker, participant_id, confidence, verification, source_continuity, first/last positions, source_row_ids, text.

    A line joins the block before it unless it begins one, comes after a gap, or has another kind or speaker. Texts are joined by blanks,
    empty ones left out. lines need verification; where it is missing, it is 'uncertain'.
    """
    if "verification" not in lines.columns:
        lines = lines.withColumn("verification", F.lit("uncertain"))
    told = running(lines.filter("kind <> 'page_header'"), ["row_index"], lasts={"prior": F.struct(F.col("kind").alias("k"), F.col("speaker").alias("s"))})
    merges = F.coalesce(~F.col("starts_new_block") & (F.col("source_continuity") != "gap_before") & (F.col("prior.k") == F.col("kind")) & F.col("prior.s").eqNullSafe(F.col("speaker")), F.lit(False)) & F.col("prior").isNotNull()
    numbered = running(told.withColumn("opens", (~merges).cast("long")).drop("prior"), ["row_index"], sums={"block_no": F.col("opens")})
    at = F.struct("physical_page", "row_index")
    ordered = F.array_sort(F.collect_list(F.struct("physical_page", "row_index", "source_row_id", "text")))
    spot = F.struct("physical_page", "transcript_page", "line_number")
    made = numbered.groupBy("doc_id", "block_no").agg(
        F.min_by(F.struct("kind", "speaker", "participant_id", "source_continuity"), at).alias("f"), worst(F.col("confidence"), CONFIDENCE).alias("confidence"), worst(F.col("verification"), VERIFICATION).alias("verification"),
        F.min_by(spot, at).alias("first"), F.max_by(spot, at).alias("last"), F.min(at).alias("at"), ordered.alias("rows"),
    )
    return made.select(
        "doc_id", "block_no", F.format_string("block_%06d", "block_no").alias("block_id"), "f.kind", "f.speaker", "f.participant_id", "confidence", "verification", "f.source_continuity", F.col("first").alias("first_spot"), F.col("last").alias("last_spot"), F.col("at.physical_page").alias("physical_page"),
        F.transform("rows", lambda r: r["source_row_id"]).alias("source_row_ids"), F.array_join(F.filter(F.transform("rows", lambda r: r["text"]), lambda t: t != ""), " ").alias("text"),
    )


def _order(made: DataFrame) -> list[str]:
    return ["block_no"]


def exchange_numbers(made: DataFrame) -> DataFrame:
    """Blocks with exchange_no: the question's number among its document's, null for blocks that belong to no exchange.

    A question opens an exchange; the next question, a gap, a heading, a redaction and a parenthetical that leaves the record close it. The
    block that closes one, unless it is a question, belongs to none.
    """
    closes = (F.col("source_continuity") == "gap_before") | F.col("kind").isin("examination_heading", "heading", "redaction_marker") | ((F.col("kind") == "parenthetical") & F.lower("text").rlike(OFF_RECORD))
    asks = F.col("kind") == "question"
    event = F.when(asks, True).when(closes, False)
    told = running(made, _order(made), sums={"q_no": asks.cast("long")}, lasts={"open": event})
    inside = asks | (~closes & F.coalesce("open", F.lit(False)))
    return told.select(*made.columns, F.when(inside, F.col("q_no")).alias("exchange_no"))


def exchanges(made: DataFrame) -> DataFrame:
    """doc_id, exchange_no, question_block, responses (block ids in order), answered."""
    told = exchange_numbers(made).filter("exchange_no is not null")
    grouped = told.groupBy("doc_id", "exchange_no").agg(F.array_sort(F.collect_list(F.struct("block_no", "block_id", "kind"))).alias("b"))
    rest = F.slice("b", 2, F.greatest(F.lit(0), F.size("b") - 1))
    return grouped.select("doc_id", "exchange_no", F.col("b")[0]["block_id"].alias("question_block"), F.transform(rest, lambda x: x["block_id"]).alias("responses"), F.exists(rest, lambda x: x["kind"] == "answer").alias("answered"))


def unpaired_answers(made: DataFrame) -> DataFrame:
    """Answers outside of any exchange."""
    return exchange_numbers(made).filter("exchange_no is null and kind = 'answer'").drop("exchange_no")


def unanswered_questions(made: DataFrame) -> DataFrame:
    """B05."""
    return exchanges(made).filter("not answered").select("doc_id", "exchange_no", "question_block")


def graph_nodes(made: DataFrame) -> DataFrame:
    """B06."""
    return made.select("doc_id", F.concat(F.lit("node_"), "block_id").alias("node_id"), "block_id", "kind", "participant_id")


def graph_edges(made: DataFrame) -> DataFrame:
    """doc_id, from_block, to_block, edge_kind.

    Gaps, headings, redactions and parentheticals of any kind forget the open question and who broke in; a gap does so before its block. A
    question resumes after the last objection since the question before it, if that was not yet taken up.
    """
    gap = F.col("source_continuity") == "gap_before"
    stops = F.col("kind").isin("examination_heading", "heading", "redaction_marker", "parenthetical")
    none = F.lit(None).cast("long")
    question = F.when(F.col("kind") == "question", F.struct(F.col("block_no").alias("q"))).when(gap | stops, F.struct(none.alias("q")))
    told = running(made, _order(made), lasts={"q": question, "prior": F.col("block_no")})
    open_ = F.when(~gap, F.col("q.q"))
    # an objection counts if a question is open; the next question takes it up
    breaks = (F.col("kind") == "objection") & open_.isNotNull()
    flagged = told.withColumn("open_q", open_).withColumn("breaks", breaks)
    broke = F.when(F.col("breaks"), F.struct(F.col("block_no").alias("b"))).when((F.col("kind") == "question") | gap | stops, F.struct(none.alias("b")))
    linked = running(flagged, _order(made), lasts={"broken": broke})
    resumes = F.when((F.col("kind") == "question") & ~gap, F.col("broken.b"))
    edge = lambda to, kind: F.when(to.isNotNull(), F.struct(to.alias("to_no"), F.lit(kind).alias("edge_kind")))
    all_ = F.array(
        F.when(F.col("prior").isNotNull(), F.struct(F.col("block_no").alias("to_no"), F.lit("follows").alias("edge_kind"))), edge(F.when(F.col("kind") == "answer", F.col("open_q")), "responds_to"), edge(F.when(F.col("breaks"), F.col("open_q")), "interrupts"), edge(resumes, "resumes_after"),
        edge(F.when(F.col("kind") == "interpreter_statement", F.col("prior")), "interprets"),
    )
    out = linked.select("doc_id", "block_no", "prior", F.explode(F.filter(all_, lambda e: e.isNotNull())).alias("e"))
    from_no = F.when(F.col("e.edge_kind") == "follows", F.col("prior")).otherwise(F.col("block_no"))
    return out.select("doc_id", F.format_string("block_%06d", from_no).alias("from_block"), F.format_string("block_%06d", F.col("e.to_no")).alias("to_block"), "e.edge_kind")
