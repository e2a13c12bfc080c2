"""Marks of lines, sections, layout: small cases."""

import pytest
from pyspark.sql import functions as F

from attestant.functions import marks, text
from attestant.operators import inventory, layout, preflight, sections, turns


def one(spark, expression, value):
    df = spark.createDataFrame([(value,)], "c string")
    return df.select(expression(F.col("c")).alias("v")).first()["v"]


@pytest.mark.parametrize(("value", "want"), [("12-year-old", (None, "12-year-old")), ("12", (12, "")), ("12Q. When?", (12, "Q. When?")), ("3 12 jurors", (3, "12 jurors")), ("101 x", (None, "101 x")), ("0 x", (None, "0 x")), ("7: a", (7, "a")), ("99999 x", (None, "99999 x"))])
def test_numbered(spark, value, want):
    got = one(spark, marks.numbered, value)
    assert (got["number"], got["body"]) == want


@pytest.mark.parametrize(("value", "want"), [("A     Yes.", ("answer", "bare_uppercase", "Yes.")), ("a product", None), ("Q. x", ("question", "dot", "x")), ("Q.x", None), ("question: y", ("question", "word", "y")), ("A:", ("answer", "colon", "")), ("", None)])
def test_marker(spark, value, want):
    got = one(spark, marks.marker, value)
    assert (got and (got["kind"], got["style"], got["rest"])) == want


@pytest.mark.parametrize(("value", "want"), [("MR. SMITH: Yes.", ("MR. SMITH", "Yes.")), ("Mr. Smith: Yes.", ("Mr. Smith", "Yes.")), ("JOHN DOE:", ("JOHN DOE", "")), ("Note that: x", None), ("FOR THE STATE: x", None), ("Q: x", None), ("[REDACTED]: Q. x", ("[REDACTED]", "Q. x")), ("Ünter: x", None), ("É. ROY: x", ("É. ROY", "x")), ("the interpreter said: x", ("the interpreter said", "x"))])
def test_colon_label(spark, value, want):
    got = one(spark, marks.colon_label, value)
    assert (got and (got["label"], got["rest"])) == want


@pytest.mark.parametrize(("value", "want"), [("Mr. Smith. Good day.", ("Mr. Smith", "Good day.")), ("Mr. J. Smith. Yes.", ("Mr. J. Smith", "Yes.")), ("Mr. smith. Yes.", None), ("Dr. van der Berg. No.", ("Dr. van der Berg", "No.")), ("Mr. Smith said so", None)])
def test_titled_label(spark, value, want):
    got = one(spark, marks.titled_label, value)
    assert (got and (got["label"], got["rest"])) == want


@pytest.mark.parametrize(("value", "want"), [("WITNESS: JANE DOE", "JANE DOE"), ("WITNESS: Yes, sir", None), ("JANE DOE, having been first duly sworn", "JANE DOE"), ("Jane, being late", None)])
def test_introduced(spark, value, want):
    assert one(spark, marks.introduced, value) == want


@pytest.mark.parametrize(("value", "want"), [("THE WITNESS", "witness"), ("MR. X", "unknown"), ("COUNSEL FOR ACME", "attorney"), ("THE COURT", "judge"), ("COURT REPORTER", "court_reporter"), ("SPANISH INTERPRETER", "interpreter"), ("JOHN DOE", None), ("XXXX", "unknown")])
def test_roles(spark, value, want):
    assert one(spark, marks.label_role, value) == want


def test_text_semantics(spark):
    assert one(spark, text.ascii_upper, "é a") == "é A" and one(spark, text.trimmed, " \t x 　") == "x" and one(spark, text.lines_of, "a\r\nb\n") == ["a", "b"] and one(spark, text.lines_of, "") == []
    assert one(spark, text.label_id, " Mr. É ") == "label_4d522e20c389" and one(spark, lambda c: text.shortened(c, 3), "abcde") == "abc..." and one(spark, lambda c: text.number_of(c), "+12") == 12 and one(spark, lambda c: text.number_of(c), " 5 ") is None


def test_section_cascade_and_smoothing(spark):
    qa = "1 Q. a?\n2 A. b.\n3 Q. c?\n4 A. d."
    pages = [("d", 1, "DEPOSITION OF\nJANE DOE"), ("d", 2, "APPEARANCES\nFor the State"), ("d", 3, "Some firm\nSome street"), ("d", 4, qa), ("d", 5, "(long pause)"), ("d", 6, qa), ("d", 7, "REPORTER'S CERTIFICATE\nI certify"), ("d", 8, "ERRATA\nx"), ("d", 9, "INDEX OF EXHIBITS"), ("e", 1, "\n".join(f"word{i} 12:{i + 1} 13:{i + 2}" for i in range(8))), ("f", 1, None)]
    got = {(r["doc_id"], r["physical_page"]): r["section"] for r in sections.sections(spark.createDataFrame(pages, "doc_id string, physical_page int, text string")).collect()}
    assert [got["d", i] for i in range(1, 10)] == ["cover", "appearances", "appearances", "transcript", "transcript", "transcript", "certificate", "errata", "exhibit_index"]
    assert got["e", 1] == "word_index" and got["f", 1] == "unknown"


def test_index_run_goes_on(spark):
    index = "\n".join(f"w{i} 12:{i + 1} 13:{i + 2}" for i in range(8))
    pages = [("d", i, index) for i in (1, 2, 3)] + [("d", 4, "z 1:2 2:3 3:4"), ("d", 5, "plain")] + [("e", 1, index), ("e", 2, "z 1:2 2:3 3:4")]
    got = {(r["doc_id"], r["physical_page"]): r["section"] for r in sections.sections(spark.createDataFrame(pages, "doc_id string, physical_page int, text string")).collect()}
    assert got["d", 4] == "word_index" and got["d", 5] == "unknown" and got["e", 2] == "unknown"


def test_empty_frames(spark):
    pages = spark.createDataFrame([], "doc_id string, physical_page int, text string, section string, kind string")
    lines = inventory.source_lines(pages)
    contexts = inventory.page_contexts(pages, lines)
    assert inventory.canonical_rows(lines, contexts).count() == 0 and preflight.layout_summary(pages).count() == 0 and sections.sections(pages.drop("section")).count() == 0


def test_ties_in_votes_go_to_the_later_role(spark):
    seen = [("d", 1, i, "X", "X", r, "statement") for i, r in enumerate(("attorney", "judge", "attorney", "judge"))]
    got = preflight.participants(spark.createDataFrame(seen, "doc_id string, physical_page int, line_index int, label string, canonical string, speaker_role string, observation string")).first()
    assert got["speaker_role"] == "judge" and got["role_confidence"] == 0.5 and got["id"] == "judge_1"


def test_graph_resets(spark):
    kinds = ["question", "objection", "question", "answer", "parenthetical", "answer", "question", "answer"]
    made = spark.createDataFrame([("d", 1, i + 1, k, "continuous" if i != 7 else "gap_before", f"block_{i + 1:06d}", "x") for i, k in enumerate(kinds)], "doc_id string, physical_page int, block_no long, kind string, source_continuity string, block_id string, text string")
    got = {(int(r["from_block"][-2:]), int(r["to_block"][-2:]), r["edge_kind"]) for r in turns.graph_edges(made).collect() if r["edge_kind"] != "follows"}
    assert got == {(2, 1, "interrupts"), (3, 2, "resumes_after"), (4, 3, "responds_to")}


def test_boxes_colours_and_matrices(spark):
    df = spark.createDataFrame([([0.0, 0.0, 10.0, 10.0], [5.0, 5.0, 20.0, 20.0], [0.1, 0.1, 0.1], [0.2, 0.1, 0.3, 0.8], [1.0, 0.0, 0.0, 1.0, 2.0, 3.0])], "a array<double>, b array<double>, rgb array<double>, cmyk array<double>, m array<double>")
    got = df.select(layout.overlap_share(F.col("a"), F.col("b")).alias("o"), layout.is_dark(F.col("rgb")).alias("d"), layout.is_dark(F.col("cmyk")).alias("e"), layout.affine(F.col("m"), F.lit(1.0), F.lit(1.0)).alias("p"), layout.combined(F.col("m"), F.col("m")).alias("c")).first()
    assert got["o"] == 0.25 and got["d"] and got["e"] and (got["p"]["x"], got["p"]["y"]) == (3.0, 4.0) and got["c"][4:] == [4.0, 6.0]


def test_masks_columns_and_gutters(spark):
    ddl = "doc_id string, physical_page int, fragment_id string, sequence long, text string, x_pos double, y_pos double, width double, height double, font_size double, redaction_masked boolean"
    rows = [("d", 1, f"l{i}", 2 * i, f"left {i}", 50.0, 700.0 - 18 * i, 100.0, 12.0, 12.0, False) for i in range(6)] + [("d", 1, f"r{i}", 2 * i + 1, f"right {i}", 300.0, 700.0 - 18 * i, 100.0, 12.0, 12.0, False) for i in range(6)]
    pieces = spark.createDataFrame(rows, ddl)
    placed = layout.visual_rows(pieces)
    splits = layout.two_columns(layout.row_texts(pieces, placed), pieces, placed)
    assert splits.first()["split_x"] == 225.0
    masks = spark.createDataFrame([("d", 1, [290.0, 690.0, 410.0, 712.0])], "doc_id string, physical_page int, rect array<double>")
    assert [(r["fragment_id"], r["text"]) for r in layout.masked(pieces, masks).filter("redaction_masked").collect()] == [("r0", "[REDACTED]")]
    gut = spark.createDataFrame([("d", i, 10, 1, 70.0, True, 72.0) for i in (1, 2, 4)] + [("d", 3, 3, 1, 71.0, True, None)], "doc_id string, physical_page int, numbered_rows int, column_count int, first_x double, first_is_number boolean, gutter_x double")
    assert layout.inherited_gutters(gut).filter("physical_page = 3").first()["gutter_x"] == 72.0


def test_joined_text(spark):
    ddl = "fs array<struct<text:string,x_pos:double,width:double,font_size:double,redaction_masked:boolean>>"
    cases = [([("Hel", 0.0, 15.0, 10.0, False), ("lo", 11.0, 10.0, 10.0, False), (",", 25.0, 2.0, 10.0, False), ("you", 40.0, 10.0, 10.0, False)], "Hello, you"), ([("a", 0.0, 5.0, 10.0, True), ("b", 20.0, 5.0, 10.0, True), ("c", 40.0, 5.0, None, None)], "a c")]
    for fs, want in cases:
        assert spark.createDataFrame([(fs,)], ddl).select(layout.joined_text(F.col("fs")).alias("t")).first()["t"] == want
