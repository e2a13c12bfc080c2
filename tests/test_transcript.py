"""Whole transcripts from short pages: what the lines, turns, exchanges and checks must be."""

import pytest

from attestant.plans.transcript import Transcripts

DOCS = {
    "cross_page": ["1 00012\n20 Q. Where were\n21 you on the night\n22 that the pump", "2 00013\n1 failed?\n2 A. At home."],
    "bare_a": ["9 Q. Do you have\n10 Q. Do you really have\n11 a product like it?\n12 A     Yes.\n13 A. Truly."],
    "unknown_gap": ["5 Q. What did he say\n6 about it?\n8 something else\n9 and more\n10 A. Nothing."],
    "tail": ["1 00012\n21 Q. Did you see\n22 the man", "2 00013\n1 who came in?\n2 A. No."],
    "redacted": ["1 BY [REDACTED]:\n2 Q. Who was there?\n3 A. Two men.\n4 [REDACTED]: Q. Where?\n5 A. Outside."],
    "mixed": ["Mr. Smith. I call the witness to order now.\nMs. Jones. I have no remarks at all.\nEXAMINATION\nBY MR. SMITH:\nQ. Were you there?\nA. I was."],
    "wrap": ["ALICE SMITH: I counted\n12 jurors in the room\nBOB JONES: I saw\nall of them."],
    "blank_number": ["1 Q. One?\n2 A. Two.\n3\n4 Q. Three?\n5 A. Four."],
    "gap": ["1 Q. One?\n2 and a half?\n4 A. Four."],
    "repeated": ["1 Q. Same?\n2 A. Same."] * 5,
    "witnesses": ["1 WITNESS: JANE DOE\n2 Q. Name?\n3 A. Jane.\n4 WITNESS: SAM RAY\n5 Q. Name?\n6 A. Sam."],
    "number_once": ["1 Q. How many?\n2 A. There were\n3 12 jurors and 25 witnesses."],
    "inline": ["1 Q. Who?\n2 A. I met [REDACTED] in June.\n3 and July."],
    "index": ["1 Q. One?\n2 A. Two.", "INDEX OF EXHIBITS\nExhibit 1"],
    "david": ["DAVID MARKUS: A what?\nJANE ROE: A product.\nDAVID MARKUS: I see."],
    "learned": ["1 00048\n1 BY MR. SCOTT:\n2 Q. What happened?\n3 A. Nothing at all.\n4 A     Still nothing.\n6 Q. Why?"],
    "behaviour": ["1 PAGE 1\n1 JOHN DOE: Q. Where did you go?\n2 JANE DOE: A. To the yard."],
    "empty": [""],
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(d, i + 1, t, "pdf", "exhibit_index" if t.startswith("INDEX") else "transcript") for d, pages in DOCS.items() for i, t in enumerate(pages)]
    return Transcripts(spark.createDataFrame(rows, "doc_id string, physical_page int, text string, kind string, section string"))


@pytest.fixture(scope="module")
def lines(parsed):
    out = {}
    for r in parsed.lines.orderBy("doc_id", "physical_page", "row_index").collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


@pytest.fixture(scope="module")
def blocks(parsed):
    out = {}
    for r in parsed.blocks.orderBy("doc_id", "block_no").collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_question_over_a_page_break_is_one_block(blocks):
    b = [x for x in blocks["cross_page"] if x["kind"] == "question"]
    assert len(b) == 1 and b[0]["text"] == "Where were you on the night that the pump failed?"


def test_bare_a_only_as_a_capital(lines):
    assert [x["kind"] for x in lines["bare_a"]] == ["question", "question", "question", "answer", "answer"]


def test_text_after_a_gap_stays_unknown(lines, parsed):
    assert lines["unknown_gap"][2]["kind"] == "unknown"
    assert parsed.gate.filter("doc_id = 'unknown_gap'").first()["ready"] is False


def test_unmarked_tail_joins_the_question(blocks):
    assert blocks["tail"][0]["text"].endswith("who came in?")


def test_redacted_examiner_keeps_one_id(lines):
    asked = {x["participant_id"] for x in lines["redacted"] if x["kind"] == "question"}
    assert asked == {"attorney_redacted_1"}


def test_label_and_heading_are_one_person_and_utterances_mirror_blocks(lines, parsed, blocks):
    ids = {x["participant_id"] for x in lines["mixed"] if x["speaker"] and "SMITH" in x["speaker"]["label"].upper()}
    assert len(ids) == 1
    assert parsed.utterances.filter("doc_id = 'mixed'").count() == len(blocks["mixed"])


def test_wrapped_labels_and_numbers_of_the_text(blocks):
    b = blocks["wrap"]
    assert len(b) == 2 and b[0]["text"] == "I counted 12 jurors in the room"


def test_blank_numbered_line_is_no_gap(lines):
    assert "gap_before" not in {x["source_continuity"] for x in lines["blank_number"]}


def test_gap_parts_question_and_answer(parsed):
    assert parsed.exchanges.filter("doc_id = 'gap' and answered").count() == 0


def test_repetition_is_kept(blocks):
    assert sum(x["kind"] == "answer" for x in blocks["repeated"]) == 5


def test_witness_switch(lines):
    assert len({x["participant_id"] for x in lines["witnesses"] if x["kind"] == "answer"}) == 2


def test_number_is_stripped_once(lines):
    assert lines["number_once"][2]["text"] == "12 jurors and 25 witnesses."


def test_redaction_inside_an_answer(blocks):
    a = [x for x in blocks["inline"] if x["kind"] == "answer"]
    assert len(a) == 1 and a[0]["text"].endswith("and July.")


def test_reference_pages_stay_in_the_inventory(parsed, lines):
    kept = parsed.source_rows.filter("doc_id = 'index' and physical_page = 2")
    assert {r["disposition"] for r in kept.collect()} == {"reference"} and all(x["physical_page"] == 1 for x in lines["index"])


def test_label_outranks_bare_mark(lines):
    assert all(e["source"] != "explicit_marker" for x in lines["david"] for e in x["evidence"]["items"])
    assert lines["david"][0]["speaker"]["label"] == "DAVID MARKUS" and lines["david"][0]["text"] == "A what?"


def test_every_testimony_row_has_one_block(parsed):
    from attestant.operators.quality import row_ownership

    assert row_ownership(parsed.source_rows, parsed.blocks).filter("owners <> 1").count() == 0


def test_empty_document_is_blocked(parsed):
    assert parsed.gate.filter("doc_id = 'empty'").first()["status"] == "blocked"


def test_confidence_and_json(parsed):
    assert all(0 <= r["parse_confidence"] <= 0.95 for r in parsed.confidence.collect())
    assert parsed.document_json().count() == len(DOCS)


def test_learned_participants_marks_and_gaps(parsed):
    assert parsed.participants_before.filter("doc_id = 'learned' and display_label = 'MR. SCOTT'").count() == 1
    seen = {r["pattern"]: r["observations"] for r in parsed.rules.filter("doc_id = 'learned'").collect()}
    assert seen["Q."] == 2 and seen["A."] == 1 and seen["A"] == 1 and seen["QUESTION:"] == 0
    gap = parsed.gaps.filter("doc_id = 'learned'").collect()
    assert [(g["gap_kind"], g["first_missing"], g["last_missing"]) for g in gap] == [("missing_lines", 5, 5)]


def test_roles_from_behaviour(parsed):
    roles = {r["display_label"]: r["speaker_role"] for r in parsed.participants_before.filter("doc_id = 'behaviour'").collect()}
    assert roles == {"JOHN DOE": "attorney", "JANE DOE": "witness"}


def test_unpaired_answer_after_a_gap(parsed):
    from attestant.operators.turns import unpaired_answers

    assert unpaired_answers(parsed.blocks.filter("doc_id = 'gap'")).count() == 1


def test_fold_and_windows_agree_on_continuity(parsed, lines):
    from attestant.operators.inventory import continuity

    spoken = parsed.source_rows.filter("disposition in ('dialogue', 'blank_numbered_line')")
    by_window = {(r["doc_id"], r["id"]): r["source_continuity"] for r in continuity(spoken).collect()}
    for doc, own in lines.items():
        for x in own:
            assert by_window[(doc, x["source_row_id"])] == x["source_continuity"]


def test_sinks(parsed, spark, tmp_path):
    from attestant.sources import sinks

    sinks.write_json(parsed, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == len(DOCS)
    sinks.write_relations(parsed, str(tmp_path / "rel"), names=("exchanges", "edges", "page_frames"))
    assert spark.read.parquet(str(tmp_path / "rel/page_frames")).count() == parsed.pages.filter("text <> ''").count()


def test_rows_without_page_are_kept(spark):
    from attestant.operators.inventory import continuity

    rows = spark.createDataFrame([("d", None, 0, None, None), ("d", 1, 0, None, 1), ("d", 1, 1, None, 2)], "doc_id string, physical_page int, row_index int, transcript_page string, line_number int")
    assert [r["source_continuity"] for r in continuity(rows).orderBy("physical_page", "row_index").collect()] == ["first_observed", "first_observed", "continuous"]
