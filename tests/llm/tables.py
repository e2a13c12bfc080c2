"""Schemas of the tables, and a writer of small ones."""

SCHEMAS = {
    "canonical_rows": "doc_id string, matter_id string, id string, physical_page int, row_index int, transcript_page string, line_number int, text string, raw_text string, section string, panel int, bbox array<double>, ocr_confidence double, disposition string, event_kind string, speaker_anchor_label string, speaker_participant_id string, format_region_id string, source string, row_timestamp string, ingested_at timestamp_ntz",
    "transcript_lines": "doc_id string, source_row_id string, physical_page int, row_index int, kind string, speaker struct<participant_id:string,label:string,speaker_role:string,redacted:boolean>, confidence string",
    "doc_context": "doc_id string, matter_id string, kind string, document_type string, language_hint struct<code:string,language_name:string,confidence:double,dominant_script:string>, page_count int, typical_line_min int, typical_line_max int, received_at timestamp_ntz",
    "participants": "participant_key bigint, doc_id string, matter_id string, id string, display_label string, canonical_name string, observed_labels array<string>, speaker_role string, role_confidence double, participant_function string, function_confidence double, redacted boolean, observations bigint, question_observations bigint, answer_observations bigint, objection_observations bigint, statement_observations bigint",
    "page_frames": "doc_id string, physical_page int, transcript_page string, section string, row_ids array<string>, format_region_ids array<string>, continuity_in struct<utterance_id:string,participant_id:string>, continuity_out struct<utterance_id:string,participant_id:string>",
    "fragments": "doc_id string, fragment_id string, physical_page int, row_index int, sequence bigint, text string, x_pos double, y_pos double, width double, height double, font_name string, font_size double, source string, geometry_estimated boolean, redaction_masked boolean",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, issue_date string, page_no int, n_columns int, mean_conf double, line_boxes array<struct<line_no:int,x_left:int,y_top:int,box_width:int,box_height:int,conf:double>>, scanned_at timestamp_ntz",
    "eval_items": "item_id bigint, suite string, text string",
    "mix_targets": "source string, target_share double, max_repeats int",
    "common_words": "lang string, word string, freq_rank int",
}
KEYS = {"doc_id": {"documents": 1}, "id": {}, "source_row_id": {}}


def write(spark, folder, extra: bool = False, **rows):
    """Writes every table: the rows given (dicts, missing columns null), else none. ``extra`` adds columns whose names clash with those operators use."""
    for name, ddl in SCHEMAS.items():
        empty = spark.createDataFrame([], ddl)
        given = rows.get(name) or []
        df = spark.createDataFrame([tuple(r.get(c) for c in empty.columns) for r in given], empty.schema) if given else empty
        if extra:
            df = df.selectExpr("*", "1 as n", "'x' as r", "2.0 as weight", "'y' as lang_code", "true as h", "array(1) as words", "'z' as prior")
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def row(doc, page, index, text, kind=None, **more):
    """A canonical row and, if a kind is given, its line."""
    rid = f"p{page}_r{index + 1}"
    base = {"doc_id": doc, "matter_id": "m1", "id": rid, "physical_page": page, "row_index": index, "text": text, "raw_text": text, "section": "transcript", "disposition": "dialogue" if kind else "page_furniture", "event_kind": more.get("event_kind", "text"), "source": more.get("source", "plain_text"), "speaker_anchor_label": more.get("label") if more.get("anchor") else None}
    line = kind and {"doc_id": doc, "source_row_id": rid, "physical_page": page, "row_index": index, "kind": kind, "speaker": (more.get("pid"), more.get("label"), more.get("role", "unknown"), False), "confidence": "explicit"}
    return base, line


def transcript(*entries):
    rows = [e[0] for e in entries]
    return rows, [e[1] for e in entries if e[1]]
