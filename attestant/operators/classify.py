"""Lines classified one after another.

What a row says of itself is worked out in columns: introductions, headings, labels, marks, redactions. Only the state (examiner, witness,
open turn, position) is folded over the rows of a document, which come sorted, so that the fold holds a state and no rows. Redacted labels
make a recursion through time that no fixed number of windows can follow, so this is one ordered pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestant.functions.marks import (
    MARKER_STRIP, WITNESS_WORDS, by_label, closes_parenthetical, introduced, is_examination, is_exhibit, is_heading, is_objection, is_redacted, is_redaction, label_role, marker, opens_parenthetical, speaker_label, speaker_of_label,
)
from attestant.functions.text import ascii_upper, label_id, trimmed
from attestant.operators.preflight import speaker_struct
from attestant.operators.scan import running

SPEAKER = "struct<participant_id:string,label:string,speaker_role:string,redacted:boolean>"
_EVIDENCE = "struct<question_score:double,answer_score:double,objection_score:double,statement_score:double,items:array<struct<source:string,weight:double>>>"
LINES = f"doc_id string, source_row_id string, physical_page int, row_index int, transcript_page string, line_number int, kind string, speaker {SPEAKER}, participant_id string, confidence string, source_continuity string, starts_new_block boolean, text string, raw_text string, evidence {_EVIDENCE}"

_SPEAKER_T = pa.struct([("participant_id", pa.string()), ("label", pa.string()), ("speaker_role", pa.string()), ("redacted", pa.bool_())])
_EVIDENCE_T = pa.struct([("question_score", pa.float64()), ("answer_score", pa.float64()), ("objection_score", pa.float64()), ("statement_score", pa.float64()), ("items", pa.list_(pa.struct([("source", pa.string()), ("weight", pa.float64())])))])
_OUT = pa.schema([("doc_id", pa.string()), ("source_row_id", pa.string()), ("physical_page", pa.int32()), ("row_index", pa.int32()), ("transcript_page", pa.string()), ("line_number", pa.int32()), ("kind", pa.string()), ("speaker", _SPEAKER_T), ("participant_id", pa.string()), ("confidence", pa.string()), ("source_continuity", pa.string()), ("starts_new_block", pa.bool_()), ("text", pa.string()), ("raw_text", pa.string()), ("evidence", _EVIDENCE_T)])

# Weights of evidence.
STATEMENT_KIND = {"witness": "witness_statement", "interpreter": "interpreter_statement", "court_reporter": "reporter_statement", "judge": "judge_statement", "videographer": "videographer_statement"}


def signals(rows: DataFrame, people: DataFrame, primaries: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with everything the fold reads: what the line says of itself, who bears its label, and the document's constants."""
    paired = rules.groupBy("doc_id").agg(F.bool_or((F.col("kind") == "question") & (F.col("observations") > 0)).alias("q"), F.bool_or((F.col("kind") == "answer") & (F.col("observations") > 0)).alias("a"))
    constants = paired.select("doc_id", (F.col("q") & F.col("a")).alias("paired")).join(primaries.select("doc_id", "primary_witness", "witnesses"), "doc_id", "left")
    body = F.col("text")
    told = rows.withColumn("m0", marker(body)).select(
        "*", introduced(body).alias("intro"), by_label(body).alias("by"), is_examination(body).alias("exam"), speaker_label(body).alias("l"), opens_parenthetical(body).alias("opens"), closes_parenthetical(body).alias("closes"), is_exhibit(body).alias("exhibit"),
        is_redaction(body).alias("pure"), is_objection(body).alias("objects"), is_heading(body).alias("heading"),
    )
    rest = F.col("l.rest")
    inline = F.when(F.col("m0.rest").rlike("(?i)^BY [^:]*:"), trimmed(F.regexp_extract("m0.rest", r"(?i)^BY ([^:]*):", 1)))
    asked = told.withColumn("m1", marker(rest)).withColumn("rest_objects", is_objection(rest)).withColumn("inline", F.when(F.col("intro").isNull() & F.col("by").isNull() & F.col("l").isNull() & (inline != ""), inline))
    name = F.coalesce("intro", "by", "l.label", "inline")
    keyed = asked.withColumn("name", name).withColumn("key", ascii_upper(trimmed(name)))
    labels = people.select("doc_id", "first_seen", speaker_struct().alias("s"), F.explode(F.array_distinct(F.transform(F.array_append("observed_labels", F.col("display_label")), lambda x: ascii_upper(trimmed(x))))).alias("key"))
    first = labels.groupBy("doc_id", "key").agg(F.min_by("s", "first_seen").alias("registered"))
    own = F.when(F.col("name").isNotNull(), speaker_of_label(F.col("name")))
    return keyed.join(first, ["doc_id", "key"], "left").join(constants, "doc_id", "left").select(
        "doc_id", "id", "physical_page", "row_index", "transcript_page", "line_number", "text", "raw_text", "disposition", F.coalesce(F.col("section") == "transcript", F.lit(False)).alias("spoken"), F.coalesce("allow_bare", F.lit(True)).alias("allow_bare") if "allow_bare" in rows.columns else F.lit(True).alias("allow_bare"),
        F.col("intro").isNotNull().alias("intro"), F.col("by").isNotNull().alias("by"), "exam", F.col("l").isNotNull().alias("labelled"), rest.alias("rest"), F.col("m1.kind").alias("m1_kind"), F.col("m1.style").alias("m1_style"), F.col("m1.priority").alias("m1_priority"), F.col("m1.rest").alias("m1_rest"), "rest_objects",
        "opens", "closes", "exhibit", F.col("m0.kind").alias("m0_kind"), F.col("m0.style").alias("m0_style"), F.col("m0.priority").alias("m0_priority"), F.regexp_replace(F.coalesce("m0.rest", F.lit("")), r"(?i)^BY [^:]*:[\s\p{Z}]*", "").alias("inline_rest"), F.col("m0.rest").alias("m0_rest"), F.col("inline").isNotNull().alias("inline"),
        "pure", "objects", "heading", "registered", own.alias("own"), F.coalesce(is_redacted(F.col("name")), F.lit(False)).alias("hidden"), F.coalesce(F.col("key").isin(*WITNESS_WORDS), F.lit(False)).alias("generic_witness"), label_role(F.col("name")).isNotNull().alias("known_role"), F.coalesce("paired", F.lit(False)).alias("paired"), "primary_witness", F.coalesce("witnesses", F.lit(0)).alias("witnesses"),
    )


@dataclass
class State:
    """What is known before a row: examiner, witness, open turn (kind, speaker), position, and how many nameless speakers there were."""

    examiner: dict | None = None
    witness: dict | None = None
    turn: tuple[str, dict | None] | None = None
    position: tuple[int, int | None, int | None] | None = None
    attorneys: int = 0
    speakers: int = 0
    objector: dict | None = None
    hidden_witness: dict | None = None
    evidence: list = field(default_factory=list)

    def nameless(self, role: str, number: int) -> dict:
        return {"participant_id": f"{'speaker' if role == 'unknown' else role}_redacted_{number}", "label": "[REDACTED]", "speaker_role": role, "redacted": True}

    def new_attorney(self) -> dict:
        self.attorneys += 1
        return self.nameless("attorney", self.attorneys)

    def new_speaker(self) -> dict:
        self.speakers += 1
        return self.nameless("unknown", self.speakers)


def _number(label: str | None) -> int | None:
    return int(label) if label and label.isdigit() else None


def place(state: State, page: int, label: str | None, line: int | None) -> tuple[str, bool]:
    """Source continuity of a row, and whether the turn before it can't reach over to it."""
    if state.position is None:
        return "first_observed", False
    p_page, p_label, p_line = state.position
    here = _number(label)
    if page > p_page + 1:
        return "gap_before", True
    same = page == p_page
    if line is None:
        return ("continuous" if same else "cross_page_continuous") if p_line is None else "first_observed", False
    if same:
        if p_line is None:
            return "first_observed", False
        goes_on = line == p_line + 1
        return "continuous" if goes_on else "gap_before", not goes_on
    both = p_label is not None and here is not None
    goes_on = both and here == p_label + 1 and line == 1
    if p_line is None:
        return "first_observed", both and not goes_on
    return ("cross_page_continuous" if goes_on else "gap_before") if both else "unknown", both and not goes_on


Made = tuple[str, "dict | None", str, bool, str, dict, list]


def _scores(**found: float) -> dict:
    return {"question_score": 0.0, "answer_score": 0.0, "objection_score": 0.0, "statement_score": 0.0} | found


def _scored(kind: str, value: float) -> dict:
    return _scores(**{f"{kind if kind in ('question', 'answer', 'objection') else 'statement'}_score": value})


def who(state: State, r: dict) -> dict:
    """The speaker of a labelled row."""
    if r["generic_witness"] and state.witness:
        return state.witness
    if not r["hidden"]:
        if r["registered"]:
            return r["registered"]
        if r["known_role"]:
            return r["own"]
        mark = _mark(r, "m1", bare=True)
        role = {"question": "attorney", "answer": "witness"}.get(mark, "attorney" if r["rest_objects"] else "unknown")
        return r["own"] | {"speaker_role": role}
    mark = _mark(r, "m1", bare=True)
    if mark == "question":
        e = state.examiner
        if not (e and e["redacted"] and e["speaker_role"] == "attorney"):
            state.examiner = state.new_attorney()
        return state.examiner
    if mark == "answer":
        state.hidden_witness = state.hidden_witness or state.nameless("witness", 1)
        state.witness = state.hidden_witness
        return state.witness
    if r["rest_objects"]:
        state.objector = state.objector or state.new_attorney()
        return state.objector
    if state.turn and state.turn[1] and state.turn[1]["redacted"]:
        return state.turn[1]
    return state.new_speaker()


def _mark(r: dict, which: str, bare: bool) -> str | None:
    """The kind of a row's mark, if the document's conventions allow it."""
    kind = r[f"{which}_kind"]
    if kind and r[f"{which}_style"] == "bare_uppercase" and not (bare and r["paired"]):
        return None
    return kind


def classify(state: State, r: dict) -> Made:
    """Kind, speaker, confidence, whether a block begins, text, scores and evidence of a row; the first rule that fits counts."""
    text = r["text"]
    structural = (_scores(statement_score=1.0), [("format_fingerprint", 1.0)])
    if r["intro"]:
        speaker = (r["registered"] or r["own"]) | {"speaker_role": "witness"}
        state.witness, state.examiner, state.turn = speaker, None, None
        return "heading", speaker, "explicit", True, text, *structural
    if r["by"]:
        speaker = state.new_attorney() if r["hidden"] else r["registered"] or r["own"]
        state.examiner, state.turn = speaker, None
        return "examination_heading", speaker, "explicit", True, text, structural[0], [*structural[1], ("current_examiner", 1.0)]
    if r["exam"]:
        state.turn = None
        return "examination_heading", None, "explicit", True, text, *structural
    if r["labelled"]:
        return labelled(state, r, who(state, r))
    if r["opens"]:
        kind = "exhibit_marker" if r["exhibit"] else "parenthetical"
        state.turn = None if r["closes"] else (kind, None)
        return kind, None, "explicit", True, text, *structural
    mark = _mark(r, "m0", bare=r["allow_bare"])
    if mark:
        return marked(state, r, mark)
    if r["pure"]:
        state.turn = None
        return "redaction_marker", None, "explicit", True, text, _scores(), [("redaction", 1.0)]
    if r["objects"]:
        state.turn = ("objection", None)
        return "objection", None, "explicit", True, text, _scored("objection", 1.0), [("role_behavior", 1.0)]
    if r["heading"]:
        state.turn = None
        return "heading", None, "explicit", True, text, *structural
    if state.turn:
        kind, speaker = state.turn
        if kind in ("parenthetical", "exhibit_marker") and r["closes"]:
            state.turn = None
        return kind, speaker, "inferred", False, text, _scored(kind, 0.72), [("previous_line", 0.72)]
    return "unknown", None, "unknown", True, text, _scores(), []


def marked(state: State, r: dict, mark: str) -> Made:
    """A row that begins with a question or answer mark."""
    weight = 1.0 if r["m0_priority"] == 1 else 0.94
    evidence = [("explicit_marker", weight), ("format_fingerprint", 0.4)]
    if mark == "question":
        text = r["m0_rest"]
        if r["inline"]:
            state.examiner = state.new_attorney() if r["hidden"] else r["registered"] or r["own"]
            text = r["inline_rest"]
        if state.examiner:
            evidence.append(("current_examiner", 0.6))
        speaker = state.examiner or {"participant_id": None, "label": "UNKNOWN ATTORNEY", "speaker_role": "attorney", "redacted": False}
        state.examiner, state.turn = speaker, ("question", speaker)
        return "question", speaker, "explicit", True, text, _scored("question", weight), evidence
    state.witness = state.witness or {"participant_id": "witness_unresolved", "label": "UNRESOLVED WITNESS", "speaker_role": "witness", "redacted": False}
    state.turn = ("answer", state.witness)
    text = (r["m0_rest"] or "").strip()
    for prefix in ("THE WITNESS:", "BY THE WITNESS:"):
        if text[: len(prefix)].upper() == prefix:
            text = text[len(prefix) :].strip()
            break
    return "answer", state.witness, "explicit", True, text, _scored("answer", weight), [*evidence, ("known_witness", 0.7)]


def labelled(state: State, r: dict, speaker: dict) -> Made:
    """A row that begins with a speaker's label."""
    mark, rest = _mark(r, "m1", bare=False), r["rest"] or ""
    if mark:
        weight = 1.0 if r["m1_priority"] == 1 else 0.94
        if mark == "question":
            state.examiner = speaker
        else:
            state.witness = speaker
        state.turn = (mark, speaker)
        return mark, speaker, "explicit", True, r["m1_rest"], _scored(mark, weight), [("explicit_marker", weight), ("speaker_label", 0.9)]
    role, asks = speaker["speaker_role"], rest.rstrip().endswith("?")
    if role in ("attorney", "unknown") and asks:
        state.examiner, state.turn = speaker, ("question", speaker)
        if role == "attorney":
            return "question", speaker, "inferred", True, rest, _scored("question", 0.86), [("speaker_label", 0.8), ("question_punctuation", 0.75)]
        return "question", speaker, "inferred", True, rest, _scored("question", 0.78), [("question_punctuation", 0.72), ("role_behavior", 0.65)]
    if role == "attorney":
        kind = "objection" if r["rest_objects"] else "attorney_statement"
        if kind == "objection" and speaker["redacted"]:
            state.objector = speaker
        state.turn = (kind, speaker)
        return kind, speaker, "explicit", True, rest, _scored(kind, 0.92), [("speaker_label", 0.92), *([("role_behavior", 1.0)] if kind == "objection" else [])]
    if role == "witness":
        state.witness = speaker
        if state.turn and state.turn[0] == "question":
            state.turn = ("answer", speaker)
            return "answer", speaker, "inferred", True, rest, _scored("answer", 0.84), [("speaker_label", 0.8), ("previous_line", 0.7)]
    if role == "unknown":
        state.turn = ("speaker_statement", speaker)
        return "speaker_statement", speaker, "explicit", True, rest, _scores(statement_score=0.45), [("speaker_label", 0.45)]
    kind = STATEMENT_KIND[role]
    state.turn = (kind, speaker)
    return kind, speaker, "explicit", True, rest, _scores(statement_score=0.92), [("speaker_label", 0.92)]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    doc, state = None, State()
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["doc_id"] != doc:
                doc, state = r["doc_id"], State(witness=r["primary_witness"] if r["witnesses"] <= 1 else None)
            page, label, line = r["physical_page"], r["transcript_page"], r["line_number"]
            if r["disposition"] == "blank_numbered_line" and r["spoken"]:
                state.position = (page, _number(label), line)
                continue
            if r["disposition"] != "dialogue":
                if r["disposition"] != "page_furniture":
                    state.turn = None
                continue
            continuity, doubtful = place(state, page, label, line)
            if doubtful:
                state.turn = None
            kind, speaker, confidence, opens, text, scores, items = classify(state, r)
            state.position = (page, _number(label), line)
            evidence = scores | {"items": [{"source": s, "weight": w} for s, w in items]}
            out.append((doc, r["id"], page, r["row_index"], label, line, kind, speaker, speaker and speaker["participant_id"], confidence, continuity, opens, text, r["raw_text"], evidence))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _OUT.types, strict=True)], schema=_OUT)


def classified(rows: DataFrame, people: DataFrame, primaries: DataFrame, rules: DataFrame) -> DataFrame:
    """A line for each row of testimony. Rows have no repeated ids; those without any text but a number only move the position on."""
    told = signals(rows, people, primaries, rules)
    return told.repartition("doc_id").sortWithinPartitions("doc_id", "physical_page", "row_index").mapInArrow(_fold, LINES)


def completed(lines: DataFrame) -> DataFrame:
    """Labelled turns that end in a question mark become questions, and turns of a witness after another's question become answers."""
    struct = F.col("speaker")
    told = running(lines, ["row_index"], lasts={"prior": F.struct(struct.alias("s"), F.lit(True).alias("is"))})
    new = F.col("prior").isNull() | F.col("starts_new_block") | ~F.col("prior.s").eqNullSafe(struct)
    numbered = running(told.withColumn("new", new.cast("long")).drop("prior"), ["row_index"], sums={"run": F.col("new")})
    at = F.struct("physical_page", "row_index")
    has_label = F.exists("evidence.items", lambda e: e["source"] == "speaker_label")
    runs = numbered.groupBy("doc_id", "run").agg(F.min_by(F.struct("kind", "speaker", "participant_id", has_label.alias("labelled"), "physical_page"), at).alias("f"), F.max_by(trimmed(F.col("text")).endswith("?"), at).alias("asks"))
    open_ = F.col("f.labelled") & ~F.col("f.kind").isin("question", "answer", "objection")
    # the speaker of the last question before a run; headings and redactions forget it
    asked = (F.col("f.kind") == "question") | (open_ & F.col("asks"))
    event = F.when(asked, F.struct(F.col("f.participant_id").alias("who"))).when(F.col("f.kind").isin("examination_heading", "heading", "redaction_marker"), F.struct(F.lit(None).cast("string").alias("who")))
    before = W.partitionBy("doc_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    remembered = runs.withColumn("question", F.last(event, ignorenulls=True).over(before))
    responds = (F.col("f.speaker.speaker_role") == "witness") & F.col("question.who").isNotNull() & ~F.col("question.who").eqNullSafe(F.col("f.participant_id"))
    new_kind = F.when(open_ & F.col("asks"), "question").when(open_ & F.coalesce(responds, F.lit(False)), "answer")
    kinds = remembered.select("doc_id", "run", new_kind.alias("new_kind"))
    joined = numbered.join(kinds, ["doc_id", "run"])
    added = F.struct(*[F.col("evidence")[c].alias(c) for c in ("question_score", "answer_score", "objection_score", "statement_score")], F.array_append("evidence.items", F.struct(F.lit("role_behavior").alias("source"), F.lit(0.7).alias("weight"))).alias("items"))
    done = joined.withColumn("kind", F.coalesce("new_kind", "kind")).withColumn("confidence", F.when(F.col("new_kind").isNotNull(), "inferred").otherwise(F.col("confidence"))).withColumn("evidence", F.when(F.col("new_kind").isNotNull(), added).otherwise(F.col("evidence")))
    return done.select(*lines.columns)


def bare_marks_allowed(rows: DataFrame, fragments: DataFrame) -> DataFrame:
    """Adds allow_bare: whether a row whose first piece is Q or A has a wide enough gap after it; rows without pieces may.

    fragments: doc_id, physical_page, row_index, x_pos, width, font_size, text; the first two of each row are compared.
    """
    order = W.partitionBy("doc_id", "physical_page", "row_index").orderBy("x_pos", "sequence")
    firsts = fragments.withColumn("next_x", F.lead("x_pos").over(order)).withColumn("n", F.row_number().over(order)).filter("n = 1")
    wide = ~trimmed(F.col("text")).isin("Q", "A") | F.col("next_x").isNull() | (F.col("next_x") - (F.col("x_pos") + F.col("width")) > 0.65 * F.coalesce("font_size", F.lit(10.0)))
    return rows.join(firsts.select("doc_id", "physical_page", "row_index", F.coalesce(wide, F.lit(True)).alias("allow_bare")), ["doc_id", "physical_page", "row_index"], "left").withColumn("allow_bare", F.coalesce("allow_bare", F.lit(True)))

