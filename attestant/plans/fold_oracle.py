"""The line classifier in SQL: a recursive query that goes row by row through all documents at once, written for itself."""

from __future__ import annotations

from attestant.plans.oracles import COLON, R, TITLED, has, q, role_sql, trim, upper, words

# Marks (kind, bare style, priority, expression), exclusive of one another in this order.
_MARKS = (
    ("question", False, 1, r"^Q\.($|[\s\p{Z}])"), ("answer", False, 1, r"^A\.($|[\s\p{Z}])"), ("question", True, 2, r"^Q($|[\s\p{Z}])"), ("answer", True, 2, r"^A($|[\s\p{Z}])"), ("question", False, 3, r"^Q:($|[\s\p{Z}])"), ("answer", False, 3, r"^A:($|[\s\p{Z}])"),
    ("question", False, 4, r"(?i)^QUESTION[:.]"), ("answer", False, 4, r"(?i)^ANSWER[:.]"),
)
_STRIP = r"^(?:[QA][.:]?|(?i:QUESTION|ANSWER)[:.])[\s\p{Z}]*"
_ROLE = "CASE WHEN speaker_role <> 'unknown' THEN speaker_role WHEN participant_function IN ('witness', 'interviewee') THEN 'witness' WHEN participant_function IN ('counsel', 'government_counsel') THEN 'attorney' WHEN participant_function IN ('interpreter', 'court_reporter', 'judge', 'videographer') THEN participant_function ELSE 'unknown' END"
_EXAM = "('EXAMINATION', 'DIRECT EXAMINATION', 'CROSS-EXAMINATION', 'CROSS EXAMINATION', 'REDIRECT EXAMINATION', 'RE-DIRECT EXAMINATION', 'RECROSS EXAMINATION', 'RE-CROSS EXAMINATION', 'FURTHER EXAMINATION')"
_HEAD = "('APPEARANCES', 'INDEX', 'PROCEEDINGS', 'CERTIFICATE', 'CERTIFICATION', 'ERRATA', 'SIGNATURE', 'STIPULATIONS', 'CONTENTS')"
_PURE = r"(?i)^(?:\[REDACTED\]|\[NAME REDACTED\]|\[REDACTED NAME\]|\[NAME WITHHELD\]|\[SEALED\]|REDACTED|SEALED|NAME WITHHELD)$|^[█■▇Xx*_]{3,}$"
_HIDDEN = r"(?i)\[REDACTED\]|NAME REDACTED|REDACTED NAME|NAME WITHHELD|\[SEALED\]|^REDACTED$|^SEALED$|[█■▇].*[█■▇].*[█■▇]|^[Xx*_]{4,}$"
_OBJECT = r"(?i)^objection|^object |^i object| object to "
_NAMES = r"^[\p{L}\p{M}\s\p{Z}.'’\-]+$"


def _left(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+', '')"


def _mark(x: str, field: int) -> str:
    return "CASE " + " ".join(f"WHEN {has(_left(x), m[3])} THEN {q(m[field]) if field == 0 else str(m[field]).lower()}" for m in _MARKS) + " END"


def _s(pid: str, label: str, role: str, hidden: str) -> str:
    return f"{{'participant_id': {pid}, 'label': {label}, 'speaker_role': {role}, 'redacted': {hidden}}}"


def _signs() -> str:
    sub = lambda x, e: f"regexp_replace({x}, {q(e)}, '')"
    pick = lambda x, e: f"regexp_extract({x}, {q(e)}, 1)"
    intro = f"CASE WHEN {has('t', '(?i)^(?:WITNESS|DEPONENT): ')} THEN {trim(sub('t', '(?s)^[^:]*:'))} WHEN contains(t, ',') AND {has(trim(sub('t', '(?s)^[^,]*,')), '(?i)^(?:HAVING BEEN|BEING FIRST|CALLED AS A WITNESS)')} THEN {trim(pick('t', '(?s)^([^,]*),'))} END"
    by = f"CASE WHEN {has('t', '(?i)^BY .*:$')} THEN {trim(sub(sub('t', '(?i)^BY '), ':+$'))} END"
    letters = r"regexp_replace(b, '[^\p{L}]', '', 'g')"
    wide = rf"({words('b')} BETWEEN 1 AND 7 AND length({letters}) >= 2 AND length(regexp_replace({letters}, '[^\p{{Lu}}]', '', 'g')) / greatest(1, length({letters})) >= 0.8 AND b NOT IN ('Q', 'A', 'QUESTION', 'ANSWER'))"
    bare = rf"({words('b')} BETWEEN 1 AND 5 AND regexp_matches(b, '[A-Za-z]') AND regexp_matches(b, '^[A-Z0-9\s\p{{Z}}.''\-]+$'))"
    pure = has(trim("regexp_replace(t, '^:+|:+$', '', 'g')"), _PURE)
    own = _s(f"CASE WHEN NOT hidden THEN 'label_' || lower(hex(encode({upper(trim('name'))}))) END", trim("name"), f"coalesce({role_sql('name')}, 'unknown')", "hidden")
    return (
        COLON
        + TITLED[len(R) :]
        + f""", pp AS (SELECT DISTINCT ON (doc_id, id) *, {_ROLE} AS role FROM participants),
lb AS (SELECT doc_id, k, arg_min({_s('id', 'display_label', 'role', 'redacted')}, id) AS registered FROM (SELECT *, unnest(list_distinct(list_transform(list_append(observed_labels, display_label), lambda x: {upper(trim('x'))}))) AS k FROM pp) GROUP BY doc_id, k),
y0 AS (SELECT doc_id, id, physical_page, row_index, transcript_page, line_number, text, disposition, coalesce(section = 'transcript', false) AS spoken, {trim('text')} AS t FROM r),
y1 AS (SELECT y0.*, {intro} AS i0, {by} AS b, coalesce(cl.label, tl.label) AS l_label, CASE WHEN cl.label IS NOT NULL THEN cl.rest ELSE tl.rest END AS l_rest FROM y0 LEFT JOIN cl USING (doc_id, id) LEFT JOIN tl USING (doc_id, id)),
y2 AS (SELECT *, CASE WHEN {has('i0', _NAMES)} AND {words('i0')} BETWEEN 2 AND 6 THEN i0 END AS intro, CASE WHEN b <> '' AND ({wide} OR {bare} OR {role_sql('b')} IS NOT NULL) THEN b END AS byl, {upper('t')} IN {_EXAM} AS exam, {upper('t')} IN {_HEAD} AS heading, {pure} AS pure,
 coalesce(starts_with(t, '(') OR (starts_with(t, '[') AND NOT {pure}) OR starts_with(t, '---'), false) AS parens, coalesce(starts_with(t, '---') OR ends_with(t, ')') OR ends_with(t, ']'), false) AS closes, coalesce({has('text', '(?i)exhibit')} AND {has('text', '(?i)marked|received|identified|admitted')}, false) AS exhibit, coalesce({has('t', _OBJECT)}, false) AS objects,
 {_mark('text', 0)} AS m0, {_mark('text', 1)} AS m0_bare, {_mark('text', 2)} AS m0_rank, {sub(_left('text'), _STRIP)} AS m0_all, {_mark('l_rest', 0)} AS m1, {_mark('l_rest', 1)} AS m1_bare, {_mark('l_rest', 2)} AS m1_rank, {sub(_left('l_rest'), _STRIP)} AS m1_rest, coalesce({has(trim('l_rest'), _OBJECT)}, false) AS rest_objects FROM y1),
y3 AS (SELECT *, CASE WHEN m0 IS NOT NULL THEN m0_all END AS m0_rest, CASE WHEN intro IS NULL AND byl IS NULL AND l_label IS NULL AND m0 IS NOT NULL AND {has('m0_all', '(?i)^BY [^:]*:')} THEN nullif({trim(pick('m0_all', '(?i)^BY ([^:]*):'))}, '') END AS inl FROM y2),
y4 AS (SELECT *, coalesce(intro, byl, l_label, inl) AS name FROM y3), y5 AS (SELECT *, {upper(trim('name'))} AS k, coalesce({has(trim('name'), _HIDDEN)}, false) AS hidden FROM y4),
ru AS (SELECT doc_id, bool_or(m = 'question') AND bool_or(m = 'answer') AS paired, count_if(m = 'answer') AS n FROM (SELECT doc_id, CASE WHEN l_label IS NULL THEN m0 END AS m FROM y5) GROUP BY 1),
pw AS (SELECT doc_id, arg_max({_s('id', 'display_label', q('witness'), 'redacted')}, (answer_observations, observations, id)) FILTER (speaker_role = 'witness' OR participant_function IN ('witness', 'interviewee')) AS w, count_if(speaker_role = 'witness') AS witnesses FROM pp GROUP BY 1),
co AS (SELECT doc_id, coalesce(paired, false) AS paired, CASE WHEN coalesce(witnesses, 0) <= 1 THEN coalesce(w, CASE WHEN n > 0 THEN {_s("'witness_1'", "'THE WITNESS'", "'witness'", 'false')} END) END AS first_witness FROM ru LEFT JOIN pw USING (doc_id)),
sg AS (SELECT y5.*, row_number() OVER (PARTITION BY doc_id ORDER BY physical_page, row_index) AS rn, co.paired, lb.registered, CASE WHEN name IS NOT NULL THEN {own} END AS own, coalesce(k IN ('THE WITNESS', 'WITNESS', 'THE DEPONENT', 'DEPONENT'), false) AS generic, {role_sql('name')} IS NOT NULL AS known_role, try_cast(CASE WHEN regexp_matches(transcript_page, '^[0-9]+$') THEN transcript_page END AS INT) AS plabel,
 CASE WHEN m0_bare AND NOT co.paired THEN NULL ELSE m0 END AS mk, CASE WHEN m1_bare AND NOT co.paired THEN NULL ELSE m1 END AS mw, CASE WHEN NOT m1_bare THEN m1 END AS ml, ends_with({trim('l_rest')}, '?') AS asks FROM y5 LEFT JOIN co USING (doc_id) LEFT JOIN lb USING (doc_id, k))"""
    )


def fold() -> str:
    """Common table expressions that end in ``ln``: a line for each row of testimony."""
    null_s = "CAST(NULL AS STRUCT(participant_id VARCHAR, label VARCHAR, speaker_role VARCHAR, redacted BOOLEAN))"
    lawyer = _s("'attorney_redacted_' || (att + 1)", "'[REDACTED]'", "'attorney'", "true")
    named = f"CASE WHEN registered IS NOT NULL THEN registered WHEN known_role THEN own ELSE {_s('own.participant_id', 'own.label', chr(67) + 'ASE WHEN mw = ' + q('question') + ' THEN ' + q('attorney') + ' WHEN mw = ' + q('answer') + ' THEN ' + q('witness') + ' WHEN rest_objects THEN ' + q('attorney') + ' ELSE ' + q('unknown') + ' END', 'own.redacted')} END"
    keeps = "coalesce(ex.redacted AND ex.speaker_role = 'attorney', false)"
    statement = "CASE sp.speaker_role WHEN 'witness' THEN 'witness_statement' WHEN 'interpreter' THEN 'interpreter_statement' WHEN 'court_reporter' THEN 'reporter_statement' WHEN 'judge' THEN 'judge_statement' WHEN 'videographer' THEN 'videographer_statement' END"
    says = "regexp_replace({x}, '(?i)^(?:BY )?THE WITNESS:', '')"
    return (
        "RECURSIVE "
        + _signs()
        + f""", st AS (
SELECT doc_id, CAST(0 AS BIGINT) AS rn, {null_s} AS ex, first_witness AS wi, CAST(NULL AS VARCHAR) AS tk, {null_s} AS ts, false AS placed, CAST(NULL AS INT) AS p_page, CAST(NULL AS INT) AS p_label, CAST(NULL AS INT) AS p_line, 0 AS att, 0 AS spk, {null_s} AS ob, {null_s} AS hw,
 CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS kind, {null_s} AS speaker, CAST(NULL AS VARCHAR) AS confidence, CAST(NULL AS VARCHAR) AS continuity, false AS opens, CAST(NULL AS VARCHAR) AS said, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS evidence, CAST(NULL AS INT) AS physical_page, CAST(NULL AS INT) AS row_index FROM co
UNION ALL
SELECT doc_id, rn,
 CASE WHEN act <> 'line' THEN ex WHEN br = 'intro' THEN NULL WHEN br = 'by' THEN sp WHEN br = 'label' THEN CASE WHEN ml = 'question' OR (ml IS NULL AND sp.speaker_role IN ('attorney', 'unknown') AND asks) OR (wb = 'hq') THEN sp ELSE ex END WHEN br = 'mark' AND mk = 'question' THEN sp ELSE ex END,
 CASE WHEN act <> 'line' THEN wi WHEN br = 'intro' THEN sp WHEN br = 'label' THEN CASE WHEN ml = 'answer' OR wb = 'ha' OR (ml IS NULL AND sp.speaker_role = 'witness') THEN sp ELSE wi END WHEN br = 'mark' AND mk = 'answer' THEN sp ELSE wi END,
 CASE WHEN act = 'blank' OR act = 'furniture' THEN tk0 WHEN act = 'other' THEN NULL WHEN br IN ('intro', 'by', 'exam', 'pure', 'head') THEN NULL WHEN br = 'paren' THEN CASE WHEN NOT closes THEN k2 END WHEN br = 'turn' AND k2 IN ('parenthetical', 'exhibit_marker') AND closes THEN NULL WHEN br = 'none' THEN NULL ELSE k2 END,
 CASE WHEN act = 'blank' OR act = 'furniture' THEN ts0 WHEN act = 'line' AND br IN ('label', 'mark', 'turn') THEN sp END,
 CASE WHEN act IN ('line', 'blank') THEN true ELSE placed END, CASE WHEN act IN ('line', 'blank') THEN physical_page ELSE p_page END, CASE WHEN act IN ('line', 'blank') THEN plabel ELSE p_label END, CASE WHEN act IN ('line', 'blank') THEN line_number ELSE p_line END,
 att + CASE WHEN act = 'line' AND (wb IN ('hq', 'ho') OR (br = 'by' AND hidden) OR (br = 'mark' AND mk = 'question' AND inl IS NOT NULL AND hidden)) THEN 1 ELSE 0 END, spk + CASE WHEN act = 'line' AND wb = 'hn' THEN 1 ELSE 0 END,
 CASE WHEN act = 'line' AND wb = 'ho' THEN sp WHEN act = 'line' AND br = 'label' AND k2 = 'objection' AND ml IS NULL AND sp.redacted THEN sp ELSE ob END, CASE WHEN act = 'line' AND wb = 'ha' THEN sp ELSE hw END,
 CASE WHEN act = 'line' THEN id END, CASE WHEN act = 'line' THEN k2 END, CASE WHEN act = 'line' THEN sp END,
 CASE WHEN br = 'none' THEN 'unknown' WHEN br = 'turn' OR (br = 'label' AND ml IS NULL AND ((sp.speaker_role IN ('attorney', 'unknown') AND asks) OR k2 = 'answer')) THEN 'inferred' ELSE 'explicit' END, continuity, br <> 'turn',
 CASE WHEN br = 'label' THEN CASE WHEN ml IS NOT NULL THEN m1_rest ELSE coalesce(l_rest, '') END WHEN br = 'mark' AND mk = 'question' THEN CASE WHEN inl IS NOT NULL THEN regexp_replace(m0_rest, '(?i)^BY [^:]*:[\\s\\p{{Z}}]*', '') ELSE m0_rest END WHEN br = 'mark' THEN {trim(says.format(x=trim('m0_rest')))} ELSE text END,
 CASE WHEN br IN ('pure', 'none') THEN 0.0e0 WHEN br = 'turn' THEN 0.72e0 WHEN br = 'mark' THEN CASE WHEN m0_rank = 1 THEN 1.0e0 ELSE 0.94e0 END WHEN br <> 'label' THEN 1.0e0 WHEN ml IS NOT NULL THEN CASE WHEN m1_rank = 1 THEN 1.0e0 ELSE 0.94e0 END WHEN k2 = 'question' THEN CASE WHEN sp.speaker_role = 'attorney' THEN 0.86e0 ELSE 0.78e0 END WHEN k2 = 'answer' THEN 0.84e0 WHEN k2 = 'speaker_statement' THEN 0.45e0 ELSE 0.92e0 END,
 CASE WHEN br = 'by' THEN 'format_fingerprint:100 current_examiner:100' WHEN br IN ('intro', 'exam', 'paren', 'head') THEN 'format_fingerprint:100' WHEN br = 'pure' THEN 'redaction:100' WHEN br = 'obj' THEN 'role_behavior:100' WHEN br = 'turn' THEN 'previous_line:72' WHEN br = 'none' THEN ''
  WHEN br = 'mark' THEN 'explicit_marker:' || CASE WHEN m0_rank = 1 THEN '100' ELSE '94' END || ' format_fingerprint:40' || CASE WHEN mk = 'answer' THEN ' known_witness:70' WHEN ex IS NOT NULL OR inl IS NOT NULL THEN ' current_examiner:60' ELSE '' END
  WHEN ml IS NOT NULL THEN 'explicit_marker:' || CASE WHEN m1_rank = 1 THEN '100' ELSE '94' END || ' speaker_label:90' WHEN k2 = 'question' AND sp.speaker_role = 'attorney' THEN 'speaker_label:80 question_punctuation:75' WHEN k2 = 'question' THEN 'question_punctuation:72 role_behavior:65' WHEN k2 = 'objection' THEN 'speaker_label:92 role_behavior:100' WHEN k2 = 'answer' THEN 'speaker_label:80 previous_line:70' WHEN k2 = 'speaker_statement' THEN 'speaker_label:45' ELSE 'speaker_label:92' END,
 physical_page, row_index
FROM (SELECT *, CASE br WHEN 'intro' THEN 'heading' WHEN 'by' THEN 'examination_heading' WHEN 'exam' THEN 'examination_heading' WHEN 'paren' THEN CASE WHEN exhibit THEN 'exhibit_marker' ELSE 'parenthetical' END WHEN 'mark' THEN mk WHEN 'pure' THEN 'redaction_marker' WHEN 'obj' THEN 'objection' WHEN 'head' THEN 'heading' WHEN 'turn' THEN tk0 WHEN 'none' THEN 'unknown'
  ELSE CASE WHEN ml IS NOT NULL THEN ml WHEN sp.speaker_role IN ('attorney', 'unknown') AND asks THEN 'question' WHEN sp.speaker_role = 'attorney' THEN CASE WHEN rest_objects THEN 'objection' ELSE 'attorney_statement' END WHEN sp.speaker_role = 'witness' AND tk0 = 'question' THEN 'answer' WHEN sp.speaker_role = 'unknown' THEN 'speaker_statement' ELSE {statement} END END AS k2
 FROM (SELECT *, CASE WHEN br = 'intro' THEN {_s('coalesce(registered, own).participant_id', 'coalesce(registered, own).label', q('witness'), 'coalesce(registered, own).redacted')} WHEN br = 'by' THEN CASE WHEN hidden THEN {lawyer} ELSE coalesce(registered, own) END
   WHEN br = 'label' THEN CASE wb WHEN 'gw' THEN wi WHEN 'nm' THEN {named} WHEN 'hx' THEN ex WHEN 'hq' THEN {lawyer} WHEN 'ha' THEN coalesce(hw, {_s("'witness_redacted_1'", "'[REDACTED]'", "'witness'", 'true')}) WHEN 'hb' THEN ob WHEN 'ho' THEN {lawyer} WHEN 'ht' THEN ts0 ELSE {_s("'speaker_redacted_' || (spk + 1)", "'[REDACTED]'", "'unknown'", 'true')} END
   WHEN br = 'mark' AND mk = 'question' THEN CASE WHEN inl IS NOT NULL THEN CASE WHEN hidden THEN {lawyer} ELSE coalesce(registered, own) END ELSE coalesce(ex, {_s('NULL', "'UNKNOWN ATTORNEY'", "'attorney'", 'false')}) END WHEN br = 'mark' THEN coalesce(wi, {_s("'witness_unresolved'", "'UNRESOLVED WITNESS'", "'witness'", 'false')}) WHEN br = 'turn' THEN ts0 END AS sp
  FROM (SELECT *, CASE WHEN br <> 'label' THEN '' WHEN generic AND wi IS NOT NULL THEN 'gw' WHEN NOT hidden THEN 'nm' WHEN mw = 'question' THEN CASE WHEN {keeps} THEN 'hx' ELSE 'hq' END WHEN mw = 'answer' THEN 'ha' WHEN rest_objects THEN CASE WHEN ob IS NOT NULL THEN 'hb' ELSE 'ho' END WHEN ts0 IS NOT NULL AND ts0.redacted THEN 'ht' ELSE 'hn' END AS wb
   FROM (SELECT *, CASE WHEN act <> 'line' THEN '' WHEN intro IS NOT NULL THEN 'intro' WHEN byl IS NOT NULL THEN 'by' WHEN exam THEN 'exam' WHEN l_label IS NOT NULL THEN 'label' WHEN parens THEN 'paren' WHEN mk IS NOT NULL THEN 'mark' WHEN pure THEN 'pure' WHEN objects THEN 'obj' WHEN heading THEN 'head' WHEN tk0 IS NOT NULL THEN 'turn' ELSE 'none' END AS br
    FROM (SELECT *, CASE WHEN act = 'line' AND doubt THEN NULL ELSE tk END AS tk0, CASE WHEN NOT (act = 'line' AND doubt) THEN ts END AS ts0
     FROM (SELECT g.*, s.ex, s.wi, s.tk, s.ts, s.placed, s.p_page, s.p_label, s.p_line, s.att, s.spk, s.ob, s.hw, CASE WHEN disposition = 'blank_numbered_line' AND spoken THEN 'blank' WHEN disposition = 'dialogue' THEN 'line' WHEN disposition = 'page_furniture' THEN 'furniture' ELSE 'other' END AS act,
       CASE WHEN NOT placed THEN 'first_observed' WHEN g.physical_page > p_page + 1 THEN 'gap_before' WHEN line_number IS NULL THEN CASE WHEN p_line IS NOT NULL THEN 'first_observed' WHEN g.physical_page = p_page THEN 'continuous' ELSE 'cross_page_continuous' END WHEN p_line IS NULL THEN 'first_observed' WHEN g.physical_page = p_page THEN CASE WHEN line_number = p_line + 1 THEN 'continuous' ELSE 'gap_before' END
        WHEN p_label IS NULL OR plabel IS NULL THEN 'unknown' WHEN plabel = p_label + 1 AND line_number = 1 THEN 'cross_page_continuous' ELSE 'gap_before' END AS continuity,
       CASE WHEN NOT placed THEN false WHEN g.physical_page > p_page + 1 THEN true WHEN line_number IS NULL THEN false WHEN g.physical_page = p_page THEN p_line IS NOT NULL AND line_number <> p_line + 1 WHEN p_label IS NULL OR plabel IS NULL THEN false ELSE NOT (plabel = p_label + 1 AND line_number = 1) END AS doubt
      FROM st s JOIN sg g ON g.doc_id = s.doc_id AND g.rn = s.rn + 1))))))
), ln AS (SELECT * FROM st WHERE id IS NOT NULL)"""
    )


def oracle_sql() -> dict[str, str]:
    ln = fold()
    run = (
        ", l1 AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR opens OR lag(speaker) OVER w IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS new FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY rn)), l2 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY rn) AS run FROM l1), "
        f"u1 AS (SELECT doc_id, run, arg_min(kind, rn) AS fk, first(speaker ORDER BY rn) AS fs, contains(arg_min(evidence, rn), 'speaker_label') AND arg_min(kind, rn) NOT IN ('question', 'answer', 'objection') AS free, ends_with({trim('arg_max(said, rn)')}, '?') AS asks FROM l2 GROUP BY doc_id, run), "
        "u2 AS (SELECT *, CASE WHEN fk = 'question' OR (free AND asks) THEN 'q' || coalesce(fs.participant_id, '') WHEN fk IN ('examination_heading', 'heading', 'redaction_marker') THEN 'x' END AS ev FROM u1), u3 AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM u2), "
        "u4 AS (SELECT doc_id, run, CASE WHEN free AND asks THEN 'question' WHEN free AND fs.speaker_role = 'witness' AND starts_with(prior, 'q') AND length(prior) > 1 AND substr(prior, 2) IS DISTINCT FROM fs.participant_id THEN 'answer' END AS nk FROM u3)"
    )
    group = "CASE WHEN kind IN ('question', 'answer', 'objection') THEN kind ELSE 'statement' END"
    return {
        "classified_lines": f"WITH {ln} SELECT doc_id, id AS source_row_id, kind, speaker.participant_id AS participant_id, speaker.label AS label, speaker.speaker_role AS speaker_role, coalesce(speaker.redacted, false) AS redacted, confidence, continuity AS source_continuity, opens AS starts_new_block, said AS text, evidence, "
        + ", ".join(f"CASE WHEN {group} = '{k}' THEN score ELSE 0.0e0 END AS {k}_score" for k in ("question", "answer", "objection", "statement"))
        + " FROM ln",
        "completed_turns": f"WITH {ln}{run} SELECT l2.doc_id, id AS source_row_id, coalesce(nk, kind) AS kind, CASE WHEN nk IS NOT NULL THEN 'inferred' ELSE confidence END AS confidence, evidence || CASE WHEN nk IS NOT NULL THEN ' role_behavior:70' ELSE '' END AS evidence FROM l2 JOIN u4 USING (doc_id, run)",
    }
