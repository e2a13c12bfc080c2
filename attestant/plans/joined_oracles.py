"""Queries over several operators in SQL, put together from the texts of the others."""

from __future__ import annotations

from attestant.plans.fold_oracle import fold
from attestant.plans.oracles import BLOCKS, R, TALK, has, q, trim, upper
from attestant.plans.stage_oracles import _HIDDEN, _MARK, _NUMBERED, _TITLED, _labelled

_PEOPLE = "pp AS (SELECT DISTINCT ON (doc_id, id) * FROM participants)"


def oracle_sql(parts: dict[str, str]) -> dict[str, str]:
    of = lambda name: f"({parts[name]})"
    bare = lambda x: rf"array_to_string(list_filter(string_split_regex({trim(upper(rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}\s\p{{Z}}]', ' ', 'g')"))}, '[\s\p{{Z}}]+'), lambda w: w NOT IN ('MR', 'MS', 'MRS', 'MISS', 'DR', 'HON', 'THE', 'WITNESS')), ' ')"
    functions = (
        f"WITH {_PEOPLE}, ty AS (SELECT DISTINCT ON (doc_id) doc_id, document_type FROM doc_context), su AS (SELECT * FROM {of('named_subjects')}), fr AS (SELECT * FROM {of('front_roles')}), fn AS (SELECT * FROM {of('front_names')}), "
        "tq AS (SELECT doc_id, arg_max(id, (question_observations, id)) AS qi, max(question_observations) AS qn, arg_max(id, (answer_observations, id)) AS ai, max(answer_observations) AS an FROM pp GROUP BY 1), "
        f"a AS (SELECT pp.doc_id, pp.id, canonical_name, display_label, speaker_role, role_confidence, subject, front_name, coalesce(document_type = 'interview', false) AS iv, coalesce(document_type IN ('deposition', 'examination'), false) AS dep, coalesce(counsel, false) AS counsel, coalesce(law, false) AS law, coalesce(government, false) AS gov, qi = pp.id AND qn > 0 AS asks, ai = pp.id AND an > 0 AS answers, {bare('subject')} AS s, {bare(upper('display_label'))} AS l FROM pp LEFT JOIN tq USING (doc_id) LEFT JOIN su USING (doc_id) LEFT JOIN fr ON fr.doc_id = pp.doc_id AND fr.id = pp.id LEFT JOIN fn ON fn.doc_id = pp.doc_id AND fn.id = pp.id LEFT JOIN ty ON ty.doc_id = pp.doc_id), "
        "b AS (SELECT *, coalesce(s <> '' AND l <> '' AND (contains(s, l) OR contains(l, s)), false) AS subj FROM a), c AS (SELECT *, CASE WHEN subj THEN 'witness' WHEN speaker_role = 'unknown' AND (counsel OR gov) THEN 'attorney' ELSE speaker_role END AS role, CASE WHEN subj THEN 0.98 WHEN speaker_role = 'unknown' AND (counsel OR gov) THEN 0.95 ELSE role_confidence END AS rc FROM b), "
        "d AS (SELECT *, CASE WHEN subj THEN CASE WHEN iv THEN ('interviewee', 1.0) WHEN dep THEN ('witness', 1.0) ELSE ('witness', 0.9) END WHEN role = 'interpreter' THEN ('interpreter', 1.0) WHEN role = 'court_reporter' THEN ('court_reporter', 1.0) WHEN role = 'judge' THEN ('judge', 1.0) WHEN role = 'videographer' THEN ('videographer', 1.0) WHEN law THEN ('law_enforcement', 0.95) WHEN asks AND iv THEN ('interviewer', 0.95) WHEN gov THEN ('government_counsel', 0.92) WHEN counsel THEN ('counsel', 0.92) WHEN role = 'attorney' THEN ('counsel', 0.78) WHEN role = 'witness' OR answers THEN CASE WHEN iv THEN ('interviewee', 0.88) ELSE ('witness', 0.88) END ELSE ('unknown', 0.3) END AS f FROM c) "
        "SELECT doc_id, id, CASE WHEN subj THEN subject WHEN front_name IS NOT NULL THEN front_name WHEN canonical_name IS NULL AND f[1] <> 'unknown' THEN display_label ELSE canonical_name END AS canonical_name, role AS speaker_role, round(CAST(rc AS DOUBLE), 6) AS role_confidence, f[1] AS participant_function, round(CAST(f[2] AS DOUBLE), 6) AS function_confidence FROM d"
    )
    rest = trim("regexp_replace(t, '(?s)^[^:]*:', '')")
    prints = (
        f"WITH {R}{_labelled('r', 'w', 'text')}, a AS (SELECT doc_id, count_if(colon AND {rest} <> '') AS colons, count_if(NOT colon AND titled OR titled) AS titles, bool_or(colon AND {has('c', _HIDDEN)}) AS hid FROM w GROUP BY 1), b AS (SELECT doc_id, bool_or(by_label IS NOT NULL) AS byl FROM {of('introductions')} GROUP BY 1), "
        f"l AS (SELECT doc_id, count_if(section = 'transcript' AND transcript_page IS NOT NULL) AS n FROM (SELECT DISTINCT doc_id, physical_page, transcript_page, section FROM page_frames) GROUP BY 1), d AS (SELECT * FROM {of('dominant_markers')}) "
        "SELECT l.doc_id, d.question AS dominant_question_marker, d.answer AS dominant_answer_marker, coalesce(colons, 0) >= 2 OR coalesce(titles, 0) >= 1 AS speaker_prefixed_dialogue, coalesce(colons, 0) >= 2 AS colon_speaker_prefixed_dialogue, coalesce(titles, 0) >= 1 AS titled_speaker_prefixed_dialogue, coalesce(byl, false) AS examination_heading_style_detected, coalesce(hid, false) AS redacted_speaker_labels_detected, CAST(l.n AS BIGINT) AS transcript_page_labels_detected FROM l LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN d ON d.doc_id = l.doc_id"
    )
    router = (
        f"WITH {_PEOPLE}, ro AS (SELECT doc_id, avg(CASE WHEN speaker_role <> 'unknown' THEN 1.0 ELSE 0.0 END) AS share FROM pp GROUP BY 1), m AS (SELECT doc_id, sum(CASE WHEN kind = 'question' THEN observations ELSE 0 END) AS nq, sum(CASE WHEN kind = 'answer' THEN observations ELSE 0 END) AS na FROM {of('marker_rules')} GROUP BY 1), pl AS (SELECT doc_id, avg(CASE WHEN transcript_page IS NOT NULL THEN 1.0 ELSE 0.0 END) FILTER (section = 'transcript') AS pc FROM (SELECT DISTINCT doc_id, physical_page, transcript_page, section FROM page_frames) GROUP BY 1), "
        f"fp AS (SELECT * FROM ({prints})), la AS (SELECT * FROM {of('language_hints')}), ly AS (SELECT doc_id, count_if(section = 'unknown') AS unk FROM (SELECT DISTINCT doc_id, physical_page, section FROM page_frames) GROUP BY 1), ty AS (SELECT DISTINCT ON (doc_id) doc_id, document_type FROM doc_context), "
        "c AS (SELECT m.doc_id, coalesce(share, CASE WHEN nq + na >= 20 THEN 0.6 ELSE 0.3 END) AS person, CASE WHEN nq + na >= 40 AND nq > 0 AND na > 0 THEN 1.0 WHEN nq + na >= 8 THEN 0.82 WHEN nq + na > 0 THEN 0.6 WHEN fp.speaker_prefixed_dialogue THEN 0.82 ELSE 0.35 END AS mark, coalesce(pc, 0.0) AS page FROM m LEFT JOIN ro USING (doc_id) LEFT JOIN fp USING (doc_id) LEFT JOIN pl ON pl.doc_id = m.doc_id), e AS (SELECT *, 0.3 * person + 0.3 * page + 0.4 * mark AS form FROM c) "
        "SELECT e.doc_id, round(CAST(person AS DOUBLE), 6) AS participant_confidence, round(CAST(mark AS DOUBLE), 6) AS marker_confidence, round(CAST(page AS DOUBLE), 6) AS page_confidence, round(CAST(form AS DOUBLE), 6) AS format_confidence, form < 0.78 OR coalesce(la.code, 'und') = 'und' OR coalesce(document_type, 'unknown') = 'unknown' OR coalesce(unk, 0) > 3 AS router_recommended FROM e LEFT JOIN la USING (doc_id) LEFT JOIN ly USING (doc_id) LEFT JOIN ty ON ty.doc_id = e.doc_id"
    )
    issues = (
        f"WITH {R}, g AS (SELECT doc_id, physical_page, {trim('string_agg(coalesce(raw_text, ' + q('') + '), chr(10) ORDER BY row_index)')} = '' AS void, bool_or(source = 'ocr') AS o, coalesce(min(ocr_confidence) < 0.7, false) AS n, bool_or(source = 'fallback_text') AS f, coalesce(max(panel) > 1, false) AS u, count(*) = 1 AS one, max(row_index) >= count(*) AS lack FROM r GROUP BY ALL) "
        "SELECT doc_id, code, CAST(physical_page AS BIGINT) AS physical_page FROM (SELECT *, unnest(list_filter([CASE WHEN void THEN 'empty_page' END, CASE WHEN n THEN 'ocr_required' END, CASE WHEN o THEN 'ocr_review_required' END, CASE WHEN f THEN 'fallback_extraction' END, CASE WHEN u THEN 'reading_order_review' END, CASE WHEN one THEN 'extraction_warning' END, CASE WHEN lack THEN 'extraction_warning' END], lambda c: c IS NOT NULL)) AS code FROM g)"
    )
    left = lambda x: rf"regexp_replace({x}, '^[\s\p{{Z}}]+', '')"
    body = f"CASE WHEN r.line_number IS NOT NULL AND {has('r.raw_text', _NUMBERED)} THEN regexp_replace(r.raw_text, '^[0-9]+:*[\\s\\p{{Z}}]*', '') ELSE r.raw_text END"
    checked = (
        f"WITH {fold()}, z0 AS (SELECT ln.doc_id, ln.id, ln.kind, ln.speaker, ln.confidence, ln.evidence, ln.said, r.raw_text, {body} AS body FROM ln JOIN r USING (doc_id, id)){_labelled('z0', 'z1', 'body')}, z2 AS (SELECT *, CASE WHEN colon THEN {rest} WHEN titled THEN {trim(f'regexp_extract(t, {q(_TITLED)}, 2)')} ELSE body END AS rest FROM z1), "
        f"z3 AS (SELECT *, {left('rest')} AS m FROM z2), z4 AS (SELECT *, CASE WHEN {has('m', _MARK)} THEN CASE WHEN regexp_matches(m, '^Q') OR regexp_matches(m, '(?i)^QUESTION[:.]') THEN 'question' ELSE 'answer' END END AS shown, regexp_matches(m, '^[QA]($|[\\s\\p{{Z}}])') AS bare FROM z3), "
        "rg AS (SELECT DISTINCT ON (doc_id, id) doc_id, id AS pid, CASE WHEN participant_key % 3 = 0 THEN 'judge' ELSE speaker_role END AS rr FROM participants), "
        "z5 AS (SELECT z4.*, coalesce(shown IS NOT NULL AND (NOT bare OR contains(evidence, 'explicit_marker')) AND shown <> kind, false) AS mc, coalesce(rr <> 'unknown' AND speaker.speaker_role <> 'unknown' AND rr <> speaker.speaker_role, false) AS rc FROM z4 LEFT JOIN rg ON rg.doc_id = z4.doc_id AND rg.pid = z4.speaker.participant_id)"
    )
    pure = r"(?i)^(?:\[REDACTED\]|\[NAME REDACTED\]|\[REDACTED NAME\]|\[NAME WITHHELD\]|\[SEALED\]|REDACTED|SEALED|NAME WITHHELD)$|^[█■▇Xx*_]{3,}$"
    marked = r"(?i)\[REDACTED\]|\[NAME REDACTED\]|\[REDACTED NAME\]|NAME REDACTED|NAME WITHHELD|DOJ REDACTION|\[SEALED\]|[█■▇].*[█■▇].*[█■▇]"
    red = f"(coalesce({has(trim(f'regexp_replace({trim(chr(115) + chr(97) + chr(105) + chr(100))}, ' + q('^:+|:+$') + ', ' + q('') + ', ' + q('g') + ')'), pure)}, false) OR coalesce({has('raw_text', marked)}, false))"
    titled = f"(SELECT DISTINCT participant_key, list_extract(['Mr. ', 'DR ', 'The Witness ', 'JUDGE ', 'Captain '], participant_key % 5 + 1) || canonical_name || '. ' || coalesce(display_label, '') AS line FROM participants WHERE canonical_name IS NOT NULL)"
    return {
        "titled_lines": f"WITH z AS (SELECT 1 AS one){_labelled(titled, 'w', 'line')} SELECT participant_key, d AS label, {trim(f'regexp_extract(t, {q(_TITLED)}, 2)')} AS rest FROM w WHERE titled",
        "unlisted_speakers": f"WITH {TALK} SELECT DISTINCT doc_id, participant_id AS id FROM t WHERE participant_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM participants p WHERE p.doc_id = t.doc_id AND p.id = t.participant_id AND p.participant_key % 4 <> 0)",
        "disputed_rows": f"WITH {BLOCKS}, w AS (SELECT doc_id, source_row_id AS id, sum(CASE WHEN block_no % 9 <> 0 THEN 1 ELSE 0 END + CASE WHEN block_no % 11 = 0 THEN 1 ELSE 0 END) AS o FROM n GROUP BY ALL) SELECT r.doc_id, r.id, CAST(coalesce(o, 0) AS BIGINT) AS owners FROM r LEFT JOIN w USING (doc_id, id) WHERE disposition = 'dialogue' AND coalesce(o, 0) <> 1",
        "participant_functions": functions,
        "format_prints": prints,
        "router_flags": router,
        "page_issues": issues,
        "line_verification": f"{checked} SELECT doc_id, id AS source_row_id, CASE WHEN coalesce(speaker.redacted, false) THEN 'uncertain' WHEN mc OR rc THEN 'conflict' WHEN kind = 'unknown' THEN 'uncertain' WHEN {red} THEN CASE WHEN kind = 'redaction_marker' THEN 'redacted' ELSE 'verified_with_inference' END WHEN confidence = 'explicit' THEN 'verified' WHEN confidence = 'inferred' THEN 'verified_with_inference' ELSE 'uncertain' END AS verification FROM z5",
        "passed_on_issues": f"{checked}, y AS (SELECT doc_id, 'explicit_marker_conflict' AS code FROM z5 WHERE mc UNION ALL SELECT doc_id, 'participant_role_conflict' FROM z5 WHERE rc UNION ALL SELECT doc_id, 'source_gap_candidate' FROM {of('gaps')} UNION ALL SELECT doc_id, 'language_review' FROM {of('language_hints')} WHERE code <> 'en' UNION ALL SELECT DISTINCT doc_id, 'no_dialogue' FROM r WHERE doc_id NOT IN (SELECT doc_id FROM r WHERE section = 'transcript' AND disposition = 'dialogue')) SELECT doc_id, code, count(*) AS issues FROM y GROUP BY ALL",
    }


