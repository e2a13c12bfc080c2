"""The queries in SQL, written for themselves: the same tables, none of the operators' code but the fixed patterns."""

from __future__ import annotations

from attestant.functions import marks as M
from attestant.plans.queries import TOP_MARGIN

_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def upper(x: str) -> str:
    return f"translate({x}, '{_LOW}', '{_UP}')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def words(x: str) -> str:
    return rf"len(string_split_regex({trim(x)}, '[\s\p{{Z}}]+'))"


R = "r AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY ingested_at DESC) n FROM canonical_rows) WHERE n = 1)"
CONT = """c AS (SELECT *, lag(physical_page) OVER w AS p_page, lag(try_cast(transcript_page AS INT)) OVER w AS p_label, lag(line_number) OVER w AS p_line, try_cast(transcript_page AS INT) AS label FROM {src} WINDOW w AS (PARTITION BY doc_id ORDER BY physical_page, row_index)),
k AS (SELECT *, CASE WHEN physical_page > p_page + 1 THEN 'gap_before' WHEN p_page IS NOT NULL AND line_number IS NULL AND p_line IS NULL THEN CASE WHEN p_page = physical_page THEN 'continuous' ELSE 'cross_page_continuous' END
 WHEN p_page IS NULL OR p_line IS NULL OR line_number IS NULL THEN 'first_observed' WHEN p_page = physical_page THEN CASE WHEN line_number = p_line + 1 THEN 'continuous' ELSE 'gap_before' END
 WHEN p_label IS NULL OR label IS NULL THEN 'unknown' WHEN label = p_label + 1 AND line_number = 1 THEN 'cross_page_continuous' ELSE 'gap_before' END AS source_continuity FROM c)"""
TALK = (
    R
    + ", s AS (SELECT * FROM r WHERE line_number IS NOT NULL OR event_kind <> 'page_header'), "
    + CONT.format(src="s")
    + """, l AS (SELECT DISTINCT doc_id, source_row_id, kind, speaker, confidence FROM transcript_lines),
t AS (SELECT k.doc_id, k.id AS source_row_id, k.physical_page, k.row_index, k.transcript_page, k.line_number, l.kind, l.speaker, l.speaker.participant_id AS participant_id, l.confidence, k.source_continuity, k.event_kind <> 'text' AS opens, k.event_kind = 'speaker_anchor' AS labelled, k.text,
 CASE l.confidence WHEN 'unknown' THEN 'uncertain' WHEN 'inferred' THEN 'verified_with_inference' ELSE 'verified' END AS verification FROM k JOIN l ON k.doc_id = l.doc_id AND k.id = l.source_row_id)"""
)
BLOCKS = (
    TALK
    + """, m AS (SELECT *, lag(kind) OVER w AS pk, lag(speaker) OVER w AS ps, row_number() OVER w AS rn FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY physical_page, row_index)),
n AS (SELECT *, sum(CASE WHEN rn > 1 AND NOT opens AND source_continuity <> 'gap_before' AND pk = kind AND ps IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY physical_page, row_index) AS block_no FROM m),
b AS (SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, printf('block_%06d', CAST(block_no AS BIGINT)) AS block_id, arg_min(kind, rn) AS kind, first(participant_id ORDER BY rn) AS participant_id, first(speaker ORDER BY rn) AS speaker, first(source_continuity ORDER BY rn) AS source_continuity,
 CASE max(CASE confidence WHEN 'unknown' THEN 3 WHEN 'inferred' THEN 2 ELSE 1 END) WHEN 3 THEN 'unknown' WHEN 2 THEN 'inferred' ELSE 'explicit' END AS confidence, CASE max(CASE verification WHEN 'uncertain' THEN 3 WHEN 'verified_with_inference' THEN 2 ELSE 1 END) WHEN 3 THEN 'uncertain' WHEN 2 THEN 'verified_with_inference' ELSE 'verified' END AS verification,
 count(*) AS rows, coalesce(string_agg(text, ' ' ORDER BY rn) FILTER (text <> ''), '') AS text FROM n GROUP BY doc_id, block_no)"""
)
EXCH = (
    BLOCKS
    + """, e AS (SELECT *, kind = 'question' AS asks, source_continuity = 'gap_before' OR kind IN ('examination_heading', 'heading', 'redaction_marker') OR (kind = 'parenthetical' AND regexp_matches(lower(text), 'off the record|concluded|adjourned|recess')) AS closes FROM b),
e2 AS (SELECT *, CAST(sum(CASE WHEN asks THEN 1 ELSE 0 END) OVER w AS BIGINT) AS q_no, last_value(CASE WHEN asks THEN true WHEN closes THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
x AS (SELECT *, CASE WHEN asks OR (NOT closes AND coalesce(open, false)) THEN q_no END AS exchange_no FROM e2),
g AS (SELECT doc_id, exchange_no, first(block_id ORDER BY block_no) AS question_block, coalesce(string_agg(block_id, ' ' ORDER BY block_no) FILTER (NOT asks), '') AS responses, coalesce(bool_or(kind = 'answer'), false) AS answered FROM x WHERE exchange_no IS NOT NULL GROUP BY doc_id, exchange_no)"""
)
# The graph's state is followed block by block in SQL by the last block that set or forgot it.
EDGES = (
    BLOCKS
    + """, z AS (SELECT *, source_continuity = 'gap_before' AS gap, kind IN ('examination_heading', 'heading', 'redaction_marker', 'parenthetical') AS stops, lag(block_no) OVER (PARTITION BY doc_id ORDER BY block_no) AS prior FROM b),
z2 AS (SELECT *, max(CASE WHEN kind = 'question' THEN block_no END) OVER p AS last_q, max(CASE WHEN kind <> 'question' AND (gap OR stops) THEN block_no END) OVER p AS last_stop FROM z WINDOW p AS (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z3 AS (SELECT *, CASE WHEN NOT gap AND last_q > coalesce(last_stop, 0) THEN last_q END AS open_q FROM z2),
z4 AS (SELECT *, max(CASE WHEN kind = 'objection' AND open_q IS NOT NULL THEN block_no END) OVER p AS last_obj, max(CASE WHEN NOT (kind = 'objection' AND open_q IS NOT NULL) AND (kind = 'question' OR gap OR stops) THEN block_no END) OVER p AS last_clear FROM z3 WINDOW p AS (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT doc_id, prior AS f, block_no AS t, 'follows' AS edge_kind FROM z4 WHERE prior IS NOT NULL UNION ALL SELECT doc_id, block_no, open_q, 'responds_to' FROM z4 WHERE kind = 'answer' AND open_q IS NOT NULL UNION ALL SELECT doc_id, block_no, open_q, 'interrupts' FROM z4 WHERE kind = 'objection' AND open_q IS NOT NULL
 UNION ALL SELECT doc_id, block_no, last_obj, 'resumes_after' FROM z4 WHERE kind = 'question' AND NOT gap AND last_obj > coalesce(last_clear, 0) UNION ALL SELECT doc_id, block_no, prior, 'interprets' FROM z4 WHERE kind = 'interpreter_statement' AND prior IS NOT NULL)"""
)
SIGNALS = TALK + ", g AS (SELECT doc_id, physical_page, count_if(opens AND labelled) AS speakers, count_if(opens AND confidence = 'explicit' AND kind = 'question') AS questions, count_if(opens AND confidence = 'explicit' AND kind = 'answer') AS answers, count_if(opens AND kind = 'examination_heading') AS headings FROM t GROUP BY ALL)"
REGIONS = (
    SIGNALS
    + """, h AS (SELECT *, CASE WHEN speakers > 0 AND questions + answers > 0 THEN 'hybrid' WHEN speakers > 0 THEN 'speaker_prefixed' WHEN questions + answers > 0 THEN 'qa_markers' ELSE 'unknown' END AS grammar FROM g),
h2 AS (SELECT *, CASE WHEN lag(grammar) OVER w = grammar AND lag(physical_page) OVER w + 1 = physical_page THEN 0 ELSE 1 END AS new FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY physical_page)),
h3 AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY physical_page) AS BIGINT) AS region_no FROM h2)"""
)
SPANS = (
    BLOCKS
    + """, o AS (SELECT n.doc_id, n.block_no, n.source_row_id AS id, r.physical_page, r.row_index, r.transcript_page, r.line_number FROM n JOIN r ON n.doc_id = r.doc_id AND n.source_row_id = r.id),
o2 AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 1 WHEN lag(physical_page) OVER w = physical_page AND lag(transcript_page) OVER w IS NOT DISTINCT FROM transcript_page THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY doc_id, block_no ORDER BY physical_page, row_index)),
o3 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, block_no ORDER BY physical_page, row_index) AS span_no FROM o2)"""
)
SURE = "u0 AS (SELECT n.doc_id, n.block_no, least(1.0e0, min(coalesce(p.c, 0.0e0))) AS source_confidence FROM (SELECT DISTINCT doc_id, block_no, physical_page FROM n) n LEFT JOIN (SELECT doc_id, physical_page, coalesce(min(ocr_confidence), 1.0e0) AS c FROM r GROUP BY ALL) p USING (doc_id, physical_page) GROUP BY ALL)"
PROCEDURAL = "('parenthetical', 'examination_heading', 'heading', 'exhibit_marker', 'redaction_marker')"
ROLE = f"CASE WHEN kind = 'question' THEN 'question' WHEN kind = 'answer' THEN 'response' WHEN kind = 'objection' THEN 'objection' WHEN kind = 'interpreter_statement' THEN 'interpretation' WHEN kind = 'unknown' THEN 'unknown' WHEN kind IN {PROCEDURAL} THEN 'procedural' ELSE 'statement' END"


def marker_sql(x: str) -> str:
    left = rf"regexp_replace({x}, '^[\s\p{{Z}}]+', '')"
    return "CASE " + " ".join(f"WHEN {has(left, e)} THEN {i}" for i, (_, _, _, _, e) in enumerate(M.MARKERS)) + " END"


def case_marker(i: str, field: int) -> str:
    return f"CASE {i} " + " ".join(f"WHEN {k} THEN {q(m[field]) if field < 3 else m[field]}" for k, m in enumerate(M.MARKERS)) + " END"


def role_sql(x: str) -> str:
    u = upper(trim(x))
    return (
        f"CASE WHEN {has(trim(x), M.REDACTED)} THEN 'unknown' WHEN {u} IN ('THE WITNESS', 'WITNESS', 'THE DEPONENT', 'DEPONENT') THEN 'witness' WHEN contains({u}, 'INTERPRETER') THEN 'interpreter' WHEN {u} IN ('THE REPORTER', 'REPORTER') OR contains({u}, 'COURT REPORTER') OR contains({u}, 'STENOGRAPHER') THEN 'court_reporter' "
        f"WHEN contains({u}, 'VIDEOGRAPHER') OR {u} = 'VIDEO OPERATOR' THEN 'videographer' WHEN {has(u, M.JUDGE)} THEN 'judge' WHEN {has(u, M.HONORIFIC)} THEN 'unknown' WHEN {has(u, M.ATTORNEY)} THEN 'attorney' END"
    )


COLON = (
    R
    + rf""", c0 AS (SELECT doc_id, id, {trim('text')} AS t FROM r WHERE contains(text, ':')), c1 AS (SELECT *, {trim("regexp_extract(t, '(?s)^([^:]*):', 1)")} AS label FROM c0),
cl AS (SELECT doc_id, id, label, {trim("regexp_replace(t, '(?s)^[^:]*:', '')")} AS rest FROM c1 WHERE label <> '' AND NOT {has(upper('label'), M.STRUCTURAL)} AND strlen(label) <= 80
 AND ({role_sql('label')} IS NOT NULL OR ({has('label', M.NAME_CHARS)} AND {has('label', chr(92) + 'p{L}')} AND NOT {has('label', chr(92) + 'p{Ll}|[ªº]')} AND {words('label')} BETWEEN 1 AND 6)))"""
)
TITLED = (
    R
    + rf""", t0 AS (SELECT doc_id, id, {trim('text')} AS t FROM r), t1 AS (SELECT *, {trim(f"regexp_extract(t, {q('(?s)' + M.TITLED)}, 1)")} AS label FROM t0 WHERE {has('t', '(?s)' + M.TITLED)}),
tl AS (SELECT doc_id, id, label, {trim(f"regexp_extract(t, {q('(?s)' + M.TITLED)}, 2)")} AS rest FROM t1 WHERE strlen(label) <= 80 AND {has('label', M.NAME_CHARS)} AND {has('label', M.TITLED_LABEL)} AND {words('label')} BETWEEN 2 AND 6)"""
)
SCORE = "CASE WHEN len(ns) >= 2 THEN list_sum(list_transform(range(1, len(ns)), lambda i: CASE WHEN ns[i + 1] > ns[i] AND ns[i + 1] - ns[i] <= {most} THEN 1 ELSE 0 END)) / (len(ns) - 1) ELSE 0.0e0 END"
PAGES = R + ", p AS (SELECT doc_id, physical_page, string_agg(coalesce(raw_text, ''), chr(10) ORDER BY row_index) AS text FROM r GROUP BY ALL)"
MARKED = PAGES + f", ml AS (SELECT doc_id, physical_page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p), mk AS (SELECT doc_id, physical_page, arg_min(line, i) AS line, min(i) AS i FROM ml WHERE {has('line', M.REDACTION)} GROUP BY doc_id, physical_page, {upper(trim('line'))})"
LEAD = r"regexp_extract(regexp_replace({x}, '^[\s\p{{Z}}]+', ''), '^([0-9]{{1,5}})($|[\s\p{{Z}}])', 1)"
STRIPPED = r"CASE WHEN try_cast(regexp_extract(x, '^([0-9]{1,5})', 1) AS INT) BETWEEN 1 AND 50 THEN regexp_replace(regexp_replace(x, '^[0-9]+', ''), '^[\s\p{Z}]+', '') ELSE x END"
ISSUES = (
    TALK
    + f""", i0 AS (SELECT doc_id, 'unclassified_source_row' AS code FROM r WHERE disposition = 'unclassified' UNION ALL SELECT doc_id, 'low_ocr_confidence' FROM r WHERE ocr_confidence < 0.85
 UNION ALL SELECT doc_id, 'unresolved_attribution' FROM t WHERE kind NOT IN {PROCEDURAL[:-1]}, 'page_header') AND (participant_id IS NULL OR kind = 'unknown')
 UNION ALL SELECT doc_id, 'participant_reference' FROM t WHERE participant_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM participants p WHERE p.doc_id = t.doc_id AND p.id = t.participant_id)
 UNION ALL SELECT doc_id, 'redacted_identity' FROM t WHERE speaker.redacted UNION ALL SELECT e.doc_id, 'source_inventory_mismatch' FROM (SELECT doc_id, sum(len(row_ids)) AS expected FROM page_frames GROUP BY 1) e LEFT JOIN (SELECT doc_id, count(*) AS n FROM r GROUP BY 1) h USING (doc_id) WHERE coalesce(n, 0) <> expected)"""
)
VOTES = (
    TALK
    + rf""", v AS (SELECT doc_id, physical_page, row_index, {trim('speaker.label')} AS label, {upper(r"regexp_replace(" + trim('speaker.label') + r", '[\s\p{Z}]+', ' ', 'g')")} AS canonical, speaker.speaker_role AS role, CASE WHEN kind IN ('question', 'answer', 'objection') THEN kind ELSE 'statement' END AS ob FROM t WHERE speaker.label IS NOT NULL),
v2 AS (SELECT doc_id, canonical, min(physical_page * 1000000 + row_index) AS seen, list_sort(list_distinct(list(label))) AS labels, count(*) AS observations, count_if(ob = 'question') AS qo, count_if(ob = 'answer') AS ao, count_if(ob = 'objection') AS oo, count_if(ob = 'statement') AS so,
 [count_if(role = 'attorney'), count_if(role = 'witness'), count_if(role = 'interpreter'), count_if(role = 'court_reporter'), count_if(role = 'judge'), count_if(role = 'videographer')] AS votes FROM v GROUP BY doc_id, canonical),
v3 AS (SELECT *, list_max(votes) AS top, 7 - list_position(list_reverse(votes), list_max(votes)) AS pos, list_sum(votes) AS total FROM v2),
v4 AS (SELECT *, CASE WHEN top = 0 THEN 'unknown' ELSE list_extract(['attorney', 'witness', 'interpreter', 'court_reporter', 'judge', 'videographer'], pos) END AS role, CASE WHEN top = 0 THEN 'speaker' ELSE list_extract(['attorney', 'witness', 'interpreter', 'reporter', 'judge', 'videographer'], pos) END AS prefix FROM v3)"""
)


def oracle_sql() -> dict[str, str]:
    from attestant.plans import fold_oracle, source_oracles, stage_oracles

    return _whole(_single() | fold_oracle.oracle_sql() | stage_oracles.oracle_sql() | source_oracles.oracle_sql())


def _whole(parts: dict[str, str]) -> dict[str, str]:
    from attestant.plans import joined_oracles

    return parts | joined_oracles.oracle_sql(parts)


def _single() -> dict[str, str]:
    flags = [("redacted", has(trim("text"), M.REDACTED)), ("has_redaction", has("text", M.REDACTION)), ("pure_redaction", has(trim(f"regexp_replace({trim('text')}, '^:+|:+$', '', 'g')"), M.PURE_REDACTION)), ("objection", has(trim("text"), M.OBJECTION))]
    flags += [("opens", f"starts_with({trim('text')}, '(') OR (starts_with({trim('text')}, '[') AND NOT {flags[2][1]}) OR starts_with({trim('text')}, '---')"), ("closes", f"starts_with({trim('text')}, '---') OR ends_with({trim('text')}, ')') OR ends_with({trim('text')}, ']')")]
    flags += [("exhibit", f"{has('text', M.EXHIBIT)} AND {has('text', M.EXHIBIT_ACT)}"), ("examination", f"{upper(trim('text'))} IN {M.EXAMINATION}"), ("heading", f"{upper(trim('text'))} IN {M.HEADINGS}")]
    intro = f"CASE WHEN {has('t', '(?i)^(?:WITNESS|DEPONENT): ')} THEN {trim(chr(114) + 'egexp_replace(t, ' + q('(?s)^[^:]*:') + ', ' + q('') + ')')} WHEN contains(t, ',') AND {has(trim('regexp_replace(t, ' + q('(?s)^[^,]*,') + ', ' + q('') + ')'), M.INTRODUCED)} THEN {trim('regexp_extract(t, ' + q('(?s)^([^,]*),') + ', 1)')} END"
    by = f"CASE WHEN {has('t', '(?i)^BY .*:$')} THEN {trim('regexp_replace(regexp_replace(t, ' + q('(?i)^BY ') + ', ' + q('') + '), ' + q(':+$') + ', ' + q('') + ')')} END"
    letters = r"regexp_replace(b, '[^\p{L}]', '', 'g')"
    generic = rf"({words('b')} BETWEEN 1 AND 7 AND length({letters}) >= 2 AND length(regexp_replace({letters}, '[^\p{{Lu}}]', '', 'g')) / greatest(1, length({letters})) >= 0.8 AND b NOT IN ('Q', 'A', 'QUESTION', 'ANSWER'))"
    bare = rf"({words('b')} BETWEEN 1 AND 5 AND regexp_matches(b, '[A-Za-z]') AND regexp_matches(b, '^[A-Z0-9\s\p{{Z}}.''\-]+$'))"
    bare_name = lambda x: rf"array_to_string(list_filter(string_split_regex({trim(upper(rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}\s\p{{Z}}]', ' ', 'g')"))}, '[\s\p{{Z}}]+'), lambda w: w NOT IN ('MR', 'MS', 'MRS', 'MISS', 'DR', 'HON', 'THE', 'WITNESS')), ' ')"
    entries = ", ".join(f"({q(k)}, {q(s)}, {q(p)}, {n})" for k, s, p, n, _ in M.MARKERS)
    rules = COLON + TITLED[len(R) :] + f", mr AS (SELECT doc_id, {marker_sql('text')} AS i FROM r WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.doc_id = r.doc_id AND cl.id = r.id) AND NOT EXISTS (SELECT 1 FROM tl WHERE tl.doc_id = r.doc_id AND tl.id = r.id)), mc AS (SELECT doc_id, i, count(*) AS n FROM mr WHERE i IS NOT NULL GROUP BY ALL), dict AS (SELECT row_number() OVER () - 1 AS i, * FROM (VALUES {entries}) d(kind, style, pattern, priority)), mm AS (SELECT x.doc_id, d.*, coalesce(mc.n, 0) AS observations FROM (SELECT DISTINCT doc_id FROM r) x, dict d LEFT JOIN mc ON mc.doc_id = x.doc_id AND mc.i = d.i)"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hits = " + ".join(f"CASE WHEN contains({low.replace('text', 's')}, ' {w} ') THEN 1 ELSE 0 END" for w in ("the", "and", "you", "of", "to", "that"))
    count = lambda p: f"len(regexp_extract_all(s, {q(p)}))"
    return {
        "numbered_lines": f"WITH {R}, x AS (SELECT doc_id, id, {trim('raw_text')} AS t FROM r), y AS (SELECT *, CASE WHEN {has('t', M.NUMBERED)} THEN try_cast(regexp_extract(t, {q(M.NUMBERED)}, 1) AS BIGINT) END AS n FROM x) SELECT doc_id, id, CASE WHEN n BETWEEN 1 AND 100 THEN n END AS number, CASE WHEN n BETWEEN 1 AND 100 THEN regexp_replace(t, {q(M.NUMBERED_BODY)}, '') ELSE t END AS body FROM y",
        "page_numbers": f"WITH {R}, x AS (SELECT doc_id, id, try_cast(nullif(regexp_extract({upper(trim('text'))}, {q(M.PAGE_MARK)}, 1), '') AS BIGINT) AS page_mark, CASE WHEN regexp_matches({trim('text')}, '^[0-9]{{1,7}}$') THEN CAST({trim('text')} AS BIGINT) END AS pure_number FROM r) SELECT * FROM x WHERE page_mark IS NOT NULL OR pure_number IS NOT NULL",
        "marker_candidates": rf"WITH {R}, x AS (SELECT doc_id, id, {marker_sql('text')} AS i, regexp_replace(regexp_replace(text, '^[\s\p{{Z}}]+', ''), {q(M.MARKER_STRIP)}, '') AS rest FROM r) SELECT doc_id, id, {case_marker('i', 0)} AS kind, {case_marker('i', 1)} AS style, {case_marker('i', 2)} AS pattern, CAST({case_marker('i', 3)} AS BIGINT) AS priority, rest FROM x WHERE i IS NOT NULL",
        "line_flags": f"WITH {R} SELECT doc_id, id, " + ", ".join(f"coalesce({e}, false) AS {n}" for n, e in flags) + " FROM r",
        "label_roles": rf"SELECT DISTINCT doc_id, id, {role_sql('display_label')} AS label_role, 'label_' || lower(hex(encode({upper(trim('display_label'))}))) AS label_id, {upper(r"regexp_replace(" + trim('display_label') + r", '[\s\p{Z}]+', ' ', 'g')")} AS canonical_label, CASE WHEN length(display_label) > 12 THEN substr(display_label, 1, 12) || '...' ELSE display_label END AS short_label FROM participants",
        "colon_labels": f"WITH {COLON} SELECT doc_id, id, label, rest FROM cl",
        "titled_labels": f"WITH {TITLED} SELECT doc_id, id, label, rest FROM tl",
        "introductions": f"WITH {R}, x AS (SELECT doc_id, id, {trim('text')} AS t FROM r), y AS (SELECT doc_id, id, {intro} AS i, {by} AS b FROM x), z AS (SELECT doc_id, id, CASE WHEN {has('i', M.NAME_CHARS)} AND {words('i')} BETWEEN 2 AND 6 THEN i END AS introduced, CASE WHEN b <> '' AND ({generic} OR {bare} OR {role_sql('b')} IS NOT NULL) THEN b END AS by_label FROM y) SELECT * FROM z WHERE introduced IS NOT NULL OR by_label IS NOT NULL",
        "label_matches": f"WITH x AS (SELECT DISTINCT doc_id, id, canonical_name, display_label FROM participants WHERE canonical_name IS NOT NULL AND display_label IS NOT NULL), y AS (SELECT doc_id, id, {bare_name('canonical_name')} AS a, {bare_name('display_label')} AS b FROM x) SELECT doc_id, id, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) AS matches FROM y",
        "marker_rules": f"WITH {rules} SELECT doc_id, kind, style, pattern, CAST(priority AS BIGINT) AS priority, observations FROM mm",
        "dominant_markers": f"WITH {rules}, a AS (SELECT doc_id, kind, arg_max(pattern, observations * 1000 - priority * 100 + i) AS p FROM mm WHERE observations > 0 GROUP BY ALL) SELECT d.doc_id, CASE WHEN x.p IS NOT NULL AND y.p IS NOT NULL THEN x.p END AS question, CASE WHEN x.p IS NOT NULL AND y.p IS NOT NULL THEN y.p END AS answer FROM (SELECT DISTINCT doc_id FROM r) d LEFT JOIN a x ON x.doc_id = d.doc_id AND x.kind = 'question' LEFT JOIN a y ON y.doc_id = d.doc_id AND y.kind = 'answer'",
        "typical_line_range": f"WITH {R}, p AS (SELECT doc_id, physical_page, min(line_number) AS lo, max(line_number) AS hi FROM r WHERE line_number IS NOT NULL GROUP BY ALL), a AS (SELECT doc_id, lo, count(*) AS n FROM p GROUP BY ALL), b AS (SELECT doc_id, hi, count(*) AS n FROM p GROUP BY ALL) SELECT doc_id, CAST((SELECT lo FROM a WHERE a.doc_id = d.doc_id ORDER BY n DESC, lo LIMIT 1) AS BIGINT) AS typical_line_min, CAST((SELECT hi FROM b WHERE b.doc_id = d.doc_id ORDER BY n DESC, hi DESC LIMIT 1) AS BIGINT) AS typical_line_max FROM (SELECT DISTINCT doc_id FROM p) d",
        "gaps": f"WITH {R}, f AS (SELECT doc_id, physical_page, try_cast(transcript_page AS INT) AS n FROM page_frames WHERE section = 'transcript'), f2 AS (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY physical_page) AS p FROM f WHERE n IS NOT NULL), g AS (SELECT DISTINCT doc_id, physical_page, line_number AS n FROM r WHERE line_number IS NOT NULL), g2 AS (SELECT *, lag(n) OVER (PARTITION BY doc_id, physical_page ORDER BY n) AS p FROM g) SELECT doc_id, 'missing_transcript_pages' AS gap_kind, CAST(physical_page AS BIGINT) AS physical_page, CAST(p + 1 AS BIGINT) AS first_missing, CAST(n - 1 AS BIGINT) AS last_missing FROM f2 WHERE n > p + 1 UNION ALL SELECT doc_id, 'missing_lines', physical_page, p + 1, n - 1 FROM g2 WHERE n > p + 1",
        "source_completeness": f"WITH {R}, p AS (SELECT doc_id, physical_page, min(line_number) AS lo, max(line_number) AS hi FROM r WHERE line_number IS NOT NULL GROUP BY ALL), a AS (SELECT doc_id, lo, count(*) AS n FROM p GROUP BY ALL), b AS (SELECT doc_id, hi, count(*) AS n FROM p GROUP BY ALL), d AS (SELECT doc_id, max(try_cast(transcript_page AS BIGINT)) FILTER (section = 'transcript') - min(try_cast(transcript_page AS BIGINT)) FILTER (section = 'transcript') + 1 AS span FROM page_frames GROUP BY 1), s AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, physical_page, line_number FROM r WHERE line_number IS NOT NULL) GROUP BY 1), m AS (SELECT d.doc_id, span, coalesce(s.n, 0) AS n, (SELECT hi FROM b WHERE b.doc_id = d.doc_id ORDER BY b.n DESC, hi DESC LIMIT 1) - (SELECT lo FROM a WHERE a.doc_id = d.doc_id ORDER BY a.n DESC, lo LIMIT 1) + 1 AS k FROM d LEFT JOIN s USING (doc_id)) SELECT doc_id, round(coalesce(CASE WHEN k >= 1 AND span IS NOT NULL THEN least(1.0e0, n / (span * k)) END, 0.5), 6) AS source_completeness FROM m",
        "layout_summary": "SELECT doc_id, count(*) AS pages, " + ", ".join(f"count_if(section = '{n}') AS {n}_pages" for n in ("cover", "caption", "appearances", "transcript", "word_index", "exhibit_index", "certificate", "errata", "appendix", "attachment", "unknown")) + ", count_if(section IN ('word_index', 'exhibit_index', 'certificate', 'errata', 'appendix', 'attachment')) AS reference_only_pages FROM page_frames GROUP BY doc_id",
        "participant_votes": f"WITH {VOTES} SELECT doc_id, prefix || '_' || row_number() OVER (PARTITION BY doc_id, role ORDER BY seen) AS id, labels[1] AS display_label, CASE WHEN role <> 'unknown' AND NOT {has(trim('labels[1]'), M.REDACTED)} AND {upper(trim('labels[1]'))} NOT IN ('THE WITNESS', 'WITNESS', 'THE DEPONENT', 'DEPONENT', 'THE REPORTER', 'REPORTER', 'THE INTERPRETER', 'INTERPRETER', 'THE COURT') THEN labels[1] END AS canonical_name, array_to_string(labels, '|') AS observed_labels, role AS speaker_role, round(CASE WHEN top = 0 THEN 0.3e0 ELSE top / total END, 6) AS role_confidence, observations, qo AS question_observations, ao AS answer_observations, oo AS objection_observations, so AS statement_observations FROM v4",
        "primaries": "WITH p AS (SELECT DISTINCT ON (doc_id, id) * FROM participants), a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY question_observations DESC, observations DESC, id DESC) AS k, count(*) OVER (PARTITION BY doc_id) AS c FROM p WHERE speaker_role = 'attorney'), w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY answer_observations DESC, observations DESC, id DESC) AS k FROM p WHERE speaker_role = 'witness' OR participant_function IN ('witness', 'interviewee')) SELECT d.doc_id, CASE WHEN a.question_observations > 0 OR a.c <= 1 THEN a.id END AS questioner, w.id AS witness, (SELECT count(*) FROM p WHERE p.doc_id = d.doc_id AND speaker_role = 'witness') AS witnesses FROM (SELECT DISTINCT doc_id FROM p) d LEFT JOIN a ON a.doc_id = d.doc_id AND a.k = 1 LEFT JOIN w ON w.doc_id = d.doc_id AND w.k = 1",
        "redaction_candidates": f"WITH {MARKED}, z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY physical_page, i) AS n FROM mk) SELECT doc_id, CAST(physical_page AS BIGINT) AS physical_page, 'textual_redaction_marker' AS signal, 'high' AS confidence, CASE WHEN length({trim('line')}) > 140 THEN substr({trim('line')}, 1, 140) || '...' ELSE {trim('line')} END AS note FROM z WHERE n <= 750",
        "redaction_summary": f"WITH {MARKED} SELECT d.doc_id, coalesce(n, 0) AS textual_redaction_markers, false AS requires_visual_confirmation FROM (SELECT DISTINCT doc_id FROM p) d LEFT JOIN (SELECT doc_id, count(*) AS n FROM mk GROUP BY 1) m USING (doc_id)",
        "language_hints": f"WITH {PAGES}, x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY physical_page) AS n FROM p), y AS (SELECT doc_id, substr(string_agg(text, chr(10) ORDER BY physical_page), 1, 80000) AS s FROM x WHERE n <= 20 GROUP BY 1), c AS (SELECT doc_id, {count('[A-Za-z' + chr(92) + 'x{00C0}-' + chr(92) + 'x{024F}]')} AS latin, {count('[' + chr(92) + 'x{0900}-' + chr(92) + 'x{097F}]')} AS devanagari, {count('[' + chr(92) + 'x{0600}-' + chr(92) + 'x{06FF}]')} AS arabic, {count('[' + chr(92) + 'x{4E00}-' + chr(92) + 'x{9FFF}' + chr(92) + 'x{3040}-' + chr(92) + 'x{30FF}' + chr(92) + 'x{AC00}-' + chr(92) + 'x{D7AF}]')} AS cjk, {count(chr(92) + 'p{L}')} AS letters, {hits} AS hits FROM y), e AS (SELECT *, letters > 0 AND latin * 100 // greatest(1, letters) >= 80 AND hits >= 4 AS en, greatest(latin, devanagari, arabic, cjk) AS top FROM c) SELECT doc_id, CASE WHEN en THEN 'en' ELSE 'und' END AS code, CASE WHEN letters = 0 THEN 0.1e0 WHEN en THEN 0.92e0 WHEN top > 0 THEN 0.65e0 ELSE 0.1e0 END AS confidence, CASE WHEN letters = 0 THEN 'unknown' WHEN en THEN 'latin' WHEN cjk = top THEN 'cjk' WHEN arabic = top THEN 'arabic' WHEN devanagari = top THEN 'devanagari' ELSE 'latin' END AS dominant_script FROM e",
        "page_features": f"WITH x AS (SELECT coalesce(source, '?') AS doc_id, doc_id AS physical_page, list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: {trim('l')}) AS ls, string_split_regex({trim('coalesce(text, ' + q('') + ')')}, '[\\s\\p{{Z}}]+') AS ts FROM documents), y AS (SELECT *, list_filter(list_transform(ls, lambda l: try_cast({LEAD.format(x='l')} AS INT)), lambda n: n BETWEEN 1 AND 50) AS ns, list_transform(ls, lambda x: {STRIPPED}) AS plain FROM x) SELECT doc_id, physical_page, len(ns) AS numbered, round({SCORE.format(most=1)}, 6) AS sequence, len(list_filter(ts, lambda t: {has('t', _citation())})) AS citations, coalesce(len(list_filter(ls, lambda l: len(list_filter(string_split_regex(l, '[\\s\\p{{Z}}]+'), lambda t: {has('t', _citation())})) > 0)) / nullif(len(list_filter(ls, lambda l: l <> '')), 0) >= 0.2, false) AS index_like, len(list_filter(plain, lambda l: {has(upper('l'), _mark())})) AS marks FROM y",
        "sequence_scores": f"WITH {R}, x AS (SELECT doc_id, CAST(physical_page AS BIGINT) AS physical_page, list(line_number ORDER BY row_index) AS ns FROM r WHERE line_number IS NOT NULL GROUP BY ALL) SELECT doc_id, physical_page, round({SCORE.format(most=1)}, 6) AS sequence, round({SCORE.format(most=4)}, 6) AS tolerant FROM x",
        "source_rows": f"WITH x AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, chr(13) || '$', '')), lambda l: {trim('l')} <> '') AS ls FROM documents), y AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS k FROM x) SELECT doc_id, 'p1_r' || k AS row_id, k - 1 AS row_index, {trim('l')} AS raw_text, CASE WHEN try_cast({LEAD.format(x='l')} AS BIGINT) BETWEEN 1 AND 50 THEN try_cast({LEAD.format(x='l')} AS BIGINT) END AS leading_number FROM y",
        "document_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
        "repeated_furniture": f"WITH {COLON}, t0 AS (SELECT doc_id, id, {trim('text')} AS t FROM r), t1 AS (SELECT *, {trim(f"regexp_extract(t, {q('(?s)' + M.TITLED)}, 1)")} AS label FROM t0 WHERE {has('t', '(?s)' + M.TITLED)}), tl AS (SELECT doc_id, id FROM t1 WHERE strlen(label) <= 80 AND {has('label', M.NAME_CHARS)} AND {has('label', M.TITLED_LABEL)} AND {words('label')} BETWEEN 2 AND 6), m AS (SELECT doc_id, id, physical_page, {trim('text')} AS body, {marker_sql('text')} IS NOT NULL OR starts_with({upper(trim('text'))}, 'BY ') OR EXISTS (SELECT 1 FROM cl WHERE cl.doc_id = r.doc_id AND cl.id = r.id) OR EXISTS (SELECT 1 FROM tl WHERE tl.doc_id = r.doc_id AND tl.id = r.id) AS anchor FROM r WHERE line_number IS NULL AND bbox[2] < {TOP_MARGIN} AND {trim('text')} <> ''), o AS (SELECT doc_id, body FROM m WHERE NOT anchor GROUP BY ALL HAVING count(DISTINCT physical_page) >= 3) SELECT DISTINCT m.doc_id, m.id FROM m JOIN o USING (doc_id, body)",
        "source_continuity": f"WITH {R}, {CONT.format(src='r')} SELECT doc_id, id, source_continuity, coalesce(physical_page > p_page + 1 OR CASE WHEN line_number IS NOT NULL THEN CASE WHEN p_page = physical_page THEN line_number <> p_line + 1 WHEN p_page IS NULL THEN NULL ELSE label <> p_label + 1 OR line_number <> 1 END END, false) AS suspicious FROM k",
        "block_turns": f"WITH {BLOCKS} SELECT doc_id, block_no, block_id, kind, participant_id, confidence, verification, rows, text FROM b",
        "exchanges": f"WITH {EXCH} SELECT doc_id, exchange_no, question_block, responses, answered FROM g",
        "unpaired_answers": f"WITH {EXCH} SELECT doc_id, block_id FROM x WHERE exchange_no IS NULL AND kind = 'answer'",
        "unanswered_questions": f"WITH {EXCH} SELECT doc_id, question_block FROM g WHERE NOT answered",
        "graph_edges": f"WITH {EDGES} SELECT doc_id, printf('block_%06d', f) AS from_block, printf('block_%06d', t) AS to_block, edge_kind FROM d",
        "conversation_edges": f"WITH {EDGES} SELECT doc_id, printf('utterance_block_%06d', f) AS from_utterance, printf('utterance_block_%06d', t) AS to_utterance, CASE edge_kind WHEN 'resumes_after' THEN 'resumes' WHEN 'interprets' THEN 'clarifies' ELSE edge_kind END AS relation, CASE WHEN edge_kind = 'follows' THEN 1.0e0 ELSE 0.7e0 END AS confidence FROM d",
        "event_kinds": f"WITH {TALK} SELECT doc_id, source_row_id, CASE WHEN kind = 'question' THEN 'question_marker' WHEN kind = 'answer' THEN 'answer_marker' WHEN kind = 'examination_heading' THEN 'examination_heading' WHEN kind IN ('parenthetical', 'exhibit_marker') THEN 'parenthetical' WHEN kind = 'redaction_marker' THEN 'redaction' WHEN kind = 'heading' THEN 'procedural' WHEN opens AND speaker IS NOT NULL THEN 'speaker_anchor' ELSE 'text' END AS event_kind FROM t",
        "page_signals": f"WITH {SIGNALS} SELECT doc_id, CAST(physical_page AS BIGINT) AS physical_page, speakers, questions, answers, headings FROM g",
        "format_regions": f"WITH {REGIONS} SELECT doc_id, 'format_region_' || region_no AS region_id, grammar, CAST(min(physical_page) AS BIGINT) AS physical_page_start, CAST(max(physical_page) AS BIGINT) AS physical_page_end, CAST(sum(speakers) AS BIGINT) AS speakers, CAST(sum(questions) AS BIGINT) AS questions, CAST(sum(answers) AS BIGINT) AS answers, CAST(sum(headings) AS BIGINT) AS headings, CASE WHEN grammar = 'unknown' THEN 0.3e0 ELSE 0.9e0 END AS confidence FROM h3 GROUP BY doc_id, region_no, grammar",
        "row_regions": f"WITH {REGIONS} SELECT r.doc_id, r.id, 'format_region_' || region_no AS region_id FROM r JOIN h3 USING (doc_id, physical_page) WHERE r.disposition = 'dialogue'",
        "utterances": f"WITH {BLOCKS}, {SURE} SELECT b.doc_id, 'utterance_' || block_id AS utterance_id, participant_id, {ROLE} AS discourse_role, CASE WHEN coalesce(speaker.redacted, false) THEN 'uncertain' ELSE verification END AS verification, CASE WHEN participant_id IS NOT NULL THEN 0.9e0 ELSE 0.0e0 END AS speaker_confidence, CASE WHEN confidence = 'explicit' THEN 0.95e0 ELSE 0.7e0 END AS boundary_confidence, CASE WHEN confidence = 'explicit' THEN 0.95e0 ELSE 0.65e0 END AS role_confidence, round(source_confidence, 6) AS source_confidence FROM b JOIN u0 USING (doc_id, block_no)",
        "source_spans": f"WITH {SPANS} SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, CAST(span_no AS BIGINT) AS span_no, CAST(physical_page AS BIGINT) AS physical_page, CAST(first(line_number ORDER BY row_index) AS BIGINT) AS line_start, CAST(last(line_number ORDER BY row_index) AS BIGINT) AS line_end, string_agg(id, ' ' ORDER BY row_index) AS row_ids FROM o3 GROUP BY doc_id, block_no, span_no, physical_page",
        "entities": "SELECT DISTINCT doc_id, 'entity_' || id AS entity_id, coalesce(canonical_name, display_label) AS canonical_label, 'person' AS entity_kind, id AS participant_id FROM participants WHERE NOT redacted",
        "page_frames": f"WITH {REGIONS}{SPANS[len(TALK) :]}, pr AS (SELECT doc_id, physical_page, string_agg(id, ' ' ORDER BY row_index) AS row_ids, bool_or(disposition = 'dialogue') AS d FROM r GROUP BY ALL), ps AS (SELECT doc_id, block_no, min(physical_page) AS lo, max(physical_page) AS hi FROM o GROUP BY ALL), pp AS (SELECT DISTINCT doc_id, block_no, physical_page FROM o), pc AS (SELECT doc_id, physical_page, min(CASE WHEN lo < physical_page THEN block_no END) AS i, min(CASE WHEN hi > physical_page THEN block_no END) AS u FROM pp JOIN ps USING (doc_id, block_no) GROUP BY ALL) SELECT pr.doc_id, CAST(pr.physical_page AS BIGINT) AS physical_page, row_ids, coalesce(CASE WHEN d THEN 'format_region_' || region_no END, '') AS format_region_ids, CASE WHEN i IS NOT NULL THEN printf('utterance_block_%06d', CAST(i AS BIGINT)) END AS utterance_in, CASE WHEN u IS NOT NULL THEN printf('utterance_block_%06d', CAST(u AS BIGINT)) END AS utterance_out FROM pr LEFT JOIN h3 USING (doc_id, physical_page) LEFT JOIN pc USING (doc_id, physical_page)",
        "ir_diagnostics": f"WITH {REGIONS}{SPANS[len(TALK) :]}, {SURE}, uu AS (SELECT doc_id, count(*) AS utterances, avg(least(source_confidence, CASE WHEN confidence = 'explicit' THEN 0.95e0 ELSE 0.65e0 END, CASE WHEN kind IN {PROCEDURAL} THEN 1.0e0 WHEN participant_id IS NOT NULL THEN 0.9e0 ELSE 0.0e0 END)) AS cc FROM b JOIN u0 USING (doc_id, block_no) GROUP BY 1), rr AS (SELECT r.doc_id, count(*) AS canonical_rows, count_if(disposition = 'dialogue') AS tr, count_if(disposition = 'dialogue' AND n.source_row_id IS NOT NULL) AS ra FROM r LEFT JOIN n ON n.doc_id = r.doc_id AND n.source_row_id = r.id GROUP BY 1), un AS (SELECT doc_id, count_if(speaker IS NULL AND kind NOT IN {PROCEDURAL}) AS un FROM t GROUP BY 1), fr AS (SELECT doc_id, count(DISTINCT region_no) AS fr FROM h3 GROUP BY 1), cp AS (SELECT doc_id, count_if(k > 1) AS cp FROM (SELECT doc_id, block_no, count(DISTINCT physical_page) AS k FROM o GROUP BY ALL) GROUP BY 1) SELECT doc_id, canonical_rows, tr AS transcript_rows, ra AS rows_assigned, coalesce(utterances, 0) AS utterances, coalesce(fr, 0) AS format_regions, coalesce(cp, 0) AS cross_page_utterances, coalesce(un, 0) AS unresolved_speaker_rows, round(CASE WHEN tr > 0 THEN ra / tr ELSE 0.0e0 END, 6) AS source_row_coverage, round(coalesce(cc, 0.0e0), 10) AS conversation_confidence FROM rr LEFT JOIN uu USING (doc_id) LEFT JOIN un USING (doc_id) LEFT JOIN fr USING (doc_id) LEFT JOIN cp USING (doc_id)",
        "unregistered_speakers": f"WITH {TALK} SELECT DISTINCT doc_id, participant_id AS id FROM t WHERE participant_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM participants p WHERE p.doc_id = t.doc_id AND p.id = t.participant_id)",
        "line_confidence": f"WITH {TALK} SELECT doc_id, round(avg(CASE verification WHEN 'verified' THEN 1.0e0 WHEN 'verified_with_inference' THEN 0.88e0 ELSE 0.25e0 END), 10) AS line_confidence FROM t GROUP BY 1",
        "line_diagnostics": f"WITH {TALK} SELECT doc_id, count(*) AS lines, count_if(confidence = 'inferred') AS inferred_lines, count_if(kind = 'unknown') AS unknown_lines, count_if(verification = 'verified') AS verified_lines, count_if(verification = 'verified_with_inference') AS verified_with_inference_lines, count_if(verification = 'conflict') AS conflict_lines, count_if(verification = 'uncertain') AS uncertain_lines, count(DISTINCT physical_page) AS transcript_pages, count(DISTINCT physical_page) FILTER (transcript_page IS NULL) AS pages_without_label FROM t GROUP BY 1",
        "row_inventory": f"WITH {R} SELECT e.doc_id, CAST(expected AS BIGINT) AS expected, coalesce(n, 0) AS rows, coalesce(d, 0) AS distinct_rows FROM (SELECT doc_id, sum(len(row_ids)) AS expected FROM page_frames GROUP BY 1) e LEFT JOIN (SELECT doc_id, count(*) AS n, count(DISTINCT id) AS d FROM r GROUP BY 1) h USING (doc_id)",
        "row_ownership": f"WITH {BLOCKS}, w AS (SELECT doc_id, source_row_id AS id, count(*) AS owners FROM n GROUP BY ALL) SELECT r.doc_id, r.id, coalesce(owners, 0) AS owners FROM r LEFT JOIN w USING (doc_id, id) WHERE disposition = 'dialogue' AND coalesce(owners, 0) <> 1",
        "quality_issues": f"WITH {ISSUES} SELECT doc_id, code, count(*) AS issues FROM i0 GROUP BY ALL",
        "quality_gate": f"WITH {ISSUES}, y AS (SELECT doc_id, count(*) AS issues, bool_or(code IN ('source_inventory_mismatch', 'participant_reference')) AS blocked FROM i0 GROUP BY 1) SELECT d.doc_id, CASE WHEN coalesce(blocked, false) THEN 'blocked' WHEN coalesce(issues, 0) = 0 THEN 'passed_structural_checks' ELSE 'needs_review' END AS status, NOT coalesce(blocked, false) AND coalesce(issues, 0) = 0 AS ready, CASE WHEN coalesce(blocked, false) THEN 0.35e0 WHEN coalesce(issues, 0) = 0 THEN 0.95e0 ELSE 0.75e0 END AS confidence_ceiling, coalesce(issues, 0) AS issues FROM (SELECT DISTINCT doc_id FROM doc_context) d LEFT JOIN y USING (doc_id)",
        "row_tolerance": "WITH s AS (SELECT doc_id, CAST(physical_page AS BIGINT) AS physical_page, list_sort(list(font_size) FILTER (font_size > 0.1)) AS l FROM fragments GROUP BY ALL) SELECT doc_id, physical_page, round(coalesce(greatest(0.65, least(3.0, 0.18 * l[len(l) // 2 + 1])), 1.5), 6) AS tolerance FROM s",
        "text_widths": r"WITH x AS (SELECT doc_id, fragment_id, coalesce(font_size, 10.0) AS z, length(text) AS n, len(regexp_extract_all(text, '[\s\p{Z}]')) AS a, len(regexp_extract_all(text, '[ilIj.,:;!''|]')) AS b, len(regexp_extract_all(text, '[MWmw@%]')) AS c FROM fragments WHERE text IS NOT NULL) SELECT doc_id, fragment_id, round(greatest(0.2 * z, z * (0.33 * a + 0.28 * b + 0.82 * c + 0.54 * (n - a - b - c))), 4) AS width FROM x",
        "masked_fragments": f"WITH {R}, k AS (SELECT doc_id, physical_page, bbox FROM r WHERE bbox IS NOT NULL AND {has('text', M.REDACTION)}) SELECT DISTINCT f.doc_id, f.fragment_id FROM fragments f LEFT JOIN k ON k.doc_id = f.doc_id AND k.physical_page = f.physical_page AND f.x_pos + f.width / 2 BETWEEN bbox[1] - 1.5 AND bbox[3] + 1.5 AND (f.y_pos BETWEEN -bbox[4] - 1.5 AND -bbox[2] + 1.5 OR f.y_pos + 0.35 * coalesce(f.font_size, f.height) BETWEEN -bbox[4] - 1.5 AND -bbox[2] + 1.5) WHERE f.redaction_masked OR k.doc_id IS NOT NULL",
    }


def _citation() -> str:
    from attestant.operators.sections import CITATION

    return CITATION


def _mark() -> str:
    from attestant.operators.sections import DIALOGUE_MARK

    return DIALOGUE_MARK
