"""Queries of this subpackage in SQL, where SQL can say them."""

from __future__ import annotations

P3 = """WITH r AS (SELECT DISTINCT ON (doc_id, id) * FROM canonical_rows), l AS (SELECT DISTINCT doc_id, source_row_id, kind FROM transcript_lines WHERE kind IN ('question', 'answer', 'objection', 'speaker_statement')),
t AS (SELECT r.doc_id, r.physical_page, r.row_index, r.event_kind, l.kind, coalesce(regexp_matches(r.text, '[^ \\t\\r\\n]'), false) AS full_text FROM r JOIN l ON l.doc_id = r.doc_id AND l.source_row_id = r.id),
f AS (SELECT DISTINCT doc_id FROM t WHERE full_text),
s AS (SELECT *, lag(kind) OVER w AS before FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY physical_page, row_index)),
s2 AS (SELECT *, sum(CASE WHEN kind = 'question' AND (event_kind = 'question_marker' OR before IS NULL OR before <> 'question') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY physical_page, row_index) AS turn FROM s),
n AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, turn FROM s2 WHERE turn > 0 GROUP BY ALL HAVING count_if(kind = 'answer') = 0)),
p AS (SELECT doc_id, physical_page, count(DISTINCT row_index) AS k, max(row_index) AS hi, list(DISTINCT id) AS ids FROM r GROUP BY ALL),
b AS (SELECT d.doc_id FROM doc_context d LEFT JOIN (SELECT doc_id, count(*) AS k FROM p GROUP BY 1) x USING (doc_id) WHERE coalesce(k, 0) < page_count UNION SELECT doc_id FROM p WHERE k <= hi UNION SELECT p.doc_id FROM p JOIN page_frames q USING (doc_id, physical_page) WHERE len(list_filter(q.row_ids, lambda i: NOT list_contains(p.ids, i))) > 0
 UNION SELECT a.doc_id FROM page_frames a JOIN page_frames z ON z.doc_id = a.doc_id AND z.physical_page = a.physical_page + 1 WHERE a.continuity_out.utterance_id IS DISTINCT FROM z.continuity_in.utterance_id)
SELECT DISTINCT doc_id, 'empty' AS defect FROM doc_context WHERE doc_id NOT IN (SELECT doc_id FROM f) UNION ALL SELECT doc_id, 'broken' FROM b WHERE doc_id IN (SELECT doc_id FROM f) UNION ALL SELECT doc_id, 'no_reply' FROM n WHERE doc_id IN (SELECT doc_id FROM f)"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3}
