"""The stages before classification in SQL: lines, printed labels, inventory, sections, front matter. Patterns are spelled out here again."""

from __future__ import annotations

from attestant.plans.oracles import R, has, q, role_sql, trim, upper, words

_NUMBERED = r"^([0-9]{1,5})($|[\s\p{Z}:]|[QA][.:])"
_TITLED = r"(?s)^((?i:MR\. |MR |MS\. |MS |MRS\. |MRS |MISS |CHAIRMAN |CHAIRWOMAN |CONGRESSMAN |CONGRESSWOMAN |REPRESENTATIVE |SENATOR |GOVERNOR |DR\. |DR |JUDGE |JUSTICE |THE WITNESS )(?:(?:[^.]*[\s\p{Z}])?[^\s\p{Z}.]\.[\s\p{Z}]*)*[^.]*[^\s\p{Z}.][^\s\p{Z}.])\.(.*)$"
_TITLED_LABEL = r"^[^\s\p{Z}]+(?:[\s\p{Z}]+(?:\p{Lu}[^\s\p{Z}]*|de|van|von|der|den|la|del))+$"
_NAMES = r"^[\p{L}\p{M}\s\p{Z}.'’\-]+$"
_STRUCTURE = r"^(?:Q|A|QUESTION|ANSWER|APPEARANCES|PRESENT|INTERVIEW OF|DEPOSITION OF|CASE NO|CASE NO\.|DATE|TIME|NOTE|NOTES|EXHIBITS|INDEX)$|^(?:FOR |BY |CERTIFICATE|EXAMINATION|IN THE )"
_MARK = r"^(?:Q\.|A\.|Q|A|Q:|A:)($|[\s\p{Z}])|(?i)^(?:QUESTION|ANSWER)[:.]"
_CITED = r"^[,;()\[\].:]*[0-9]+:(?:[1-9]|[1-4][0-9]|50)[,;()\[\].:]*$"
_HIDDEN = r"(?i)\[REDACTED\]|NAME REDACTED|REDACTED NAME|NAME WITHHELD|\[SEALED\]|^REDACTED$|^SEALED$|[█■▇].*[█■▇].*[█■▇]|^[Xx*_]{4,}$"
_REFERENCE = "('word_index', 'exhibit_index', 'certificate', 'errata', 'appendix', 'attachment')"
_FAMILY = "('cover', 'caption', 'appearances', 'transcript')"

# Pages as texts, with the section they were delivered in, and their lines.
PAGES = (
    R
    + ", pf AS (SELECT DISTINCT doc_id, physical_page, section FROM page_frames), dk AS (SELECT DISTINCT doc_id, kind FROM doc_context), tx AS (SELECT doc_id, physical_page, string_agg(coalesce(raw_text, ''), chr(10) ORDER BY row_index) AS text FROM r GROUP BY ALL), "
    "p AS (SELECT tx.*, dk.kind, coalesce(pf.section, 'unknown') AS section FROM tx LEFT JOIN dk USING (doc_id) LEFT JOIN pf USING (doc_id, physical_page)), "
    "ll AS (SELECT *, list_transform(CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END, lambda l: regexp_replace(l, chr(13) || '$', '')) AS ls FROM p)"
)
LINES = (
    PAGES
    + rf""", e0 AS (SELECT doc_id, physical_page, section, kind, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM ll), e1 AS (SELECT *, {trim('line')} AS raw FROM e0),
e2 AS (SELECT *, CASE WHEN {has('raw', _NUMBERED)} THEN try_cast(regexp_extract(raw, {q(_NUMBERED)}, 1) AS INT) END AS n0 FROM e1), e3 AS (SELECT *, CASE WHEN n0 BETWEEN 1 AND 100 THEN n0 END AS n, CASE WHEN n0 BETWEEN 1 AND 100 THEN regexp_replace(raw, '^[0-9]+:*[\s\p{{Z}}]*', '') ELSE raw END AS nb FROM e2),
e4 AS (SELECT *, n > lag(n) OVER (PARTITION BY doc_id, physical_page ORDER BY i) AS up FROM e3 WHERE n IS NOT NULL), e5 AS (SELECT doc_id, physical_page, bool_or({has('nb', '^[QA][.:]')}) OR (count(*) >= 3 AND 2 * count_if(up) >= count(*) - 1) AS counted FROM e4 GROUP BY ALL),
li AS (SELECT doc_id, physical_page, section, kind, i AS line_index, CASE WHEN raw <> '' THEN CAST(count_if(raw <> '') OVER (PARTITION BY doc_id, physical_page ORDER BY i) - 1 AS BIGINT) END AS row_index, raw, coalesce(counted, false) AS has_numbers, CASE WHEN counted THEN n END AS number, CASE WHEN counted THEN {trim('nb')} ELSE raw END AS body FROM e3 LEFT JOIN e5 USING (doc_id, physical_page))"""
)
LABELS = (
    "RECURSIVE "
    + LINES
    + rf""", a0 AS (SELECT *, try_cast(nullif(regexp_extract({upper(trim('body'))}, '^PAGE [\s\p{{Z}}]*\+?([0-9]+)$', 1), '') AS INT) AS pm, CASE WHEN regexp_matches({trim('body')}, '^[0-9]{{1,7}}$') THEN CAST({trim('body')} AS INT) END AS pn FROM li),
a1 AS (SELECT doc_id, physical_page, list({{'r': row_index, 'm': pm, 'n': coalesce(pm, pn), 'e': row_index < 5, 's': CASE WHEN strlen(body) >= 3 AND starts_with(body, '0') THEN 100 ELSE 0 END + CASE WHEN number IS NULL AND row_index < 5 AND pn > 100 THEN 80 ELSE 0 END + CASE WHEN row_index = 0 AND number IS NULL AND has_numbers THEN 80 ELSE 0 END + CASE WHEN row_index < 5 THEN 10 ELSE 0 END}}) AS cs FROM a0 WHERE row_index < 10 AND (pm IS NOT NULL OR pn IS NOT NULL) GROUP BY ALL),
a2 AS (SELECT p.doc_id, physical_page, section, cs, row_number() OVER (PARTITION BY p.doc_id ORDER BY physical_page) AS k FROM p LEFT JOIN a1 USING (doc_id, physical_page)),
a3 AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS INT) AS prev, CAST(NULL AS INT) AS lab, CAST(NULL AS INT) AS physical_page, CAST(NULL AS VARCHAR) AS section FROM (SELECT DISTINCT doc_id FROM p) UNION ALL
 SELECT doc_id, k, CASE WHEN (section IN {_FAMILY} OR section = 'unknown') AND lab IS NOT NULL THEN lab ELSE prev END, lab, physical_page, section FROM (SELECT *, CASE WHEN section NOT IN {_REFERENCE} AND best.s >= 80 THEN best.n END AS lab FROM (SELECT a2.*, a3.prev, list_max(list_transform(cs, lambda c: {{'s': CASE WHEN c.m IS NOT NULL THEN 1000 ELSE c.s + CASE WHEN c.e AND coalesce(c.n = a3.prev + 1, false) THEN 80 ELSE 0 END END, 'r': -c.r, 'n': c.n}})) AS best FROM a3 JOIN a2 ON a2.doc_id = a3.doc_id AND a2.k = a3.k + 1))),
lb AS (SELECT doc_id, physical_page, section, CAST(lab AS VARCHAR) AS transcript_page FROM a3 WHERE k > 0)"""
)


def _labelled(source: str, out: str, text: str) -> str:
    """Common table expressions: ``source`` with the label of each line and whether that comes before a colon."""
    return (
        f", {out}0 AS (SELECT *, {trim(text)} AS t FROM {source}), {out}1 AS (SELECT *, CASE WHEN contains(t, ':') THEN {trim("regexp_extract(t, '(?s)^([^:]*):', 1)")} END AS c, CASE WHEN {has('t', _TITLED)} THEN {trim(f'regexp_extract(t, {q(_TITLED)}, 1)')} END AS d FROM {out}0), "
        f"{out} AS (SELECT *, coalesce(c <> '' AND NOT {has(upper('c'), _STRUCTURE)} AND strlen(c) <= 80 AND ({role_sql('c')} IS NOT NULL OR ({has('c', _NAMES)} AND {has('c', chr(92) + 'p{L}')} AND NOT {has('c', chr(92) + 'p{Ll}|[ªº]')} AND {words('c')} BETWEEN 1 AND 6)), false) AS colon, "
        f"coalesce(strlen(d) <= 80 AND {has('d', _NAMES)} AND {has('d', _TITLED_LABEL)} AND {words('d')} BETWEEN 2 AND 6, false) AS titled FROM {out}1)"
    )


def _inventory() -> str:
    lone = f"try_cast(nullif(regexp_extract({upper(trim('body'))}, '^PAGE [{chr(92)}s{chr(92)}p{{Z}}]*{chr(92)}+?([0-9]+)$', 1), '') AS INT)"
    pure = f"CASE WHEN regexp_matches({trim('body')}, '^[0-9]{{1,7}}$') THEN CAST({trim('body')} AS INT) END"
    second = r"list_extract(string_split_regex(raw, '[\s\p{Z}]+'), 2)"
    return (
        LABELS
        + _labelled("(SELECT li.*, lb.transcript_page FROM li LEFT JOIN lb USING (doc_id, physical_page) WHERE row_index IS NOT NULL)", "v", "body")
        + f""", v2 AS (SELECT *, coalesce((number IS NULL AND CAST(coalesce({pure}, {lone}) AS VARCHAR) = transcript_page) OR (number IS NOT NULL AND strlen({second}) >= 3 AND starts_with({second}, '0') AND row_index < 3 AND CAST({pure} AS VARCHAR) = transcript_page), false) AS furniture,
 coalesce({has('body', '(?i)^[' + chr(92) + 's' + chr(92) + 'p{Z}]*BY ')} OR {has('regexp_replace(body, ' + q('^[' + chr(92) + 's' + chr(92) + 'p{Z}]+') + ', ' + q('') + ')', _MARK)} OR colon OR titled, false) AS anchor, section = 'transcript' AS spoken FROM v),
v3 AS (SELECT doc_id, physical_page, bool_or(starts_with({upper('body')}, 'APPEARANCES') OR (starts_with({upper('body')}, 'FOR ') AND ends_with({upper('body')}, ':'))) AS preamble FROM v2 GROUP BY ALL),
v4 AS (SELECT doc_id, physical_page, count_if(section <> 'transcript') OVER (PARTITION BY doc_id ORDER BY physical_page) AS run FROM lb), v5 AS (SELECT doc_id, run, min(physical_page * 1000000 + row_index) AS opened FROM v2 JOIN v4 USING (doc_id, physical_page) WHERE anchor AND spoken AND NOT furniture AND body <> '' GROUP BY ALL),
v6 AS (SELECT v2.*, CASE WHEN furniture THEN 'page_furniture' WHEN body = '' THEN 'blank_numbered_line' WHEN section IN {_REFERENCE} THEN 'reference' WHEN section IN ('cover', 'caption', 'appearances') THEN 'front_matter' WHEN spoken AND preamble AND (opened IS NULL OR physical_page * 1000000 + row_index < opened) THEN 'front_matter' WHEN spoken THEN 'dialogue' ELSE 'unclassified' END AS disposition
 FROM v2 JOIN v3 USING (doc_id, physical_page) JOIN v4 USING (doc_id, physical_page) LEFT JOIN v5 USING (doc_id, run))"""
    )


def _sections() -> str:
    u = upper("text")
    says = lambda w: f"contains({u}, '{w}')"
    heads = lambda *ws: "len(list_filter(heads, lambda h: " + " OR ".join(f"starts_with(h, {q(w)})" for w in ws) + ")) > 0"
    quiet, few = "labels = 0 AND marks = 0", "numbered < 8"
    rules = [
        (heads("CERTIFICATE OF", "REPORTER'S CERTIFICATE", "CERTIFICATION OF"), "certificate", 0.96), (heads("ERRATA"), "errata", 0.96), (f"{heads('APPEARANCES')} AND {quiet}", "appearances", 0.97),
        (f"physical_page <= 3 AND {heads('INTERVIEW OF', 'DEPOSITION OF', 'TRANSCRIPT OF')} AND {quiet}", "cover", 0.96), ("labels >= 2 OR marks >= 2", "transcript", 0.92),
        (f"{says('WORD INDEX')} OR {says('WORD/PHRASE INDEX')} OR (citations >= 10 AND numbered <= 5 AND index_like)", "word_index", 0.96), (f"{says('EXHIBIT INDEX')} OR {says('INDEX OF EXHIBITS')} OR ({says('EXHIBIT')} AND {says('DESCRIPTION')} AND {few})", "exhibit_index", 0.94),
        (f"{says('CERTIFICATE')} AND ({says('CERTIFICATE OF TRANSCRIPTION')} OR {says('I CERTIFY')} OR {says('COURT REPORTER')} OR {says('NOTARY')}) AND {few}", "certificate", 0.92), (f"({says('ERRATA SHEET')} OR ({says('ERRATA')} AND {says('PAGE')} AND {says('LINE')})) AND {few}", "errata", 0.92),
        (f"{says('ATTACHMENT')} AND {few}", "attachment", 0.84), (f"{says('APPENDIX')} AND {few}", "appendix", 0.86), (f"({says('CASE NO.')} OR {says('CASE NUMBER')}) AND ({says('COURT')} OR {says('DISTRICT')}) AND numbered < 6 AND {quiet}", "caption", 0.82),
        (f"{says('APPEARANCES')} AND {few}", "appearances", 0.97), ("numbered >= 8 AND sequence >= 0.62", "transcript", 0.97), (f"({says('DEPOSITION OF')} OR {says('INTERVIEW OF')} OR {says('TRANSCRIPT OF')}) AND {few}", "cover", 0.90), ("numbered >= 4 AND sequence >= 0.5", "transcript", 0.70),
    ]
    case = lambda k: "CASE " + " ".join(f"WHEN {r[0]} THEN {q(r[1]) if k == 1 else str(r[2]) + 'e0'}" for r in rules) + (" ELSE 'unknown' END" if k == 1 else " ELSE 0.35e0 END")
    bare = r"CASE WHEN try_cast(regexp_extract(x, '^([0-9]{1,5})', 1) AS INT) BETWEEN 1 AND 50 THEN regexp_replace(regexp_replace(x, '^[0-9]+', ''), '^[\s\p{Z}]+', '') ELSE x END"
    lead = r"try_cast(regexp_extract(regexp_replace(l, '^[\s\p{Z}]+', ''), '^([0-9]{1,5})($|[\s\p{Z}])', 1) AS INT)"
    step = lambda n, old, when, s, c: f", {n} AS (SELECT * REPLACE (CASE WHEN {when} THEN '{s}' ELSE section END AS section, CASE WHEN {when} THEN {c}e0 ELSE conf END AS conf) FROM {old})"
    w = "(PARTITION BY doc_id ORDER BY physical_page)"
    return (
        PAGES
        + f""", f0 AS (SELECT doc_id, physical_page, unnest(list_transform(list_transform(ls, lambda l: {trim('l')}), lambda x: {bare})) AS x, generate_subscripts(ls, 1) AS i FROM ll)"""
        + _labelled("f0", "f1x", "x")
        + f""", f2 AS (SELECT doc_id, physical_page, count_if(regexp_matches(x, '[:.]') AND (colon OR titled)) AS labels, count_if(regexp_matches(x, '(?i)^(?:[QA][. :]|QUESTION:|ANSWER:)')) AS marks, list({upper('x')} ORDER BY i) FILTER ({upper('x')} <> '' AND NOT regexp_matches(x, '^[0-9]+$')) AS hs FROM f1x GROUP BY ALL),
f3 AS (SELECT doc_id, physical_page, text, list_filter(list_transform(ls, lambda l: {lead}), lambda n: n BETWEEN 1 AND 50) AS ns, len(list_filter(string_split_regex({trim('text')}, '[\\s\\p{{Z}}]+'), lambda t: {has('t', _CITED)})) AS citations, list_filter(ls, lambda l: {trim('l')} <> '') AS fl FROM ll),
f4 AS (SELECT f3.*, coalesce(labels, 0) AS labels, coalesce(marks, 0) AS marks, coalesce(hs, [])[1:8] AS heads, len(ns) AS numbered, CASE WHEN len(ns) >= 2 THEN list_sum(list_transform(range(1, len(ns)), lambda i: CASE WHEN ns[i + 1] = ns[i] + 1 THEN 1 ELSE 0 END)) / (len(ns) - 1) ELSE 0.0e0 END AS sequence,
 coalesce(len(list_filter(fl, lambda l: len(list_filter(string_split_regex({trim('l')}, '[\\s\\p{{Z}}]+'), lambda t: {has('t', _CITED)})) > 0)) / nullif(len(fl), 0) >= 0.2, false) AS index_like FROM f3 LEFT JOIN f2 USING (doc_id, physical_page)),
f5 AS (SELECT *, {case(1)} AS section, {case(2)} AS conf, labels >= 3 OR numbered >= 5 OR marks >= 4 AS talks, {says('EXAMINATION')} OR {heads('BY ')} AS exam FROM f4),
g1 AS (SELECT *, coalesce(last_value(CASE WHEN section = 'appearances' THEN true WHEN section IN {_REFERENCE} OR NOT ({quiet} AND NOT exam) THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY physical_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS opened FROM f5)"""
        + step("g2", "g1", f"opened AND section <> 'appearances' AND section NOT IN {_REFERENCE} AND {quiet} AND NOT exam", "appearances", 0.88)
        + f""", g3 AS (SELECT *, section IN ('unknown', 'transcript') AND (citations >= 3 OR index_like) AND labels < 2 AND marks < 2 AS may FROM g2), g4 AS (SELECT *, count_if(NOT (may OR section = 'word_index')) OVER {w} AS part FROM g3), g5 AS (SELECT *, count_if(may) OVER (PARTITION BY doc_id, part ORDER BY physical_page) AS gap FROM g4),
g6 AS (SELECT *, coalesce(count_if(section = 'word_index' AND gap = 0) OVER (PARTITION BY doc_id, part ORDER BY physical_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g5), g7 AS (SELECT *, may AND max(before) OVER (PARTITION BY doc_id, part ORDER BY physical_page) >= 3 AS joins FROM g6)"""
        + step("g8", "g7", "joins", "word_index", 0.9)
        + f", h1 AS (SELECT *, coalesce(lag(section) OVER {w} = 'transcript' AND lead(section) OVER {w} = 'transcript', false) AS near FROM g8)"
        + step("h2", "h1", "near AND section = 'unknown'", "transcript", 0.72)
        + "".join(f", i{k} AS (SELECT *, coalesce(lag(section) OVER {w} = 'transcript', false) OR coalesce(lead(section) OVER {w} = 'transcript', false) AS beside{k} FROM {old})" + step(f"j{k}", f"i{k}", f"beside{k} AND talks AND section = 'unknown'", "transcript", 0.64) for k, old in ((1, "h2"), (2, "j1")))
        + ", k1 AS (SELECT *, bool_or(section = 'transcript') OVER (PARTITION BY doc_id) AS has_talk FROM j2)"
        + step("sx", "k1", "NOT has_talk AND talks AND section = 'unknown'", "transcript", 0.52)
    )


def _front() -> str:
    """Front lines: of the first pages in order, by page rank ``n`` and, for the family's pages only, ``fn``."""
    return PAGES + f", fp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY physical_page) AS n, CASE WHEN section IN {_FAMILY} THEN row_number() OVER (PARTITION BY doc_id, section IN {_FAMILY} ORDER BY physical_page) END AS fn FROM ll), fl AS (SELECT doc_id, physical_page, section, n, fn, {trim('unnest(ls)')} AS line, generate_subscripts(ls, 1) AS i FROM fp)"


def oracle_sql() -> dict[str, str]:
    inventory, sections, front = _inventory(), _sections(), _front()
    people = "pp AS (SELECT DISTINCT ON (doc_id, id) doc_id, id, display_label FROM participants)"
    name = rf"array_to_string(list_filter(string_split_regex({trim(upper(rf"regexp_replace(display_label, '[^\p{{L}}\p{{N}}\s\p{{Z}}]', ' ', 'g')"))}, '[\s\p{{Z}}]+'), lambda w: w NOT IN ('MR', 'MS', 'MRS', 'MISS', 'DR', 'HON', 'CHAIRMAN')), ' ')"
    last = lambda x: rf"list_extract(string_split_regex({x}, '[\s\p{{Z}}]+'), -1)"
    dots = lambda x: f"regexp_replace({x}, '^{chr(92)}.+|{chr(92)}.+$', '', 'g')"
    subjects = ["INTERVIEW OF:", "INTERVIEW OF", "DEPOSITION OF:", "DEPOSITION OF", "WITNESS:"]
    cands = ", ".join(f"CASE WHEN position({q(w)} IN u) > 0 THEN {trim(f"regexp_replace({trim(f'substr(line, position({q(w)} IN u) + {len(w)})')}, '^:+|:+$', '', 'g')")} END" for w in subjects)
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    types = [("h_iv", "interview of", 4), ("h_ti", "transcribed interview", 4), ("h_dep", "deposition of", 4), ("dep", "deposition", 16), ("depo", "deponent", 16), ("arb", "arbitration", 16), ("arbr", "arbitrator", 16), ("hear", "hearing", 16), ("tt", "trial transcript", 16), ("tp", "trial proceedings", 16), ("court", "the court", 16), ("iv", "interview", 16), ("ex", "examination", 16)]
    learned = _labelled("r", "w", "text") + f", ob AS (SELECT doc_id, count_if({has('regexp_replace(text, ' + q('^[' + chr(92) + 's' + chr(92) + 'p{Z}]+') + ', ' + q('') + ')', _MARK)} AND NOT (colon OR titled)) AS m FROM w GROUP BY 1), po AS (SELECT doc_id, sum(observations) AS p FROM (SELECT DISTINCT ON (doc_id, id) * FROM participants) GROUP BY 1)"
    return {
        "page_lines": f"WITH {LINES} SELECT doc_id, CAST(physical_page AS BIGINT) AS physical_page, line_index, row_index, raw, has_numbers, CAST(number AS BIGINT) AS number, body FROM li",
        "page_labels": f"WITH {LABELS} SELECT doc_id, CAST(physical_page AS BIGINT) AS physical_page, section, transcript_page FROM lb",
        "inventory_rows": f"WITH {inventory} SELECT doc_id, 'p' || physical_page || '_r' || (row_index + 1) AS id, transcript_page, CAST(number AS BIGINT) AS line_number, body AS text, CASE WHEN furniture THEN 'page_header' ELSE 'unknown' END AS event_kind, disposition, CASE WHEN kind = 'text' THEN 'plain_text' ELSE 'fallback_text' END AS source, anchor FROM v6",
        "page_sections": f"WITH {sections} SELECT doc_id, physical_page, section, conf AS section_confidence FROM sx",
        "named_subjects": rf"WITH {front}, s1 AS (SELECT *, {upper('line')} AS u FROM fl WHERE n <= 12 AND (section IN {_FAMILY} OR section = 'unknown')), s2 AS (SELECT *, list_filter([{cands}], lambda c: strlen(c) >= 2) AS cs FROM s1) SELECT doc_id, arg_min({upper("regexp_replace(" + trim("cs[1]") + r", '[\s\p{Z}]+', ' ', 'g')")}, (physical_page, i)) AS subject FROM s2 WHERE len(cs) > 0 GROUP BY 1",
        "front_names": rf"WITH {front}, {people}, n0 AS (SELECT doc_id, physical_page, i, {trim("regexp_replace(line, '^[0-9]+', '')")} AS line FROM fl WHERE n <= 16 AND (section IN {_FAMILY} OR section = 'unknown')){_labelled('n0', 'nl', 'line')}, n1 AS (SELECT *, {trim("regexp_extract(line, '^([^,]*)', 1)")} AS head FROM nl WHERE NOT colon AND NOT titled), n2 AS (SELECT *, {upper(r"regexp_replace(" + last('head') + r", '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')")} AS surname FROM n1 WHERE NOT regexp_matches(head, '\p{{Ll}}') AND {words('head')} BETWEEN 2 AND 5 AND head <> ''), n3 AS (SELECT doc_id, id, list_extract(string_split({name}, ' '), -1) AS surname FROM pp) SELECT n3.doc_id, n3.id, arg_min(head, (physical_page, i)) AS front_name FROM n3 JOIN n2 USING (doc_id, surname) WHERE strlen(surname) >= 3 GROUP BY ALL",
        "front_roles": rf"WITH {front}, {people}, m0 AS (SELECT doc_id, {upper('line')} AS u FROM fl WHERE fn <= 12), m1 AS (SELECT doc_id, {dots(last(trim("regexp_extract(u, '^([^,]*),', 1)")))} AS surname, regexp_replace(u, '^[^,]*,', '') AS role FROM m0 WHERE contains(u, ',')), m2 AS (SELECT doc_id, id, {dots(last(upper(trim('display_label'))))} AS surname FROM pp) SELECT m2.doc_id, m2.id, bool_or(regexp_matches(role, 'COUNSEL|ATTORNEY|ESQ')) AS counsel, bool_or(regexp_matches(role, 'FBI|SPECIAL AGENT|MARSHAL|LAW ENFORCEMENT')) AS law, bool_or(regexp_matches(role, 'ATTORNEY GENERAL|DEPARTMENT OF JUSTICE|U\.S\. ATTORNEY')) AS government FROM m2 JOIN m1 USING (doc_id, surname) WHERE strlen(surname) >= 2 GROUP BY ALL",
        "document_types": f"WITH {PAGES}{learned}, d0 AS (SELECT *, {low} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY physical_page) AS n FROM p), d1 AS (SELECT doc_id, {', '.join(f'bool_or(contains(t, {q(w)}) AND n <= {m}) AS {k}' for k, w, m in types)} FROM d0 WHERE n <= 16 GROUP BY 1), d2 AS (SELECT d1.*, coalesce(m, 0) + coalesce(po.p, 0) AS signals FROM d1 LEFT JOIN ob USING (doc_id) LEFT JOIN po USING (doc_id)) "
        "SELECT doc_id, CASE WHEN h_iv OR h_ti THEN 'interview' WHEN h_dep OR dep OR depo THEN 'deposition' WHEN arb OR arbr THEN 'arbitration' WHEN hear THEN 'hearing' WHEN tt OR tp OR (court AND signals >= 4) THEN 'trial_transcript' WHEN iv THEN 'interview' WHEN ex AND signals >= 4 THEN 'examination' WHEN signals >= 8 THEN 'other_transcript' ELSE 'unknown' END AS document_type FROM d2",
        "titled_style": f"WITH {R}{_labelled('r', 'w', 'text')} SELECT doc_id, bool_or(titled) AS titled FROM w GROUP BY 1",
    }
