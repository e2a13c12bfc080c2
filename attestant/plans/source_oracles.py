"""Sources and geometry in SQL."""

from __future__ import annotations

from attestant.plans.oracles import R, q, trim

_ROWS = "gr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, physical_page, row_index ORDER BY x_pos NULLS FIRST, sequence NULLS FIRST) AS place FROM {src})"


def _texts(src: str = "fragments") -> str:
    """Rows' texts: a fragment without text, and a mask after a mask, is passed over; what is kept is compared with the one kept before."""
    t, word = trim("text"), r"[\p{L}\p{N}]"
    return (
        _ROWS.format(src=src)
        + rf""", x0 AS (SELECT doc_id, physical_page, row_index, place, {t} AS t, x_pos, width, greatest(1.0, coalesce(font_size, 10.0)) AS size, coalesce(redaction_masked, false) AS m FROM gr WHERE text IS NOT NULL AND {t} <> ''), x1 AS (SELECT *, lag(m) OVER w AS pm FROM x0 WINDOW w AS (PARTITION BY doc_id, physical_page, row_index ORDER BY place)),
x2 AS (SELECT *, lag(x_pos + width) OVER w AS rx, lag(size) OVER w AS rs, lag(t) OVER w AS rt FROM x1 WHERE NOT (m AND coalesce(pm, false)) WINDOW w AS (PARTITION BY doc_id, physical_page, row_index ORDER BY place)),
x3 AS (SELECT *, CASE WHEN coalesce(rx IS NOT NULL AND (x_pos - rx > 0.1 * rs OR (regexp_matches(rt, '{word}$') AND regexp_matches(t, '^{word}') AND x_pos - rx > -0.3 * rs)) AND NOT regexp_matches(t, '^[.,;:?!)\]}}]'), false) THEN ' ' ELSE '' END || t AS piece FROM x2),
x4 AS (SELECT doc_id, physical_page, row_index, regexp_replace({trim("string_agg(piece, '' ORDER BY place)")}, '[\s\p{{Z}}]+', ' ', 'g') AS text FROM x3 GROUP BY ALL), x5 AS (SELECT doc_id, physical_page, row_index, arg_min(x_pos, place) AS left_x FROM gr WHERE x_pos IS NOT NULL OR place = 1 GROUP BY ALL),
x6 AS (SELECT doc_id, physical_page, row_index, first(x_pos ORDER BY place) AS left_x FROM gr GROUP BY ALL),
rt AS (SELECT x4.*, x6.left_x, CASE WHEN try_cast(regexp_extract(text, '^([0-9]{{1,5}})($|[\s\p{{Z}}])', 1) AS BIGINT) BETWEEN 1 AND 50 THEN try_cast(regexp_extract(text, '^([0-9]{{1,5}})($|[\s\p{{Z}}])', 1) AS BIGINT) END AS line_number FROM x4 JOIN x6 USING (doc_id, physical_page, row_index) WHERE text <> '')"""
    )


def _gutters() -> str:
    score = "CASE WHEN len(ns) >= 2 THEN list_sum(list_transform(range(1, len(ns)), lambda i: CASE WHEN ns[i + 1] > ns[i] AND ns[i + 1] - ns[i] <= 4 THEN 1 ELSE 0 END)) / (len(ns) - 1) ELSE 0.0e0 END"
    return f", g0 AS (SELECT doc_id, physical_page, list(line_number ORDER BY row_index) AS ns, list_sort(list(left_x) FILTER (left_x IS NOT NULL)) AS xs FROM rt WHERE line_number IS NOT NULL GROUP BY ALL), g1 AS (SELECT *, {score} AS seq, xs[len(xs) // 2 + 1] AS x FROM g0), gu AS (SELECT doc_id, physical_page, CASE WHEN len(ns) >= 5 AND list_min(ns) <= 6 AND list_max(ns) - list_min(ns) >= 5 AND seq >= 0.62 THEN x END AS gutter_x, CASE WHEN len(ns) >= 4 THEN x END AS likely_x, seq, len(ns) AS n FROM g1)"


def oracle_sql() -> dict[str, str]:
    page_line = r"(?i)^PAGE [\s\p{Z}]*\+?[0-9]+$"
    lines = "CASE WHEN t = '' THEN [] WHEN ends_with(t, chr(10)) THEN string_split(left(t, length(t) - 1), chr(10)) ELSE string_split(t, chr(10)) END"
    texts = _texts()
    seats = "row_number() OVER (PARTITION BY doc_id, physical_page ORDER BY y_pos DESC, coalesce(x_pos, 0), coalesce(sequence, 0))"
    parts = {
        # groups of a page as sums and counts; each fragment goes to the nearest mean within the tolerance, the first of equally near ones
        "visual_rows": "WITH RECURSIVE t AS (SELECT doc_id, physical_page, coalesce(greatest(0.65e0, least(3.0e0, 0.18e0 * l[len(l) // 2 + 1])), 1.5e0) AS tol FROM (SELECT doc_id, physical_page, list_sort(list(font_size) FILTER (font_size > 0.1)) AS l FROM fragments GROUP BY ALL)), "
        f"o AS (SELECT doc_id, physical_page, fragment_id, x_pos, y_pos, sequence, tol, {seats} AS k FROM fragments JOIN t USING (doc_id, physical_page) WHERE y_pos IS NOT NULL), "
        "s AS (SELECT DISTINCT doc_id, physical_page, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS fragment_id, CAST(NULL AS BIGINT) AS g, CAST([] AS STRUCT(s DOUBLE, c BIGINT)[]) AS gs FROM o UNION ALL "
        "SELECT doc_id, physical_page, k, fragment_id, coalesce(g, len(gs) + 1), CASE WHEN g IS NULL THEN list_append(gs, {'s': y_pos, 'c': CAST(1 AS BIGINT)}) ELSE list_transform(gs, lambda x, i: CASE WHEN i = g THEN {'s': x.s + y_pos, 'c': x.c + 1} ELSE x END) END FROM "
        "(SELECT *, CASE WHEN near <= tol THEN CAST(list_position(ds, near) AS BIGINT) END AS g FROM (SELECT *, list_min(ds) AS near FROM (SELECT o.*, s.gs, list_transform(s.gs, lambda x: abs(x.s / x.c - o.y_pos)) AS ds FROM s JOIN o ON o.doc_id = s.doc_id AND o.physical_page = s.physical_page AND o.k = s.k + 1)))), "
        "e AS (SELECT doc_id, physical_page, arg_max(gs, k) AS gs FROM s GROUP BY ALL), m AS (SELECT doc_id, physical_page, generate_subscripts(gs, 1) AS g, unnest(list_transform(gs, lambda x: x.s / x.c)) AS mean FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, physical_page ORDER BY mean DESC, g) - 1 AS row_no FROM m) "
        "SELECT s.doc_id, CAST(s.physical_page AS BIGINT) AS physical_page, s.fragment_id, row_no, row_number() OVER (PARTITION BY s.doc_id, s.physical_page, row_no ORDER BY coalesce(o.x_pos, 0), coalesce(o.sequence, 0), s.k) - 1 AS place FROM s JOIN n ON n.doc_id = s.doc_id AND n.physical_page = s.physical_page AND n.g = s.g JOIN o ON o.doc_id = s.doc_id AND o.physical_page = s.physical_page AND o.k = s.k WHERE s.k > 0",
        "anchored_rows": "WITH RECURSIVE t AS (SELECT doc_id, physical_page, greatest(1.0e0, least(3.5e0, 0.3e0 * median(font_size))) AS tol FROM fragments GROUP BY ALL), o AS (SELECT doc_id, physical_page, fragment_id, -(y_pos + height / 2) AS m, tol, row_number() OVER (PARTITION BY doc_id, physical_page ORDER BY -(y_pos + height / 2), x_pos, sequence, fragment_id) AS k FROM fragments JOIN t USING (doc_id, physical_page)), "
        "s AS (SELECT DISTINCT doc_id, physical_page, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS fragment_id, CAST(NULL AS DOUBLE) AS anchor, CAST(0 AS BIGINT) AS n FROM o UNION ALL SELECT o.doc_id, o.physical_page, o.k, o.fragment_id, CASE WHEN coalesce(abs(o.m - s.anchor) <= o.tol, false) THEN s.anchor ELSE o.m END, CASE WHEN coalesce(abs(o.m - s.anchor) <= o.tol, false) THEN s.n ELSE s.n + 1 END FROM s JOIN o ON o.doc_id = s.doc_id AND o.physical_page = s.physical_page AND o.k = s.k + 1) "
        "SELECT doc_id, CAST(physical_page AS BIGINT) AS physical_page, fragment_id, n AS row_no FROM s WHERE k > 0",
        # base lines of a page as a list; each letter goes to the nearest of the last five
        "glyph_words": f"WITH RECURSIVE f AS (SELECT *, width / length(text) AS cw FROM fragments WHERE text IS NOT NULL AND text <> ''), c AS (SELECT *, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM f), g AS (SELECT doc_id, physical_page, ch, x_pos + i * cw + sh AS x, y_pos AS y, cw, height, coalesce(font_size, 10.0) AS size, sequence * 1000 + i AS sq FROM (SELECT *, unnest(CASE WHEN sequence % 13 = 0 AND i = 2 THEN [0.0, 0.05] ELSE [0.0] END) AS sh FROM c)), "
        f"t AS (SELECT doc_id, physical_page, greatest(0.8e0, least(3.0e0, 0.24e0 * median(height))) AS tol FROM g WHERE {trim('ch')} <> '' GROUP BY ALL), ys AS (SELECT DISTINCT doc_id, physical_page, y, tol FROM g JOIN t USING (doc_id, physical_page)), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, physical_page ORDER BY y DESC) AS k FROM ys), "
        "s AS (SELECT DISTINCT doc_id, physical_page, CAST(0 AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS BIGINT) AS n, CAST([] AS DOUBLE[]) AS bs FROM o UNION ALL SELECT doc_id, physical_page, k, y, coalesce(near, len(bs) + 1), CASE WHEN near IS NULL THEN list_append(bs, y) ELSE bs END FROM (SELECT *, CASE WHEN d <= tol THEN CAST(start + list_position(ds, d) AS BIGINT) END AS near FROM (SELECT *, list_min(ds) AS d FROM (SELECT o.*, s.bs, greatest(0, len(s.bs) - 5) AS start, list_transform(s.bs[-5:], lambda b: abs(b - o.y)) AS ds FROM s JOIN o ON o.doc_id = s.doc_id AND o.physical_page = s.physical_page AND o.k = s.k + 1)))), "
        "e AS (SELECT doc_id, physical_page, arg_max(bs, k) AS bs FROM s GROUP BY ALL), a AS (SELECT g.*, s.n AS line_no, e.bs[s.n] AS base, row_number() OVER (PARTITION BY g.doc_id, g.physical_page, s.n ORDER BY g.x, g.y DESC, g.sq) AS r FROM g JOIN s ON s.doc_id = g.doc_id AND s.physical_page = g.physical_page AND s.y = g.y JOIN e ON e.doc_id = g.doc_id AND e.physical_page = g.physical_page), "
        f"b AS (SELECT *, {trim('ch')} = '' AS blank, coalesce(lag(ch) OVER w = ch AND abs(x - lag(x) OVER w) < 0.15 AND abs(y - lag(y) OVER w) < 0.15, false) AND {trim('ch')} <> '' AS again FROM a WINDOW w AS (PARTITION BY doc_id, physical_page, line_no ORDER BY r)), d AS (SELECT *, coalesce(x - lag(x + cw) OVER w > greatest(0.7e0, 0.22e0 * size), true) OR coalesce(lag(blank) OVER w, true) AS cut FROM b WHERE NOT again WINDOW w AS (PARTITION BY doc_id, physical_page, line_no ORDER BY r)), "
        "h AS (SELECT *, CAST(count_if(cut AND NOT blank) OVER (PARTITION BY doc_id, physical_page, line_no ORDER BY r ROWS UNBOUNDED PRECEDING) AS BIGINT) AS word_no FROM d) SELECT doc_id, CAST(physical_page AS BIGINT) AS physical_page, line_no, word_no, string_agg(ch, '' ORDER BY r) AS text, round(min(x), 3) AS x_pos, round(max(x + cw), 3) AS right_x, first(base) AS y_pos FROM h WHERE NOT blank GROUP BY doc_id, physical_page, line_no, word_no",
        "gutter_columns": f"WITH RECURSIVE o AS (SELECT doc_id, physical_page, fragment_id, n, e, y, row_number() OVER (PARTITION BY doc_id, physical_page ORDER BY e, y DESC, fragment_id) AS k FROM (SELECT doc_id, physical_page, fragment_id, CAST({trim('text')} AS INT) AS n, x_pos + coalesce(width, 0) AS e, y_pos AS y FROM fragments WHERE regexp_matches({trim('text')}, '^[0-9]{{1,3}}$') AND x_pos IS NOT NULL AND y_pos IS NOT NULL) WHERE n BETWEEN 1 AND 100), "
        "s AS (SELECT DISTINCT doc_id, physical_page, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS c, CAST([] AS DOUBLE[]) AS es, CAST(NULL AS VARCHAR) AS fragment_id, CAST(NULL AS INT) AS n, CAST(NULL AS DOUBLE) AS y FROM o UNION ALL SELECT o.doc_id, o.physical_page, o.k, CASE WHEN coalesce(abs(o.e - list_aggregate(s.es, 'median')) <= 7, false) THEN s.c ELSE s.c + 1 END, CASE WHEN coalesce(abs(o.e - list_aggregate(s.es, 'median')) <= 7, false) THEN list_append(s.es, o.e) ELSE [o.e] END, o.fragment_id, o.n, o.y FROM s JOIN o ON o.doc_id = s.doc_id AND o.physical_page = s.physical_page AND o.k = s.k + 1), "
        "p AS (SELECT *, lag(n) OVER (PARTITION BY doc_id, physical_page, c ORDER BY y DESC, k) AS b FROM s WHERE k > 0), g AS (SELECT doc_id, physical_page, c FROM p GROUP BY ALL HAVING count(DISTINCT n) >= 4 AND max(n) - min(n) >= 3 AND count_if((n > b AND n - b <= 3) OR (n <= 3 AND b >= 8)) / greatest(1, count(*) - 1) >= 0.65) SELECT p.doc_id, CAST(p.physical_page AS BIGINT) AS physical_page, p.c AS column_no, p.fragment_id FROM p JOIN g USING (doc_id, physical_page, c)",
        "masked_words": "WITH m AS (SELECT doc_id, physical_page, min(x_pos) + 20 AS a, min(y_pos) + 4 AS b, max(x_pos + width) AS c, max(y_pos + height) + 4 AS d FROM fragments WHERE row_index % 10 = 3 GROUP BY doc_id, physical_page, row_index), k AS (SELECT f.* FROM fragments f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = f.doc_id AND m.physical_page = f.physical_page AND width * height > 0 AND greatest(0, least(f.x_pos + width, c) - greatest(f.x_pos, a)) * greatest(0, least(f.y_pos + height, d) - greatest(f.y_pos, b)) / (width * height) > 0.25)) "
        "SELECT doc_id, CAST(physical_page AS BIGINT) AS physical_page, text, round(x_pos, 4) AS x_pos, round(y_pos, 4) AS y_pos, round(width, 4) AS width, round(height, 4) AS height, false AS masked FROM k UNION ALL SELECT DISTINCT doc_id, CAST(physical_page AS BIGINT), '[REDACTED]', round(a, 4), round(b, 4), round(c - a, 4), round(d - b, 4), true FROM m",
        "decoded_files": "WITH d AS (SELECT doc_id, text, doc_id % 6 AS n, doc_id % 5 AS e FROM documents WHERE text IS NOT NULL), x AS (SELECT *, CASE WHEN e IN (0, 1) THEN 'text' WHEN e = 2 THEN 'pdf' END AS kind, n >= 4 AS bad FROM d), y AS (SELECT *, CASE WHEN kind IS NULL THEN 'unsupported_file_type' WHEN kind = 'pdf' THEN 'not_a_pdf' WHEN bad THEN 'invalid_encoding' END AS error FROM x) "
        "SELECT CAST(doc_id AS VARCHAR) AS doc_id, kind, error, CASE WHEN error IS NULL THEN text END AS text, CASE n WHEN 0 THEN sha256(text) WHEN 1 THEN sha256(unhex('EFBBBF') || encode(text)) WHEN 5 THEN sha256(unhex('FF20') || encode(text)) ELSE NULL END AS source_sha256 FROM y",
        "split_pages": f"WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, '.' || chr(10), '.' || chr(12)) WHEN 1 THEN chr(10) || ' ' || chr(10) || replace(text, '.' || chr(10), '.' || chr(10) || ' page  12 ' || chr(10) || chr(10)) ELSE text END AS t FROM documents WHERE text IS NOT NULL), "
        f"f0 AS (SELECT doc_id, string_split(t, chr(12)) AS ps FROM d WHERE contains(t, chr(12))), f1 AS (SELECT doc_id, CASE WHEN {trim('ps[-1]')} = '' THEN ps[:-2] ELSE ps END AS ps FROM f0), f2 AS (SELECT doc_id, generate_subscripts(ps, 1) AS physical_page, unnest(ps) AS text FROM f1), "
        f"l0 AS (SELECT doc_id, list_transform({lines}, lambda l: regexp_replace(l, chr(13) || '$', '')) AS ls FROM d WHERE NOT contains(t, chr(12))), l1 AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM l0), l2 AS (SELECT *, count_if(regexp_matches({trim('l')}, {q(page_line)})) OVER w AS n, count_if({trim('l')} <> '') OVER w AS seen FROM l1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)), "
        f"l3 AS (SELECT *, bool_or(n = 0 AND {trim('l')} <> '') OVER (PARTITION BY doc_id) AS intro FROM l2 WHERE seen > 0), l4 AS (SELECT doc_id, n + CASE WHEN intro THEN 1 ELSE 0 END AS physical_page, string_agg(l, chr(10) ORDER BY i) AS text FROM l3 WHERE intro OR n > 0 GROUP BY ALL) SELECT doc_id, CAST(physical_page AS BIGINT) AS physical_page, text FROM f2 UNION ALL SELECT doc_id, CAST(physical_page AS BIGINT), text FROM l4",
        "joined_lines": f"WITH {R}, a AS (SELECT doc_id, physical_page, row_index, list_filter([CAST(line_number AS VARCHAR), CASE WHEN row_index % 7 = 3 THEN ' 9 ' END, coalesce(text, ''), CASE WHEN row_index % 5 = 2 THEN '13A. Yes.' END], lambda x: x IS NOT NULL) AS ls FROM r), b AS (SELECT doc_id, physical_page, row_index, unnest(ls) AS l0, generate_subscripts(ls, 1) AS j FROM a), "
        f"c AS (SELECT *, regexp_replace(l0, '^([0-9]{{1,2}})([QA][.:])', '\\1 \\2') AS l, row_number() OVER (PARTITION BY doc_id, physical_page ORDER BY row_index, j) AS i FROM b), d AS (SELECT *, regexp_matches({trim('l')}, '^(?:[1-9]|[1-4][0-9]|50)$') AS lone FROM c), e AS (SELECT *, i - coalesce(max(CASE WHEN NOT lone THEN i END) OVER (PARTITION BY doc_id, physical_page ORDER BY i), 0) AS k, lead(l) OVER (PARTITION BY doc_id, physical_page ORDER BY i) AS nxt FROM d), "
        f"f AS (SELECT *, coalesce(lag(lone AND k % 2 = 1) OVER (PARTITION BY doc_id, physical_page ORDER BY i), false) AS taken FROM e) SELECT doc_id, CAST(physical_page AS BIGINT) AS physical_page, string_agg(CASE WHEN lone AND k % 2 = 1 AND nxt IS NOT NULL THEN {trim('l')} || ' ' || {trim('nxt')} ELSE l END, chr(10) ORDER BY i) AS lines FROM f WHERE NOT taken GROUP BY doc_id, physical_page",
        "dark_colours": "WITH x AS (SELECT l_orderkey, l_linenumber, l_linenumber % 4 AS n, CAST(l_discount AS DOUBLE) AS d, CAST(l_tax AS DOUBLE) AS t FROM lineitem) SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE n WHEN 0 THEN d + t <= 0.12 WHEN 1 THEN d <= 0.12 AND t <= 0.12 AND d + t <= 0.12 WHEN 2 THEN 0.6 + 2 * d >= 0.75 AND d <= 0.35 AND t * 5 <= 0.35 AND d * 4 <= 0.35 ELSE false END AS is_dark FROM x",
        "rectangle_signals": "WITH x AS (SELECT doc_id, physical_page, fragment_id, width AS w, height * (sequence % 3 + 1) / 4 AS h, (sequence % 4) * 0.05 <= 0.12 AS dark, row_index, sequence FROM fragments), y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, physical_page ORDER BY row_index, sequence, fragment_id) AS n FROM x WHERE w >= 2 AND h >= 2) SELECT doc_id, fragment_id, dark AS is_dark, dark AND w BETWEEN 18 AND 520 AND h BETWEEN 4 AND 36 AS possible_redaction FROM y WHERE n <= 40",
        "annotation_signals": "WITH x AS (SELECT DISTINCT participant_key, ['Redact', 'Square', 'highlight', 'Polygon', 'Link', 'text', 'REDACT', 'Ink'][participant_key % 8 + 1] AS subtype, coalesce(role_confidence, 0) / 8 <= 0.12 AND coalesce(function_confidence, 0) / 8 <= 0.12 AS dark FROM participants) SELECT participant_key, subtype, lower(subtype) = 'redact' AS is_explicit_redaction, lower(subtype) IN ('square', 'highlight', 'polygon', 'redact') AND dark AS is_dark_overlay_candidate FROM x",
        "affine_points": "WITH x AS (SELECT doc_id, fragment_id, 2.0e0 * x_pos - y_pos + font_size AS u, 0.5e0 * x_pos + 1.5e0 * y_pos + 3.0e0 AS v, font_size FROM fragments WHERE x_pos IS NOT NULL AND y_pos IS NOT NULL AND font_size IS NOT NULL) SELECT doc_id, fragment_id, round(0.25e0 * u + 0.5e0 * v - 7.0e0, 4) AS x, round(4.0e0 * v + font_size, 4) AS y, true AS same FROM x",
        "ocr_need": "WITH x AS (SELECT *, CAST(l_quantity AS DOUBLE) AS qn, CAST(l_extendedprice AS DOUBLE) / 100 AS g FROM lineitem) SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, (qn * 12 < 30 AND l_linenumber % 2 = 0) OR qn / 4 > greatest(5.0, 0.03 * g) OR (CAST(l_discount AS DOUBLE) * 5 > 0.35 AND qn * 12 < 500) OR CAST(l_tax AS DOUBLE) * 300 > greatest(5.0, 0.25 * g) AS needs_ocr FROM x",
        "box_overlaps": "WITH f AS (SELECT doc_id, physical_page, row_index, fragment_id, x_pos AS a, y_pos AS b, x_pos + width AS c, y_pos + 3 * height AS d FROM fragments WHERE x_pos IS NOT NULL AND y_pos IS NOT NULL), u AS (SELECT doc_id, physical_page, row_index, min(a) AS ua, min(b) AS ub, max(c) AS uc, max(d) AS ud FROM f GROUP BY ALL) "
        "SELECT f.doc_id, f.fragment_id, round(CASE WHEN (c - a) * (d - b) > 0 THEN greatest(0, least(c, v.uc) - greatest(a, v.ua)) * greatest(0, least(d, v.ud) - greatest(b, v.ub)) / ((c - a) * (d - b)) ELSE 0 END, 6) AS share, round(u.ua, 4) AS left_x, round(u.uc, 4) AS right_x FROM f JOIN u USING (doc_id, physical_page, row_index) JOIN u v ON v.doc_id = f.doc_id AND v.physical_page = f.physical_page AND v.row_index = f.row_index - 1",
        "given_row_texts": f"WITH {texts} SELECT doc_id, CAST(physical_page AS BIGINT) AS physical_page, CAST(row_index AS BIGINT) AS row_no, text, left_x, line_number FROM rt",
        "given_gutters": f"WITH {texts}{_gutters()} SELECT doc_id, CAST(physical_page AS BIGINT) AS physical_page, gutter_x, likely_x, round(seq, 6) AS tolerant_sequence, n AS numbered_rows FROM gu",
        "inherited_gutters": f"WITH {texts}{_gutters()}, h0 AS (SELECT doc_id, physical_page, first(left_x ORDER BY row_index) AS fx, first(line_number ORDER BY row_index) IS NOT NULL AS fn FROM rt GROUP BY ALL), h1 AS (SELECT h0.*, n, coalesce(gutter_x, likely_x) AS g FROM h0 LEFT JOIN gu USING (doc_id, physical_page)), h2 AS (SELECT a.doc_id, a.physical_page, list_sort(list(b.g) FILTER (b.n >= 8 AND b.g IS NOT NULL)) AS near FROM h1 a JOIN h1 b ON b.doc_id = a.doc_id AND b.physical_page BETWEEN a.physical_page - 2 AND a.physical_page + 2 GROUP BY ALL), "
        "h3 AS (SELECT h1.*, near[len(near) // 2 + 1] AS mid FROM h1 JOIN h2 USING (doc_id, physical_page)) SELECT doc_id, CAST(physical_page AS BIGINT) AS physical_page, CASE WHEN coalesce(coalesce(n, 0) < 8 AND fn AND abs(fx - mid) <= 8, false) THEN mid ELSE g END AS gutter_x FROM h3",
        "given_reconstruction": f"WITH {texts}, {R}, pg AS (SELECT doc_id, physical_page, length(regexp_replace(string_agg(coalesce(raw_text, ''), chr(10) ORDER BY row_index), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS m FROM r GROUP BY ALL), k AS (SELECT doc_id, physical_page, sum(length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g'))) AS n, count(*) AS c FROM rt GROUP BY ALL) SELECT doc_id, CAST(physical_page AS BIGINT) AS physical_page, round(CASE WHEN n > 0 THEN least(1.0, 0.6 * CASE WHEN coalesce(m, 0) = 0 THEN 1.0 ELSE least(1.0, n / m) END + 0.2 * least(1.0, c / 8) + 0.2) ELSE 0.0 END, 6) AS reconstruction_confidence FROM k LEFT JOIN pg USING (doc_id, physical_page)",
        "column_splits": "WITH sf AS (SELECT * REPLACE (x_pos + CASE WHEN sequence % 2 = 1 THEN 260.0 ELSE 0.0 END AS x_pos) FROM fragments), gr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, physical_page, row_index ORDER BY x0, sequence) AS place FROM (SELECT s.*, f.x_pos AS x0 FROM sf s JOIN fragments f USING (doc_id, fragment_id)))"
        + texts[len(_ROWS.format(src="fragments")) :]
        + ", s0 AS (SELECT doc_id, physical_page, max(x_pos + width) - min(x_pos) AS w FROM sf GROUP BY ALL), s1 AS (SELECT *, lag(x_pos + width) OVER (PARTITION BY doc_id, physical_page, row_index ORDER BY x_pos) AS l FROM sf), s2 AS (SELECT s1.*, floor((x_pos + l) / 20) AS bin FROM s1 JOIN s0 USING (doc_id, physical_page) WHERE l IS NOT NULL AND x_pos - l >= 0.08 * w), s3 AS (SELECT doc_id, physical_page, bin, count(DISTINCT row_index) AS n, avg((x_pos + l) / 2) AS sx FROM s2 GROUP BY ALL HAVING count(DISTINCT row_index) >= 4), "
        "s4 AS (SELECT doc_id, physical_page, arg_max(sx, n * 1000000 - bin) AS sx FROM s3 GROUP BY ALL), s5 AS (SELECT rt.*, CASE WHEN left_x >= sx THEN 1 ELSE 0 END AS pane FROM rt LEFT JOIN s4 USING (doc_id, physical_page)) SELECT doc_id, CAST(physical_page AS BIGINT) AS physical_page, CAST(row_index AS BIGINT) AS row_no, CAST(pane AS BIGINT) AS pane, row_number() OVER (PARTITION BY doc_id, physical_page ORDER BY pane, row_index) AS reading_no FROM s5",
    }
    # the same over the visual rows instead of the delivered ones
    seen = f"vf AS (SELECT f.* REPLACE (v.row_no AS row_index) FROM fragments f JOIN ({parts['visual_rows']}) v ON v.doc_id = f.doc_id AND v.physical_page = f.physical_page AND v.fragment_id = f.fragment_id)"
    for own, given in (("row_texts", "given_row_texts"), ("printed_gutters", "given_gutters"), ("reconstruction", "given_reconstruction")):
        parts[own] = parts[given].replace("WITH " + _ROWS.format(src="fragments"), f"WITH {seen}, " + _ROWS.format(src="vf"), 1)
    share = "list_sum(list_transform(range(1, len(ns)), lambda i: CASE WHEN ns[i + 1] > ns[i] AND ns[i + 1] - ns[i] <= 4 THEN 1 ELSE 0 END)) / (len(ns) - 1)"
    parts["number_columns"] = (
        f"WITH {seen}, ex AS (SELECT doc_id, physical_page, min(x_pos) AS lo, max(x_pos + greatest(0, width)) AS hi, count(DISTINCT row_index) AS rows FROM vf GROUP BY ALL), ln AS (SELECT doc_id, physical_page, row_index, x_pos, CAST({trim('text')} AS INT) AS n FROM vf WHERE regexp_matches({trim('text')}, '^[0-9]{{1,2}}$') AND CAST({trim('text')} AS INT) BETWEEN 1 AND 50), sd AS (SELECT DISTINCT doc_id, physical_page, x_pos AS seed FROM ln), "
        "nr AS (SELECT doc_id, physical_page, seed, row_index, arg_min(n, x_pos) AS n, min(x_pos) AS x FROM sd JOIN ln USING (doc_id, physical_page) WHERE abs(x_pos - seed) <= 12 GROUP BY ALL), cl AS (SELECT doc_id, physical_page, seed, list(n ORDER BY row_index) AS ns, list_sort(list(x)) AS xs FROM nr GROUP BY ALL), "
        f"sc AS (SELECT *, xs[len(xs) // 2 + 1] AS x, CASE WHEN len(ns) >= 2 THEN {share} ELSE 0.0e0 END AS seq, list_max(ns) - list_min(ns) AS spread FROM cl), "
        "sv AS (SELECT sc.*, 0.55e0 * seq + 0.2e0 * least(1.0e0, len(ns) / rows) + 0.15e0 * greatest(0.0e0, 1 - least(abs(x - lo), abs(hi - x)) / (greatest(1.0e0, hi - lo) / 2)) + 0.1e0 * least(1.0e0, spread / 20) AS score FROM sc JOIN ex USING (doc_id, physical_page) WHERE len(list_distinct(ns)) >= 5 AND list_min(ns) <= 6 AND spread >= 5 AND seq >= 0.62) "
        "SELECT doc_id, CAST(physical_page AS BIGINT) AS physical_page, first(x ORDER BY score DESC, seed) AS x, round(max(score), 6) AS score FROM sv GROUP BY doc_id, physical_page"
    )
    return parts
