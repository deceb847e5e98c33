"""DuckDB SQL for the operators' queries, where SQL can express them. Written out by
hand: it shares no constant with the code that it checks."""

_SPACES = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

OP2 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split(translate(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), {_SPACES}, '      '), ' '), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 85 * (x.n + y.n - inter)
), both_ways AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b FROM reach r JOIN both_ways ON r.node = a
)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.node) AS component_id, r.doc_id = min(r.node) AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP4 = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
), steps AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start')
            || '>' || role AS step FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g'))) AS BIGINT) AS formatted_chars,
  bool_and(step IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user',
                    'assistant>tool', 'tool>assistant')) AS in_order
FROM steps GROUP BY conv_id
"""

OP6 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text,
    list_filter(string_split(translate(text, {_SPACES}, '      '), ' '), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: length(replace(translate(x, {_SPACES}, '      '), ' ', '')) > 0) AS l
  FROM d
), g AS (
  SELECT doc_id, unnest(range(len(w) - 4)) AS i, w FROM w WHERE len(w) >= 5
), n AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(w, i + 1, i + 5), ' ')) AS n FROM g
), c AS (
  SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS c FROM n WHERE n > 1
), r AS (
  SELECT doc_id, sum(c) AS n FROM c GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w) AS n_words, length(replace(translate(text, {_SPACES}, '      '), ' ', '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN (
      'the','of','and','to','in','is','that','for','it','on','with','as','was','at','by',
      'der','die','das','und','den','von','zu','mit','ist','auf','für','nicht','ein','eine',
      'le','la','les','de','des','et','un','une','du','que','qui','dans','pour','est',
      'el','los','las','y','en','se','por','con','del','su','no','al','es'))) AS n_stop
  FROM w LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.1
    AND (n_words < 50 OR n_stop / n_words >= 0.02) AND n_dup_lines / n_lines <= 0.5 AS kept
FROM b
"""

OP9 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS bytes FROM pages
), k AS (
  SELECT *, CASE WHEN bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS keeper FROM p
)
SELECT page_id, bytes AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN coalesce(page_id <> keeper, false) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to, true AS verified
FROM k
"""

OP10 = """
WITH RECURSIVE l AS (
  SELECT doc_id, i - 1 AS place, parts[i] AS part, lower(trim(parts[i], chr(32)||chr(9)||chr(13)||chr(11)||chr(12))) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
        FROM documents)
), c AS (
  SELECT DISTINCT line FROM l WHERE strlen(line) >= 25
), v AS (
  SELECT line, string_split(line, ' ') AS w FROM c
), s AS (
  SELECT DISTINCT line, unnest(CASE WHEN length(line) <= 200 OR length(line) > 16 * len(w)
    THEN list_transform(range(1, length(line) - 3), lambda i: substr(line, i, 5))
    ELSE list_transform(range(1, len(w) + 1), lambda i: w[i] || ' ' || coalesce(left(w[i + 1], 1), '')) END) AS s FROM v
), n AS (
  SELECT line, count(*) AS n FROM s GROUP BY line
), e AS (
  SELECT a, b FROM (
    SELECT x.line AS a, y.line AS b, count(*) AS inter FROM s x JOIN s y ON x.s = y.s AND x.line < y.line GROUP BY ALL)
  JOIN n x ON x.line = a JOIN n y ON y.line = b WHERE 100 * inter >= 80 * (x.n + y.n - inter)
), both_ways AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach(line, node) AS (
  SELECT line, line FROM c UNION SELECT r.line, b FROM reach r JOIN both_ways ON r.node = a
), g AS (
  SELECT line, min(node) AS component FROM reach GROUP BY line
), k AS (
  SELECT l.doc_id, l.place, l.part, l.line = '' OR row_number() OVER (
    PARTITION BY coalesce(component, l.line) ORDER BY l.doc_id, l.place) = 1 AS stays
  FROM l LEFT JOIN g ON g.line = l.line
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(k.part, chr(10) ORDER BY k.place) FILTER (WHERE k.stays), '') END AS text,
  count(*) FILTER (WHERE NOT k.stays) AS n_removed
FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id, d.text
"""

OP11 = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split(
    translate(coalesce(text, ''), {_SPACES}, '      '), ' '), lambda x: x <> '') AS w FROM documents
), f AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
    len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d,
    d.doc_id > min(d.doc_id) OVER (PARTITION BY text) AS e
  FROM d LEFT JOIN labels USING (doc_id)
), m AS (
  SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'],
    lambda x: CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE coalesce(e, false) END) AS fails FROM f
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT v.x || w.x || y.x || z.x || u.x AS filter_order FROM letters v, letters w, letters y, letters z, letters u
  WHERE len(list_distinct([v.x, w.x, y.x, z.x, u.x])) = 5
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS here,
    string_split(substr(filter_order, 1, step - 1), '') AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)
), h AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL
), r AS (
  SELECT part, filter_order, step, here, n, good, toxic, fails, list_contains(fails, here) AS hit, len(list_intersect(fails, before)) > 0 AS gone
  FROM h, steps
), s AS (
  SELECT part, here, sum(n) AS shapley FROM r WHERE hit AND NOT gone GROUP BY ALL
)
SELECT part, filter_order, step,
  CAST(sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN hit AND len(fails) = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN hit AND NOT gone AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN hit AND NOT gone AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(coalesce(any_value(s.shapley), 0) AS BIGINT) AS shapley
FROM r LEFT JOIN s USING (part, here) GROUP BY part, filter_order, step
"""

OP12 = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split(translate(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:!?' || chr(11) || chr(12) || chr(13),
    repeat(chr(10), 9)), chr(10))) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM p
), g AS (
  SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 30
), cuts AS (
  SELECT lang, k, phrase, a, j, array_to_string(list_slice(w, 1, j), ' ') AS x, array_to_string(list_slice(w, j + 1, k), ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
), s AS (
  SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 2000000 * CAST(a AS HUGEINT) // (x.f + y.f), j) AS nth
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.x AND x.k = c.j JOIN f y ON y.lang = c.lang AND y.phrase = c.y AND y.k = c.k - c.j
), inside AS (
  SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS over
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest(range(2, 4)) AS m) WHERE m < k) GROUP BY ALL
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase WHERE nth = 1 AND (over IS NULL OR 100 * over < 80 * a)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

SQL = {"op11_filter_audit": OP11, "op12_collocations": OP12, "op10_line_dedup": OP10, "op2_near_dups": OP2, "op4_chat": OP4, "op6_quality": OP6, "op9_warc": OP9}
