"""DuckDB SQL for the queries that SQL can say, over the view ``documents``. Where it cannot (edit
distances, tokenizers, learned models, spans of terms, windows by token budgets), the tests compare
the query with brute force, a round trip or held-out labels instead."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_WORDS = r"regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op8_quality_cascade"] = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS text, {_WORDS} AS w,
         list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS rows_with_words
  FROM documents),
windows AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs) AS x),
twice AS (SELECT r, i FROM windows QUALIFY COUNT(*) OVER (PARTITION BY r, a, b, c) > 1),
repeated AS (SELECT r, COUNT(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) AS three GROUP BY r),
figures AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(rows_with_words) - len(list_distinct(rows_with_words)) AS BIGINT) AS n_dup_lines,
         CAST(COALESCE(n, 0) AS BIGINT) AS n_repeat_words, len(rows_with_words) AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower
  FROM docs LEFT JOIN repeated USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 30 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR n_upper > n_lower
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM figures"""

ORACLES["op4_minhash_near_dups"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) >= 1 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS one, b.doc_id AS two, COUNT(*) AS n FROM items AS a JOIN items AS b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (
  SELECT one, two FROM common JOIN sets AS p ON p.doc_id = one JOIN sets AS q ON q.doc_id = two
  WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
ways AS (SELECT one AS a, two AS b FROM linked UNION ALL SELECT two, one FROM linked),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reached.a, ways.b FROM reached JOIN ways ON reached.b = ways.a),
least AS (SELECT a AS doc_id, MIN(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)"""

ORACLES["op2_suffix_lpf_dedup"] = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
starts AS (
  SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS m
  FROM (SELECT r, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 399)) AS i FROM docs) AS x),
found AS (SELECT r, i FROM starts QUALIFY COUNT(*) OVER (PARTITION BY m) > 1),
marks AS (SELECT r, i, CASE WHEN i - LAG(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM found),
numbered AS (SELECT r, i, SUM(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM marks),
spans AS (SELECT r, k, MIN(i) AS b, MAX(i) + 400 AS e FROM numbered GROUP BY r, k),
gaps AS (
  SELECT r, b AS place, COALESCE(LAG(e) OVER (PARTITION BY r ORDER BY b), 0) AS gap_begin, b AS gap_end FROM spans
  UNION ALL
  SELECT docs.r, length(h), COALESCE((SELECT MAX(e) FROM spans WHERE spans.r = docs.r), 0), CAST(length(h) / 2 AS BIGINT) FROM docs),
kept AS (
  SELECT gaps.r, string_agg(substr(h, 2 * gap_begin + 1, 2 * (gap_end - gap_begin)), '' ORDER BY place) AS h
  FROM gaps JOIN docs USING (r) GROUP BY gaps.r),
sums AS (SELECT r, SUM(e - b) AS n, COUNT(*) AS k FROM spans GROUP BY r)
SELECT doc_id, CAST(length(docs.h) / 2 AS BIGINT) AS n_bytes, CAST(COALESCE(sums.n, 0) AS BIGINT) AS n_removed,
       CAST(COALESCE(sums.k, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM docs JOIN kept USING (r) LEFT JOIN sums USING (r)"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, over the one-row view ``crc_table`` (``steps``)."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, steps[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), 4294967295)"


_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM range(256) AS t(i))"""

_BASE32 = "list_aggregate(list_transform(range(8), lambda b: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, CAST(5 * b + 1 AS INTEGER), 5) AS BIGINT) >> s) & 31) + 1 AS INTEGER), 1)), 'string_agg', '')), 'string_agg', '')"

ORACLES["op11_warc_archives"] = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, url, sha1(COALESCE(html, '')) AS hex, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS payload_bytes FROM pages),
ranked AS (
  SELECT page_id, payload_bytes, hex, row_number() OVER same AS place, first_value(page_id) OVER same AS top
  FROM p WINDOW same AS (PARTITION BY hex ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST, r))
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN top END AS refers_to
FROM ranked"""

# The cheapest edits from the front: of each row the least cost, then audit, by what stood last.
ORACLES["op12_turn_repair"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
base AS (
  SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
         {_crc32("COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ')")} % 20 AS k
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM base WHERE k <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
         right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS final, left(role, 1) AS r
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS i FROM damaged) AS d),
marked AS (
  SELECT *, final = '' AS blank, final <> '' AND seen AS twice, final <> '' AND NOT seen AND final NOT IN ('.', '!', '?') AS cut,
         lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
ids AS (SELECT DISTINCT conv_id FROM conversations),
best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, last, {{'cost': CAST(cost AS BIGINT), 'audit': audit, 'lines': lines}} AS b
  FROM ids, (VALUES ('', 0, '', CAST([] AS VARCHAR[])), ('u', 5, 'I', ['user:']), ('a', 10, 'II', ['user:', 'assistant:'])) AS start(last, cost, audit, lines)
  UNION ALL
  SELECT conv_id, i, last, min(b) FROM (
    SELECT conv_id, i, n.last, {{'cost': s.cost + n.cost, 'audit': s.audit || n.audit, 'lines': list_concat(s.lines, n.lines)}} AS b
    FROM (
      SELECT m.conv_id, m.i, e.last, best.b.cost + e.cost AS cost, best.b.audit || e.audit AS audit, list_concat(best.b.lines, e.lines) AS lines
      FROM best JOIN marked AS m ON m.conv_id IS NOT DISTINCT FROM best.conv_id AND m.i = best.i + 1,
      LATERAL (
        SELECT best.last AS last, 2 AS cost, 'D' AS audit, CAST([] AS VARCHAR[]) AS lines
        UNION ALL SELECT m.r, CASE WHEN m.cut THEN 5 ELSE 0 END, 'K', [m.role || ':' || m.text]
                  WHERE NOT m.blank AND NOT m.twice AND m.r <> '' AND (best.last || m.r) IN ('s', 'u', 'su', 'ua', 'au')
        UNION ALL SELECT CASE WHEN best.last = 'u' THEN 'a' ELSE 'u' END, CASE WHEN m.cut THEN 6 ELSE 1 END, 'R',
                         [CASE WHEN best.last = 'u' THEN 'assistant' ELSE 'user' END || ':' || m.text]
                  WHERE NOT m.blank AND NOT m.twice) AS e) AS s,
    LATERAL (
      SELECT s.last AS last, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines
      UNION ALL SELECT CASE WHEN s.last = 'u' THEN 'a' ELSE 'u' END, 5, 'I', [CASE WHEN s.last = 'u' THEN 'assistant:' ELSE 'user:' END]
      UNION ALL SELECT CASE WHEN s.last = 'u' THEN 'u' ELSE 'a' END, 10, 'II',
                       CASE WHEN s.last = 'u' THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END) AS n) AS x
  GROUP BY conv_id, i, last),
found AS (
  SELECT conv_id, count(*) AS n, COALESCE(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (twice) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (before IS NOT NULL AND (before || r) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id),
ends AS (
  SELECT ids.conv_id, f.gaps, f.blank, f.duplicate, f.truncated, f.illegal, min(best.b) AS b
  FROM ids LEFT JOIN found AS f ON f.conv_id IS NOT DISTINCT FROM ids.conv_id
  JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id AND best.i = COALESCE(f.n, 0) AND best.last IN ('', 'a')
  GROUP BY ALL)
SELECT conv_id, CAST(COALESCE(gaps, 0) AS BIGINT) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate,
       COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal, b.cost AS cost, b.audit AS audit,
       sha256(array_to_string(b.lines, chr(10))) AS repaired_sha256
FROM ends"""


def _field(value: str) -> str:
    return f"COALESCE(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))

ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE {_CRC_TABLE},
made AS (
  SELECT doc_id, source, {_LEAF} || {_field('text')}) AS leaf, {_LEAF} || {_field("replace(text, chr(10), '')")}) AS cut,
         doc_id IS NOT NULL AND {_crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0 AS chosen
  FROM documents, crc_table),
leaves AS (
  SELECT doc_id, source, leaf, CASE WHEN chosen THEN cut ELSE leaf END AS seen,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM made),
nodes AS (
  SELECT 0 AS level, source, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, source, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY level, source, pos // 3, n),
subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS sources, level AS depth FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place AS pos, sources AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 3, n),
climbs AS (
  SELECT l.doc_id, l.source, l.pos, l.leaf, l.seen, s.subroot, s.depth, s.place FROM leaves AS l JOIN subroots AS s ON l.source IS NOT DISTINCT FROM s.source),
sides AS (
  SELECT c.source, c.pos, n.level, n.pos AS spot, n.h, c.pos // CAST(pow(3, n.level) AS BIGINT) AS own
  FROM climbs AS c JOIN nodes AS n ON n.source IS NOT DISTINCT FROM c.source AND n.n > 1 AND n.pos // 3 = c.pos // CAST(pow(3, n.level + 1) AS BIGINT)
  UNION ALL
  SELECT c.source, c.pos, c.depth + t.level, t.pos, t.h, c.place // CAST(pow(3, t.level) AS BIGINT)
  FROM climbs AS c JOIN tops AS t ON t.n > 1 AND t.pos // 3 = c.place // CAST(pow(3, t.level + 1) AS BIGINT)),
steps AS (
  SELECT source, pos, level, COALESCE(string_agg(h, '' ORDER BY spot) FILTER (spot < own), '') AS l, COALESCE(string_agg(h, '' ORDER BY spot) FILTER (spot > own), '') AS r
  FROM sides GROUP BY source, pos, level),
paths AS (SELECT source, pos, string_agg(l || r, '' ORDER BY level) AS proof, list(l || ':' || r ORDER BY level) AS path FROM steps GROUP BY source, pos),
folds AS (
  SELECT c.*, COALESCE(p.proof, '') AS proof, list_reduce(list_prepend(c.seen, COALESCE(p.path, [])), lambda h, p: sha256(split_part(p, ':', 1) || h || split_part(p, ':', 2))) AS folded_root,
         (SELECT h FROM tops WHERE n = 1) AS root
  FROM climbs AS c LEFT JOIN paths AS p ON c.source IS NOT DISTINCT FROM p.source AND c.pos = p.pos)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM folds"""
