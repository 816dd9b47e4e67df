"""The queries' results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op9_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN 'n' ELSE 's' END || coalesce(source, '') AS here
  FROM documents),
per AS (
  SELECT source, here, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w
  FROM sized GROUP BY source, here),
walk AS (
  SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / w AS reach FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
  FROM walk
  WINDOW before AS (ORDER BY reach, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
target AS (
  SELECT here, source_size,
         coalesce(least(w * (SELECT level FROM levels WHERE level <= reach ORDER BY reach, level LIMIT 1), cap::DOUBLE), 0.0) AS target
  FROM levels),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY here ORDER BY
           CASE WHEN size < 8 THEN size ELSE length(bin(size)) * 8 + (size >> (length(bin(size)) - 4)) % 8 END,
           md5('mix-1' || coalesce(doc_id::VARCHAR, '-')), doc_id) AS rank
  FROM sized),
placed AS (
  SELECT doc_id, size, source_size, target, rank,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix-1' || here), 1, 12))::BIGINT / 281474976710656.0 AS u
  FROM ranked JOIN target USING (here))
SELECT doc_id, size, source_size, target,
       ((floor(rate * rank + u) - floor(rate * (rank - 1) + u))::BIGINT * size)::BIGINT AS taken
FROM placed
"""

SQL["op6_positional_index"] = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[i:i + least(12, len(w) - 1)] AS p, least(13, len(w)) AS n
  FROM items, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i)
  WHERE len(w) > 0),
starts AS (SELECT r, unnest(range(1, len(w) + 1)) AS i FROM docs),
cut AS (
  SELECT r, i, n, w[i:i + n - 1] AS p
  FROM starts JOIN docs USING (r), (SELECT DISTINCT n FROM windows)
  WHERE i + n - 1 <= len(w)),
hits AS (SELECT r, i, cut.n, item_id FROM cut JOIN windows ON cut.p = windows.p AND cut.n = windows.n),
covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
named AS (SELECT r, list_sort(list(DISTINCT item_id)) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

SQL["op2_block_anchors"] = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, r, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13),
windows AS (SELECT starts.doc_id, starts.r, i, md5(array_to_string(w[i:i + 12], ' ')) AS p FROM starts JOIN docs USING (r)),
firsts AS (SELECT p, min(doc_id) AS least FROM windows GROUP BY p),
covered AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS j FROM windows JOIN firsts USING (p) WHERE least < doc_id),
gone AS (SELECT r, list(j) AS js, count(*) AS n FROM covered GROUP BY r),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM docs),
kept AS (
  SELECT words.r, string_agg(word, ' ' ORDER BY words.j) AS body
  FROM words LEFT JOIN covered ON covered.r = words.r AND covered.j = words.j
  WHERE covered.j IS NULL GROUP BY words.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""

SQL["op7_boilerplate"] = r"""
WITH pages_text AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
         regexp_replace(regexp_replace(regexp_replace(html,
           '(?is)<(?:script|style|title)\b.*?</(?:script|style|title)\s*>|<!--.*?-->', '', 'g'),
           '(?i)</?(?:p|div|li|ul|ol|nav|article|section|footer|header|main|h[1-6]|br|tr|td|th|table|body|head|html)\b[^>]*>', chr(10), 'g'),
           '<[^>]*>', '', 'g') AS text
  FROM pages),
split AS (
  SELECT row_number() OVER () AS r, page_id, host,
         list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS own
  FROM pages_text),
seen AS (SELECT r, coalesce(host, '') AS site, unnest(list_distinct(own)) AS line FROM split),
sites AS (SELECT coalesce(host, '') AS site, count(*) AS held FROM split GROUP BY 1),
common AS (
  SELECT site, line FROM (SELECT site, line, count(*) AS n FROM seen GROUP BY site, line) JOIN sites USING (site)
  WHERE n >= 2 AND n > 0.2::DOUBLE * held),
lines AS (SELECT r, site, line, i FROM (
  SELECT r, coalesce(host, '') AS site, unnest(own) AS line, unnest(range(1, len(own) + 1)) AS i FROM split)),
kept AS (
  SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body
  FROM lines ANTI JOIN common USING (site, line) GROUP BY r)
SELECT page_id, host, len(own)::BIGINT AS n_lines, (len(own) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(body, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)
"""

# CRC-32 of the bytes of a text: the usual table, one entry for each byte value.
_CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n::BIGINT, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(n)))"""


def _crc32(text: str) -> str:
    """Needs ``crc_table`` in the FROM clause."""
    data = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(t[(xor(c, b) & 255)::INT + 1], c >> 8)))"


SQL["op12_spelling"] = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
hashed AS (SELECT run, n, {_crc32("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h
  FROM (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL), crc_table),
words AS (SELECT word, sum(n)::BIGINT AS n FROM
  (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
shorter AS (SELECT DISTINCT c.word AS longer, w.word FROM cut c JOIN words w ON w.word = c.a || c.b),
near AS (SELECT x.word, y.word AS other FROM cut x JOIN cut y ON y.a || '*' || y.b = x.a || '*' || x.b AND y.word <> x.word
  UNION SELECT longer, word FROM shorter UNION SELECT word, longer FROM shorter),
ranked AS (SELECT e.word, e.other, o.n AS other_n, row_number() OVER (PARTITION BY e.word ORDER BY o.n DESC, e.other) AS place,
  count(*) OVER (PARTITION BY e.word) AS n_near FROM near e JOIN words o ON o.word = e.other),
forms AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 10 * w.n THEN r.other END AS form,
  CASE WHEN r.other_n >= 10 * w.n THEN r.other_n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
walk AS (SELECT word, word AS here, 0 AS step FROM forms
  UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN forms f ON f.word = w.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, (SELECT arg_max(here, step) FROM walk w WHERE w.word = f.word) AS root, f.n, f.n_near, f.form_n FROM forms f
"""


def _ways() -> str:
    """VALUES of every way to take a row: state, initials, what is written before the row, own initial it needs, its new role, next state, cost.

    States: 0 nothing, 1 s, 2 u, 3 a.  After u comes an assistant, after all else a user.
    """
    follow, role = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}
    rows = []
    for start in range(4):
        at, before = start, ""
        for inserted in range(4):
            rows.append((start, "I" * inserted + "D", before, "", "", at, 2 * inserted + 3))
            rows.append((start, "I" * inserted + "R", before, "", role[follow[at]], follow[at], 2 * inserted + 2))
            rows.append((start, "I" * inserted + "K", before, "ua"[follow[at] - 2], "", follow[at], 2 * inserted))
            if at == 0:
                rows.append((start, "K", "", "s", "", 1, 0))
            at = follow[at]
            before += role[at] + ":\n"
    return ", ".join(str(r) for r in rows).replace("\\n", "' || chr(10) || '")


#: Insertions that end a conversation, by the state it is in.
_CLOSING = "(0, '', '', 0), (1, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 4), (2, 'I', 'assistant:' || chr(10), 2), (3, '', '', 0)"

SQL["op11_turn_repair"] = f"""
WITH RECURSIVE {_CRC_TABLE},
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fault FROM conversations, crc_table),
hurt AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
  CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy FROM keyed WHERE fault <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS place FROM hurt),
judged AS (SELECT *, coalesce(conv_id::VARCHAR, '-') AS conv, left(role, 1) AS own,
  CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) AS pair FROM placed),
ways(state, edits, before, needs, becomes, upto, cost) AS (VALUES {_ways()}),
best AS (
  SELECT conv, 0::BIGINT AS place, 0 AS state, {{'cost': 0::BIGINT, 'audit': '', 'text': ''}} AS b FROM (SELECT DISTINCT conv FROM judged)
  UNION ALL
  SELECT j.conv, j.place, w.upto, min({{'cost': p.b.cost + w.cost + CASE WHEN j.fault = 'truncated' AND right(w.edits, 1) <> 'D' THEN 1 ELSE 0 END,
    'audit': p.b.audit || w.edits, 'text': p.b.text || w.before || CASE right(w.edits, 1) WHEN 'D' THEN '' WHEN 'K' THEN j.role || ':' || j.text || chr(10)
      ELSE w.becomes || ':' || j.text || chr(10) END}})
  FROM best p JOIN judged j ON j.conv = p.conv AND j.place = p.place + 1 JOIN ways w ON w.state = p.state
  WHERE right(w.edits, 1) = 'D' OR (j.fault NOT IN ('blank', 'duplicate') AND (right(w.edits, 1) = 'R' OR w.needs = j.own))
  GROUP BY j.conv, j.place, w.upto),
ended AS (SELECT conv, min({{'cost': b.cost + c.cost, 'audit': b.audit || c.edits, 'text': b.text || c.lines}}) AS b
  FROM best JOIN (SELECT conv, max(place) AS place FROM judged GROUP BY conv) USING (conv, place)
  JOIN (VALUES {_CLOSING}) c(state, edits, lines, cost) USING (state) GROUP BY conv),
counted AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv)
SELECT DISTINCT c.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0)::BIGINT AS blank, coalesce(n.duplicate, 0)::BIGINT AS duplicate,
  coalesce(n.truncated, 0)::BIGINT AS truncated, coalesce(n.illegal, 0)::BIGINT AS illegal, coalesce(e.b.cost, 0)::BIGINT AS cost, coalesce(e.b.audit, '') AS audit,
  sha256(coalesce(CASE WHEN e.b.text = '' THEN '' ELSE left(e.b.text, length(e.b.text) - 1) END, '')) AS repaired_sha256
FROM conversations c LEFT JOIN ended e ON e.conv = coalesce(c.conv_id::VARCHAR, '-') LEFT JOIN counted n ON n.conv = coalesce(c.conv_id::VARCHAR, '-')
"""
