"""The queries that SQL can express, as DuckDB SQL over the same tables."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_BLANKS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2 = f"""
WITH sized AS (
  SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS draw
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS words,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weights
  FROM sources
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
clamps AS (SELECT *, words * weight > cap * weights AS clamped FROM filled),
level AS (SELECT max(weights) AS weights, arg_max(words, weights) AS words FROM clamps WHERE NOT clamped),
targets AS (
  SELECT c.source, c.source_size,
         CASE WHEN clamped THEN cap::DOUBLE ELSE weight * level.words::DOUBLE / level.weights::DOUBLE END AS target
  FROM clamps c CROSS JOIN level),
needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
         target - whole * source_size AS need
  FROM targets),
running AS (
  SELECT s.*, n.source_size, n.target, n.whole, n.need,
         sum(size) OVER (PARTITION BY s.source ORDER BY draw) AS until
  FROM sized s JOIN needs n ON s.source IS NOT DISTINCT FROM n.source),
missing AS (
  SELECT source, max(need) - coalesce(max(until) FILTER (until <= need), 0) AS missing FROM running GROUP BY source),
extra AS (
  SELECT r.source, arg_min(draw, struct_pack(a := abs(missing - size), b := draw)) AS draw
  FROM running r JOIN missing m ON r.source IS NOT DISTINCT FROM m.source
  WHERE until > need AND abs(missing - size) < missing GROUP BY r.source)
SELECT r.doc_id, r.size, r.source_size, r.target,
       r.size * (whole + (until <= need OR r.draw = coalesce(e.draw, -1))::BIGINT) AS taken
FROM running r LEFT JOIN extra e ON r.source IS NOT DISTINCT FROM e.source
"""

OP4 = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS position FROM parts),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, c.last IS NOT NULL AND k.doc_id < c.last AS dropped FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP6 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS words FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [words]
         ELSE list_transform(range(1, len(words) - 3), lambda i: words[i:i + 4]) END) AS shingle
  FROM words),
sets AS (SELECT DISTINCT doc_id, array_to_string(shingle, ' ') AS shingle FROM shingles),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT common.a, common.b FROM common JOIN sizes x ON x.doc_id = common.a JOIN sizes y ON y.doc_id = common.b
  WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(r.other) AS component_id,
       d.doc_id = min(r.other) AS kept
FROM documents d JOIN reached r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id
"""

OP9 = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM payloads)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest,
       CASE WHEN strlen(payload) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(payload) >= 100 AND page_id <> first THEN first END AS refers_to
FROM firsts
"""

# unsigned crc32 of a list of byte values: the table of its 256 steps, and the fold over it
_CRC_TABLE = """
crc_table AS (SELECT list_transform(range(256), lambda c: list_reduce(list_prepend(c, range(8)),
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS steps)"""
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, {0}), "
        "lambda a, b: xor(a >> 8, steps[1 + (xor(a, b) & 255)])), 4294967295)")
_ASCII = "list_transform(string_split({}, ''), lambda c: ord(c)::BIGINT)"
_LATIN = ("flatten(list_transform(string_split({}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] "
          "ELSE [192 + (ord(c) >> 6)::BIGINT, 128 + (ord(c) & 63)::BIGINT] END))")

OP11 = f"""
WITH RECURSIVE {_CRC_TABLE.strip()},
runs AS (
  SELECT doc_id, {_LOWER.format("run")} AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
summed AS (
  SELECT runs.*, {_CRC.format(_LATIN.format("coalesce(doc_id::VARCHAR, '') || ':' || run"))} AS h FROM runs, crc_table),
edited AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END
         AS word, n FROM summed),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (
  SELECT word, place, substr(word, 1, place - 1) || substr(word, place + 1) AS cut
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS place FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.place = b.place AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.cut = w.word
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.cut = w.word),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(near.other, struct_pack(a := -o.n, b := near.other)) AS form
  FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN f.n >= 2 * w.n THEN f.word END AS form,
         CASE WHEN f.n >= 2 * w.n THEN f.n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word LEFT JOIN words f ON f.word = b.form),
chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.root WHERE e.form IS NULL
"""

OP12 = f"""
WITH {_CRC_TABLE.strip()},
split AS (
  SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words,
         CASE WHEN doc_id IS NULL THEN 1 ELSE {_CRC.format(_ASCII.format("doc_id::VARCHAR"))} END AS h
  FROM documents, crc_table),
places AS (
  SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM split),
planted AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM places),
texts AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN words ELSE
         list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS words
  FROM planted),
words AS (SELECT doc_id, n, unnest(words) AS word, unnest(range(n)) AS place FROM texts),
same AS (
  SELECT x.doc_id, x.place, y.place - x.place AS period FROM words x JOIN words y
  ON x.doc_id = y.doc_id AND x.word = y.word AND y.place > x.place AND y.place - x.place <= x.n // 4),
stretches AS (
  SELECT doc_id, period, min(place) AS start, count(*) + period AS length
  FROM (SELECT *, place - row_number() OVER (PARTITION BY doc_id, period ORDER BY place) AS stretch FROM same)
  GROUP BY doc_id, period, stretch),
runs AS (
  SELECT doc_id, start, length, min(period) AS period FROM stretches
  WHERE length >= greatest(6, 4 * period) GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS place FROM runs),
kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.place) AS text
  FROM words w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.place = w.place GROUP BY w.doc_id),
found AS (
  SELECT doc_id, count(*) AS n_runs,
         arg_max(struct_pack(start, length, period), struct_pack(a := length, b := -start, c := -period)) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs
  FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
       1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN found USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

# for pages whose article is an element of that name, with headings and paragraphs as its only blocks
OP13 = r"""
WITH articles AS (
  SELECT page_id, url, coalesce(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '') AS article FROM pages),
blocks AS (
  SELECT page_id, url, list_transform(string_split_regex(article, '</?(p|h1)>'), lambda b:
         trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(b, '<br>', ' '), '<b>', ''),
         '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks
  FROM articles),
texts AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda b: b <> ''), chr(10) || chr(10)) AS text FROM blocks)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
"""
