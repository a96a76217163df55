"""DuckDB SQL of operators, some with the crc32 of a text, which DuckDB lacks."""

from __future__ import annotations

from pagelake.llm import pii

#: The table of the reflected polynomial 0xEDB88320, made by its rule.
CRC_TABLE = """
crc_table AS (
  SELECT list(v ORDER BY i) AS crc_t FROM (
    SELECT i, list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i::BIGINT) AS v FROM range(256) r(i)))"""


def crc32(text: str) -> str:
    """crc32 of the UTF-8 bytes of an expression, beside ``crc_table``."""
    nibble = lambda at: f"(instr('0123456789ABCDEF', substr(hex(encode({text})), {at}, 1)) - 1)"
    octets = f"list_transform(range(1, 2 * strlen({text}), 2), lambda k: 16 * {nibble('k')} + {nibble('k + 1')})"
    return f"xor(list_reduce({octets}, lambda c, o: xor(c >> 8, crc_t[(xor(c, o::BIGINT) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RESAMPLE = rf"""
WITH {CRC_TABLE.strip()},
words AS (
  SELECT kind, id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)),
counts AS (SELECT kind, id, w, count(*) AS n FROM words GROUP BY kind, id, w),
buckets AS (SELECT w, {crc32('w')} % 10000 AS bucket FROM (SELECT DISTINCT w FROM counts), crc_table),
per AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t FROM counts JOIN buckets USING (w) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM per),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) AS gain FROM per, totals),
weights AS (
  SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight
  FROM counts JOIN buckets USING (w) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM documents LEFT JOIN weights ON doc_id = id),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * able // 100 THEN rank END::BIGINT AS rank
FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id
"""

SPELLING = rf"""
WITH RECURSIVE {CRC_TABLE.strip()},
runs AS (
  SELECT doc_id, r, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents)
  WHERE length(r) >= 6 GROUP BY doc_id, r),
hashed AS (SELECT r, n, {crc32("doc_id::VARCHAR || ':' || r")} AS h FROM runs, crc_table),
blurred AS (SELECT n, CASE WHEN h % 199 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM blurred WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM cut SEMI JOIN words w ON cut.rest = w.word
  UNION SELECT rest, word FROM cut SEMI JOIN words w ON cut.rest = w.word),
best AS (
  SELECT word, near, near_n, n_near FROM (
    SELECT p.word, near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
           row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, encode(near)) AS k
    FROM pairs p JOIN words w ON p.near = w.word) WHERE k = 1),
judged AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
path(word, last, k) AS (
  SELECT word, word, 0 FROM judged
  UNION ALL SELECT p.word, j.form, k + 1 FROM path p JOIN judged j ON p.last = j.word WHERE j.form IS NOT NULL),
ends AS (SELECT word, arg_max(last, k) AS root FROM path GROUP BY word)
SELECT j.word, form, root, n, n_near, form_n FROM judged j JOIN ends e ON j.word = e.word
"""


def _pii_sql() -> str:
    """The spans in DuckDB SQL: patterns as first written, places by running sums over rows."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    } | pii.ADDED_PATTERNS
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS kind, '{name}' AS name, regexp_extract_all(text, '{patterns[name]}') AS f, string_split_regex(text, '{patterns[name]}') AS g FROM texts" for k, name in enumerate(pii.KINDS)
    )
    lengths = ", ".join(f"('{c}', {n})" for c, n in pii.IBAN_LENGTHS.items())
    near = " ".join(f"WHEN '{k}' THEN regexp_matches(around, '(^|[^a-z])({w})([^a-z]|$)')" for k, w in pii.CONTEXT.items())
    beside = " ".join(f"WHEN '{k}' THEN NOT regexp_matches(right(before, 1), '{c}') AND NOT regexp_matches(left(after, 1), '{c}')" for k, c in pii.BESIDE.items())
    scores = " ".join(f"WHEN '{k}' THEN {n}" for k, n in pii.SCORES.items())
    luhn = "list_sum(list_transform(string_split(reverse(digits), ''), lambda d, i: CASE WHEN i % 2 = 1 THEN d::INTEGER WHEN d::INTEGER > 4 THEN 2 * d::INTEGER - 9 ELSE 2 * d::INTEGER END)) % 10 = 0"
    line = "string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lengths(country, size) AS (VALUES {lengths}),
lists AS ({found}),
matches AS (
  SELECT doc_id, kind, name, value, gap, next_gap, i,
         (sum(length(gap) + length(value)) OVER (PARTITION BY doc_id, kind ORDER BY i) - length(value))::BIGINT AS start
  FROM (SELECT doc_id, kind, name, unnest(f) AS value, unnest(g[1:len(f)]) AS gap, unnest(g[2:]) AS next_gap, generate_subscripts(f, 1) AS i FROM lists WHERE len(f) > 0)),
cut AS (
  SELECT doc_id, kind, name, start, right(gap, {pii.BEFORE}) AS before, i > 1 AND gap = '' AS joined, left(next_gap, {pii.AFTER}) AS after, value,
         CASE WHEN name = 'iban' THEN coalesce(regexp_extract(value, '^([A-Z0-9] ?){{' || (size - 1) || '}}[A-Z0-9]'), '') ELSE value END AS v
  FROM matches LEFT JOIN lengths ON name = 'iban' AND country = value[1:2]),
spans AS (
  SELECT *, CASE WHEN name = 'iban' THEN left(value[length(v) + 1:] || after, {pii.AFTER}) ELSE after END AS after_v,
         regexp_replace(v, '[^0-9]', '', 'g') AS digits, replace(v[5:] || v[1:4], ' ', '') AS moved FROM cut),
judged AS (
  SELECT doc_id, kind, name, start, start + length(v) AS stop,
         CASE name
           WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(right(p, 3) AS INTEGER), 0) > 255)) = 0
           WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND {luhn}
           WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
           WHEN 'iban' THEN v <> '' AND list_reduce(string_split(regexp_replace(moved, '(.)', '\1', 'g'), ''), lambda a, c: CASE WHEN c >= 'A' THEN (a * 100 + ascii(c) - 55) % 97 ELSE (a * 10 + ascii(c) - 48) % 97 END, 0) = 1
           WHEN 'ssn' THEN NOT regexp_matches(v, '^(000|666|9)|-00-|-0000$')
           WHEN 'birth' THEN try_cast(CASE WHEN v[5:5] = '-' THEN v[6:7] ELSE v[4:5] END AS INTEGER) BETWEEN 1 AND 12 AND try_cast(CASE WHEN v[5:5] = '-' THEN v[9:10] ELSE v[1:2] END AS INTEGER) BETWEEN 1 AND 31
           ELSE TRUE END AS valid,
         kind < {len(pii.BASE)} AS base,
         NOT joined AND CASE name {beside.replace("after,", "after_v,")} ELSE TRUE END AS free,
         CASE name {scores} END + CASE WHEN CASE name {near} END THEN {pii.NEARBY} ELSE 0 END AS score
  FROM (SELECT *, translate(before || ' | ' || after_v, '{UPPER}', '{LOWER}') AS around FROM spans)),
good AS (
  SELECT * FROM judged j WHERE valid AND (base OR (free AND score >= {pii.LEAST} AND NOT EXISTS (
    SELECT 1 FROM judged b WHERE b.base AND b.valid AND b.doc_id = j.doc_id AND b.start < j.stop AND j.start < b.stop)))),
lines AS (SELECT doc_id, {line} AS spans, {line} FILTER (base) AS base_line, {", ".join(f"count_if(name = '{k}') AS n_{k}" for k in pii.BASE)} FROM good GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in pii.BASE)}, sha256(coalesce(base_line, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN lines l ON t.doc_id = l.doc_id
"""


PERSONAL = _pii_sql()


SUBSTRINGS = r"""
WITH words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
windows AS (SELECT doc_id, i, string_agg(word, ' ') OVER w AS g, count(*) OVER w AS n FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM windows WHERE n = 20) WHERE k > 1),
covered AS (SELECT DISTINCT doc_id, i + j AS i FROM repeats, range(20) r(j)),
marked AS (SELECT w.*, c.i IS NOT NULL AS gone FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id AND w.i = c.i),
per AS (SELECT doc_id, count(*) AS n_words, count_if(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN per p ON d.doc_id = p.doc_id
"""

NEAR = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
component AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN component c ON d.doc_id = c.doc_id
"""

_WRAP = "(({0})::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
JUMPS = rf"""
WITH RECURSIVE {CRC_TABLE.strip()},
octets AS (SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: 16 * (instr('0123456789ABCDEF', h[1]) - 1) + instr('0123456789ABCDEF', h[2]) - 1) AS o FROM documents),
rows AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
         xor(list_reduce(o, lambda c, x: xor(c >> 8, crc_t[(xor(c, x::BIGINT) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM octets, crc_table),
a AS (SELECT DISTINCT doc_id, doc_id::UBIGINT AS k FROM documents),
b AS (SELECT doc_id, {_WRAP.format("xor(k, k >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT")} AS k FROM a),
c AS (SELECT doc_id, {_WRAP.format("xor(k, k >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT")} AS k FROM b),
steps(doc_id, k, now, ahead) AS (
  SELECT doc_id, xor(k, k >> 31), -1::BIGINT, 0::BIGINT FROM c
  UNION ALL SELECT doc_id, j, ahead, floor((ahead + 1) * (2147483648::DOUBLE / ((j >> 33)::DOUBLE + 1)))::BIGINT
  FROM (SELECT doc_id, ahead, {_WRAP.format("k::UHUGEINT * 2862933555777941757::UHUGEINT + 1::UHUGEINT")} AS j FROM steps WHERE ahead < 9)),
shards AS (SELECT doc_id, max(now) FILTER (now < 8)::INTEGER AS shard, max(now) FILTER (now < 9)::INTEGER AS grown_shard FROM steps GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM rows JOIN shards USING (doc_id)
"""
