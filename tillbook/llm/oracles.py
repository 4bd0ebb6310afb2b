"""DuckDB SQL for the queries that SQL can express whole, over the given
tables. Each states its result from the contract, not by the method."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit: a byte enters at every eighth step."""
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, len({text}) + 1),
      lambda i: [ascii(substr({text}, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))), 4294967295)"""


WARC = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
        MIN(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)"""

NEAR_DEDUP = """
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM texts),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY doc_id),
meets AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM meets JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT doc_id, CAST(coalesce(ANY_VALUE(n), 0) AS BIGINT) AS n_shingles, MIN(r) AS component_id, doc_id = MIN(r) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""

PERIODIC_RUNS = f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    {crc32_sql('doc_id::VARCHAR')} AS h
  FROM documents),
planted AS (
  SELECT doc_id, len(w) AS n, CASE WHEN h % 10 > 0 OR len(w) = 0 THEN w ELSE
    list_transform(range(0, len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) END]) END AS w
  FROM (SELECT *, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split)),
places AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM planted),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM places x JOIN places y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (
  SELECT doc_id, q, MIN(i) AS start, COUNT(*) + q AS length
  FROM (SELECT *, i - ROW_NUMBER() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island),
long AS (SELECT * FROM islands WHERE length >= GREATEST(6, 4 * q)),
runs AS (
  SELECT * FROM long l WHERE NOT EXISTS (FROM long s WHERE s.doc_id = l.doc_id AND s.q < l.q AND s.start <= l.start
    AND s.start + s.length >= l.start + l.length)),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM places ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id),
told AS (
  SELECT doc_id, COUNT(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed,
    FIRST({{'start': start, 'length': length, 'q': q}} ORDER BY length::DOUBLE / q DESC, start, q) AS best
  FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length,
  CAST(best.q AS BIGINT) AS period, CAST(1000 * best.length // best.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def repair_sql() -> str:
    """op12: damage, faults, and the cheapest edits by a fold over each
    conversation's rows. A value is its cost (eight digits) and its audit in one
    string, so the smaller string is the better value; NULL: not reached."""
    def add(v: str, cost, letter: str) -> str:
        return f"(lpad(CAST({v}[1:8]::BIGINT + {cost} AS VARCHAR), 8, '0') || {v}[9:] || '{letter}')"

    extra = "CASE WHEN r.fault = 't' THEN 1 ELSE 0 END"

    def keep(v: str, initial: str) -> str:
        return f"CASE WHEN r.fault IN ('.', 't') AND r.initial = '{initial}' THEN {add(v, extra, 'K')} END"

    def rename(v: str) -> str:
        return f"CASE WHEN r.fault IN ('.', 't') THEN {add(v, f'2 + {extra}', 'R')} END"

    st, sy, us, asst = "v.st", "v.sy", "v.us", "v.asst"
    new_st = add(st, 3, "D")
    new_sy = f"least({add(sy, 3, 'D')}, {keep(st, 's')})"
    new_us = f"least({add(us, 3, 'D')}, " + ", ".join([keep(x, "u") for x in (st, sy, asst)] + [rename(x) for x in (st, sy, asst)]) + ")"
    new_as = f"least({add(asst, 3, 'D')}, {keep(us, 'a')}, {rename(us)})"
    # inserted turns behind a row: at most a user and an assistant
    closed_us = f"least({new_us}, {add(f'({new_st})', 2, 'I')}, {add(f'({new_sy})', 2, 'I')}, {add(f'({new_as})', 2, 'I')})"
    closed_as = f"least({new_as}, {add(f'({closed_us})', 2, 'I')})"
    step = (f"{{'initial': '', 'fault': '', 'st': {new_st}, 'sy': {new_sy}, 'us': {closed_us}, 'asst': {closed_as}}}")
    none = "CAST(NULL AS VARCHAR)"
    crc = crc32_sql("k") + " % 20"
    return f"""
WITH coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} AS kind
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM coded WHERE kind <> 0),
judged AS (
  SELECT *, role[1:1] AS initial, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
      WHEN ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'd'
      WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault,
    ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i
  FROM damaged),
paired AS (SELECT *, LAG(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM judged),
told AS (
  SELECT conv_id, coalesce(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (fault = 'b') AS blank,
    COUNT(*) FILTER (fault = 'd') AS duplicate, COUNT(*) FILTER (fault = 't') AS truncated,
    COUNT(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list_reduce(list_concat([{{'initial': '', 'fault': '', 'st': '00000000', 'sy': {none}, 'us': '00000002I', 'asst': '00000004II'}}],
      list({{'initial': initial, 'fault': fault, 'st': {none}, 'sy': {none}, 'us': {none}, 'asst': {none}}} ORDER BY i)),
      lambda v, r: {step}) AS best
  FROM paired GROUP BY conv_id),
chosen AS (SELECT conv_id, least(best.st, best.asst)[9:] AS audit, least(best.st, best.asst)[1:8]::BIGINT AS cost FROM told),
letters AS (
  SELECT conv_id, e, pos, COUNT(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i,
    COUNT(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS k, COUNT(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id) % 2 AS odd
  FROM (SELECT conv_id, unnest(range(1, len(audit) + 1)) AS pos, unnest(string_split(audit, '')) AS e FROM chosen WHERE audit <> '')),
mended AS (
  SELECT l.conv_id, string_agg(CASE WHEN e = 'K' THEN j.role WHEN (k - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':'
      || CASE WHEN e = 'I' THEN '' ELSE j.text END, chr(10) ORDER BY pos) AS text
  FROM letters l LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.i WHERE e <> 'D' GROUP BY l.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(m.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN chosen h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLES = {"op3_warc": WARC, "op8_minhash_near_dedup": NEAR_DEDUP, "op12_conversation_repair": repair_sql(),
           "op13_periodic_runs": PERIODIC_RUNS}
