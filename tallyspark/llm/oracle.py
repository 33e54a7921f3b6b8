"""DuckDB twins of the numbered queries that SQL can express."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_topk_nra"] = """
WITH sound AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, vec_id, unnest(v) AS x, unnest(range(len(v))) AS d FROM sound),
scores AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.r AS c, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.d = c.d AND q.r <> c.r
  WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY rank <= 5
"""

ORACLE_SQL["op2_warc"] = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
  SELECT page_id, payload, array_to_string(list_transform(range(1, 41), lambda i:
    lpad(bin(CAST(strpos('0123456789abcdef', hex[i]) - 1 AS INTEGER)), 4, '0')), '') AS b FROM hashed),
coded AS (
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY payload) AS first_id,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST(list_sum(list_transform(range(5), lambda j: CAST(b[5 * i + j + 1] AS INTEGER) * CAST(2 ** (4 - j) AS INTEGER))) AS INTEGER),
      1)), '') AS payload_digest
  FROM bits)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM coded
"""

# Per rule: the matches, the text between them, and from both their places.
_RULES = {  # kind: pattern, measured group, least length
    "assign": (
        "((?i:password|passwd|secret|token|api_?key))[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]+", 0, 32),
    "github": ("gh[pousr]_[A-Za-z0-9]+", 0, 40),
    "slack": ("xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    "private_key": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "web_token": ("eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 1),
}
_FOUND = " UNION ALL ".join(
    f"""SELECT doc_id, {n} AS rule, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, p, g, {least} AS least FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g,
        string_split_regex(t, '{pattern}') AS p FROM docs)"""
    for n, (kind, (pattern, group, least)) in enumerate(_RULES.items())
)
ORACLE_SQL["op6_secret_scan"] = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_FOUND}),
placed AS (
  SELECT doc_id, rule, kind, len(m[i]) AS n,
    list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS start
  FROM found WHERE len(g[i]) >= least),
spans AS (SELECT doc_id, rule, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT) AS s FROM placed),
joined AS (
  SELECT doc_id, count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access, count(*) FILTER (rule = 2) AS n_hex,
    string_agg(s, ',' ORDER BY start, rule) FILTER (rule < 3) AS base, string_agg(s, ',' ORDER BY start, rule) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (doc_id)
"""

# Seats by brute force: as many quotients as there are seats for every source and shard, the highest win.
ORACLE_SQL["op7_mix_sources"] = """
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS ordinal FROM docs GROUP BY source),
weighed AS (SELECT *, (ordinal - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM sources),
filled AS (
  SELECT *, row_number() OVER w AS place, (sum(source_size) OVER () - sum(cap) OVER w + cap) / (sum(weight) OVER () - sum(weight) OVER w + weight) AS rate
  FROM weighed WINDOW w AS (ORDER BY cap / weight, ordinal)),
free AS (SELECT arg_min(rate, place) AS rate FROM filled WHERE rate * weight <= cap),
targets AS (SELECT source, source_size, ordinal, least(CAST(cap AS DOUBLE), rate * weight) AS target FROM weighed, free),
seats AS (SELECT CAST(round(sum(target)) AS BIGINT) AS seats FROM targets),
offers AS (SELECT ordinal, target / (2 * k + 1) AS quotient, k FROM targets, seats, range(seats) r(k) WHERE target > 0),
won AS (SELECT ordinal, count(*) AS due FROM (
  SELECT *, row_number() OVER (ORDER BY quotient DESC, ordinal, k) AS place FROM offers), seats WHERE place <= seats GROUP BY ordinal),
shared AS (
  SELECT t.*, coalesce(due, 0) AS due, greatest(1, CAST(ceil(source_size / 4000000.0) AS BIGINT)) AS shards
  FROM targets t LEFT JOIN won USING (ordinal)),
dealt AS (
  SELECT d.doc_id, size, s.*, md5('17:' || d.doc_id) AS draw,
    CAST(('0x' || substr(md5('17:' || d.doc_id), 1, 15)) AS BIGINT) % shards AS shard
  FROM docs d JOIN shared s ON d.source IS NOT DISTINCT FROM s.source),
words AS (SELECT ordinal, shard, CAST(sum(size) AS BIGINT) AS words, max(due) AS due FROM dealt GROUP BY ALL),
shard_offers AS (SELECT ordinal, shard, due, words / (2 * k + 1) AS quotient, k FROM words, range(due) r(k) WHERE words > 0),
shard_won AS (SELECT ordinal, shard, count(*) AS quota FROM (
  SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY quotient DESC, shard, k) AS place FROM shard_offers)
  WHERE place <= due GROUP BY ALL),
quotas AS (
  SELECT ordinal, shard, words, least(coalesce(quota, 0), words * 3) AS quota FROM words LEFT JOIN shard_won USING (ordinal, shard)),
passes AS (
  SELECT *, CASE WHEN words > 0 THEN quota // words ELSE 0 END AS passes, CASE WHEN words > 0 THEN quota % words ELSE 0 END AS rest FROM quotas),
blocks AS (
  SELECT ordinal, shard, block, least(64, words - block * 64) AS n, rest,
    sum(least(64, words - block * 64)) OVER (PARTITION BY ordinal, shard ORDER BY md5('17:' || ordinal || ':' || shard || ':' || block), block) AS seen
  FROM passes, range((words + 63) // 64) r(block) WHERE rest > 0),
drawn AS (SELECT ordinal, shard, block, block * 64 AS first, least(n, rest - seen + n) AS n FROM blocks WHERE rest - seen + n > 0),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY ordinal, shard ORDER BY draw, doc_id) - size AS pos FROM dealt),
extra AS (
  SELECT doc_id, sum(least(pos + size, first + n) - greatest(pos, first)) AS extra
  FROM placed JOIN drawn USING (ordinal, shard) WHERE least(pos + size, first + n) > greatest(pos, first) GROUP BY doc_id)
SELECT p.doc_id, size, source_size, target, CAST(passes * size + coalesce(extra, 0) AS BIGINT) AS taken
FROM placed p JOIN passes USING (ordinal, shard) LEFT JOIN extra USING (doc_id)
"""

ORACLE_SQL["op8_exact_dedup"] = """
WITH keyed AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
grouped AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM keyed GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM keyed JOIN grouped USING (text_sha256)
"""

# Sets as word joins, every pair of texts that shares a shingle, and the least document reached by links.
ORACLE_SQL["op9_near_dedup"] = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s
  FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT p.doc_id AS a, q.doc_id AS b, min(p.n) AS na, min(q.n) AS nb, count(*) AS met
  FROM shingles p JOIN shingles q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * met >= 80 * (na + nb - met)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reached r JOIN ends e ON r.other = e.a),
component AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM sets s JOIN component USING (doc_id)
"""


def _crc32(text: str) -> str:
    """CRC-32 of a short ASCII expression, bit by bit."""
    bits = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(range(1, len({text}) + 1), lambda i: CAST(ascii(substr({text}, CAST(i AS INTEGER), 1)) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: {bits}), 4294967295)"


def _then(state: str, cost: object, edit: str, line: str | None = None) -> str:
    """A state of the repair (cost, audit, lines) after one more edit; NULL if it was not reached."""
    lines = f"{state}.r || chr(10) || {line}" if line else f"{state}.r"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'r': {lines}}} END"


def _keep(state: str, initial: str) -> str:
    return f"CASE WHEN ini = '{initial}' AND NOT doomed THEN {_then(state, 'more', 'K', "role || ':' || text")} END"


def _rerole(state: str, role: str) -> str:
    return f"CASE WHEN NOT doomed THEN {_then(state, '1 + more', 'R', f"'{role}:' || text")} END"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


_STATE = "STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"
_INSERTED_U = _least("s2", *[_then(s, 5, "I", "'user:'") for s in ("s0", "s1", "s3")])
_INSERTED_A = _least("s3", _then("u", 5, "I", "'assistant:'"))

# Row by row: the best way, with its edits and lines, to each state of the role grammar (nothing yet, after s, u and a).
ORACLE_SQL["op11_conversation_repair"] = f"""
WITH RECURSIVE fated AS (
  SELECT coalesce('=' || conv_id, '-') AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS fate
  FROM conversations),
copies AS (
  SELECT k, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM fated WHERE fate <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS i, substr(role, 1, 1) AS ini,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM copies),
judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(ini) OVER (PARTITION BY k ORDER BY i) AS before FROM placed),
items AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS doomed, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM judged),
ways AS (
  SELECT k, CAST(0 AS BIGINT) AS i, CAST({{'c': 0, 'a': '', 'r': ''}} AS {_STATE}) AS s0, CAST(NULL AS {_STATE}) AS s1,
    CAST(NULL AS {_STATE}) AS s2, CAST(NULL AS {_STATE}) AS s3 FROM items GROUP BY k
  UNION ALL
  SELECT k, i, {_then("s0", 2, "D")}, {_least(_then("s1", 2, "D"), _keep("s0", "s"))},
    {_least(_then("u", 2, "D"), *[_keep(s, "u") for s in ("s0", "s1", "a")], *[_rerole(s, "user") for s in ("s0", "s1", "a")])},
    {_least(_then("a", 2, "D"), _keep("u", "a"), _rerole("u", "assistant"))}
  FROM (
    SELECT *, {_INSERTED_A} AS a FROM (
      SELECT t.*, s0, s1, s2, s3, {_INSERTED_U} AS u FROM ways w JOIN items t ON w.k = t.k AND t.i = w.i + 1))),
ended AS (
  SELECT k, {_least("s0", "a")} AS best FROM (
    SELECT *, {_INSERTED_A} AS a FROM (SELECT w.*, {_INSERTED_U} AS u FROM ways w QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1))),
counted AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM items GROUP BY k)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT k, max(conv_id) AS conv_id FROM fated GROUP BY k) LEFT JOIN counted USING (k) LEFT JOIN ended USING (k)
"""

# Every prefix of every conversation as one text; a node is a distinct one.
ORACLE_SQL["op13_prefix_trie"] = f"""
WITH named AS (
  SELECT conv_id AS c, turn, coalesce(text, '') AS t,
    substr(sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS tid
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, tid) - 1 AS pos FROM named),
convs AS (SELECT c, count(*) AS n, {_crc32("CAST(c AS VARCHAR)")} % 6 AS h, c - c % 100 AS base FROM placed GROUP BY c),
rebuilt AS (
  SELECT v.c, p.pos + 1 AS depth, tid, t FROM convs v JOIN placed p ON p.c = v.base AND p.pos < v.h
  UNION ALL
  SELECT p.c, least(v.h, coalesce(b.n, 0)) + p.pos - v.h + 1, tid, t
  FROM placed p JOIN convs v ON v.c = p.c LEFT JOIN convs b ON b.c = v.base WHERE p.pos >= v.h),
steps AS (
  SELECT c, depth, len(t) AS chars, string_agg(tid, ',') OVER (PARTITION BY c ORDER BY depth) AS path FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM convs),
prefixes AS (
  SELECT *, lag(path) OVER (PARTITION BY c ORDER BY depth) AS up, max(depth) OVER (PARTITION BY c) AS length FROM steps),
nodes AS (
  SELECT path, min(c) AS conv_id, min(depth) AS depth, min(up) AS up, count(*) AS n_convs, (count(*) - 1) * min(chars) AS own,
    sha256(coalesce(string_agg(CASE WHEN depth = length THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
  FROM prefixes GROUP BY path),
children AS (SELECT up AS path, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
totals AS (
  SELECT p.path, sum(n.own) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM nodes n LEFT JOIN children k ON k.path = n.path JOIN prefixes p ON p.c = n.conv_id AND p.depth <= n.depth GROUP BY p.path)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes u ON u.path = n.up LEFT JOIN children k ON k.path = n.path JOIN totals s ON s.path = n.path
"""
