"""DuckDB SQL for the queries that SQL can express over whole tables."""

OP1 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s
), t AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held_before,
    sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_after
  FROM r
), f AS (
  SELECT *, (3 * total - 4 * held_before) * w > 4 * source_size * w_after AS held FROM t
), l AS (
  SELECT (SELECT 3 * any_value(total) FROM f) - 4 * coalesce(sum(source_size) FILTER (held), 0) AS remaining, sum(w) FILTER (NOT held) AS weights FROM f
), g AS (
  SELECT source, source_size, CASE WHEN held THEN (2 * source_size)::DOUBLE ELSE (remaining * w)::DOUBLE / (2 * weights)::DOUBLE END AS target FROM f, l
), e AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0 END AS rate
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), c AS (
  SELECT *, (floor(rate) + CASE WHEN ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM e
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""

OP8 = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), g AS (
  SELECT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM g
), dg AS (
  SELECT k, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
), h AS (
  SELECT DISTINCT k, i, dg.n, item FROM dg JOIN g USING (n, gram)
), p AS (
  SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS q FROM h) GROUP BY k
), m AS (
  SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h) GROUP BY k
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p USING (k) LEFT JOIN m USING (k)
"""

OP2 = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT k, i, lines[i] AS line, ('0x' || substr(md5(lines[i]), 1, 8))::BIGINT % 2147483647 AS h, i = len(lines) AS last
  FROM (SELECT k, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)
), e AS (
  SELECT k, i, line, last OR ((h + coalesce(lag(h, 1) OVER w, 0) * 1000003 % 2147483647 + coalesce(lag(h, 2) OVER w, 0) * ((1000003::BIGINT * 1000003) % 2147483647) % 2147483647) % 2147483647) % 4 = 0 AS ends
  FROM l WINDOW w AS (PARTITION BY k ORDER BY i)
), n AS (
  SELECT k, i, line, coalesce(sum(ends::INT) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM e
), c AS (
  SELECT k, pos, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS chunk FROM n GROUP BY k, pos
), r AS (
  SELECT c.k, c.pos, c.lines, chunk, c.lines > 1 AND row_number() OVER (PARTITION BY chunk ORDER BY d.doc_id NULLS FIRST, md5(d.text), pos) > 1 AS gone FROM c JOIN d USING (k)
), s AS (
  SELECT k, sum(lines)::BIGINT AS n_lines, coalesce(sum(lines) FILTER (NOT gone), 0)::BIGINT AS n_kept, count(*) FILTER (gone) AS n_removed,
    md5(coalesce(string_agg(chunk, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_md5
  FROM r GROUP BY k
)
SELECT doc_id, n_lines, n_kept, n_removed::BIGINT AS n_removed, kept_md5 FROM s JOIN d USING (k)
UNION ALL SELECT doc_id, 0, 0, 0, NULL FROM documents WHERE text IS NULL
"""

OP4 = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    CASE WHEN strlen(coalesce(html, '')) >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS top
  FROM pages
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM p
"""

# XXH64, whose constants are fixed values; numbers of 64 bits are multiplied in 128
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
WORD, SEED = 1 << 64, 42


def number(v: int) -> str:
    return f"{v}::UHUGEINT"


def modulo(v: str) -> str:
    return f"(({v}) % {number(WORD)})"


def turned(v: str, bits: int) -> str:
    """A number of 64 bits, turned to the left."""
    return f"({modulo(f'({v}) * {number(1 << bits)}')} + ({v}) // {number(1 << 64 - bits)})"


def xored(a: str, b: str) -> str:
    return f"xor(({a})::UBIGINT, ({b})::UBIGINT)::UHUGEINT"


def mixed_in(acc: str, lane: str) -> str:
    return modulo(f"{turned(modulo(f'({acc}) + ({lane}) * {number(P2)}'), 31)} * {number(P1)}")


def little(begin: str, n: int) -> str:
    """n bytes from a place on (of the digits h), the last one first, as a number."""
    return "('0x' || " + " || ".join(f"substr(h, 2 * ({begin}) + {2 * k + 1}, 2)" for k in reversed(range(n))) + ")::UBIGINT::UHUGEINT"


def folded(first: str, rest: str, step: str) -> str:
    """``rest`` folded into a number, from ``first`` on; a: so far, x: the next."""
    return f"list_reduce(list_prepend({first}, {rest}), lambda a, x: {step})"


def stripe(k: int, first: int) -> str:
    return folded(number(first % WORD), f"list_transform(range(n // 32), lambda i: lanes[4 * i + {k + 1}])", mixed_in("a", "x"))


def merged_in(acc: str, v: str) -> str:
    return modulo(f"{xored(acc, mixed_in('0', v))} * {number(P1)} + {number(P4)}")


def shifted(v: str, bits: int, factor: int | None) -> str:
    both = xored(v, f"({v}) // {number(1 << bits)}")
    return modulo(f"{both} * {number(factor)}") if factor else both


OP7 = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), g AS (
  SELECT k, gram, count(*) AS many FROM (SELECT k, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS gram FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)) GROUP BY k, gram
), s0 AS MATERIALIZED (
  SELECT gram, hex(encode(gram)) AS h, strlen(gram)::BIGINT AS n FROM (SELECT DISTINCT gram FROM g)
), s1 AS MATERIALIZED (
  SELECT *, list_transform(range(n // 8), lambda i: {little("8 * i", 8)}) AS lanes FROM s0
), s2 AS MATERIALIZED (
  SELECT *, {stripe(0, SEED + P1 + P2)} AS v1, {stripe(1, SEED + P2)} AS v2, {stripe(2, SEED)} AS v3, {stripe(3, SEED - P1)} AS v4 FROM s1
), s3 AS MATERIALIZED (
  SELECT *, CASE WHEN n < 32 THEN {number(SEED + P5)} ELSE {modulo(f"{turned('v1', 1)} + {turned('v2', 7)} + {turned('v3', 12)} + {turned('v4', 18)}")} END AS acc FROM s2
), s4 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN n < 32 THEN acc ELSE {merged_in("acc", "v1")} END AS acc) FROM s3
), s5 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN n < 32 THEN acc ELSE {merged_in("acc", "v2")} END AS acc) FROM s4
), s6 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN n < 32 THEN acc ELSE {merged_in("acc", "v3")} END AS acc) FROM s5
), s7 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN n < 32 THEN acc ELSE {merged_in("acc", "v4")} END AS acc) FROM s6
), s8 AS MATERIALIZED (
  SELECT * REPLACE ({folded(modulo("acc + n::UHUGEINT"), "lanes[4 * (n // 32) + 1 : n // 8]", modulo(f"{turned(xored('a', mixed_in('0', 'x')), 27)} * {number(P1)} + {number(P4)}"))} AS acc) FROM s7
), s9 AS MATERIALIZED (
  SELECT * REPLACE (CASE WHEN n % 8 >= 4 THEN {modulo(f"{turned(xored('acc', modulo(f'{little("n // 8 * 8", 4)} * {number(P1)}')), 23)} * {number(P2)} + {number(P3)}")} ELSE acc END AS acc) FROM s8
), s10 AS MATERIALIZED (
  SELECT gram, {folded("acc", f"list_transform(range(n // 4 * 4, n), lambda i: {little('i', 1)})", modulo(f"{turned(xored('a', modulo(f'x * {number(P5)}')), 11)} * {number(P1)}"))} AS acc FROM s9
), s11 AS MATERIALIZED (SELECT gram, {shifted("acc", 33, P2)} AS acc FROM s10
), s12 AS MATERIALIZED (SELECT gram, {shifted("acc", 29, P3)} AS acc FROM s11
), s13 AS MATERIALIZED (SELECT gram, ({shifted("acc", 32, None)})::UBIGINT AS hash FROM s12
), b AS (
  SELECT k, bit, sum(many * ((hash >> bit) & 1::UBIGINT)::BIGINT) AS ones, sum(many) AS every FROM g JOIN s13 USING (gram), (SELECT unnest(range(64))::UBIGINT AS bit) GROUP BY k, bit
), f AS MATERIALIZED (
  SELECT d.k, doc_id, coalesce(fp, 0)::UBIGINT AS fp FROM d LEFT JOIN (SELECT k, bit_or(CASE WHEN 2 * ones > every THEN 1::UBIGINT << bit ELSE 0::UBIGINT END) AS fp FROM b GROUP BY k) USING (k)
), u AS MATERIALIZED (
  SELECT fp, min(doc_id) AS least FROM f GROUP BY fp
), l AS MATERIALIZED (
  SELECT a.fp AS a, c.fp AS c FROM u a JOIN u c ON bit_count(xor(a.fp, c.fp)) <= 4
), r AS (
  SELECT fp AS a, fp AS c FROM u UNION SELECT r.a, l.c FROM r JOIN l ON r.c = l.a
), m AS (
  SELECT r.a AS fp, min(least) AS component_id FROM r JOIN u ON r.c = u.fp GROUP BY r.a
)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM f JOIN m USING (fp)
"""

OP11 = r"""
WITH t AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), m AS (
  SELECT k, 0 AS kind, 8 AS least, 2 AS g, '(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([a-z0-9+/_.=-]+)' AS p, low AS s FROM t WHERE regexp_matches(low, '(password|passwd|secret|token|api_?key)["'']?\x20*[:=]')
  UNION ALL SELECT k, 1, 16, 0, 'AKIA[A-Z0-9]+', text FROM t WHERE contains(text, 'AKIA')
  UNION ALL SELECT k, 2, 32, 0, '[0-9a-f]+', text FROM t WHERE regexp_matches(text, '[0-9a-f]{32}')
  UNION ALL SELECT k, 3, 3, 2, '(user|username|user_?id|login|account|client_?id|access_?key_?id)["'']?\x20*[:=]\x20*["'']?([a-z0-9@+/_.=-]+)', low FROM t WHERE regexp_matches(low, '(user|login|account|client|access)')
  UNION ALL SELECT k, 4, 0, 0, '(https?|wss?|ftp|s3|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp|ldap)://[a-z0-9.:@/_?&=%+~#-]+', low FROM t WHERE contains(low, '://')
  UNION ALL SELECT k, 5, 20, 0, '[A-Za-z0-9+/_=-]+', text FROM t WHERE regexp_matches(text, '[A-Za-z0-9+/_=-]{20}')
), f AS (
  SELECT k, kind, least, regexp_extract_all(s, p) AS hits, regexp_extract_all(s, p, g) AS told, regexp_split_to_array(s, p) AS rest FROM m
), h AS (
  SELECT k, kind, least, unnest(range(1, len(hits) + 1)) AS i, hits, told, rest FROM f
), r AS (
  SELECT k, kind, (list_sum(list_transform(rest[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0))::BIGINT AS a, len(hits[i]) AS n, hits[i] AS hit
  FROM h WHERE len(told[i]) >= least
), w AS (
  SELECT k, kind, a, a + n AS b FROM r WHERE kind < 5 OR regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[0-9]')
), x AS (
  SELECT * FROM w WHERE kind <> 3 OR NOT EXISTS (SELECT 1 FROM w o WHERE o.k = w.k AND o.kind < 3 AND o.a < w.b AND w.a < o.b)
), y AS (
  SELECT * FROM x WHERE kind < 5 OR NOT EXISTS (SELECT 1 FROM x o WHERE o.k = x.k AND o.kind < 5 AND o.a < x.b AND x.a < o.b)
), z AS (
  SELECT y.*, len(regexp_extract_all(t.text[1:y.a], '\n[ \t\r]*\n')) AS scope FROM y JOIN t ON y.k = t.k
), c AS (
  SELECT z.k, z.kind, z.a, z.b,
    z.kind < 3 OR
    (z.kind = 4 OR z.kind = 3 OR EXISTS (SELECT 1 FROM z o WHERE o.k = z.k AND o.scope = z.scope AND o.kind IN (1, 3) AND o.a - z.b <= 200 AND z.a - o.b <= 200)) AND
    (z.kind = 5 OR EXISTS (SELECT 1 FROM z o WHERE o.k = z.k AND o.scope = z.scope AND o.kind IN (0, 2, 5) AND o.a - z.b <= 200 AND z.a - o.b <= 200)) AND
    (z.kind <> 4 OR EXISTS (SELECT 1 FROM z o WHERE o.k = z.k AND o.scope = z.scope AND o.kind IN (1, 3) AND o.a - z.b <= 200 AND z.a - o.b <= 200)) AS told
  FROM z
), l AS (
  SELECT k, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(s, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY a, kind) AS spans
  FROM (SELECT *, ['assign', 'access', 'hex', 'login', 'host', 'key'][kind + 1] || ':' || a || ':' || b AS s FROM c WHERE told) GROUP BY k
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN l ON t.k = l.k
"""

OP12 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, source,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head,
    text, replace(text, chr(10), '') AS bare
  FROM documents
), crc_table AS (
  SELECT n::BIGINT AS n, n::BIGINT AS c, 0 AS s FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, s + 1 FROM crc_table WHERE s < 8
), crc AS (
  SELECT k, doc_id::VARCHAR AS id, 1 AS j, 4294967295::BIGINT AS c FROM d WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT crc.k, id, j + 1, xor(crc.c >> 8, t.c) FROM crc JOIN crc_table t ON t.s = 8 AND t.n = xor(crc.c & 255, ord(id[j])) WHERE j <= len(id)
), tampered AS (
  SELECT k FROM crc WHERE j = len(id) + 1 AND xor(c, 4294967295) % 2 = 0
), leaves AS (
  SELECT d.k, doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    CASE WHEN t.k IS NULL THEN NULL ELSE sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(bare) || ':' || bare END) END AS changed
  FROM d LEFT JOIN tampered t ON d.k = t.k
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, k) - 1 AS i FROM leaves
), nodes AS (
  SELECT source, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM placed
  UNION ALL
  SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, level, i // 3
), subroots AS (
  SELECT source, level AS height, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, rank AS i, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, i // 3
), top AS (
  SELECT h AS root, level AS top_height FROM tops WHERE n = 1
), every AS (
  SELECT source, level, i, h, n FROM nodes UNION ALL
  SELECT s.source, s.height + t.level, t.i, t.h, t.n FROM tops t, subroots s WHERE t.n > 1
), ways AS (
  SELECT p.k, p.leaf, coalesce(p.changed, p.leaf) AS h, p.source, p.i, s.rank, s.height, s.subroot, 0 AS level, '' AS siblings FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT w.k, any_value(w.leaf), sha256(string_agg(CASE WHEN e.i = w.place THEN w.h ELSE e.h END, '' ORDER BY e.i)), any_value(w.source), any_value(w.i), any_value(w.rank), any_value(w.height), any_value(w.subroot), any_value(w.level) + 1,
    any_value(w.siblings) || coalesce(string_agg(e.h, '' ORDER BY e.i) FILTER (e.i <> w.place), '')
  FROM (SELECT *, CASE WHEN level < height THEN i // (3 ** level)::BIGINT ELSE rank // (3 ** (level - height))::BIGINT END AS place FROM ways, top WHERE level < height + top_height) w
  JOIN (SELECT * FROM every WHERE n > 1) e ON w.source IS NOT DISTINCT FROM e.source AND w.level = e.level AND w.place // 3 = e.i // 3
  GROUP BY w.k
)
SELECT doc_id, w.leaf, subroot, root, sha256(siblings) AS proof_sha256, h AS folded_root, h = root AS verified
FROM ways w JOIN top ON w.level = height + top_height JOIN d ON d.k = w.k
"""

OP13 = r"""
WITH t AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT k, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(w) < 200,
    100 * len(list_distinct(w)) < 50 * len(w),
    100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * len(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(min(t.doc_id) OVER (PARTITION BY text) < t.doc_id, false)] AS fails
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id
), v AS (
  SELECT unnest(range(1, 6)) AS x
), o AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM v a, v b, v c, v d, v e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT array_to_string(list_transform(o, lambda x: chr(64 + x::INT)), '') AS filter_order, unnest(range(1, 6))::INT AS step, o FROM o
), p AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), c AS (
  SELECT part, filter_order, step, o[step] AS x,
    coalesce(sum(n) FILTER (NOT list_bool_or(list_transform(o[1:step], lambda y: fails[y]))), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails[o[step]] AND NOT (step > 1 AND list_bool_or(list_transform(o[1:step - 1], lambda y: fails[y])))), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails[o[step]] AND step > 1 AND list_bool_or(list_transform(o[1:step - 1], lambda y: fails[y]))), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails[o[step]] AND len(list_filter(fails, lambda y: y)) = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails[o[step]] AND NOT (step > 1 AND list_bool_or(list_transform(o[1:step - 1], lambda y: fails[y])))), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (fails[o[step]] AND NOT (step > 1 AND list_bool_or(list_transform(o[1:step - 1], lambda y: fails[y])))), 0)::BIGINT AS toxic_lost
  FROM p, s GROUP BY part, filter_order, step, o
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM c
"""

ORACLE_SQL = {
    "op1_mix_sources": OP1,
    "op2_line_dedup": OP2,
    "op4_warc": OP4,
    "op7_simhash_near_dedup": OP7,
    "op8_decontaminate": OP8,
    "op11_secret_scan": OP11,
    "op12_merkle_manifest": OP12,
    "op13_filter_audit": OP13,
}
