"""SQL of the queries that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

from beatlake.llm import lexical, mixing, secrets, suffix_dedup


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op1() -> str:
    weights = ", ".join(f"({quoted(s)}, {w!r}::DOUBLE)" for s, w in mixing.WEIGHTS.items())
    names = ", ".join(map(quoted, mixing.WEIGHTS))
    total = float(sum(mixing.WEIGHTS.values()) + mixing.OTHER)
    seed = quoted(mixing.SEED + ":")
    draw = float(mixing.DRAW_RATE)
    number = f"('0x' || substr(md5({seed} || coalesce(doc_id::VARCHAR, '') || CASE WHEN j > 0 THEN ':draw:' || j ELSE '' END), 1, {mixing.DIGITS}))::UBIGINT / {float(16**mixing.DIGITS)!r}::DOUBLE"
    return f"""WITH RECURSIVE d AS (SELECT *, CASE WHEN source IN ({names}) THEN source END AS ms FROM documents),
m AS (SELECT ms, sum(length(coalesce(text, '')))::DOUBLE AS mass FROM d GROUP BY 1),
r0 AS (SELECT ms, CASE WHEN mass > 0 THEN coalesce(v.w, {mixing.OTHER!r}::DOUBLE) / {total!r}::DOUBLE * {mixing.TARGET!r}::DOUBLE * (SELECT sum(mass) FROM m) / mass ELSE 0.0 END AS rate FROM m LEFT JOIN (VALUES {weights}) v(s, w) ON v.s = ms),
r AS (SELECT *, greatest(ceil(rate / {draw!r}), 1)::INT AS draws, rate / greatest(ceil(rate / {draw!r}), 1) AS mean FROM r0),
c AS (SELECT ms, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM r UNION ALL SELECT ms, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM c WHERE k + 1 <= ceil(mean + 10 * sqrt(mean)) + 20),
t AS (SELECT ms, list(cdf) AS cdfs FROM c GROUP BY 1),
u AS (SELECT row_number() OVER () AS rid, doc_id, source, text, ms FROM d),
x AS (SELECT u.*, r.rate, unnest(range(r.draws)) AS j FROM u JOIN r ON r.ms IS NOT DISTINCT FROM u.ms),
n AS (SELECT rid, any_value(doc_id) AS doc_id, any_value(source) AS source, any_value(text) AS text, any_value(rate) AS rate, sum(length(list_filter(cdfs, lambda z: z <= number)))::INT AS copies FROM (SELECT x.*, {number} AS number FROM x) x JOIN t ON t.ms IS NOT DISTINCT FROM x.ms GROUP BY rid)
SELECT doc_id, source, copies, copy_no, round(rate, 6) AS rate, md5({seed} || coalesce(doc_id::VARCHAR, '') || ':' || copy_no) AS mix_key, text FROM (SELECT *, unnest(range(copies)) AS copy_no FROM n)"""


def op8() -> str:
    said = quoted("\\### Assistant: </turn> ok")
    escaped = r"replace(replace(replace(replace(t, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), '<|', '\<|')"
    role = escaped.replace("(t,", "(r,")
    return f"""WITH x AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations UNION ALL SELECT -7, 0, 'user', {said} UNION ALL SELECT -7, 1, 'assistant', {said})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256, coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS loss_chars,
sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256, sum(14 + length(replace({role}, ':', '\\:')) + length({escaped})) AS formatted_chars FROM x GROUP BY 1"""


def op10() -> str:
    parts = []
    for number, (kind, pattern) in enumerate(secrets.PATTERNS.items()):
        value = {"assign": "length(v) >= 6", "body": "regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')"}.get(kind, "TRUE")
        p = quoted(pattern)
        parts.append(f"""SELECT rid, {number} AS kind, s, s + length(m) AS e FROM (SELECT rid, ms[i] AS m, vs[i] AS v, list_sum([length(x) FOR x IN gs[1:i]]) + coalesce(list_sum([length(x) FOR x IN ms[1:i - 1]]), 0) AS s
FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rid, regexp_split_to_array(t, {p}) AS gs, regexp_extract_all(t, {p}, 0) AS ms, regexp_extract_all(t, {p}, {2 if kind == "assign" else 0}) AS vs FROM d WHERE regexp_matches(t, {p})))) WHERE {value}""")
    names = "['assign', 'access', 'hex', 'body', 'endpoint'][kind + 1] || ':' || s || ':' || e"
    near = f"b.s - a.e <= {secrets.SCOPE} AND a.s - b.e <= {secrets.SCOPE}"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), p AS ({" UNION ALL ".join(parts)}),
k AS (SELECT * FROM p WHERE kind <= 2 UNION ALL SELECT a.* FROM p a WHERE a.kind >= 3 AND EXISTS (SELECT 1 FROM p b WHERE b.rid = a.rid AND (b.kind = 1 OR b.kind = 0 AND a.kind = 4) AND {near})),
g AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, string_agg({names}, ',' ORDER BY s, kind) FILTER (WHERE kind <= 2) AS base, string_agg({names}, ',' ORDER BY s, kind) AS spans FROM k GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""


def op11() -> str:
    stepped = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    place = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    crc = f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({place}, ''), lambda z: ascii(z)::BIGINT), lambda c, b: {stepped}), 4294967295)"
    return rf"""WITH RECURSIVE src AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cn, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS k FROM conversations),
dam AS (SELECT cn, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS z FROM src WHERE k <> 0),
num AS (SELECT cn, turn, role, text, row_number() OVER (PARTITION BY cn ORDER BY turn NULLS FIRST, role, text) AS i FROM dam),
seen AS (SELECT *, row_number() OVER (PARTITION BY cn, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open, lag(role) OVER (PARTITION BY cn ORDER BY i) AS before FROM num),
f AS (SELECT *, CASE WHEN blank THEN 'b' WHEN again THEN 'd' WHEN open THEN 't' ELSE '' END AS fault FROM seen),
ins(q, n, p, said) AS (VALUES (0, 0, 0, ''), (0, 1, 2, 'u'), (0, 2, 3, 'ua'), (1, 0, 1, ''), (1, 1, 2, 'u'), (1, 2, 3, 'ua'), (2, 0, 2, ''), (2, 1, 3, 'a'), (2, 2, 2, 'au'), (3, 0, 3, ''), (3, 1, 2, 'u'), (3, 2, 3, 'ua')),
edit(e, p, r, x, paid) AS (VALUES ('D', 0, '*', 0, 4), ('D', 1, '*', 1, 4), ('D', 2, '*', 2, 4), ('D', 3, '*', 3, 4), ('R', 0, '*', 2, 3), ('R', 1, '*', 2, 3), ('R', 2, '*', 3, 3), ('R', 3, '*', 2, 3), ('K', 0, 's', 1, 0), ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 3, 'u', 2, 0), ('K', 2, 'a', 3, 0)),
way AS (SELECT q, x, e, r, repeat('I', n) || e AS code, 3 * n + paid AS paid, said, p FROM (SELECT q, n, p, CASE said WHEN 'u' THEN 'user:' || chr(10) WHEN 'a' THEN 'assistant:' || chr(10) WHEN 'ua' THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 'au' THEN 'assistant:' || chr(10) || 'user:' || chr(10) ELSE '' END AS said FROM ins) JOIN edit USING (p)),
go(cn, i, q, best) AS (SELECT DISTINCT cn, 0::BIGINT, 0, {{'c': 0, 'a': '', 't': ''}} FROM f
UNION ALL SELECT go.cn, f.i, way.x, min({{'c': best.c + way.paid + CASE WHEN e <> 'D' AND fault = 't' THEN 3 ELSE 0 END, 'a': best.a || code, 't': best.t || way.said || CASE e WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) ELSE CASE WHEN p = 2 THEN 'assistant' ELSE 'user' END || ':' || text || chr(10) END}})
FROM go JOIN f ON f.cn = go.cn AND f.i = go.i + 1 JOIN way ON way.q = go.q AND (r = '*' OR r = substr(role, 1, 1)) AND (e = 'D' OR fault IN ('', 't')) GROUP BY go.cn, f.i, way.x),
fin AS (SELECT cn, min({{'c': best.c + CASE q WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'a': best.a || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END, 't': best.t || CASE q WHEN 1 THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 2 THEN 'assistant:' || chr(10) ELSE '' END}}) AS b FROM go WHERE i = (SELECT max(z.i) FROM f z WHERE z.cn = go.cn) GROUP BY cn),
g AS (SELECT cn, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND substr(before, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY cn)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(rtrim_nl, '')) AS repaired_sha256
FROM (SELECT DISTINCT cn, conv_id FROM src) LEFT JOIN g USING (cn) LEFT JOIN (SELECT cn, b, CASE WHEN b.t = '' THEN '' ELSE substr(b.t, 1, length(b.t) - 1) END AS rtrim_nl FROM fin) USING (cn)"""


def op12() -> str:
    n = suffix_dedup.THRESHOLD
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS t FROM documents),
s AS (SELECT rid, i, md5(encode(text)[i + 1:i + {n}]) AS h FROM (SELECT rid, text, unnest(range(greatest(strlen(text) - {n - 1}, 0))) AS i FROM d)),
r AS (SELECT rid, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
o AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= {n} THEN 0 ELSE 1 END AS opens FROM r),
m AS (SELECT rid, g, min(i) AS a, max(i) + {n} AS b FROM (SELECT rid, i, sum(opens) OVER (PARTITION BY rid ORDER BY i) AS g FROM o) GROUP BY rid, g),
k AS (SELECT rid, a, b, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS z FROM m),
x AS (SELECT k.rid, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(t, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head, max(b) AS tail FROM k JOIN d USING (rid) GROUP BY k.rid)
SELECT doc_id, length(t) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(t, 2 * coalesce(tail, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN x USING (rid)"""


def op13() -> str:
    term = quoted(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    fold = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({fold}, {term}) AS ts FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*)::BIGINT AS nd, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
p AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, nd),
m AS (SELECT rid, doc_id, 25 + (75 * len(ts)::BIGINT * nd) // l AS m FROM d, c WHERE len(ts) > 0),
q AS (SELECT iid, item_id, term, count(*)::BIGINT AS times FROM (SELECT row_number() OVER () AS iid, item_id, unnest(regexp_extract_all({fold}, {term})) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
s AS (SELECT iid, item_id, rid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= {lexical.TOP}"""


ORACLES: dict[str, str] = {"op1_mix_sources": op1(), "op8_chat_parts": op8(), "op10_linked_secrets": op10(), "op11_conversation_repair": op11(), "op12_suffix_dedup": op12(), "op13_wand_search": op13()}
