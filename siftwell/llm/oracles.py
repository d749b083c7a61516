"""SQL of the corpus queries that SQL can express, by brute force; for small tables."""

from __future__ import annotations

OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::varchar[] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY 1
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.d
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(r) AS component_id, min(r) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN reach ON d = doc_id GROUP BY doc_id, n
"""

OP3 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 1 + 10 * (k // 8), 10))::bigint >> (35 - 5 * (k % 8))) & 31) + 1)::int, 1), '' ORDER BY k) AS payload_digest
  FROM (SELECT DISTINCT h FROM p), range(32) r(k) GROUP BY h
), m AS (
  SELECT h, max(page_id) AS keeper FROM p GROUP BY h
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM p JOIN b USING (h) JOIN m USING (h)
"""

OP6 = """
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, c + i AS p, hash(substr(part, 2 * i + 1, 200)) AS h FROM (
    SELECT doc_id, c, part, unnest(range(least(1000, n - 99 - c))) AS i FROM (SELECT doc_id, n, c, substr(hx, 2 * c + 1, 2200) AS part FROM (SELECT doc_id, n, hx, unnest(range(0, n - 99, 1000)) AS c FROM t WHERE n >= 100)))
), f AS (
  SELECT h, min((doc_id, p)) AS first FROM w GROUP BY h HAVING count(*) > 1
), d AS (
  SELECT w.doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY w.doc_id ORDER BY p) + 100 THEN 1 ELSE 0 END AS new FROM w JOIN f USING (h) WHERE (w.doc_id, p) > first
), s AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM d) GROUP BY doc_id, k
), k AS (
  SELECT s.doc_id, string_agg(substr(hx, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) || substr(any_value(hx), 2 * max(z) + 1) AS rest, sum(z - a) AS gone, count(*) AS spans
  FROM (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b FROM s) s JOIN t USING (doc_id) GROUP BY s.doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::bigint AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(rest, hx))) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('mix:' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))) AS code FROM documents
), s AS (
  SELECT source, n, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::int] AS w, sum(n) OVER () AS total FROM (SELECT source, sum(size)::bigint AS n FROM d GROUP BY 1)
), o AS (
  SELECT *, row_number() OVER (ORDER BY n / w, w) AS k, coalesce(sum(3 * n) OVER (ORDER BY n / w, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, sum(w) OVER (ORDER BY n / w, w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM s
), l AS (
  SELECT k AS from_k, (total - used)::hugeint AS num, free::hugeint AS den FROM o WHERE w * (total - used) <= 3 * n * free ORDER BY k LIMIT 1
), t AS (
  SELECT source, n, CASE WHEN k < from_k THEN 3 * n ELSE w * num END AS a, CASE WHEN k < from_k THEN 1 ELSE den END AS b FROM o, l
), q AS (
  SELECT source, n, a::double / b::double AS target, (2 * a + b) // (2 * b) - CASE WHEN (2 * a) % (2 * b) = b AND ((2 * a + b) // (2 * b)) % 2 = 1 THEN 1 ELSE 0 END AS given FROM t
), c AS (
  SELECT d.*, n, target, CASE WHEN n > 0 THEN given // n ELSE 0 END AS whole, CASE WHEN n > 0 THEN given % n ELSE 0 END AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY code, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, n AS source_size, target, (size * (whole + CASE WHEN 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::bigint AS taken FROM c
"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    octets = f"list_transform(string_split({text}, ''), lambda c: ord(c)::bigint)"
    step = "list_reduce([xor(c, o), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {octets}), lambda c, o: {step}), 4294967295)"


OP13 = f"""
WITH t AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, n, {crc32("conv_id::varchar")} % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY 1)
), r AS (
  SELECT c.conv_id, p + 1 AS depth, turn_id, n_bytes FROM c JOIN t ON t.conv_id = base AND p < h
  UNION ALL SELECT c.conv_id, p - c.h + least(c.h, coalesce(b.n, 0)) + 1, turn_id, n_bytes FROM c JOIN t ON t.conv_id = c.conv_id AND p >= c.h LEFT JOIN c b ON b.conv_id = c.base
), k AS (
  SELECT conv_id, depth, n_bytes, sha256(string_agg(turn_id, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS id FROM r
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM c
), u AS (
  SELECT *, lag(id) OVER (PARTITION BY conv_id ORDER BY depth) AS above, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM k
), n AS (
  SELECT id, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(above) AS above, (count(*) - 1) * any_value(n_bytes) AS saved,
    sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::varchar END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM u GROUP BY id, depth
), f AS (
  SELECT above AS id, count(*) AS n_children FROM n WHERE above IS NOT NULL GROUP BY 1
), s AS (
  SELECT k.id, sum(CASE WHEN f.id IS NULL THEN 1 ELSE 0 END)::bigint AS n_leaves, sum(n.saved)::bigint AS saved_tokens FROM n JOIN k ON k.conv_id = n.conv_id AND k.depth <= n.depth LEFT JOIN f ON f.id = n.id GROUP BY 1
)
SELECT n.conv_id, n.depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::bigint AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN s ON s.id = n.id LEFT JOIN f ON f.id = n.id LEFT JOIN n o ON o.id = n.above
"""


def _add(item: str, cost: int | str, letter: str) -> str:
    """An item, six digits of cost and then the audit, after one more edit."""
    return f"(lpad((left({item}, 6)::int + {cost})::varchar, 6, '0') || substr({item}, 7) || '{letter}')"


#: Items of the states START, SYSTEM, USER and ASSISTANT, with all that may be inserted before the next row.
_USER = f"least(w.u, {_add('w.a', 2, 'I')}, {_add('w.s', 2, 'I')}, {_add('w.z', 2, 'I')})"
_SPOKEN = "least(w.z, w.s, w.a2)"
OP11 = rf"""
WITH RECURSIVE d AS (
  SELECT coalesce(conv_id::varchar, ' ') AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 AS k FROM conversations
), m AS (
  SELECT c, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE k <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS r FROM m
), f AS (
  SELECT *, lag(r) OVER (PARTITION BY c ORDER BY i) AS before, CASE
    WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' ELSE 'none' END AS fault FROM o
), walk AS (
  SELECT DISTINCT c, 0::bigint AS i, '000000' AS z, NULL::varchar AS s, NULL::varchar AS u, NULL::varchar AS a FROM m
  UNION ALL
  SELECT c, i,
    {_add('z', 3, 'D')} AS z,
    least({_add('s', 3, 'D')}, CASE WHEN keep AND r = 's' THEN {_add('z', 'cut', 'K')} END) AS s,
    least({_add('u2', 3, 'D')}, CASE WHEN keep AND r = 'u' THEN {_add('spoken', 'cut', 'K')} END, CASE WHEN keep THEN {_add('spoken', '2 + cut', 'R')} END) AS u,
    least({_add('a2', 3, 'D')}, CASE WHEN keep AND r = 'a' THEN {_add('u2', 'cut', 'K')} END, CASE WHEN keep THEN {_add('u2', '2 + cut', 'R')} END) AS a
  FROM (SELECT w.*, {_SPOKEN} AS spoken FROM (
    SELECT w.*, least(w.a, {_add('u2', 2, 'I')}) AS a2 FROM (
      SELECT f.c, f.i, f.r, fault IN ('none', 'truncated') AS keep, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS cut, w.z, w.s, w.a, {_USER} AS u2 FROM walk w JOIN f ON f.c = w.c AND f.i = w.i + 1) w) w) w
), g AS (
  SELECT c, z, a, {_USER} AS u2 FROM walk w JOIN (SELECT c, max(i) AS i FROM f GROUP BY 1) USING (c, i)
), b AS (
  SELECT c, left(best, 6)::bigint AS cost, substr(best, 7) AS audit FROM (SELECT c, least(z, a, {_add('u2', 2, 'I')}) AS best FROM g)
), e AS (
  SELECT c, p, e, CASE WHEN e <> 'I' THEN sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY p) END AS i FROM (SELECT c, substr(audit, p::int, 1) AS e, p FROM (SELECT c, audit, unnest(range(1, length(audit) + 1)) AS p FROM b))
), x AS (
  SELECT e.*, f.role, f.r, f.text, row_number() OVER (PARTITION BY e.c ORDER BY p) AS n, first_value(e = 'K' AND f.r = 's') OVER (PARTITION BY e.c ORDER BY p) AS system FROM e LEFT JOIN f ON f.c = e.c AND f.i = e.i WHERE e <> 'D'
), h AS (
  SELECT c, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (n - CASE WHEN coalesce(system, false) THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS repaired_sha256 FROM x GROUP BY 1
), n AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1
)
SELECT conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal, coalesce(cost, 0)::bigint AS cost, coalesce(audit, '') AS audit,
  coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM d) LEFT JOIN n USING (c) LEFT JOIN b USING (c) LEFT JOIN h USING (c)
"""
