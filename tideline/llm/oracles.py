"""SQL with the same results as the queries, for those that SQL can express."""

from __future__ import annotations

from tideline.llm.sharding import GROUP_SHARE, SALTS

#: The remainder table of the CRC-32 polynomial for half bytes (fixed values of the standard).
_CRC = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
#: crc32 of a text's UTF-8 bytes: two half bytes a byte, the lower one first.
_CRC32 = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(1, 2 * octet_length(encode(t))),
  lambda k: (instr('0123456789ABCDEF', substr(hex(encode(t)), CASE WHEN k % 2 = 1 THEN k + 1 ELSE k - 1 END, 1)) - 1)::BIGINT)),
  lambda a, b: xor(a >> 4, ({_CRC}::BIGINT[])[(xor(a, b) & 15) + 1])))"""

OP1 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, t, octet_length(encode(t))::BIGINT + 1 AS size, sha256(t) AS h, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SALTS} AS salt FROM d),
o AS (SELECT *, row_number() OVER w AS n, sum(size) OVER w - size AS first, sum(size) OVER () AS total, max(size) OVER () AS largest, sum(size) OVER (PARTITION BY h) AS gb
  FROM r WINDOW w AS (ORDER BY h, salt, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, min(first) OVER (PARTITION BY h) AS gf FROM o),
s AS (SELECT *, least(7, (CASE WHEN gb <= greatest(largest::DOUBLE, {GROUP_SHARE} * total / 8) THEN 2 * gf + gb ELSE 2 * first + size END) * 8 // (2 * total))::INTEGER AS shard FROM g)
SELECT doc_id, size, {_CRC32}::BIGINT AS text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY n) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s"""


def _fill(parents: str, children: str, keys: list[str], above: list[str]) -> str:
    """Parts of each parent's budget for its children, by rising capacity per weight."""
    cols, up = ", ".join(keys), ", ".join(above) or "1"
    on = " AND ".join(f"n.{k} = p.{k}" for k in above) or "TRUE"
    return f"""a AS (SELECT {", ".join("n." + k for k in keys)}, n.capacity, n.weight, p.budget FROM {children} n JOIN {parents} p ON {on}),
    b AS (SELECT *, coalesce(sum(capacity) OVER (PARTITION BY {up} ORDER BY capacity::DOUBLE / weight, {cols} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
      sum(weight) OVER (PARTITION BY {up} ORDER BY capacity::DOUBLE / weight, {cols} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM a),
    c AS (SELECT *, capacity * open <= (budget - filled) * weight AS is_full FROM b),
    d AS (SELECT *, max(CASE WHEN NOT is_full THEN budget - filled END) OVER (PARTITION BY {up}) AS share, max(CASE WHEN NOT is_full THEN open END) OVER (PARTITION BY {up}) AS sharers FROM c)
    SELECT {cols}, CASE WHEN is_full THEN capacity ELSE share * (sharers - open + weight) // sharers - share * (sharers - open) // sharers END AS budget FROM d"""


_H = "('0x' || substr(md5({}), 1, 8))::BIGINT"
OP7 = f"""WITH u AS (SELECT doc_id, 'domain' || {_H.format("coalesce(source, '')")} % 4 AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  sum(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)) AS tokens FROM documents GROUP BY ALL),
n3 AS (SELECT domain, lang, source, sum(tokens) AS leaf_tokens, 2 * sum(tokens) AS capacity, 1 + {_H.format("'weight|' || lang || '|' || source")} % 5 AS weight FROM u GROUP BY domain, lang, source),
n2 AS (SELECT domain, lang, sum(capacity) AS capacity, sum(weight) AS weight FROM n3 GROUP BY ALL),
n1 AS (SELECT domain, sum(capacity) AS capacity, sum(weight) AS weight FROM n2 GROUP BY ALL),
p0 AS (SELECT sum(capacity) // 2 * 750 // 1000 AS budget FROM n1),
p1 AS (WITH {_fill("p0", "n1", ["domain"], [])}),
p2 AS (WITH {_fill("p1", "n2", ["domain", "lang"], ["domain"])}),
p3 AS (WITH {_fill("p2", "n3", ["domain", "lang", "source"], ["domain", "lang"])}),
t AS (SELECT domain, lang, source, budget AS target, CASE WHEN leaf_tokens = 0 THEN 0 ELSE budget // leaf_tokens END AS whole, leaf_tokens FROM p3 JOIN n3 USING (domain, lang, source)),
r AS (SELECT *, target - whole * leaf_tokens AS left_over, {_H.format("'mix-1|' || whole::BIGINT || '|' || coalesce(doc_id::VARCHAR, '')")} AS place FROM u JOIN t USING (domain, lang, source)),
s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM r)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, target::BIGINT AS target, (whole + CASE WHEN 2 * ahead + tokens <= 2 * left_over AND left_over > 0 THEN 1 ELSE 0 END)::INTEGER AS copies
FROM s WHERE copies > 0"""


_D, _K, _ROUNDS = 64, 16, 3


def _assign(cents: str, name: str) -> str:
    """Nearest centroid of each vector, the smaller number on ties."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
    return f"""{name} AS MATERIALIZED (SELECT n, vec_id, x, m.d AS d, m.k AS k FROM (SELECT v.n, v.vec_id, any_value(v.x) AS x, min({{'d': {square}, 'k': c.k}}) AS m FROM v, {cents} c GROUP BY v.n, v.vec_id))"""


def _move(assigned: str, cents: str, name: str) -> str:
    low = "(s - ((s % n) + n) % n) // n"
    return f"""{name} AS MATERIALIZED (SELECT c.k, coalesce(g.x, c.x) AS x FROM {cents} c LEFT JOIN (SELECT k, list({low} ORDER BY i)::BIGINT[] AS x FROM
      (SELECT k, i, sum(y)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT k, unnest(x) AS y, unnest(range(1, 65)) AS i FROM {assigned}) GROUP BY k, i) GROUP BY k) g USING (k))"""


_STEPS = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {_D} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
          f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT {_K}))"]
for _r in range(_ROUNDS):
    _STEPS += [_assign(f"c{_r}", f"a{_r}"), _move(f"a{_r}", f"c{_r}", f"c{_r + 1}")]
_STEPS.append(_assign(f"c{_ROUNDS}", "a"))
OP11 = f"""WITH {", ".join(_STEPS)} SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a JOIN c{_ROUNDS} c USING (k)"""

#: Runs with their crc32 continued from the id; near words share the text without one character.
OP13 = f"""WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
l AS (SELECT id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM r),
d AS (SELECT id || w AS t, w, count(*) AS n FROM l WHERE length(w) >= 6 GROUP BY id, w),
h AS (SELECT w, n, {_CRC32}::BIGINT AS h FROM d),
o AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INTEGER) || substr(w, (h % length(w))::INTEGER + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM o GROUP BY word HAVING sum(n) >= 5 AND length(word) >= 6),
x AS MATERIALIZED (SELECT word, n, k, left(word, k::INTEGER) || substr(word, k::INTEGER + 2) AS e FROM (SELECT word, n, unnest(range(length(word))) AS k FROM v)),
p AS (SELECT a.word AS a, b.word AS b, b.n AS m FROM x a JOIN x b ON a.k = b.k AND a.e = b.e AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.e = v.word UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.e = v.word),
g AS (SELECT a AS word, count(*) AS near, min({{'m': -m, 'b': b}}) AS best FROM p GROUP BY a),
f AS MATERIALIZED (SELECT word, n, coalesce(near, 0)::BIGINT AS n_near, CASE WHEN -best.m >= 5 * n THEN best.b END AS form, CASE WHEN -best.m >= 5 * n THEN -best.m END AS form_n FROM v LEFT JOIN g USING (word)),
w AS (SELECT word, word AS here, 0 AS steps FROM f UNION ALL SELECT w.word, f.form, steps + 1 FROM w JOIN f ON w.here = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, t.root, n, n_near, form_n::BIGINT AS form_n FROM f JOIN (SELECT word, arg_max(here, steps) AS root FROM w GROUP BY word) t USING (word)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1, "op7_mixing_sources": OP7, "op11_centroid_clustering": OP11, "op13_spelling_variants": OP13}
