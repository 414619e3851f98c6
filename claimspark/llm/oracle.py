"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from claimspark.llm import centroids as K
from claimspark.llm import chat as C
from claimspark.llm import quality as Q
from claimspark.llm import resample as R
from claimspark.llm.sharding import LIMIT

WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({WORDS.format('text')}, []) AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {WORDS.format('text')} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS win
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
h AS (SELECT r, s, dw.k, item FROM dw JOIN iw USING (win)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""

SPACED = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"

FOLDED = SPACED.format("translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

OP3 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {FOLDED.format('text')} AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT r, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y USING (g) GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT r, r AS o FROM d UNION SELECT reach.r, l.b AS o FROM reach JOIN l ON reach.o = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (r)
JOIN (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.r = reach.o GROUP BY reach.r) m USING (r)
"""

STOPS = ", ".join(f"'{w}'" for w in Q.STOP_WORDS)
WHITE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
RULES = " AND ".join(
    [f"100 * {part} BETWEEN {low} * {whole} AND {high} * {whole}" for part, whole, low, high in Q.RATIOS]
    + [f"{name} >= {low}" for name, low in Q.MINIMA])

OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {SPACED.format('text')} AS w FROM documents),
g AS (SELECT r, s, w[s:s + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) >= 3)),
q AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([s, s + 1, s + 2]) AS p
  FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1) GROUP BY r),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: trim(x, {WHITE}) <> '') AS lines,
  regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g') AS solid FROM d),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(solid) AS BIGINT) AS word_chars,
  CAST(length(solid) - length(regexp_replace(solid, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...')) AS BIGINT) AS n_ellipsis_lines,
  CAST(len(list_filter(lines, lambda x: ltrim(x, ' ') LIKE '- %')) AS BIGINT) AS n_bullet_lines,
  CAST(len(list_filter(w, lambda x: lower(x) IN ({STOPS}))) AS BIGINT) AS n_stop_words
  FROM l LEFT JOIN q USING (r)),
b AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {RULES} AS kept FROM b
"""

OP5 = f"""
WITH b AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
  lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT)), 60, '0') AS bits FROM documents),
p AS (SELECT doc_id, n_bytes, d, substr(bits, 1, d) AS prefix FROM b, (SELECT unnest(range(0, 61)) AS d)),
t AS (SELECT prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY prefix)
SELECT doc_id, n_bytes, CAST(d AS INTEGER) AS depth, prefix AS shard, shard_bytes, shard_docs
FROM p JOIN t USING (prefix) WHERE shard_bytes <= {LIMIT} OR shard_docs = 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d) = 1
"""

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {SPACED.format('text')} AS w FROM documents),
x AS (SELECT r, s, array_to_string(w[s:s + 34], ' ') AS win
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
g AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(s, s + 35)) AS p
  FROM x SEMI JOIN (SELECT win FROM x GROUP BY win HAVING count(*) > 1) USING (win))),
n AS (SELECT r, list(p) AS gone FROM g GROUP BY r),
k AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n_kept
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN g USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

SQUARED = "list_sum(list_transform(list_zip(v, mid), lambda p: CAST(p[1] - p[2] AS HUGEINT) * (p[1] - p[2])))"


def _clustering() -> str:
    """Rounds of nearest centroids and floored means, written out one after another."""
    finite = "lambda x: x IS NOT NULL AND isfinite(x)"
    parts = [f"""
v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {K.SCALE}) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {K.DIMS} AND len(list_filter(embedding, {finite})) = {K.DIMS})""", f"""
c0 AS (SELECT row_number() OVER (ORDER BY key, v) - 1 AS c, v AS mid
  FROM (SELECT sha256('{K.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS key, v FROM v) ORDER BY key, v LIMIT {K.CENTROIDS})"""]
    for k in range(K.ROUNDS + 1):
        parts.append(f"""
a{k} AS (SELECT r, vec_id, v, c, d FROM (SELECT r, vec_id, v, c, {SQUARED} AS d FROM v, c{k})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if k < K.ROUNDS:
            parts.append(f"""
c{k + 1} AS (SELECT c, coalesce(m.mid, c{k}.mid) AS mid FROM c{k} LEFT JOIN (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS mid FROM (
    SELECT c, i, sum(CAST(v[i] AS HUGEINT)) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, {K.DIMS + 1})) AS i FROM a{k}) GROUP BY c, i)
  GROUP BY c) m USING (c))""")
    return f"""WITH {','.join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(mid, ',')) AS centroid_sha256
FROM a{K.ROUNDS} JOIN c{K.ROUNDS} USING (c)
"""


CONTROL = r"([<\[])(\\*)(/?s>|</?SYS>>|</?ROLE>>|/?INST\])"
ESCAPED = f"regexp_replace({{}}, '{CONTROL}', '\\1\\\\\\2\\3', 'g')"
MARKED = " ".join(f"WHEN '{name}' THEN {len(a) + len(b)}" for name, (a, b) in C.MARKS.items())
OTHER_MARKS = len(C.ROLE_OPEN) + len(C.ROLE_MIDDLE) + len(C.ROLE_CLOSE)

OP12 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS own(turn, role)),
f AS (SELECT *, CASE role {MARKED} ELSE {OTHER_MARKS} + length({ESCAPED.format('role')}) END + length({ESCAPED.format('text')}) AS size FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{C.TRAINED}'), '') AS loss,
  CAST(sum(size) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

CRC_TABLE = ", ".join(map(str, R.crc_table().tolist()))
BYTES = "list_transform(range(strlen(w)), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT))"
CRC = f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {BYTES}),
  lambda a, b: xor(a >> 8, CAST([{CRC_TABLE}][(xor(a, b) & 255) + 1] AS BIGINT))), 4294967295)"""
GAIN = f"floor(1000 * ln((CAST(t AS DOUBLE) + 1) * CAST(ss + {R.BUCKETS} AS DOUBLE) / ((CAST(s AS DOUBLE) + 1) * CAST(tt + {R.BUCKETS} AS DOUBLE))))"

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({WORDS.format('text')}, []) AS w FROM documents),
dw AS (SELECT r, unnest(w) AS w FROM d),
bw AS (SELECT unnest({WORDS.format('text')}) AS w FROM benchmark),
h AS (SELECT w, {CRC} % {R.BUCKETS} AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
dn AS (SELECT b, count(*) AS s FROM dw JOIN h USING (w) GROUP BY b),
bn AS (SELECT b, count(*) AS t FROM bw JOIN h USING (w) GROUP BY b),
n AS (SELECT (SELECT count(*) FROM dw) AS ss, (SELECT count(*) FROM bw) AS tt),
g AS (SELECT b, {GAIN} AS g FROM (SELECT b, coalesce(dn.s, 0) AS s, coalesce(bn.t, 0) AS t
  FROM (SELECT DISTINCT b FROM h) LEFT JOIN dn USING (b) LEFT JOIN bn USING (b)), n),
f AS (SELECT r, CAST(count(*) AS BIGINT) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight
  FROM dw JOIN h USING (w) JOIN g USING (b) GROUP BY r),
x AS (SELECT r, CAST('0x' || substr(sha256('{R.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h FROM d),
o AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score, len(w) >= {R.MIN_WORDS} AS able
  FROM d JOIN x USING (r) LEFT JOIN f USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS k FROM o WHERE able)
SELECT doc_id, n_features, weight, score,
  CASE WHEN k <= {R.PERCENT} * (SELECT count(*) FROM k) // 100 THEN CAST(k AS BIGINT) END AS rank
FROM o LEFT JOIN k USING (r)
"""

ORACLE = {
    "op1_decontaminate": OP1,
    "op3_ngram_jaccard": OP3,
    "op4_quality_rules": OP4,
    "op5_extendible_sharding": OP5,
    "op7_substring_dedup": OP7,
    "op11_centroid_clustering": _clustering(),
    "op12_chat_tree": OP12,
    "op13_importance_resampling": OP13,
}
