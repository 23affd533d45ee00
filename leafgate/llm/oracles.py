"""DuckDB SQL for those queries of the subpackage that SQL can express."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: One round: vectors to their nearest centroid, then the floor of each component's mean. No vector is compared with another.
_LLOYD = """a{old} AS MATERIALIZED (SELECT r, any_value(v) AS v, arg_min(k, (dist, k)) AS k
  FROM (SELECT r, v, k, CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS dist FROM (SELECT row_number() OVER () AS r, v FROM v), c{old}) GROUP BY r),
s{old} AS MATERIALIZED (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{old}) GROUP BY k, i),
m{old} AS MATERIALIZED (SELECT k, list((s - ((s % n + n) % n)) // n ORDER BY i) AS c FROM s{old} GROUP BY k),
c{new} AS MATERIALIZED (SELECT k, coalesce(m.c, o.c) AS c FROM c{old} AS o LEFT JOIN m{old} AS m USING (k)),
"""

#: CRC-32 of a text: its table of 256 entries by the rule, then a fold over the bytes. DuckDB has no function for it.
_CRC_TABLE = "tab AS MATERIALIZED (SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), list_transform(range(0, 8), lambda i: CAST(0 AS BIGINT))), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"

ORACLES = {
    "op12_sharding": """
WITH RECURSIVE """ + _CRC_TABLE + """, d AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, md5(coalesce(text, '')) AS h, coalesce(text, '') AS t FROM documents),
k AS (SELECT *, substr(h, 1, 4) AS atom, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || h) AS o FROM d),
a AS (SELECT atom, CAST(sum(size) AS BIGINT) AS bytes FROM k GROUP BY atom),
l AS (SELECT list({'a': atom, 'b': bytes} ORDER BY atom) AS xs, CAST(sum(bytes) AS BIGINT) AS total, CAST(max(bytes) AS BIGINT) AS big FROM a),
bis AS (
  SELECT xs, total, greatest((total + 39) // 40, big) AS lo, total AS hi, 0 AS i FROM l WHERE total IS NOT NULL
  UNION ALL
  SELECT xs, total, CASE WHEN used <= 40 THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN used <= 40 THEN (lo + hi) // 2 ELSE hi END, i + 1
  FROM (SELECT *, list_reduce(list_prepend({'used': CAST(1 AS BIGINT), 'fill': CAST(0 AS BIGINT)}, list_transform(xs, lambda x: {'used': CAST(0 AS BIGINT), 'fill': x.b})),
          lambda s, x: CASE WHEN s.fill + x.fill <= (lo + hi) // 2 THEN {'used': s.used, 'fill': s.fill + x.fill} ELSE {'used': s.used + 1, 'fill': x.fill} END).used AS used
        FROM bis WHERE lo < hi)),
cap AS (SELECT xs, total, hi AS c FROM bis WHERE lo = hi),
late AS (
  SELECT xs, total, c, len(xs) AS i, CAST(0 AS BIGINT) AS fill, total AS pos, CAST([] AS BIGINT[]) AS st FROM cap
  UNION ALL
  SELECT xs, total, c, i - 1, CASE WHEN fill + xs[i].b <= c THEN fill + xs[i].b ELSE xs[i].b END, pos - xs[i].b, CASE WHEN fill + xs[i].b <= c THEN st ELSE list_append(st, pos) END FROM late WHERE i > 0),
walk AS (
  SELECT xs, total, c, st, 0 AS i, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS start, total // 40 AS goal, CAST([] AS VARCHAR[]) AS cuts FROM late WHERE i = 0
  UNION ALL
  SELECT xs, total, c, st, i + 1, pos + x.b, CASE WHEN cut THEN pos ELSE start END, CASE WHEN cut THEN pos + (total - pos) // (39 - len(cuts)) ELSE goal END, CASE WHEN cut THEN list_append(cuts, x.a) ELSE cuts END
  FROM (SELECT *, len(cuts) < 39 AND pos > start AND (pos + x.b - start > c OR (2 * pos + x.b > 2 * goal AND pos >= coalesce(st[39 - len(cuts)], 0))) AS cut
        FROM (SELECT *, xs[i + 1] AS x FROM walk WHERE i < len(xs)))),
cuts AS (SELECT cuts FROM walk WHERE i = len(xs))
SELECT doc_id, CAST(size AS BIGINT) AS size, """ + _CRC + """ AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY o, doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM (SELECT *, len(list_filter(cuts, lambda x: x <= atom)) AS shard FROM k, cuts, tab)""",
    "op13_centroid_clusters": """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 16)),
""" + "".join(_LLOYD.format(old=i, new=i + 1) for i in range(3)) + """
n AS MATERIALIZED (SELECT vec_id, arg_min(k, (dist, k)) AS k, min(dist) AS distance FROM (SELECT r, vec_id, k, CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS dist FROM (SELECT row_number() OVER () AS r, vec_id, v FROM v), c3) GROUP BY r, vec_id)
SELECT vec_id, CAST(n.k AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY n.k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM n JOIN c3 USING (k)""",
    "op4_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, CAST(len(w) - size + 2 AS BIGINT))) AS p FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, dw.size, p, item_id FROM dw JOIN iw ON dw.size = iw.size AND dw.win = iw.win),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, CAST(p + size AS BIGINT))) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op10_mix_sources": """
WITH RECURSIVE d AS (SELECT doc_id, source, text, coalesce(source, '') AS src, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS r FROM documents),
c AS (SELECT src, count(*) AS n FROM d GROUP BY src),
s AS (SELECT src, n, row_number() OVER (ORDER BY src) AS i, greatest(1, CAST(floor(sqrt(n) * greatest(240, 8 * count(*) OVER ()) / sum(sqrt(n)) OVER () + 1e-9) AS BIGINT)) AS q FROM c),
p AS (SELECT list(q ORDER BY i) AS q, CAST(sum(q) AS BIGINT) AS total FROM s),
run AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(q, lambda x: CAST(0 AS BIGINT)) AS done, CAST(NULL AS BIGINT) AS pick, q, total FROM p
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, j: CASE WHEN j = best THEN x + 1 ELSE x END), best, q, total
  FROM (SELECT *, list_min(list_transform(list_filter(range(1, len(q) + 1), lambda i: done[i] < q[i] AND done[i] * total // q[i] <= t),
                  lambda i: ((done[i] * total + total + q[i] - 1) // q[i]) * 100000 + i)) % 100000 AS best FROM run WHERE t < total)),
slots AS (SELECT t - 1 AS slot, pick, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM run WHERE pick IS NOT NULL),
o AS (SELECT d.doc_id, d.source, d.r, d.r // 8 AS block, (d.r // 8) // s.q * total + slots.slot AS slot
      FROM d JOIN s USING (src) JOIN slots ON slots.pick = s.i AND slots.k = (d.r // 8) % s.q CROSS JOIN p)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(slot AS BIGINT) AS slot, row_number() OVER (ORDER BY slot, r) - 1 AS position FROM o""",
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
low AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, CAST(p + 13 AS BIGINT))) AS q FROM win JOIN low USING (s) WHERE m < doc_id),
g AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT coalesce(list_contains(qs, i), false)), lambda i: w[i]), ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)""",
}
