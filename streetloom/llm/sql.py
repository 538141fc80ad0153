"""DuckDB SQL for the corpus queries that it can express, straight from their definitions; doc_id and vec_id are unique there."""

#: Words of a text: runs of bytes that aren't white space.
WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP4_COVER_TOPK = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs
QUALIFY rank <= 5
"""

#: Components of links (a, b), both ways, over nodes (node): each node's smallest reachable one.
COMPONENTS = """c(node, component) USING KEY (node) AS (
    SELECT node, node FROM nodes
    UNION
    SELECT l.b, min(c.component) FROM c JOIN links l ON l.a = c.node JOIN recurring.c r ON r.node = l.b WHERE c.component < r.component GROUP BY l.b)"""

OP6_NGRAM_JOIN = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
nodes AS (SELECT doc_id AS node FROM documents),
{COMPONENTS}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component AS component_id FROM documents LEFT JOIN size USING (doc_id) JOIN c ON node = doc_id
"""

OP7_LATTICE_NEARDUP = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.9),
nodes AS (SELECT vec_id AS node FROM embeddings),
{COMPONENTS}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component AS component_id, vec_id = component AS kept FROM embeddings JOIN c ON node = vec_id
"""

OP8_SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d)),
late AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
edges AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM late),
runs AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM runs GROUP BY ALL),
gaps AS (
    SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans
), kept AS (
    SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS k, sum(z - a) AS removed, count(*) AS n
    FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP9_WINDOW_DEDUP = f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM s) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM bad, range(13) t(j)),
kept AS (
    SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) FILTER (g.p IS NULL) AS k, count(g.p) AS removed
    FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def _drake() -> str:
    """Rounds of assignment and update by full scans, unrolled."""
    gap = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        """v AS MATERIALIZED (
    SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v FROM (SELECT v, sha256('1:' || vec_id) AS h FROM v ORDER BY h, v LIMIT 16))"""
    ]
    for r in range(4):
        parts.append(f"a{r} AS MATERIALIZED (SELECT v.i, v.vec_id, v.v, arg_min(c.j, ({gap}, c.j)) AS j, min({gap}) AS d FROM v CROSS JOIN c{r} c GROUP BY ALL)")
        if r < 3:
            parts.append(f"""m{r} AS (SELECT j, p, (s - (s % n + n) % n) // n AS x FROM (SELECT j, p, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range(64)) AS p FROM a{r}) GROUP BY j, p)
), c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT j, list(CAST(x AS BIGINT) ORDER BY p) AS v FROM m{r} GROUP BY j) m ON m.j = c.j)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a3 a JOIN c3 c ON c.j = a.j
"""


OP12_DRAKE_CLUSTERS = _drake()

#: crc holds the CRC-32 of decimal ids before its last inversion, bit by bit.
OP13_PREFIX_TRIE = r"""
WITH crc AS (
    SELECT c, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
        lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) AS r
    FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)
), heads AS (SELECT c, c - c % 20 AS base, xor(r, 4294967295) % 4 AS h FROM crc),
turns AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), unhex(sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))))) - 1 AS pos,
        {'r': coalesce(role, ''), 't': coalesce(text, '')} AS turn
    FROM conversations WHERE conv_id IS NOT NULL
), mixed AS (
    SELECT h.c, 0 AS own, t.pos, t.turn FROM heads h JOIN turns t ON t.c = h.base AND t.pos < h.h
    UNION ALL SELECT h.c, 1, t.pos, t.turn FROM heads h JOIN turns t ON t.c = h.c AND t.pos >= h.h
), convs AS (SELECT h.c, coalesce(list(m.turn ORDER BY m.own, m.pos) FILTER (m.c IS NOT NULL), []) AS s FROM heads h LEFT JOIN mixed m ON m.c = h.c GROUP BY h.c),
steps AS (SELECT c, d, s[1:d] AS p, len(s) = d AS last FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM convs)),
nodes AS (
    SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
    FROM steps GROUP BY d, p
), kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (
    SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.p[n.d].t, '[^\x20\x09-\x0D]+')) END AS saved
    FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.p = n.p
), below AS (SELECT a, p[1:a] AS q, saved, n_children FROM (SELECT p, saved, n_children, unnest(range(0, d + 1)) AS a FROM full_nodes)),
sums AS (SELECT a, q, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM below GROUP BY a, q)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s ON s.a = f.d AND s.q = f.p LEFT JOIN nodes up ON up.d = f.d - 1 AND up.p = f.p[1:f.d - 1]
"""
