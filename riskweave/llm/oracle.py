"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

COMPONENTS = """
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(v, r) AS (SELECT id, id FROM ids UNION SELECT reach.v, edges.b FROM reach JOIN edges ON reach.r = edges.a),
roots AS (SELECT v, min(r) AS root FROM reach GROUP BY v),
counts AS (SELECT a AS v, count(*) AS n FROM edges GROUP BY a)"""

OP3 = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
grams AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
          WHERE 5 * shared >= 4 * (s.n + t.n - shared)),
ids AS (SELECT doc_id AS id FROM documents), {COMPONENTS}
SELECT doc_id, coalesce(n, 0) AS n_links, root AS class_id, doc_id = root AS kept
FROM documents JOIN roots ON roots.v = doc_id LEFT JOIN counts ON counts.v = doc_id"""

_PAIRS = " + ".join(f"(length(x) - length(replace(x, '{p}', ''))) // 2" for p in ("<|", "</", "<s", "|>", "[I", "[/"))
_GROWS = f"""length(x) - length(replace(x, '\\', '')) + {_PAIRS} + length(x) - length(regexp_replace(x, '<+', '<', 'g'))"""

OP5 = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
    SELECT *, lag(role) OVER o IS DISTINCT FROM role AS fresh,
           (SELECT length(x) + {_GROWS} FROM (SELECT text AS x)) AS text_chars,
           (SELECT length(x) + {_GROWS} FROM (SELECT role AS x)) AS role_chars
    FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       cast(sum(text_chars + CASE WHEN fresh THEN 12 + role_chars ELSE 7 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

_USABLE = """embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"""

OP6 = f"""
WITH v AS (
    SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(64 * cast(x AS DOUBLE))) AS x
    FROM embeddings WHERE {_USABLE}),
scores AS (
    SELECT q.i, q.vec_id AS query_id, c.vec_id, cast(list_dot_product(q.x, c.x) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.i <> c.i AND len(q.x) = len(c.x)),
ranked AS (
    SELECT *, cast(row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""

OP8 = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: cast(x AS DOUBLE)) AS x FROM embeddings
    WHERE label IS NOT NULL AND {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.x) = len(q.x)
    WHERE list_dot_product(p.x, q.x) / (sqrt(list_dot_product(p.x, p.x)) * sqrt(list_dot_product(q.x, q.x))) >= 0.98),
ids AS (SELECT vec_id AS id FROM embeddings), {COMPONENTS}
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, vec_id = root AS kept
FROM embeddings JOIN roots ON roots.v = vec_id LEFT JOIN counts ON counts.v = vec_id"""

OP11 = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
runs AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, cast(sum(len(w)) AS BIGINT) AS n FROM runs GROUP BY lang),
grams AS (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
    FROM runs, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
found AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
cuts AS (
    SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
    FROM found, (SELECT unnest([1, 2]) AS k) WHERE k < m),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r,
           cast(cast(1000000 AS HUGEINT) * c.a * c.a // (cast(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
    FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM found WHERE m = 3),
kept AS (
    SELECT * FROM best b WHERE NOT EXISTS (
        SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 50 * b.a)),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

OP12 = r"""
WITH d AS (
    SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(
        coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(translate(
        coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS MATERIALIZED (
    SELECT DISTINCT item_id, least(len(w), 10) AS m, unnest(list_transform(
        range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS phrase FROM b WHERE len(w) > 0),
places AS (
    SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
hits AS MATERIALIZED (
    SELECT k, i, p.m, item_id FROM places p JOIN win ON win.m = p.m AND win.phrase = array_to_string(w[i:i + p.m - 1], ' ')),
marked AS (SELECT k, count(DISTINCT place) AS n FROM (SELECT k, unnest(range(i, i + m)) AS place FROM hits) GROUP BY k),
named AS (SELECT k, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
          FROM (SELECT DISTINCT k, cast(item_id AS VARCHAR) AS name FROM hits WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(marked.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(marked.n, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (k) LEFT JOIN named USING (k)"""


def _moves(rounds: int) -> str:
    """The rounds of OP13: nearest entries, then their means."""
    out = ""
    for k in range(rounds):
        out += f"""
near{k} AS MATERIALIZED (
    SELECT k, p, arg_min(c.e, (list_sum(list_transform(list_zip(y, z), lambda q: (q[1] - q[2]) * (q[1] - q[2]))), c.e)) AS e
    FROM cut JOIN book{k} c USING (p) GROUP BY k, p),
sums{k} AS (
    SELECT p, e, i, sum(y[i]) AS s, count(*) AS n FROM near{k} JOIN cut USING (k, p), places GROUP BY p, e, i),
book{k + 1} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(m.z, b.z) AS z FROM book{k} b LEFT JOIN (
        SELECT p, e, list(cast((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS z FROM sums{k} GROUP BY p, e) m
    ON m.p = b.p AND m.e = b.e),"""
    return out


OP13 = f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS k, vec_id, label,
           list_transform(embedding, lambda x: cast(floor(cast(x AS DOUBLE) * 4096) AS BIGINT)) AS x FROM embeddings WHERE {_USABLE}),
shape AS MATERIALIZED (SELECT len(x) // 8 AS w FROM v WHERE k = 1),
places AS MATERIALIZED (SELECT unnest(range(1, w + 1)) AS i FROM shape),
cut AS MATERIALIZED (SELECT k, p, x[p * w + 1:(p + 1) * w] AS y FROM v, shape, (SELECT unnest(range(8)) AS p)),
book0 AS MATERIALIZED (SELECT p, k - 1 AS e, y AS z FROM cut WHERE k <= 16),{_moves(6)}
far AS MATERIALIZED (
    SELECT k, p, c.e, list_sum(list_transform(list_zip(y, z), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS d FROM cut JOIN book6 c USING (p)),
best AS (SELECT k, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM far GROUP BY k, p),
coded AS (SELECT k, string_agg(printf('%02x', e), '' ORDER BY p) AS code, cast(sum(d) AS BIGINT) AS error FROM best GROUP BY k),
digest AS (SELECT sha256(string_agg(array_to_string(z, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book6)
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v USING (k), digest"""

ORACLE = {"op12_decontamination": OP12, "op13_codes": OP13, "op11_phrases": OP11, "op3_jaccard": OP3, "op5_chat": OP5, "op6_topk": OP6, "op8_covertree": OP8}
