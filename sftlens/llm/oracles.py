"""DuckDB SQL for the registered queries that SQL can express."""
from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def components(nodes: str, links: str) -> str:
    """``node, component_id`` (smallest node reachable) from the CTEs ``nodes`` (node) and ``links`` (x, y)."""
    return f"""
edges AS (SELECT x, y FROM {links} UNION SELECT y, x FROM {links}),
reach(node, root) AS (SELECT node, node FROM {nodes} UNION SELECT edges.y, reach.root FROM reach JOIN edges ON edges.x = reach.node),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)"""


OP1 = """
WITH RECURSIVE v AS (SELECT vec_id AS node, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.node AS x, b.node AS y FROM v a JOIN v b ON a.node < b.node AND list_cosine_similarity(a.e, b.e) >= 0.9),""" + components("v", "links") + """
SELECT node AS vec_id, CAST((SELECT count(*) FROM edges WHERE edges.x = comp.node) AS BIGINT) AS n_links, component_id, node = component_id AS kept
FROM comp
"""

OP2 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents),
win AS (SELECT r, p, array_to_string(ws[p:p + 34], ' ') AS k FROM d, unnest(range(1, len(ws) - 33)) t(p) WHERE len(ws) >= 35),
twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i FROM (SELECT r, p FROM win JOIN twice USING (k)), unnest(range(p, p + 35)) t(i)),
word AS (SELECT r, i, ws[i] AS w FROM d, unnest(range(1, len(ws) + 1)) t(i)),
kept AS (SELECT word.r, count(gone.i) AS n_removed, string_agg(w, ' ' ORDER BY word.i) FILTER (WHERE gone.i IS NULL) AS text
         FROM word LEFT JOIN gone ON word.r = gone.r AND word.i = gone.i GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id AS node, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORDS}) AS ws FROM documents),
s AS (SELECT node, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 2), lambda p: array_to_string(ws[p:p + 3], ' ')) END) AS ss FROM d),
sh AS (SELECT node, len(ss) AS n, unnest(ss) AS g FROM s),
links AS (SELECT a.node AS x, b.node AS y FROM sh a JOIN sh b ON a.g = b.g AND a.node < b.node
          GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),""" + components("d", "links") + """
SELECT node AS doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, component_id FROM s JOIN comp USING (node)
"""

OP11 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents),
m AS (SELECT part, doc_id, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
             regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM d),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE EXISTS (FROM labels l WHERE l.doc_id = m.doc_id AND l.quality = 1)) AS good,
             count(*) FILTER (WHERE EXISTS (FROM labels l WHERE l.doc_id = m.doc_id AND l.toxic = 1)) AS toxic FROM m GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || letter FROM o, letters WHERE NOT contains(filter_order, letter)),
s AS (SELECT filter_order, CAST(step AS INT) AS step, ascii(filter_order[step]) - 64 AS f, list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) AS earlier
      FROM o, unnest(range(1, 6)) t(step) WHERE length(filter_order) = 5),
x AS (SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS hit, len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone,
             len(list_filter(fails, lambda b: b)) = 1 AS single FROM c, s),
r AS (SELECT part, filter_order, step, f, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT hit), 0) AS BIGINT) AS kept,
             CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND hit), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (WHERE gone AND hit), 0) AS BIGINT) AS redundant,
             CAST(coalesce(sum(n) FILTER (WHERE hit AND single), 0) AS BIGINT) AS unique_fails,
             CAST(coalesce(sum(good) FILTER (WHERE NOT gone AND hit), 0) AS BIGINT) AS good_lost,
             CAST(coalesce(sum(toxic) FILTER (WHERE NOT gone AND hit), 0) AS BIGINT) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2,
      CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
           WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:least(c1, c2)], '') AS a, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS b, array_to_string(u[greatest(c1, c2) + 1:], '') AS c FROM e)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

OP13 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, r) = 1 AS kept, text_sha256
FROM d
"""
